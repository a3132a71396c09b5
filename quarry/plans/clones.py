r"""Clone queries on ``documents`` (project = source, file = doc_id).

Line model: a duplication is a trimmed non-empty line repeated in a project.
Token model: k-grams (k = 20) of ASCII tokens and the maximal clones made of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import clones as C
from quarry.operators import maximal as M
from quarry.plans.registry import register
from quarry.sources.tables import table

K = 20  # fixed value: the clone detector's minimum clone length in tokens

LINES_SQL = r"""
l AS (SELECT source, doc_id,
             regexp_replace(unnest(string_split(text, chr(10))), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS code
      FROM documents),
d AS (SELECT source, code, CAST(COUNT(*) AS BIGINT) AS n_occurrences, CAST(COUNT(DISTINCT doc_id) AS BIGINT) AS n_docs,
             CAST(len(regexp_extract_all(lower(code), '[a-z0-9]+')) AS INTEGER) AS tokens
      FROM l WHERE code <> '' GROUP BY source, code HAVING COUNT(*) >= 2),
pp AS (SELECT l.source, l.code, l.doc_id, COUNT(*) AS k FROM l JOIN d ON l.source = d.source AND l.code = d.code
       GROUP BY l.source, l.code, l.doc_id),
same AS (SELECT * FROM d WHERE EXISTS (SELECT 1 FROM pp WHERE pp.source = d.source AND pp.code = d.code AND pp.k > 1)),
across AS (SELECT * FROM d WHERE EXISTS (SELECT 1 FROM pp WHERE pp.source = d.source AND pp.code = d.code AND pp.k <= 1))"""


def _line_model(spark: SparkSession, sf: str) -> DataFrame:
    return C.line_duplications(table(spark, sf, "documents"), "source", "doc_id", "text")


@register("q_clone_occurrences", "WITH " + LINES_SQL + """
SELECT source AS project, code, tokens, n_occurrences, n_docs FROM d""")
def q_clone_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    """Duplications of the line model with their occurrence and file counts (CLN2)."""
    return _line_model(spark, sf).select("project", "code", "tokens", "n_occurrences", "n_docs")


@register("q_same_file_hist", "WITH " + LINES_SQL + """
SELECT tokens, CAST(COUNT(*) AS BIGINT) AS dup_count FROM same GROUP BY tokens ORDER BY tokens""")
def q_same_file_hist(spark: SparkSession, sf: str) -> DataFrame:
    """Same-file duplications (some path holds more than one occurrence) by size."""
    return C.clone_histogram(_line_model(spark, sf).filter("same_file"), "tokens")


@register("q_across_file_hist", "WITH " + LINES_SQL + """
SELECT tokens, CAST(COUNT(*) AS BIGINT) AS dup_count FROM across GROUP BY tokens ORDER BY tokens""")
def q_across_file_hist(spark: SparkSession, sf: str) -> DataFrame:
    """Across-file duplications (some path holds at most one occurrence) by size."""
    return C.clone_histogram(_line_model(spark, sf).filter("across_file"), "tokens")


@register("q_clone_projects", "WITH " + LINES_SQL + """,
t AS (SELECT COUNT(DISTINCT source) AS n FROM documents),
c AS (SELECT 'same_file' AS kind, COUNT(DISTINCT source) AS n_projects FROM same
      UNION ALL SELECT 'across_file', COUNT(DISTINCT source) FROM across)
SELECT kind, CAST(c.n_projects AS BIGINT) AS n_projects, CAST(t.n AS BIGINT) AS n_total,
       round(100.0 * c.n_projects / t.n, 2) AS pct FROM c, t""")
def q_clone_projects(spark: SparkSession, sf: str) -> DataFrame:
    """Projects with same-file / across-file clones, and their share of all projects (CLN6)."""
    docs = table(spark, sf, "documents")
    # one row per project (true where it has a clone of the kind) serves both kinds
    flagged = C.line_duplications(docs, "source", "doc_id", "text").groupBy("project").agg(
        F.bool_or("same_file").alias("same_file"), F.bool_or("across_file").alias("across_file"))
    same = flagged.filter("same_file").select(F.lit("same_file").alias("kind"), "project")
    across = flagged.filter("across_file").select(F.lit("across_file").alias("kind"), "project")
    every = docs.select(F.lit("all").alias("kind"), F.col("source").alias("project"))
    per_kind = same.unionByName(across).unionByName(every).groupBy("kind").agg(
        C.projects_with(same).alias("n_projects"))
    # the 'all' row's count reaches the other rows through a window over these few rows
    total = F.max(F.when(F.col("kind") == "all", F.col("n_projects"))).over(Window.partitionBy())
    return per_kind.withColumn("n_total", total).filter(F.col("kind") != "all").select(
        "kind", "n_projects", "n_total",
        F.round(F.lit(100.0) * F.col("n_projects") / F.col("n_total"), 2).alias("pct"))


KGRAM_SQL = rf"""
ln AS (SELECT source, doc_id, unnest(string_split(lower(text), chr(10))) AS line,
              generate_subscripts(string_split(lower(text), chr(10)), 1) AS ln FROM documents),
tk AS (SELECT source, doc_id, ln, unnest(regexp_extract_all(line, '[a-z0-9]+')) AS tok,
              generate_subscripts(regexp_extract_all(line, '[a-z0-9]+'), 1) AS ti FROM ln),
tp AS (SELECT source, doc_id, ln, tok, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY ln, ti) - 1 AS pos FROM tk),
kg AS (SELECT source, doc_id, pos, ln AS first_line,
              string_agg(tok, ' ' ORDER BY pos) OVER w AS kgram, COUNT(*) OVER w AS cnt,
              max(ln) OVER w AS last_line
       FROM tp WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {K - 1} FOLLOWING)),
fk AS (SELECT * FROM kg WHERE cnt = {K}),
rep AS (SELECT source, kgram, COUNT(*) AS n_occ, COUNT(DISTINCT doc_id) AS n_docs
        FROM fk GROUP BY source, kgram HAVING COUNT(*) >= 2)"""


@register("q_token_clones", "WITH " + KGRAM_SQL + """
SELECT source AS project, kgram, CAST(n_occ AS BIGINT) AS n_occ, CAST(n_docs AS BIGINT) AS n_docs FROM rep""")
def q_token_clones(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated 20-token k-grams per project: text, occurrences, documents (CLN1)."""
    tc = C.token_clones(table(spark, sf, "documents"), "source", "doc_id", "text", k=K)
    return tc.select("project", "kgram", "n_occ", "n_docs")


# Longest matches of all pairs of occurrences (no chaining): their texts are the maximal fragments, whose occurrences
# are then looked up by text.
FRAGMENTS_SQL = KGRAM_SQL + f""",
near AS (SELECT DISTINCT doc_id, kgram FROM (
  SELECT doc_id, kgram, pos - lag(pos) OVER (PARTITION BY doc_id, kgram ORDER BY pos) AS gap FROM fk) x WHERE gap < {K}),
spots AS MATERIALIZED (SELECT fk.doc_id, fk.kgram, list(fk.pos ORDER BY fk.pos) AS p FROM fk JOIN near USING (doc_id, kgram) GROUP BY ALL),
spaced AS (
  SELECT doc_id, kgram, p[1] AS pos, p FROM spots
  UNION ALL SELECT doc_id, kgram, list_filter(p, lambda x: x >= pos + {K})[1], p FROM spaced
  WHERE len(list_filter(p, lambda x: x >= pos + {K})) > 0),
counted AS MATERIALIZED (
  SELECT fk.*, ROW_NUMBER() OVER (PARTITION BY fk.doc_id ORDER BY fk.pos) AS rn FROM fk
  WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.doc_id = fk.doc_id AND n.kgram = fk.kgram)
     OR EXISTS (SELECT 1 FROM spaced s WHERE s.doc_id = fk.doc_id AND s.kgram = fk.kgram AND s.pos = fk.pos)),
again AS (SELECT source, kgram FROM counted GROUP BY source, kgram HAVING COUNT(*) >= 2),
occ AS MATERIALIZED (SELECT c.source, c.doc_id, c.pos, c.rn, c.kgram FROM counted c JOIN again USING (source, kgram)),
pr AS (SELECT a.source, a.doc_id AS d1, a.pos AS p1, b.doc_id AS d2, b.pos - a.pos AS delta
       FROM occ a JOIN occ b ON a.source = b.source AND a.kgram = b.kgram
         AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.pos < b.pos))),
isl AS (SELECT *, p1 - ROW_NUMBER() OVER (PARTITION BY source, d1, d2, delta ORDER BY p1) AS island FROM pr),
mem AS (SELECT source, d1, min(p1) AS p1, COUNT(*) + {K - 1} AS tokens FROM isl GROUP BY source, d1, d2, delta, island),
tl AS MATERIALIZED (SELECT source, doc_id, string_agg(tok, ' ' ORDER BY pos) || ' ' AS toks FROM tp GROUP BY source, doc_id),
tok_at AS MATERIALIZED (SELECT source, doc_id, pos, ln, tok, coalesce(sum(length(tok) + 1) OVER (PARTITION BY doc_id ORDER BY pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM tp),
frag AS MATERIALIZED (SELECT m.source, m.tokens, array_slice(t.toks, CAST(a.c AS BIGINT) + 1, CAST(z.c AS BIGINT)) AS code, min(o.kgram) AS kgram
         FROM mem m JOIN tl t ON t.source = m.source AND t.doc_id = m.d1 JOIN tok_at a ON a.doc_id = m.d1 AND a.pos = m.p1
           JOIN (SELECT doc_id, pos + 1 AS stop, c + length(tok) + 1 AS c FROM tok_at) z
             ON z.doc_id = m.d1 AND z.stop = m.p1 + m.tokens
           JOIN occ o ON o.doc_id = m.d1 AND o.pos = m.p1 GROUP BY ALL),
fo AS MATERIALIZED (SELECT f.source, f.tokens, f.code, o.doc_id, o.pos, a.ln AS first_line, z.ln AS last_line
       FROM frag f JOIN occ o ON o.source = f.source AND o.kgram = f.kgram
         JOIN tl t ON t.source = o.source AND t.doc_id = o.doc_id JOIN tok_at a ON a.doc_id = o.doc_id AND a.pos = o.pos
         JOIN tok_at z ON z.doc_id = o.doc_id AND z.pos = o.pos + f.tokens - 1
         JOIN occ e ON e.doc_id = o.doc_id AND e.pos = o.pos + f.tokens - {K} AND e.rn - o.rn = f.tokens - {K}
       WHERE array_slice(t.toks, CAST(a.c AS BIGINT) + 1, CAST(a.c AS BIGINT) + length(f.code)) = f.code),
per_doc AS (SELECT source, code, doc_id, COUNT(*) AS k FROM fo GROUP BY source, code, doc_id),
kinds AS (SELECT source, code, max(k) > 1 AS same_file, min(k) <= 1 AS across_file FROM per_doc GROUP BY source, code),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source, code ORDER BY doc_id, pos) AS i,
                  COUNT(*) OVER (PARTITION BY source, code) AS n_occ FROM fo),
dup AS (SELECT r.source AS project, r.code, CAST(r.tokens AS BIGINT) AS tokens, CAST(r.n_occ AS BIGINT) AS n_occ,
               CAST(n.n_docs AS BIGINT) AS n_docs, r.doc_id AS doc, CAST(r.pos AS BIGINT) AS start,
               CAST(r.first_line AS BIGINT) AS first_line, CAST(r.last_line AS BIGINT) AS last_line,
               CAST(r.last_line - r.first_line + 1 AS BIGINT) AS lines, k.same_file, k.across_file
        FROM ranked r JOIN kinds k ON k.source = r.source AND k.code = r.code
          JOIN (SELECT source, code, COUNT(*) AS n_docs FROM per_doc GROUP BY source, code) n
            ON n.source = r.source AND n.code = r.code WHERE r.i = 1)"""


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    return M.clone_windows(table(spark, sf, "documents"), "source", "doc_id", "text", k=K)


def _maximal(spark: SparkSession, sf: str) -> DataFrame:
    found = M.maximal_clones(_windows(spark, sf), k=K)
    return found.select("project", *[F.col(c).cast("long").alias(c) for c in (
        "tokens", "n_occ", "n_docs", "doc", "start", "first_line", "last_line", "lines")], "same_file", "across_file")


@register("q_clone_runs", "WITH RECURSIVE " + FRAGMENTS_SQL + """
SELECT project, tokens, n_occ, n_docs, doc, start, first_line, last_line, lines FROM dup""")
def q_clone_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Maximal token clones, each once with its number of occurrences and its first one (CLN1, CLN2)."""
    return _maximal(spark, sf).drop("same_file", "across_file")


@register("q_clone_fragments", "WITH RECURSIVE " + FRAGMENTS_SQL + """
SELECT d.project, d.doc AS first_doc, d.start AS first_start, d.tokens, f.doc_id AS doc, CAST(f.pos AS BIGINT) AS start,
       CAST(f.first_line AS BIGINT) AS line
FROM fo f JOIN dup d ON d.project = f.source AND d.code = f.code""")
def q_clone_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """The clone report of the maximal clones: every occurrence of every duplication (CLN2)."""
    windows = _windows(spark, sf)
    found = M.clone_occurrences(windows, M.maximal_clones(windows, k=K))
    return found.select("project", *[F.col(c).cast("long").alias(c) for c in (
        "first_doc", "first_start", "tokens", "doc", "start", "line")])


HIST_SQL = """
SELECT kind, CAST({by} AS BIGINT) AS {alias}, CAST(COUNT(*) AS BIGINT) AS dup_count{more} FROM (
  SELECT 'same_file' AS kind, dup.* FROM dup WHERE same_file
  UNION ALL SELECT 'across_file' AS kind, dup.* FROM dup WHERE across_file) x GROUP BY kind, {by}"""


def _by_kind(clones: DataFrame) -> DataFrame:
    """A row per clone and kind it has."""
    return clones.select("tokens", "lines", F.explode(F.array_compact(F.array(
        F.when(F.col("same_file"), F.lit("same_file")), F.when(F.col("across_file"), F.lit("across_file"))))).alias("kind"))


@register("q_run_hist_tokens", "WITH RECURSIVE " + FRAGMENTS_SQL + HIST_SQL.format(by="tokens", alias="tokens", more=""))
def q_run_hist_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Maximal token clones: same-file / across-file histograms by tokens (CLN3-CLN5)."""
    return _by_kind(_maximal(spark, sf)).groupBy("kind", "tokens").agg(F.count(F.lit(1)).alias("dup_count"))


@register("q_run_hist_lines", "WITH RECURSIVE " + FRAGMENTS_SQL + HIST_SQL.format(by="lines", alias="lines", more=""))
def q_run_hist_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Maximal token clones: same-file / across-file histograms by lines (CLN3-CLN5)."""
    return _by_kind(_maximal(spark, sf)).groupBy("kind", "lines").agg(F.count(F.lit(1)).alias("dup_count"))


@register("q_dup_hist", "WITH RECURSIVE " + FRAGMENTS_SQL + HIST_SQL.format(by="tokens", alias="size", more=", 'tokens' AS measure")
          + " UNION ALL" + HIST_SQL.format(by="lines", alias="size", more=", 'lines' AS measure"))
def q_dup_hist(spark: SparkSession, sf: str) -> DataFrame:
    """Token clones as a clone report (one duplication per maximal fragment, all its
    occurrences): same-file / across-file histograms by tokens and by lines (CLN2-CLN5)."""
    by_measure = _by_kind(_maximal(spark, sf)).select("kind", F.inline(F.array(
        F.struct(F.lit("tokens").alias("measure"), F.col("tokens").alias("size")),
        F.struct(F.lit("lines").alias("measure"), F.col("lines").alias("size")))))
    return by_measure.groupBy("kind", "measure", "size").agg(F.count(F.lit(1)).alias("dup_count"))

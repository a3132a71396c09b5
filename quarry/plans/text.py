r"""Text, report-parsing and corpus-counter queries on documents, pages and events.

Fixture mapping: project = ``documents.source``, file = ``doc_id``; a line
count report is a document; a report message is a document text; a crawled
listing page is ``pages.html``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import messages as msg
from quarry.functions import paths as P
from quarry.functions import text as T
from quarry.operators import documents as D
from quarry.operators import relational as rel
from quarry.plans.registry import register
from quarry.sources import web
from quarry.sources.tables import table

JTRIM = r"regexp_replace({x}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
# Fixed parameters of the fixture mapping.
MARKER_PREFIX = "the"
MARKER_NEEDLE = " and "
HREF = r'href="(/[^"]*)"'


def ntz_epoch_seconds(ts):
    """Whole seconds since 1970-01-01 of a TIMESTAMP_NTZ, independent of the session zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def jtrim(x: str) -> str:
    return JTRIM.format(x=x)


# --------------------------------------------------------------------------- EXP1
@register("q_message_numbers", r"""
WITH m AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\t\n\x0B\f\r ]([0-9]+)', 1),
                                         lambda x: TRY_CAST(x AS BIGINT)) AS nums FROM documents)
SELECT doc_id, nums[1] AS value, CASE WHEN len(nums) >= 2 THEN nums[2] END AS max,
       CAST(len(nums) AS BIGINT) AS n_numbers
FROM m WHERE len(nums) > 0
""")
def q_message_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """First and second whitespace-preceded number of each text; no number -> no row."""
    docs = table(spark, sf, "documents")
    parsed = docs.select("doc_id", msg.value_and_max("text").alias("m")).filter(F.col("m").isNotNull())
    return parsed.select("doc_id", "m.value", "m.max", "m.n_numbers")


# --------------------------------------------------------------------------- EXP2
@register("q_keyvalue", r"""
WITH s AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'),
                                       lambda x: x <> '') AS items FROM pages),
u AS (SELECT page_id, unnest(items) AS item, generate_subscripts(items, 1) - 1 AS ord FROM s)
SELECT page_id, CAST(ord AS BIGINT) AS ord, trim(split_part(item, '=', 1)) AS key,
       CASE WHEN strpos(item, '=') > 0
            THEN nullif(trim(substr(item, strpos(item, '=') + 1)), '') END AS value
FROM u
""")
def q_keyvalue(spark: SparkSession, sf: str) -> DataFrame:
    """Query-string parameters of each URL as (page, ordinal, key, value)."""
    pages = table(spark, sf, "pages")
    kv = pages.select("page_id", F.posexplode(msg.key_value_pairs("url")).alias("ord", "kv"))
    return kv.select("page_id", F.col("ord").cast("long").alias("ord"), "kv.key", "kv.value")


# --------------------------------------------------------------------------- EXP3-EXP6
@register("q_path_parse", r"""
WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
                  regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages),
v AS (SELECT *, regexp_extract(path, '([^/]+)/?$', 1) AS base FROM u)
SELECT page_id, host, split_part(host, '.', 1) AS site, path,
       regexp_extract(path, '^/([a-z][a-z])/', 1) AS lang, base,
       TRY_CAST(split_part(base, '.', 1) AS INTEGER) AS page_no,
       CASE WHEN contains(base, '.') THEN string_split(base, '.')[-1] ELSE '' END AS ext,
       translate(path, '()', '__') AS sanitized,
       CASE WHEN starts_with(path, '/' || regexp_extract(path, '^/([a-z][a-z])/', 1) || '/')
            THEN '/archive/' || split_part(host, '.', 1) || '/'
                 || substr(path, length('/' || regexp_extract(path, '^/([a-z][a-z])/', 1) || '/') + 1)
            ELSE path END AS archived
FROM v
""")
def q_path_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Host, site label, language, base name, id from name, suffix, sanitised and rebased path."""
    pages = table(spark, sf, "pages")
    u = pages.select("page_id", P.url_host("url").alias("host"), P.url_path("url").alias("path"))
    v = u.withColumn("base", P.base_name("path")).withColumn(
        "lang", F.regexp_extract("path", r"^/([a-z][a-z])/", 1))
    site = F.substring_index("host", ".", 1)
    return v.select(
        "page_id", "host", site.alias("site"), "path", "lang", "base",
        P.id_from_name("base").alias("page_no"), P.suffix("base").alias("ext"),
        P.sanitize("path").alias("sanitized"),
        P.rebase("path", F.concat(F.lit("/"), "lang", F.lit("/")),
                 F.concat(F.lit("/archive/"), site, F.lit("/"))).alias("archived"))


# --------------------------------------------------------------------------- SRC10 / WN4
@register("q_marker_line", rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
m AS (SELECT doc_id, min(pos) AS marker FROM l
      WHERE starts_with(lower({jtrim('line')}), '{MARKER_PREFIX}') GROUP BY doc_id),
k AS (SELECT l.doc_id, m.marker, min(l.pos) AS match FROM l JOIN m ON l.doc_id = m.doc_id
      WHERE l.pos > m.marker AND contains(l.line, '{MARKER_NEEDLE}') GROUP BY l.doc_id, m.marker)
SELECT k.doc_id, CAST(k.marker AS BIGINT) AS marker, CAST(k.match AS BIGINT) AS match,
       regexp_extract({jtrim('l.line')}, '^([^\t\n\x0B\f\r ]*)', 1) AS value
FROM k JOIN l ON l.doc_id = k.doc_id AND l.pos = k.match
""")
def q_marker_line(spark: SparkSession, sf: str) -> DataFrame:
    """First line containing a needle after the first marker line, per document (per row)."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    r = T.with_marker_line(docs, "text", MARKER_PREFIX, MARKER_NEEDLE, out="r")
    return r.filter(F.col("r").isNotNull()).select(
        "doc_id", F.col("r.marker").cast("long").alias("marker"),
        F.col("r.match").cast("long").alias("match"), "r.value")


# --------------------------------------------------------------------------- MET21
@register("q_sloc", rf"""
SELECT source, CAST(COUNT(*) AS BIGINT) AS n_docs,
       CAST(SUM(len(list_filter(string_split(regexp_replace(text, '(?s)/\*.*?\*/|//[^\n]*', '', 'g'), chr(10)),
                                lambda x: {jtrim('x')} <> '')))
            AS BIGINT) AS sloc
FROM documents GROUP BY source
""")
def q_sloc(spark: SparkSession, sf: str) -> DataFrame:
    """Non-blank lines after comment removal, summed per project."""
    return D.sloc_per_project(table(spark, sf, "documents"), "source", "text")


# --------------------------------------------------------------------------- MET22
@register("q_complexity", r"""
WITH c AS (SELECT 1 + len(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'),
                                      lambda t: list_contains(['if', 'for', 'while', 'case', 'catch'], t)))
                  + (length(text) - length(replace(text, '&&', ''))) // 2
                  + (length(text) - length(replace(text, '||', ''))) // 2
                  + (length(text) - length(replace(text, '?', ''))) AS complexity
           FROM documents)
SELECT CAST(complexity AS BIGINT) AS complexity, CAST(COUNT(*) AS BIGINT) AS doc_count
FROM c GROUP BY complexity
""")
def q_complexity(spark: SparkSession, sf: str) -> DataFrame:
    """Histogram of 1 + decision points per text (MET22 re-aimed)."""
    from quarry.operators import stats
    docs = table(spark, sf, "documents").select(T.cyclomatic("text").alias("complexity"))
    return stats.histogram(docs, "complexity", "doc_count")


# --------------------------------------------------------------------------- MET7 / MET8 / SNK10
EMPTY_SQL = f"(n_chars < {D.DOC_EMPTY_MIN_CHARS})"


@register("q_empty_docs", f"""
SELECT source, CAST(COUNT(*) AS BIGINT) AS n_docs,
       CAST(SUM(CASE WHEN {EMPTY_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS n_empty,
       bool_and({EMPTY_SQL}) AS all_empty
FROM documents GROUP BY source
""")
def q_empty_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Per project: files, empty files, and whether every file is empty."""
    docs = D.flag_empty_docs(table(spark, sf, "documents"))
    return D.empty_projects(docs, "source")


# --------------------------------------------------------------------------- SRC16 / SRC17 / SNK1
@register("q_size_before_after", f"""
WITH s AS (SELECT source, CAST(SUM(n_chars) AS BIGINT) AS folder_size,
                  CAST(COALESCE(SUM(n_chars) FILTER (WHERE NOT {EMPTY_SQL}), 0) AS BIGINT) AS folder_size_after
           FROM documents GROUP BY source),
p AS (SELECT d.source, CAST(SUM(strlen(d.text)) AS BIGINT) AS package_size FROM documents d
      WHERE d.doc_id IN (SELECT doc_id FROM labels) GROUP BY d.source)
SELECT s.source, s.folder_size, s.folder_size_after, CAST(COALESCE(p.package_size, 0) AS BIGINT) AS package_size
FROM s LEFT JOIN p ON s.source = p.source ORDER BY folder_size DESC, source
""")
def q_size_before_after(spark: SparkSession, sf: str) -> DataFrame:
    """Size per project before/after dropping empties, with a joined package size (0 if none)."""
    docs = D.flag_empty_docs(table(spark, sf, "documents"))
    labelled = docs.join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    package = labelled.groupBy("source").agg(
        F.sum(F.octet_length("text")).cast("long").alias("package_size"))
    return D.project_sizes(docs, "source", "n_chars", package)


# --------------------------------------------------------------------------- JN9 / SET3 / MET20
@register("q_merge_sum", f"""
WITH ne AS (SELECT source, COUNT(*) AS n FROM documents WHERE NOT {EMPTY_SQL} GROUP BY source),
em AS (SELECT source, COUNT(*) AS n FROM documents WHERE {EMPTY_SQL} GROUP BY source),
u AS (SELECT * FROM ne UNION ALL SELECT * FROM em)
SELECT source, CAST(SUM(n) AS BIGINT) AS n_files FROM u GROUP BY source HAVING SUM(n) <> 0
""")
def q_merge_sum(spark: SparkSession, sf: str) -> DataFrame:
    """Non-empty and empty file counts per project merged by key (union + sum)."""
    docs = D.flag_empty_docs(table(spark, sf, "documents"))
    nonempty = docs.filter(~F.col("is_empty")).groupBy("source").agg(F.count(F.lit(1)).alias("n_files"))
    empty = docs.filter(F.col("is_empty")).groupBy("source").agg(F.count(F.lit(1)).alias("n_files"))
    return rel.merge_counts(nonempty, empty, "source", "n_files")


# --------------------------------------------------------------------------- MET9 / AG11
@register("q_counters", f"""
WITH d AS (SELECT source, {EMPTY_SQL} AS is_empty, {D.DOC_FAILED_SQL} AS failed,
                  doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents),
s AS (SELECT source, COUNT(*) AS n, SUM(CASE WHEN is_empty THEN 1 ELSE 0 END) AS e,
             SUM(CASE WHEN failed THEN 1 ELSE 0 END) AS f, SUM(CASE WHEN labelled THEN 1 ELSE 0 END) AS l
      FROM d GROUP BY source)
SELECT CAST(SUM(n) AS BIGINT) AS n_files, CAST(SUM(n) - SUM(f) AS BIGINT) AS n_parsed,
       CAST(SUM(e) AS BIGINT) AS n_empty, CAST(SUM(n) - SUM(e) AS BIGINT) AS n_nonempty,
       CAST(SUM(f) AS BIGINT) AS n_failed, CAST(SUM(l) AS BIGINT) AS n_labelled,
       CAST(COUNT(*) AS BIGINT) AS n_projects,
       CAST(SUM(CASE WHEN e = n THEN 1 ELSE 0 END) AS BIGINT) AS n_empty_projects
FROM s
""")
def q_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Corpus counters: files, parsed, empty, failed, labelled, empty projects (one pass)."""
    docs = D.flag_empty_docs(table(spark, sf, "documents"))
    labels = table(spark, sf, "labels").select("doc_id").distinct().withColumn("labelled", F.lit(True))
    docs = docs.join(labels, "doc_id", "left").withColumn(
        "labelled", F.coalesce("labelled", F.lit(False)))
    return D.corpus_counters(docs, "source")


# --------------------------------------------------------------------------- SRC4 / SO3
@register("q_project_index", r"""
SELECT source, TRY_CAST(regexp_extract(source, '^src([0-9]+)$', 1) AS INTEGER) AS project_id
FROM (SELECT DISTINCT source FROM documents) ORDER BY project_id, source
""")
def q_project_index(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct project folders with their integer id (NULL = reject), integer order."""
    return D.project_index(table(spark, sf, "documents"), "source", r"^src([0-9]+)$")


# --------------------------------------------------------------------------- SRC13 / SET1
@register("q_extract_links", rf"""
WITH m AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin,
                  regexp_extract_all(html, '{HREF}', 1) AS l FROM pages),
u AS (SELECT page_id, origin || unnest(l) AS link, generate_subscripts(l, 1) - 1 AS pos FROM m),
r AS (SELECT link, page_id, pos, ROW_NUMBER() OVER (PARTITION BY link ORDER BY page_id, pos) AS rn FROM u)
SELECT link, page_id AS first_page, CAST(pos AS BIGINT) AS first_pos FROM r WHERE rn = 1
""")
def q_extract_links(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct links of all pages, site-prefixed, with where each was first seen."""
    return web.extract_links(table(spark, sf, "pages"), HREF, 1, prefix=web.same_site_prefix("url"))


# --------------------------------------------------------------------------- SRC12 / EXP9 / SNK5
@register("q_json_epoch", """
SELECT event_id, event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       epoch_us(ts) // 1000000 AS epoch
FROM events
""")
def q_json_epoch(spark: SparkSession, sf: str) -> DataFrame:
    """A field of a JSON column and the event time as epoch seconds (UTC)."""
    ev = table(spark, sf, "events")
    return ev.select("event_id", "event_type",
                     F.from_json("props", "k BIGINT")["k"].alias("k"),
                     ntz_epoch_seconds(F.col("ts")).alias("epoch"))


# --------------------------------------------------------------------------- SRC14
@register("q_page_seeds", r"""
WITH s AS (SELECT regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/list' AS base,
                  max(TRY_CAST(split_part(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1),
                                                         '([^/]+)/?$', 1), '.', 1) AS INTEGER)) + 1 AS hi
           FROM pages GROUP BY 1),
g AS (SELECT base, unnest(range(1, hi)) AS page FROM s WHERE hi > 1)
SELECT base, CAST(page AS BIGINT) AS page, base || '?page=' || CAST(page AS VARCHAR) AS url FROM g
""")
def q_page_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Listing-page seeds per site: pages 1 .. (highest page number seen on that site)."""
    pages = table(spark, sf, "pages")
    page_no = P.id_from_name(P.base_name(P.url_path("url")))
    sites = pages.groupBy(F.concat(P.url_origin("url"), F.lit("/list")).alias("base")).agg(
        (F.max(page_no) + 1).alias("hi"))
    return web.site_page_seeds(sites, "base", "hi")

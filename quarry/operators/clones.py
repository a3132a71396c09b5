"""Clone detection and the duplication/occurrence model (CLN1-CLN6).

Model (what a clone report holds, and what the line/token detectors build):
  duplications(dup_id, project, lines, tokens, code)
  occurrences(dup_id, path, line)

The reference's queries over that model (same-file / across-file clones,
histograms, projects with clones) are plain DataFrame operators below. They
work unchanged on ingested clone reports (``sources.reports``) and on the
duplications our detectors find.

Token clones: a k-gram is k consecutive ASCII tokens ``[a-z0-9]+`` of the
lower-cased text. Each document computes all its k-gram fingerprints in one
pass (vectorised rolling hashes, two independent 64-bit values, i.e. 128
bits); only those of k-grams that may be repeated (``operators.repeats``)
become rows. Longer fragments are put together from them in ``operators.maximal``.
Repeated k-grams are found by two partially aggregated ``groupBy``s, so a
k-gram repeated millions of times costs one row per map partition before
the shuffle. The text of a repeated k-gram is re-extracted from its first
occurrence only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.fingerprints import rolling_fingerprints
from quarry.operators.repeats import Repeats


# --------------------------------------------------------------------------- line model
def line_occurrences(docs: DataFrame, project_col: str, doc_col: str, text_col: str) -> DataFrame:
    """Every non-empty trimmed line as (project, path, line_no (1-based), code)."""
    ex = docs.select(project_col, doc_col,
                     F.posexplode(T.lines(text_col)).alias("_pos", "_raw"))
    return ex.select(
        F.col(project_col).alias("project"), F.col(doc_col).alias("path"),
        (F.col("_pos") + 1).cast("int").alias("line"),
        T.java_trim("_raw").alias("code")).filter(F.col("code") != F.lit(""))


def line_clones(docs: DataFrame, project_col: str, doc_col: str, text_col: str,
                min_occurrences: int = 2) -> tuple[DataFrame, DataFrame]:
    """Duplications = trimmed lines occurring >= ``min_occurrences`` times in a project.

    Returns (duplications, occurrences). ``dup_id`` is a hash of the natural
    key (project, code), stable across runs. Queries that need only counts and
    the two kinds take ``line_duplications``, which has no join. Occurrences are
    joined on (dup_id, project, code): with dup_id among the keys the aggregate's
    own partitioning no longer serves the join, so both sides are shuffled for it
    and AQE can split the partition of a hot line. A null project is a project.
    """
    occ = line_occurrences(docs, project_col, doc_col, text_col).withColumn(
        "dup_id", F.xxhash64("project", "code"))
    dups = line_duplications(docs, project_col, doc_col, text_col, min_occurrences)
    d = dups.select(F.col("dup_id").alias("_dup"), F.col("project").alias("_project"), F.col("code").alias("_code"))
    occs = occ.join(d, (F.col("dup_id") == F.col("_dup")) & F.col("project").eqNullSafe(F.col("_project"))
                    & (F.col("code") == F.col("_code"))).select("dup_id", "path", "line")
    return dups.drop("same_file", "across_file"), occs


def line_duplications(docs: DataFrame, project_col: str, doc_col: str, text_col: str,
                      min_occurrences: int = 2) -> DataFrame:
    """The duplications of ``line_clones`` with both kinds as flags: ``same_file`` (some path holds
    more than one occurrence) and ``across_file`` (some path holds just one).

    Two partially aggregated ``groupBy``s (per path, then per line) and no join: a line repeated
    in a third of all files is combined before each shuffle.
    """
    occ = line_occurrences(docs, project_col, doc_col, text_col)
    per_path = occ.groupBy("project", "code", "path").agg(F.count(F.lit(1)).alias("_k"))
    return (per_path.groupBy("project", "code")
            .agg(F.sum("_k").alias("n_occurrences"), F.count(F.lit(1)).alias("n_docs"),
                 (F.max("_k") > 1).alias("same_file"), (F.min("_k") <= 1).alias("across_file"))
            .filter(F.col("n_occurrences") >= min_occurrences)
            .select(F.xxhash64("project", "code").alias("dup_id"), "project",
                    F.lit(1).alias("lines"), F.size(T.ascii_tokens("code")).alias("tokens"),
                    "code", "n_occurrences", "n_docs", "same_file", "across_file"))


def _per_path_counts(occurrences: DataFrame) -> DataFrame:
    return occurrences.groupBy("dup_id", "path").agg(F.count(F.lit(1)).alias("_k"))


def same_file_duplications(dups: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Duplications with some path holding more than one of their occurrences (CLN3)."""
    ids = _per_path_counts(occurrences).filter(F.col("_k") > 1).select("dup_id")
    return dups.join(ids, "dup_id", "left_semi")


def across_file_duplications(dups: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Duplications with some path holding at most one of their occurrences (CLN4).

    Not the complement of ``same_file_duplications``: one duplication can be both.
    """
    ids = _per_path_counts(occurrences).filter(F.col("_k") <= 1).select("dup_id")
    return dups.join(ids, "dup_id", "left_semi")


def classify_duplications(dups: DataFrame, occurrences: DataFrame) -> DataFrame:
    """``dups`` with both flags from one per-path aggregation: ``same_file`` (some path
    holds > 1 occurrence) and ``across_file`` (some path holds <= 1). Equivalent to
    the two semi-joins above when both kinds are needed; a duplication without
    occurrences gets neither flag."""
    flags = _per_path_counts(occurrences).groupBy("dup_id").agg(
        (F.max("_k") > 1).alias("same_file"), (F.min("_k") <= 1).alias("across_file"))
    return dups.join(flags, "dup_id", "left").fillna(False, ["same_file", "across_file"])


def clone_histogram(dups: DataFrame, by: str = "tokens", alias: str = "dup_count") -> DataFrame:
    """Number of duplications per size (tokens or lines), ascending (CLN5)."""
    return dups.groupBy(by).agg(F.count(F.lit(1)).alias(alias)).orderBy(by)


def projects_with(dups: DataFrame, project_col: str = "project") -> Column:
    """Aggregate expression: distinct projects among the given duplications (CLN6)."""
    return F.count_distinct(project_col)


# --------------------------------------------------------------------------- token k-grams
def kgram_fingerprints(docs: DataFrame, project_col: str, doc_col: str, text_col: str, k: int = 20) -> DataFrame:
    """One row per k-gram position (see ``fingerprints.rolling_fingerprints``). Whole texts are tokenised, exactly
    like ``functions.text.ascii_tokens``; a document with fewer than k tokens has no row."""
    return rolling_fingerprints(docs, project_col, doc_col, text_col, k)


def repeated_kgrams(fps: DataFrame, min_occurrences: int = 2) -> DataFrame:
    """(project, h1, h2, n_occ, n_docs, first_doc, first_pos) of repeated k-grams.

    Two partially aggregated ``groupBy``s over all positions (per document, then
    per key). Finding the repeated keys first and filtering the positions by them
    was measured slower: it needs the fingerprints twice.
    """
    per_doc = fps.groupBy("project", "h1", "h2", "doc").agg(
        F.count(F.lit(1)).alias("_c"), F.min("pos").alias("_p"))
    rep = per_doc.groupBy("project", "h1", "h2").agg(
        F.sum("_c").alias("n_occ"), F.count(F.lit(1)).alias("n_docs"),
        F.min(F.struct("doc", "_p")).alias("_first"))
    return rep.filter(F.col("n_occ") >= min_occurrences).select(
        "project", "h1", "h2", "n_occ", "n_docs",
        F.col("_first.doc").alias("first_doc"), F.col("_first._p").alias("first_pos"))


def kgram_text(repeated: DataFrame, docs: DataFrame, doc_col: str, text_col: str,
               k: int = 20) -> DataFrame:
    """Attach the k-gram text, cut from each repeated k-gram's first occurrence.

    First occurrences are grouped per document (at most one entry per token
    position of that document), joined to the document text, and the
    document is tokenised once for all its entries. Documents holding no
    first occurrence are never tokenised again.
    """
    per_doc = repeated.groupBy("first_doc").agg(
        F.collect_list(F.struct(*[c for c in repeated.columns if c != "first_doc"])).alias("_e"))
    d = docs.select(F.col(doc_col).alias("first_doc"), F.col(text_col).alias("_text"))
    j = per_doc.join(d, "first_doc").select("first_doc", "_e", T.ascii_tokens("_text").alias("_toks"))
    cut = F.transform("_e", lambda x: F.struct(x.alias("_x"), F.concat_ws(
        " ", F.slice("_toks", x["first_pos"] + 1, k)).alias("kgram")))
    return j.select("first_doc", F.inline(cut)).select("first_doc", "_x.*", "kgram")


def token_clones(docs: DataFrame, project_col: str, doc_col: str, text_col: str,
                 k: int = 20, min_occurrences: int = 2) -> DataFrame:
    """Repeated k-grams per project with their text, occurrences and documents."""
    if min_occurrences < 2:
        rep = repeated_kgrams(kgram_fingerprints(docs, project_col, doc_col, text_col, k), min_occurrences)
    else:  # only k-grams that may be repeated become rows
        rep = repeated_kgrams(Repeats(docs, project_col, doc_col, text_col, k).grams(), min_occurrences)
    return kgram_text(rep, docs, doc_col, text_col, k)

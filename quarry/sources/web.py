"""Web-shaped inputs: listing pages, issue-search JSON, listing page seeds (SRC12-SRC14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.paths import url_origin

# Fixed value: the listing link pattern of the crawled site.
SCENARIO_LINK = r"/scenarios/[0-9]+"

# The fields of the issue-search response and its time format.
ISSUE_SCHEMA = ("issues ARRAY<STRUCT<key: STRING, fields: STRUCT<issuetype: STRUCT<name: STRING>, "
                "reporter: STRUCT<name: STRING>, created: STRING>>>")
ISSUE_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSZ"


def extract_links(pages: DataFrame, pattern: str = SCENARIO_LINK, group: int = 0,
                  prefix: Column | None = None, page_col: str = "page_id",
                  html_col: str = "html") -> DataFrame:
    """Every regex match in every page, prefixed, as an order-preserving distinct set.

    Output: (link, first_page, first_pos) - one row per distinct link with the
    page and match position where it was first seen; ordering by
    (first_page, first_pos) gives the insertion order of the reference's set.
    The distinct step is a partially aggregated ``groupBy(link)``, so a link
    present on every page costs one row per partition before the shuffle.
    """
    prefix = prefix if prefix is not None else F.lit("")
    found = pages.select(page_col, F.posexplode(
        F.regexp_extract_all(F.col(html_col), F.lit(pattern), group)).alias("pos", "m"),
        prefix.alias("_prefix"))
    links = found.select(F.concat("_prefix", "m").alias("link"), page_col, "pos")
    first = links.groupBy("link").agg(F.min(F.struct(page_col, "pos")).alias("_f"))
    return first.select("link", F.col(f"_f.{page_col}").alias("first_page"),
                        F.col("_f.pos").cast("long").alias("first_pos"))


def same_site_prefix(url_col: str = "url") -> Column:
    return url_origin(url_col)


def page_seeds(spark: SparkSession, base_url: str, lo: int = 1, hi: int = 689,
               param: str = "page") -> DataFrame:
    """Listing page request rows ``lo .. hi-1`` (upper bound exclusive)."""
    return spark.range(lo, hi).select(
        F.col("id").alias("page"),
        F.concat(F.lit(f"{base_url}?{param}="), F.col("id").cast("string")).alias("url"))


def site_page_seeds(sites: DataFrame, base_col: str, hi_col: str, lo: int = 1,
                    param: str = "page") -> DataFrame:
    """Listing page request rows ``lo .. hi-1`` for every site row (upper bound exclusive).

    ``sites`` holds one row per site with its base URL and exclusive upper
    page bound; each site expands to its own range inside the task.
    """
    page = F.explode(F.sequence(F.lit(lo), F.col(hi_col) - 1))
    rows = sites.filter(F.col(hi_col) > lo).select(base_col, page.alias("page"))
    return rows.select(base_col, F.col("page").cast("long").alias("page"),
                       F.concat(F.col(base_col), F.lit(f"?{param}="), F.col("page").cast("string")).alias("url"))


def read_issue_json(df: DataFrame, json_col: str = "value") -> DataFrame:
    """Issue-search responses -> (key, type, reporter, created, epoch) per issue.

    ``created`` looks like ``2017-01-10T22:50:23.000+0000``; epoch is seconds.
    """
    parsed = df.select(F.explode(F.from_json(F.col(json_col), ISSUE_SCHEMA)["issues"]).alias("i"))
    created = F.col("i.fields.created")
    return parsed.select(
        F.col("i.key").alias("key"), F.col("i.fields.issuetype.name").alias("type"),
        F.col("i.fields.reporter.name").alias("reporter"), created.alias("created"),
        F.unix_timestamp(created, ISSUE_TIME_FORMAT).alias("epoch"))


def malformed_json(df: DataFrame, json_col: str = "value") -> DataFrame:
    """The rows whose response isn't JSON of the expected form (cut off, for instance), as they are: ``read_issue_json``
    gives no row for them. A null response is one too; an empty list of issues is not."""
    schema = f"struct<{ISSUE_SCHEMA.replace('issues ARRAY', 'issues: ARRAY', 1)}, _corrupt: STRING>"
    parsed = F.from_json(F.col(json_col), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return df.withColumn("_x", parsed).where(F.col("_x").isNull() | F.col("_x._corrupt").isNotNull()).drop("_x")


def issue_lines(issues: DataFrame) -> DataFrame:
    """``key;type;reporter;epoch`` text lines (the reference's issue export)."""
    return issues.select(F.concat_ws(";", "key", "type", "reporter",
                                     F.col("epoch").cast("string")).alias("line"))

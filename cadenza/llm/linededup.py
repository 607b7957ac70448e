"""Removal of lines that stand on many sites.

Every line hash gets a HyperLogLog sketch of its sites, merged by aggregation.  A line whose
estimate is clearly above the limit is boilerplate; near the limit the exact number of
distinct sites decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.base import free_prefix, row_key
from cadenza.session import stage

#: Distinct sites from which a line is boilerplate, and its least length in characters.
MIN_SITES, MIN_CHARS = 10, 12
#: Base-2 logarithm of the sketch's registers, and its relative standard error.
LOG_REGISTERS, ERROR = 10, 1.04 / 32
#: Standard errors around the limit within which sites are counted exactly.
NEAR = 4


def _lines(docs: DataFrame, site: str) -> DataFrame:
    """(row, doc_id, site, at, line): trimmed lines that are long enough, by place."""
    split = docs.select(
        row_key().alias("row"), "doc_id", F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"),
        F.posexplode(F.split("text", "\n")).alias("at", "line"),
    )
    return split.withColumn("line", F.trim("line")).where(F.length("line") >= MIN_CHARS)


def spread(docs: DataFrame, site: str = "source") -> DataFrame:
    """(hash, sites, first_id, first_at) of each line on MIN_SITES sites or more.

    ``sites`` is the estimate, or the exact number near the limit; first_id and first_at are
    the line's first place by id (null ids first) and line number.  A null site is a site.
    """
    lines = _lines(docs, site).select("doc_id", "site", "at", F.md5("line").alias("hash"))
    sketched = stage(
        lines.groupBy("hash").agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_REGISTERS)).alias("sites"),
            F.min(F.struct("doc_id", "at")).alias("first"),
        ).where(F.col("sites") >= MIN_SITES * (1 - NEAR * ERROR)),
        "spread",
    )
    above = MIN_SITES * (1 + NEAR * ERROR)
    near = sketched.where(F.col("sites") <= above)
    exact = (
        lines.join(near.select("hash"), "hash", "left_semi")
        .groupBy("hash", "site").agg(F.lit(1).alias("one"))
        .groupBy("hash").agg(F.count("*").alias("exact"))
    )
    settled = near.join(exact, "hash").where(F.col("exact") >= MIN_SITES).select("hash", F.col("exact").alias("sites"), "first")
    return (
        sketched.where(F.col("sites") > above).union(settled)
        .select("hash", "sites", F.col("first.doc_id").alias("first_id"), F.col("first.at").alias("first_at"))
    )


def remove_boilerplate(docs: DataFrame, site: str = "source", prefix: str = "") -> DataFrame:
    """``docs`` with text lessened by boilerplate lines, and n_lines and n_removed.

    The two added names begin with ``prefix``.

    Every row stays.  The first place of a boilerplate line (smallest id, then line number)
    keeps it, so that text which whole sites share stays in the corpus once.  A line counts
    without blanks around it; one shorter than MIN_CHARS is never boilerplate.  A null text
    stays null, with no lines; a text whose lines all go becomes empty.  Repeated rows get
    one result each; columns of the added names are replaced.
    """
    docs = docs.drop(f"{prefix}n_lines", f"{prefix}n_removed")
    own = free_prefix(docs)
    gone_at, key = F.col(f"{own}gone"), F.col(f"{own}key")
    known = spread(docs, site)
    lines = _lines(docs, site).select("row", "doc_id", "at", F.md5("line").alias("hash"))
    first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("at") == F.col("first_at"))
    # rows that repeat come together here; their places are the same
    gone = (
        lines.join(known, "hash").where(~first)
        .groupBy("row").agg(F.collect_set("at").alias(f"{own}gone"))
        .withColumnRenamed("row", f"{own}row")
    )
    split = F.split("text", "\n")
    kept = F.filter(split, lambda line, at: ~F.array_contains(gone_at, at))
    joined = docs.withColumn(f"{own}key", row_key()).join(gone, key == F.col(f"{own}row"), "left")
    return joined.select(
        *[
            F.when(gone_at.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text") if c == "text" else F.col(f"`{c}`")
            for c in docs.columns
        ],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long").alias(f"{prefix}n_lines"),
        F.coalesce(F.array_size(gone_at), F.lit(0)).cast("long").alias(f"{prefix}n_removed"),
    )

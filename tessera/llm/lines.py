"""Line dedup by distinct-site spread, in DataFrame functions only.

Each line's 128-bit hash gets a HyperLogLog sketch of the sites that it occurs on; sketches are built where the lines are
read and merged by the aggregation. Where an estimate is within `band` of the threshold the distinct sites are counted
exactly, so the decision never rests on a near estimate. Lines on `min_sites` sites or more are boilerplate and go,
but for their very first occurrence (keep_first), so that text that is copied everywhere survives once.

Nulls and edge cases: a null text stays null and has no lines; blank lines are neither counted nor removed; a null site
is a site of its own; a null id sorts first; rows that repeat an id with the same text lose the same lines; a document may lose all
lines and keeps an empty text; other columns may have any names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, frequent

#: So many lines at most are broadcast (about 10 MB).
FEW_LINES = 100_000
BAND = 0.10  # six standard errors of a sketch of 2^12 registers


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def exploded(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """One row for each line that is not blank: (_id, _t text hash, _site, _pos, _h1, _h2)."""
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.xxhash64(F.col(text_col)).alias("_t"),
        F.coalesce(F.col(site_col).cast("string"), F.lit("\x00")).alias("_site"),
        F.posexplode(_lines(F.col(text_col))).alias("_pos", "_line"),
    ).filter(F.trim("_line") != "")
    return rows.select("_id", "_t", "_site", "_pos", F.xxhash64("_line").alias("_h1"), F.xxhash64(F.lit(1), F.col("_line")).alias("_h2"))


def met(lines: DataFrame, of: DataFrame, how: str = "inner") -> DataFrame:
    """lines that are among `of`(_h1, _h2, n, ...), a written table; n: how many rows a line has.

    Few are broadcast, so the many rows of a common line stay where they are. Of more than FEW_LINES the most frequent are, and only rows of rarer ones are dealt out by line.
    """
    keys = ["_h1", "_h2"]
    side = of.drop("n") if how == "inner" else of.select(*keys)
    if of.count() <= FEW_LINES:
        return lines.join(F.broadcast(side), keys, how)
    least = frequent(of, FEW_LINES)
    often, rare = (x.drop("n") if how == "inner" else x.select(*keys) for x in (of.filter(F.col("n") >= least), of.filter(F.col("n") < least)))
    return lines.join(F.broadcast(often), keys, how).unionByName(lines.join(F.broadcast(often.select(*keys)), keys, "left_anti").join(rare, keys, how))


def spread(lines: DataFrame, min_sites: int, scratch: Scratch) -> DataFrame:
    """(_h1, _h2, first, n): the lines on min_sites sites or more, with their first place and how many rows they have."""
    place = F.struct("_id", "_t", "_pos")
    sketched = lines.groupBy("_h1", "_h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("_site", F.lit(12))).alias("sites"), F.min(place).alias("first"), F.count("*").alias("n"))
    low, high = min_sites * (1 - BAND), min_sites * (1 + BAND)
    sketched = scratch.table(sketched.filter(F.col("sites") >= low), "sketched")
    near = sketched.filter(F.col("sites") <= high)
    # exact counts of the few near lines: sites once for each line first, then their number
    exact = met(lines, near.select("_h1", "_h2", "n"), "left_semi").select("_h1", "_h2", "_site").distinct().groupBy("_h1", "_h2").count()
    sure = sketched.filter(F.col("sites") > high).select("_h1", "_h2", "first", "n")
    return sure.unionByName(near.join(exact.filter(F.col("count") >= min_sites), ["_h1", "_h2"]).select("_h1", "_h2", "first", "n"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10, keep_first: bool = True) -> DataFrame:
    """docs with boilerplate lines taken out of text_col, and ld_lines, ld_removed: how many lines each row had and lost."""
    scratch = Scratch(docs.sparkSession)
    lines = scratch.table(exploded(docs, id_col, text_col, site_col), "lines")  # hashes and places only: texts are read twice in all
    common = scratch.table(spread(lines, min_sites, scratch), "common")
    hit = met(lines, common)
    if keep_first:
        hit = hit.filter(~F.struct("_id", "_t", "_pos").eqNullSafe(F.col("first")))
    gone = hit.groupBy(F.col("_id").alias("_gid"), F.col("_t").alias("_gt")).agg(F.collect_set("_pos").alias("_gone"))
    row = F.struct(*docs.columns).alias("_row")  # one column, so that no name of docs can clash
    text = F.col("_row")[text_col]
    joined = docs.select(row).withColumn("_th", F.xxhash64(text))
    joined = joined.join(gone, F.col("_row")[id_col].eqNullSafe(F.col("_gid")) & (F.col("_th") == F.col("_gt")), "left")
    # the lines are held by a lambda's variable, so that they are split once; places that stay come from a set difference
    stay = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_gone"))
    kept = F.get(F.transform(F.array(_lines(text)), lambda x: F.array_join(F.transform(stay(x), lambda i: F.get(x, i)), "\n")), F.lit(0))
    kept = F.when(F.col("_gone").isNull(), text).otherwise(kept)
    n = F.when(text.isNull(), F.lit(0)).otherwise(F.size(_lines(text)))
    return joined.select(
        *((kept if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns),
        n.cast("long").alias("ld_lines"),
        F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone")).cast("long").alias("ld_removed"),
    )

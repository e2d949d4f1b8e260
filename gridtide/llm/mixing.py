"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every document has a fixed position in the hash range of its source. Words are summed by source and
hash bucket; the running sum over buckets says in which bucket the budget ends. Only that boundary
bucket is divided again by the next bits of the hash, until a bucket is a single position. Documents
whose position lies below the threshold are taken: a filter, no sort. A larger budget takes a superset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtide.llm.store import word_count, written

LEVEL_BITS = 10
LEVELS = 4
MOST_REPEATS = 3
WEIGHTS = 3


def source_targets(totals: DataFrame, weights: DataFrame | None = None, most: int = MOST_REPEATS) -> DataFrame:
    """Targets that share all words by weight, none above `most` times its source's words.

    `totals` has one row per source (source, source_size). Without `weights` (source, weight) the
    sources in order of their code points, null last, weigh 1, 2, 3, 1, 2, 3 and so on. What a source
    can't take goes to the others by weight: with the sources ordered by cap per weight, the first
    `i` are full and the level of the rest is (all - caps before i) / weights from i on.
    Empty sources get 0; without any word all targets are 0. One row per source.
    """
    ranked = totals.withColumn("position", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))))
    if weights is None:
        ranked = ranked.withColumn("weight", ((F.col("position") - 1) % WEIGHTS + 1).cast("double"))
    else:
        named = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double").alias("weight"))
        ranked = ranked.join(named, F.col("source").eqNullSafe(F.col("w_source")), "left").drop("w_source")
        ranked = ranked.fillna({"weight": 0.0})
    cap = F.col("source_size") * F.lit(float(most))
    ranked = ranked.withColumn("cap", cap).withColumn("full_at", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")))
    by_level = Window.orderBy(F.col("full_at").asc_nulls_last(), "position")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    ranked = ranked.withColumn("level", F.when(F.col("weight") > 0, level))
    filled = F.when(F.col("level") <= F.col("full_at"), F.col("level"))
    ranked = ranked.withColumn("level", F.min_by(filled, F.when(filled.isNotNull(), F.struct("full_at", "position"))).over(everything))
    target = F.when(F.col("weight") > 0, F.least(F.col("cap"), F.coalesce(F.col("level"), F.col("cap")) * F.col("weight")))
    return ranked.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _position():
    """The hash of source, id and text. Equal rows share it until they are told `apart`."""
    nulls = [F.col(c).isNull() for c in ("source", "doc_id", "text")]
    return F.xxhash64("source", "doc_id", "text", *nulls).alias("h")


def _bucket(level: int):
    """The hash bits of a level, from the top."""
    return F.shiftrightunsigned(F.col("h"), 64 - LEVEL_BITS * (level + 1)).bitwiseAND((1 << LEVEL_BITS) - 1)


def _prefix(levels: int):
    """All hash bits above a level."""
    return F.shiftrightunsigned(F.col("h"), 64 - LEVEL_BITS * levels) if levels else F.lit(0).cast("long")


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: whole repeats of all its documents, and the hash prefix below which one more is taken.

    `sized` has source, size and h; `targets` those of `source_targets`. The last bucket is taken if
    that brings the sum nearer to the budget.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = targets.withColumn("repeats", whole).withColumn("rest", F.col("target") - F.col("repeats") * F.col("source_size"))
    state = state.withColumn("prefix", F.lit(0).cast("long"))
    for level in range(LEVELS):
        edge = state.select(F.col("source").alias("e_source"), F.col("prefix").alias("e_prefix"), F.col("rest").alias("e_rest"))
        inside = sized.join(edge, F.col("source").eqNullSafe(F.col("e_source")) & (_prefix(level) == F.col("e_prefix")))
        histogram = inside.groupBy("e_source", _bucket(level).alias("bucket")).agg(
            F.sum("size").alias("words"), F.first("e_rest").alias("e_rest"))
        upto = Window.partitionBy("e_source").orderBy("bucket")
        ran = histogram.withColumn("below", F.sum("words").over(upto) - F.col("words"))
        ran = ran.filter(F.col("below") <= F.col("e_rest"))
        last = ran.groupBy("e_source").agg(F.max_by(F.struct("bucket", "below", "words"), "bucket").alias("at"))
        state = state.join(last, F.col("source").eqNullSafe(F.col("e_source")), "left").drop("e_source")
        state = state.withColumns({
            "rest": F.col("rest") - F.coalesce(F.col("at.below"), F.lit(0)),
            "prefix": F.shiftleft(F.col("prefix"), LEVEL_BITS) + F.coalesce(F.col("at.bucket"), F.lit(0)),
            "edge": F.coalesce(F.col("at.words"), F.lit(0))}).drop("at")
        state = written(state, "mixing-level")
    past = F.when(F.col("rest") * 2 > F.col("edge"), F.col("prefix") + 1).otherwise(F.col("prefix"))
    return state.select("source", "source_size", "target", "repeats", past.alias("limit"))


def apart(rows: DataFrame) -> DataFrame:
    """`rows` with a position h of its own for every one of those that share it.

    The copies of a position are numbered: within the partition in which they were read, and from
    partition to partition by counts. So no task numbers more of them than it read. The positions of n copies
    are the same in every run; copies are interchangeable.
    """
    counts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    twice = written(counts.filter("n > 1").select("h"), "mixing-twice")
    if twice.isEmpty():
        return rows
    again = rows.withColumn("_at", F.monotonically_increasing_id()).join(twice, "h", "left_semi")
    again = written(again.withColumn("_part", F.shiftrightunsigned("_at", 33)), "mixing-again")
    earlier = Window.partitionBy("h").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = again.groupBy("h", "_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.select("h", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("h", "_part").orderBy("_at")) - 1
    numbered = again.withColumn("_own", own).join(offsets, ["h", "_part"])
    number = F.col("_own") + F.col("_before")
    numbered = numbered.withColumn("h", F.when(number == 0, F.col("h")).otherwise(F.xxhash64("h", number)))
    return rows.join(twice, "h", "left_anti").select(*rows.columns).union(numbered.select(*rows.columns))


def mix_limits(sized: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """The thresholds of every source of `sized` (source, size, h)."""
    totals = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mixing-totals")
    return thresholds(sized, written(source_targets(totals, weights), "mixing-targets"))


def _joined(rows: DataFrame, limits: DataFrame) -> DataFrame:
    named = limits.withColumnRenamed("source", "l_source")
    joined = rows.join(named, F.col("source").eqNullSafe(F.col("l_source"))).drop("l_source")
    copies = F.least(F.col("repeats") + (_prefix(LEVELS) < F.col("limit")).cast("long"), F.lit(MOST_REPEATS).cast("long"))
    joined = joined.withColumn("copies", copies)
    return joined.withColumn("taken", F.col("size") * F.col("copies")).drop("h", "repeats", "limit")


def mix(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken = size * copies of every row of `docs`.

    Null or empty texts have size 0. Repeated rows have positions of their own, so of n copies some may be taken
    once more than others. Null is a source of its own, last in order. The decision depends on ids, texts and
    totals only. Other columns of `docs` are not read; an empty table gives an empty result.
    """
    keyed = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _position())
    sized = written(apart(written(keyed, "mixing-sizes")), "mixing-apart")
    return _joined(sized, written(mix_limits(sized, weights), "mixing-limits"))


def repeated(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """The mix itself: the rows of `docs` with all their columns, every document as often as it is taken.

    Of rows with the same id and text, but other columns that differ, those read first count as the first copies.
    """
    keyed = apart(docs.select(F.struct("*").alias("row"), "source", word_count(F.col("text")).alias("size"), _position()))
    sized = written(keyed.select("source", "size", "h"), "mixing-sizes")
    mixed = _joined(keyed, written(mix_limits(sized, weights), "mixing-limits")).filter(F.col("copies") > 0)
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")

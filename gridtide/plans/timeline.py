"""Series order, and the blocks that keep one long series from becoming one task.

A series ordered by a DATE alone has at most one row per calendar day, so it is small by its type and
is windowed whole. Any other order (timestamps, numbers, dates with ties) can make one series hold a
large share of all rows. Such series are cut into blocks of about `block_rows` consecutive rows; a block also
gets copies of the rows just before and after it that its windows look at. Every window then runs
over one block. A short series is block 0 by the same formula. A NULL key names a series like any other.

Block borders come from row counts per time bucket: the running count of the buckets before it says
where a bucket starts in its series. Buckets are counted in two levels, so that no task holds them all.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.plans.keys import key_of
from gridtide.session import cut, stored

BLOCK_ROWS = 65_536
BUCKET_ROWS = 4_096
# Bucket widths tried for timestamps, widest first, in microseconds.
WIDTHS = (86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000, 1_000, 1)
INTEGER_WIDTH = 1_024
TIE_WIDTHS = (1_000_000_000, 1_000_000, 1_000)
# Neighbouring buckets that are summed together before the running count.
BUCKETS_TOGETHER = 1_024


@dataclass(frozen=True)
class SeriesOrder:
    """Which columns name a series and which order its rows; (keys, ts, tie) is unique."""

    keys: tuple[str, ...] = ("series_id",)
    ts: str = "trade_date"
    tie: tuple[str, ...] = ()
    block_rows: int | None = None
    bucket_at: int | None = None

    def by(self) -> list[Column]:
        return [F.col(self.ts).asc_nulls_last(), *(F.col(c) for c in self.tie)]

    def backwards(self) -> list[Column]:
        return [F.col(self.ts).desc_nulls_first(), *(F.col(c).desc() for c in self.tie)]

    def place(self) -> Column:
        """The row's place in the order as one comparable value; rows without a time come last."""
        return F.struct(F.col(self.ts).isNull().alias("untimed"), F.col(self.ts), *(F.col(c) for c in self.tie))

    def blocked(self, df: DataFrame) -> bool:
        by_date = isinstance(df.schema[self.ts].dataType, T.DateType) and not self.tie
        return self.block_rows is not None or not by_date

    def columns(self) -> list[str]:
        return [*self.keys, self.ts, *self.tie]

    def resolved(self, df: DataFrame) -> SeriesOrder:
        """This order with its buckets chosen; they stay small enough for any part of these rows."""
        if not self.blocked(df) or self.bucket_at is not None:
            return self
        return replace(self, bucket_at=_fitting_bucket(df, self))

    def cut(self, df: DataFrame) -> DataFrame:
        """Between steps of a plan: blocked orders read their input twice, so write it out first."""
        return cut(df) if self.blocked(df) else df


DAILY = SeriesOrder()


def _at(bucket: Column) -> Column:
    """Rows without a time form the last bucket."""
    return F.coalesce(bucket.cast("long"), F.lit(2**63 - 1).cast("long")).alias("at")


def _candidates(df: DataFrame, order: SeriesOrder, ts: Column | None = None, tie: Column | None = None) -> list[Column]:
    """Ways to cut the order into buckets, coarsest first, each a refinement of the one before.

    `ts` and `tie` stand for values of the time and of the first tie column that are found elsewhere.
    """
    kind = df.schema[order.ts].dataType
    ts = F.col(order.ts) if ts is None else ts
    if isinstance(kind, T.DateType):
        found = [F.year(ts) * 12 + F.month(ts), F.unix_date(ts)]
    elif isinstance(kind, T.IntegralType):
        found = [F.floor(ts / F.lit(INTEGER_WIDTH)), ts]
    else:
        if isinstance(kind, T.TimestampNTZType):  # without a zone, so that no clock change reorders rows
            micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast(kind), ts)
        else:
            micros = F.unix_micros(ts)
        found = [F.floor(micros / F.lit(w)) for w in WIDTHS]
    finest = found[-1]
    found = [F.struct(_at(c), F.lit(0).cast("long").alias("tie")) for c in found]
    if order.tie and isinstance(df.schema[order.tie[0]].dataType, T.IntegralType):
        tie = F.col(order.tie[0]) if tie is None else tie
        found += [F.struct(_at(finest), F.floor(tie / F.lit(w)).alias("tie")) for w in TIE_WIDTHS]
    return found


def _fitting_bucket(df: DataFrame, order: SeriesOrder) -> int:
    """Number of the coarsest candidate whose buckets are small.

    A date or number alone is unique, which bounds its buckets; else the buckets are counted. The least and greatest
    place in a bucket that is too full tell which finer candidate is the first to divide it: those between aren't counted.
    """
    if not order.tie and isinstance(df.schema[order.ts].dataType, (T.DateType, T.IntegralType)):
        return 0
    found = _candidates(df, order)
    places = [order.ts, *order.tie[:1]]
    ends = [[F.col(f"_{end}{i}") for i in range(len(places))] for end in ("least", "most")]
    finer = list(zip(*(_candidates(df, order, *end) for end in ends)))
    at = 0
    while at < len(found) - 1:
        counts = df.groupBy(*order.keys, found[at].alias("_bucket")).agg(
            F.count(F.lit(1)).alias("_n"),
            *(f(c).alias(f"_{end}{i}") for i, c in enumerate(places) for end, f in (("least", F.min), ("most", F.max))))
        divided = [F.bool_or(~least.eqNullSafe(most)) for least, most in finer[at + 1:]]
        full, *divided = counts.filter(F.col("_n") > BUCKET_ROWS).agg(F.count(F.lit(1)), *divided).first()
        if not full:
            break
        at = divided.index(True) + at + 1 if True in divided else len(found) - 1
    return at


def _bucket_starts(df: DataFrame, order: SeriesOrder, bucket: Column) -> DataFrame:
    """Rows `_n` per bucket of a series, and the position `_start` of its first row."""
    counts = df.groupBy(key_of(order.keys).alias("_key"), bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    counts = cut(counts)  # many readers below, one reading of the rows
    counts = counts.withColumn("_group", F.floor(F.col("_bucket.at") / BUCKETS_TOGETHER))
    groups = counts.groupBy("_key", "_group").agg(F.sum("_n").alias("_rows"))
    by_group = Window.partitionBy("_key").orderBy("_group")
    groups = groups.select("_key", "_group", (F.sum("_rows").over(by_group) - F.col("_rows")).alias("_before"))
    inside = Window.partitionBy("_key", "_group").orderBy("_bucket")
    start = F.col("_before") + F.sum("_n").over(inside) - F.col("_n")
    return counts.join(groups, ["_key", "_group"]).withColumn("_start", start).drop("_group", "_before")


def _block_plan(df: DataFrame, order: SeriesOrder, bucket: Column, lookback: int, lookahead: int) -> DataFrame:
    """One row per bucket and block that needs its rows: the first position, the bucket's own block, the block.

    A block opens where its first bucket starts. The blocks whose opening is within reach of a bucket have
    numbers near its own, so they are found by an equi-join on these.
    """
    size = order.block_rows or BLOCK_ROWS
    homes = _bucket_starts(df, order, bucket).withColumn("_home", F.floor(F.col("_start") / size))
    opens = homes.groupBy("_key", "_home").agg(F.min("_start").alias("_open"))
    names = ("_key", "_bucket", "_start", "_home")
    parts = [homes.select(*names, F.col("_home").alias("_block"))]
    if lookback > 0:
        last = F.floor((F.col("_start") + F.col("_n") + (lookback - 1)) / size)
        near = homes.filter(last > F.col("_home")).withColumn("_block", F.explode(F.sequence(F.col("_home") + 1, last)))
        found = near.join(opens.withColumnRenamed("_home", "_block"), ["_key", "_block"])
        parts.append(found.filter(F.col("_open") - lookback < F.col("_start") + F.col("_n")).select(*names, "_block"))
    if lookahead > 0:
        # Per block its opening and the block before it: that of the bucket which ends there.
        ends = homes.select("_key", (F.col("_start") + F.col("_n")).alias("_open"), F.col("_home").alias("_before"))
        entered = opens.withColumnRenamed("_home", "_at").join(ends, ["_key", "_open"])
        first = F.greatest(F.floor((F.col("_start") - (lookahead - 1)) / size), F.lit(0).cast("long"))
        near = homes.withColumn("_at", F.explode(F.sequence(first, F.col("_home"))))
        found = near.join(entered, ["_key", "_at"])
        found = found.filter((F.col("_open") <= F.col("_start")) & (F.col("_open") + lookahead > F.col("_start")))
        parts.append(found.select(*names, F.col("_before").alias("_block")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


class SeriesFrame:
    """Rows laid out for windows: whole series, or blocks with copied neighbours."""

    def __init__(self, df: DataFrame, order: SeriesOrder, is_blocked: bool, copies: bool):
        self.df = df
        self.order = order
        self.is_blocked = is_blocked
        self.copies = copies

    @classmethod
    def open(cls, df: DataFrame, order: SeriesOrder = DAILY, lookback: int = 0, lookahead: int = 0) -> SeriesFrame:
        """Lay `df` out so that windows reach `lookback` rows back and `lookahead` rows ahead."""
        if not order.blocked(df):
            return cls(df, order, False, False)
        order = order.resolved(df)
        bucket = _candidates(df, order)[order.bucket_at]
        plan = _block_plan(df, order, bucket, lookback, lookahead)
        keyed = df.withColumns({"_key": key_of(order.keys), "_bucket": bucket})
        rows = keyed.join(plan, ["_key", "_bucket"]).withColumn("_own", F.col("_block") == F.col("_home"))
        rows = rows.drop("_bucket", "_home")
        return cls(rows, order, True, lookback > 0 or lookahead > 0)

    @property
    def parts(self) -> list[str]:
        return ["_key", "_block"] if self.is_blocked else list(self.order.keys)

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.parts).orderBy(*self.order.by())

    def index(self, name: str = "idx") -> SeriesFrame:
        """Add the position of the row in its series, from 0."""
        place = F.row_number().over(self.window).cast("long") - 1
        if self.is_blocked:
            place = place + F.first("_start").over(self.window)
        return self.with_columns({name: place})

    def with_columns(self, columns: Mapping[str, Column] | Callable[[WindowSpec], Mapping[str, Column]]) -> SeriesFrame:
        if callable(columns):
            columns = columns(self.window)
        return SeriesFrame(self.df.withColumns(dict(columns)), self.order, self.is_blocked, self.copies)

    def map(self, step: Callable[[DataFrame], DataFrame]) -> SeriesFrame:
        return SeriesFrame(step(self.df), self.order, self.is_blocked, self.copies)

    def own_rows(self) -> SeriesFrame:
        """Drop the copies; windows over bounded frames have to be done before."""
        if not self.copies:
            return self
        return SeriesFrame(self.df.filter("_own"), self.order, self.is_blocked, False)

    def close(self) -> DataFrame:
        out = self.own_rows().df
        return out.drop("_key", "_block", "_own", "_start") if self.is_blocked else out

    def _carried(self, local: Mapping[str, Column], total: Mapping[str, Column], carry: Callable[[str, WindowSpec], Column],
                 merge: Callable[[str], Column], w: WindowSpec, backward: bool) -> SeriesFrame:
        """Running values in blocks: `local` ones, put together with what the blocks before hold at their ends.

        `total` names those whose value at a block's end isn't the local one there. The rows are computed once and
        written; the one at the end of each block is read again for what the block hands on.
        """
        ends = {f"_end_{n}": c for n, c in total.items()}
        rows = stored(self.own_rows().df.withColumns({**local, **ends, "_ends": F.lead(F.lit(1)).over(w).isNull()}), "carried")
        held = {n: f"_end_{n}" if n in total else n for n in local}
        per_block = rows.filter("_ends").select("_key", "_block", *(F.col(c).alias(f"_sum_{n}") for n, c in held.items()))
        step = F.col("_block").desc() if backward else F.col("_block").asc()
        before = Window.partitionBy("_key").orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
        # Stored, so that Spark knows the size of this short table before it joins it.
        carried = stored(per_block.select("_key", "_block", *(carry(f"_sum_{n}", before).alias(f"_carry_{n}") for n in local)), "carry")
        rows = rows.drop(*ends, "_ends").join(carried, ["_key", "_block"], "left")
        rows = rows.withColumns({n: merge(n) for n in local}).drop(*(f"_carry_{n}" for n in local))
        return SeriesFrame(rows, self.order, True, False)

    def running_last(self, columns: Mapping[str, Column], earlier: Mapping[str, Column] | None = None) -> SeriesFrame:
        """Per name: the latest non-null value of the expression up to the row; in `earlier` before the row."""
        earlier = earlier or {}
        upto = self.window.rowsBetween(Window.unboundedPreceding, 0)
        before = self.window.rowsBetween(Window.unboundedPreceding, -1)
        local = {n: F.last(c, ignorenulls=True).over(upto) for n, c in columns.items()}
        local.update({n: F.last(c, ignorenulls=True).over(before) for n, c in earlier.items()})
        if not self.is_blocked:
            return self.with_columns(local)
        return self._carried(
            local, {n: F.last(c, ignorenulls=True).over(upto) for n, c in earlier.items()},
            lambda s, w_: F.last(s, ignorenulls=True).over(w_),
            lambda n: F.coalesce(F.col(n), F.col(f"_carry_{n}")), self.window, backward=False)

    def running_next(self, columns: Mapping[str, Column]) -> SeriesFrame:
        """Per name: the first non-null value of the expression from the row on."""
        # From the end backwards: a frame that runs to the end would be read anew for every row.
        w = Window.partitionBy(*self.parts).orderBy(*self.order.backwards())
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        local = {n: F.last(c, ignorenulls=True).over(upto) for n, c in columns.items()}
        if not self.is_blocked:
            return self.with_columns(local)
        return self._carried(
            local, {}, lambda s, w_: F.last(s, ignorenulls=True).over(w_),
            lambda n: F.coalesce(F.col(n), F.col(f"_carry_{n}")), w, backward=True)

    def running_product(self, columns: Mapping[str, Column]) -> SeriesFrame:
        """Per name: the product of the expression over all rows up to the row."""
        w = self.window.rowsBetween(Window.unboundedPreceding, 0)
        local = {n: F.product(c).over(w) for n, c in columns.items()}
        if not self.is_blocked:
            return self.with_columns(local)
        return self._carried(
            local, {}, lambda s, w_: F.product(F.col(s)).over(w_),
            lambda n: F.col(n) * F.coalesce(F.col(f"_carry_{n}"), F.lit(1.0)), self.window, backward=False)


def windowed(df: DataFrame, *steps: Callable[[WindowSpec], Mapping[str, Column]], order: SeriesOrder = DAILY,
             lookback: int = 0, lookahead: int = 0) -> DataFrame:
    """Add the columns of each step; later steps may window over columns of earlier ones."""
    frame = SeriesFrame.open(df, order, lookback, lookahead)
    for step in steps:
        frame = frame.with_columns(step)
    return frame.close()


def with_index(df: DataFrame, order: SeriesOrder = DAILY, name: str = "idx") -> DataFrame:
    return SeriesFrame.open(df, order).index(name).close()


def split_order(order: SeriesOrder, *extra: str) -> SeriesOrder:
    """The same order within finer groups."""
    return replace(order, keys=(*order.keys, *extra))

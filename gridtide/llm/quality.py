"""Quality rules: text statistics, and decision lists learned from labelled statistics.

The statistics of every whole text are counted in Arrow batches. The list is fitted on at most
`MOST_LABELLED` labelled rows (those with the smallest hash of the id), grown rule by rule by sequential
covering and pruned on rows held back. It is handed out as an ordered Spark conditional expression.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.llm.words import byte_values, chunks, mix, not_space, run_hash, run_starts, run_sums, words

MOST_LABELLED = 20_000
MIN_PRECISION = 0.95
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_distinct_words")
SYMBOLS = b"#*$%&|<>"


def _per_row(w, begin_mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(begin_mask)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _duplicates(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks over (row, key): it occurs more than once in its row; it is not the first of its kind."""
    mixed = mix(key ^ mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    again, repeated = np.zeros(len(key), bool), np.zeros(len(key), bool)
    again[order[1:]] = same
    repeated[order[1:]] |= same
    repeated[order[:-1]] |= same
    return repeated, again


def count_batch(column: pa.Array) -> dict[str, np.ndarray]:
    """The statistics COUNTS of a chunk of texts; a null text has none of anything."""
    keep, values = not_space(), byte_values()
    w = words(column, keep, values)
    rows, data, offsets = len(column), w.data, w.offsets
    out = {"n_words": np.diff(w.first)}
    out["word_chars"] = _per_row(w, keep[data] & ((data & 0xC0) != 0x80), offsets)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out["n_symbols"] = _per_row(w, symbol[data], offsets)
    letters = np.zeros(256, bool)
    letters[65:91] = letters[97:123] = letters[0xC0:] = True
    out["n_letters"] = _per_row(w, letters[data], offsets)
    starts, hit = run_starts(w, 3), np.zeros(len(w.hash) + 1, np.int64)
    repeated, _ = _duplicates(w.row[starts], run_hash(run_sums(w.hash), starts, 3)) if len(starts) else (np.zeros(0, bool), None)
    np.add.at(hit, starts[repeated], 1)
    covered = np.convolve(hit[:-1], [1, 1, 1])[: len(w.hash)] > 0 if len(w.hash) else np.zeros(0, bool)
    out["n_repeat_words"] = np.bincount(w.row[covered], minlength=rows)
    _, again = _duplicates(w.row, w.hash)
    out["n_distinct_words"] = np.bincount(w.row[~again], minlength=rows)
    lines = words(column, np.arange(256) != 10, values)
    worded = np.searchsorted(w.begin, lines.end) > np.searchsorted(w.begin, lines.begin)
    row, key = lines.row[worded], lines.hash[worded]
    _, again = _duplicates(row, key)
    out["n_lines"] = np.bincount(row, minlength=rows)
    out["n_dup_lines"] = np.bincount(row[again], minlength=rows)
    return {name: out[name].astype(np.int64) for name in COUNTS}


def statistics(docs: DataFrame, *carried: str) -> DataFrame:
    """The columns `carried` (scalars) and the statistics COUNTS, as longs, of every row's whole text.

    Words are `[^\\x20\\x09-\\x0D]+`; a repeated word lies in a 3-word run that its text has more than
    once; a line is between \\n and counts if it has a word. Null and empty texts have zeros.
    """
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            text = batch.column(batch.num_columns - 1)
            for begin, end in chunks(text):
                own = [batch.column(i).slice(begin, end - begin) for i in range(len(carried))]
                counts = count_batch(text.slice(begin, end - begin))
                yield pa.RecordBatch.from_arrays(own + [pa.array(counts[c]) for c in COUNTS], names=[*carried, *COUNTS])

    schema = T.StructType([docs.schema[c] for c in carried] + [T.StructField(c, T.LongType()) for c in COUNTS])
    return docs.select(*carried, F.col("text").alias("text_")).mapInArrow(batches, schema)


def whole_rows(docs: DataFrame) -> DataFrame:
    """Every row as one struct `row` next to its text, so that its other columns can have any names."""
    return docs.select(F.struct("*").alias("row"), "text")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: Ratios that rules may test: name, numerator, denominator (over statistics).
RATIOS = (("symbols_per_word", "n_symbols", "n_words"), ("dup_line_share", "n_dup_lines", "n_lines"), ("repeat_share", "n_repeat_words", "n_words"),
          ("chars_per_word", "word_chars", "n_words"), ("letter_share", "n_letters", "word_chars"), ("distinct_share", "n_distinct_words", "n_words"),
          ("words_per_line", "n_words", "n_lines"))


def features() -> dict[str, Column]:
    """The ratios as Spark expressions; 0 where the denominator is 0."""
    return {name: F.when(F.col(below) > 0, F.col(above) / F.col(below)).otherwise(F.lit(0.0)) for name, above, below in RATIOS}


@dataclass(frozen=True)
class Rule:
    """A conjunction of tests (feature, True for >=, threshold) under which a text is rejected."""

    tests: tuple[tuple[str, bool, float], ...]

    def holds(self, rows: pd.DataFrame) -> np.ndarray:
        out = np.ones(len(rows), bool)
        for name, above, at in self.tests:
            out &= rows[name].to_numpy() >= at if above else rows[name].to_numpy() <= at
        return out

    def condition(self, columns: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, above, at in self.tests:
            out = out & (columns[name] >= F.lit(at) if above else columns[name] <= F.lit(at))
        return out


def _best_test(rows: pd.DataFrame, bad: np.ndarray) -> tuple[float, tuple[str, bool, float] | None]:
    """The test of the largest information gain for the bad rows; thresholds lie midway between values."""
    p, n = int(bad.sum()), len(bad)
    start = math.log2(p / n)
    best, gain = None, 1e-9
    for name in sorted(rows.columns):
        values = rows[name].to_numpy()
        order = np.argsort(values, kind="stable")
        v, cum = values[order], np.cumsum(bad[order])
        cuts = np.flatnonzero(v[1:] > v[:-1])
        if not len(cuts):
            continue
        left_p, left_n = cum[cuts], cuts + 1
        for above, cp, cn in ((False, left_p, left_n), (True, p - left_p, n - left_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gains = np.where(cp > 0, cp * (np.log2(cp / cn) - start), -1.0)
            at = int(np.argmax(gains))
            if gains[at] > gain:
                gain, best = float(gains[at]), (name, above, float((v[cuts[at]] + v[cuts[at] + 1]) / 2))
    return gain, best


def _worth(rule: Rule, rows: pd.DataFrame, bad: np.ndarray) -> float:
    held = rule.holds(rows)
    p, n = int((held & bad).sum()), int((held & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(rows: pd.DataFrame, bad: np.ndarray, min_precision: float = MIN_PRECISION, most_tests: int = 4, least: int = 5) -> list[Rule]:
    """Sequential covering: grow a rule on two thirds of the uncovered rows, prune its last tests on the rest, keep it if it is precise.

    A kept rule rejects at least `least` bad rows of those not yet covered and is right for
    `min_precision` of the rows it covers, judged on all rows given, so clean texts stay. Rows are taken in the given order, every third one
    is held back for pruning. No bad rows, or none that a precise rule covers: an empty list.
    """
    rules: list[Rule] = []
    third = np.arange(len(rows)) % 3 == 2
    covered = np.zeros(len(rows), bool)
    while (bad & ~covered).any():
        grow = ~third & ~covered
        if not (bad & grow).any():
            break
        tests: list[tuple[str, bool, float]] = []
        inside = grow.copy()
        while len(tests) < most_tests and (bad & inside).any() and (~bad & inside).any():
            _, test = _best_test(rows[inside], bad[inside])
            if test is None:
                break
            tests.append(test)
            inside &= Rule((test,)).holds(rows)
        held_back = third & ~covered
        choices = [Rule(tuple(tests[:k])) for k in range(1, len(tests) + 1)]
        if not choices:
            break
        rule = max(choices, key=lambda r: (_worth(r, rows[held_back], bad[held_back]), -len(r.tests)))
        hits = rule.holds(rows)
        if (hits & bad & ~covered).sum() < least or (hits & bad).sum() < min_precision * hits.sum():
            break
        rules.append(rule)
        covered |= hits
    return rules


def sample_labelled(counted: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> pd.DataFrame:
    """At most `most` rows with a label and its ratios, by hash of the id: the bounded sample that the list is fitted on.

    Ids that are null or have several labels take no part; repeated ids count once.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other").drop("other")
    n = known.count()
    # A hash threshold leaves little more than the sample before the exact cut.
    likely = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40) <= (1.0 if n <= 2 * most else 1.5 * most / n)
    known = known.filter(likely)
    once = counted.select("doc_id", *[c.alias(n) for n, c in features().items()]).join(known, "doc_id")
    names = [n for n, _, _ in RATIOS]
    once = once.groupBy("doc_id").agg(*[F.min(c).alias(c) for c in ("quality", *names)])
    return once.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id").limit(most).toPandas()


def decision_list(rules: list[Rule]) -> Column:
    """The ordered conditional: the first rule that holds rejects, otherwise the text is kept."""
    if not rules:
        return F.lit(True)
    columns = features()
    out = F.when(rules[0].condition(columns), F.lit(False))
    for rule in rules[1:]:
        out = out.when(rule.condition(columns), F.lit(False))
    return out.otherwise(F.lit(True))


def fit(counted: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> list[Rule]:
    """The rules learned from the labelled rows that do not fail the base rules."""
    sample = sample_labelled(counted.filter(~base_failed()), labels, most)
    names = [n for n, _, _ in RATIOS]
    return learn(sample[names].astype(float), sample["quality"].to_numpy() == 0) if len(sample) else []


def judged(counted: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds base_failed and kept to rows with statistics: kept is false for base failures and rejected rows."""
    return counted.withColumn("base_failed", base_failed()).withColumn(
        "kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(decision_list(rules)))

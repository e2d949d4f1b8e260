"""Spelling variants of a corpus's words by a variable-length gram index.

The dictionary grows short grams only while they are frequent, so every gram of it is rare or of full
length. A word is decomposed into the gram that starts at each of its letters. One edit touches the grams
over one place only; the largest number of them is the word's bound of affected grams, and a near word
shares all its other grams, in order. So two near words meet in the list of a gram that is among the
bound + 1 rarest of both, and only these lists are merged. An edit leaves alone what is left or what is right of an
untouched gram, so each list is split by either context, and what is still too long by the letter that an
edit drops. A list is merged and its candidates verified in time linear in its length: near words are equal without
the letter at one place.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.llm.store import written
from gridtide.llm.words import chunks, utf8

SLIP = 97
MIN_LENGTH = 5
MIN_COUNT = 3
DOMINANCE = 2
MIN_GRAM, MAX_GRAM = 2, 4
LEAST_FREQUENT = 64
MOST_GRAMS = 100_000
RARITY_BITS = 16
LONG_LIST = 4_096
CHUNK_BYTES = 8 << 20
SHORT_RUN = 64
PAD = "$"


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


def letter_runs(texts: pa.Array, least: int = MIN_LENGTH) -> tuple[pa.Array, np.ndarray]:
    """Runs of A-Z, a-z and U+00C0 to U+00FF with `least` code points at least, A-Z lowered, and the row of each.

    The letters beyond ASCII are the byte 0xC3 and the one after it.
    """
    data, offsets = utf8(texts)
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 32
    data = lower[data]
    lead = data == 0xC3
    inside = (data >= 0x61) & (data <= 0x7A) | lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1])))) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1 if len(data) else begin
    leads = np.concatenate(([0], np.cumsum(lead)))
    long = end - begin - (leads[end] - leads[begin]) >= least
    begin, end = begin[long], end[long]
    marks = np.zeros(len(data) + 1, np.int8)
    marks[begin] += 1
    marks[end] -= 1
    kept = data[np.cumsum(marks[:-1]).astype(bool)]
    places = np.concatenate(([0], np.cumsum(end - begin))).astype(np.int64)
    runs = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(kept)))
    return runs, np.searchsorted(offsets, begin, side="right") - 1


def codes(runs: pa.Array, prefixes: np.ndarray) -> np.ndarray:
    """crc32 of a prefix and a run, given the crc32 of each prefix: a step per byte for all runs, long runs one by one."""
    data, offsets = utf8(runs)
    table, size = _crc_table(), np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    lengths, begin = size[order], offsets[:-1][order]
    state = prefixes[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    long = int(np.searchsorted(-lengths, -SHORT_RUN))
    for i in range(long):
        state[i] = zlib.crc32(data[begin[i]: begin[i] + lengths[i]].tobytes(), int(prefixes[order[i]])) ^ 0xFFFFFFFF
    for at in range(int(lengths[long]) if long < len(lengths) else 0):
        some = slice(long, int(np.searchsorted(-lengths, -at)))
        state[some] = table[(state[some] ^ data[begin[some] + at]) & np.uint32(255)] ^ (state[some] >> np.uint32(8))
    out = np.empty(len(size), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def counted_words(ids: pa.Array, texts: pa.Array, slip: int = SLIP, least: int = MIN_LENGTH) -> tuple[pa.Array, pa.Array]:
    """Distinct words of some texts and their counts: letter runs, less one letter where `slip` divides the hash of id and run."""
    runs, row = letter_runs(texts, least)
    prefixes = np.array([zlib.crc32(f"{i or ''}:".encode()) for i in ids.to_pylist()], np.uint32)
    code = codes(runs, prefixes[row])
    hit = code % slip == 0
    cut = []
    for run, c in zip(runs.filter(pa.array(hit)).to_pylist(), code[hit].tolist()):
        at = c % len(run)
        if len(run) > least:
            cut.append(run[:at] + run[at + 1:])
    words = pc.value_counts(pa.chunked_array([runs.filter(pa.array(~hit)), pa.array(cut, pa.large_string())]))
    return words.field("values").cast(pa.string()), words.field("counts")


def vocabulary(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of MIN_LENGTH code points at least that occur `min_count` times at least.

    A-Z are lowered; a run whose hash with the document's id SLIP divides loses one letter. A null id reads as empty, a null text has no runs.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in chunks(batch.column(1), CHUNK_BYTES):
                word, n = counted_words(batch.column(0).slice(begin, end - begin), batch.column(1).slice(begin, end - begin))
                yield pa.RecordBatch.from_arrays([word, n], names=["word", "n"])

    counted = docs.select(F.col("doc_id").cast("string").alias("id"), "text").mapInArrow(rows, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def decomposed(word: str, frequent: set[str]) -> list[str]:
    """The gram at each letter of the word: the shortest that is not frequent, or one of full length; pads follow the last letter."""
    padded = word + PAD * (MAX_GRAM - 1)
    out = []
    for at in range(len(word)):
        size = MIN_GRAM
        while size < MAX_GRAM and padded[at: at + size] in frequent:
            size += 1
        out.append(padded[at: at + size])
    return out


def affected(grams: list[str]) -> int:
    """The most grams that cover one place of the word, the one after its end included: no single edit changes more."""
    most, length = 0, len(grams)
    for place in range(length + 1):
        most = max(most, sum(at + len(grams[at]) > place for at in range(max(0, place - MAX_GRAM + 1), min(place + 1, length))))
    return most


def _mapped(words: DataFrame, schema: str, rows: Callable[[list[str]], list[pa.Array]]) -> DataFrame:
    """`rows` of the words of each Arrow batch, as columns of `schema`."""
    names = [part.split()[0] for part in schema.split(", ")]

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            yield pa.RecordBatch.from_arrays(rows(batch.column(0).to_pylist()), names=names)

    return words.select("word").mapInArrow(batches, schema)


def frequent_grams(words: DataFrame, most: int = MOST_GRAMS, least: int = LEAST_FREQUENT) -> set[str]:
    """The grams that are too frequent to end at: those of MIN_GRAM to MAX_GRAM - 1 code points in more than a threshold of places.

    The threshold is `least`, or the number of places divided by `most` if larger, so no more than `most` grams pass it, whatever the number of words.
    """
    def rows(own: list[str]) -> list[pa.Array]:
        found: Counter[str] = Counter()
        for size in range(MIN_GRAM, MAX_GRAM):
            found.update(padded[at: at + size] for padded in (w + PAD * (MAX_GRAM - 1) for w in own) for at in range(len(padded) - MAX_GRAM + 1))
        return [pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())]

    counted = written(_mapped(words, "gram string, places long", rows).groupBy("gram").agg(F.sum("places").alias("places")), "spelling-grams")
    total = counted.agg(F.sum("places")).first()[0] or 0
    return {r["gram"] for r in counted.filter(F.col("places") > max(least, total // most)).select("gram").collect()}


def rarity(words: DataFrame, frequent: set[str]) -> np.ndarray:
    """How often the grams of the decomposed words occur, in 2**RARITY_BITS counters that grams share by hash: an order of rarity of bounded size."""
    known = words.sparkSession.sparkContext.broadcast(frequent)

    def rows(own: list[str]) -> list[pa.Array]:
        counts = np.bincount([_counter(gram) for w in own for gram in decomposed(w, known.value)], minlength=1)
        at = np.flatnonzero(counts)
        return [pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))]

    out = np.zeros(1 << RARITY_BITS, np.int64)
    for at, n in _mapped(words, "at int, n long", rows).groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[at] = n
    return out


def _counter(gram: str) -> int:
    return zlib.crc32(gram.encode()) & ((1 << RARITY_BITS) - 1)


def lists(words: DataFrame) -> DataFrame:
    """(key, word, n): the lists of the index; each word is in those of its bound + 1 rarest grams.

    A list is one gram with all that is left of it, or with all that is right of it, told by 64 bits; what two of them
    share by chance is verified like everything else.
    """
    frequent = frequent_grams(words)
    known = words.sparkSession.sparkContext.broadcast((frequent, rarity(words, frequent)))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rare = known.value
        for batch in found:
            starts, ends = [], []
            for w in batch.column(0).to_pylist():
                grams = decomposed(w, frequent)
                order = sorted(range(len(grams)), key=lambda at: (rare[_counter(grams[at])], grams[at], at))[: affected(grams) + 1]
                starts.append(order)
                ends.append([at + len(grams[at]) for at in order])
            placed = [pa.array(places, pa.list_(pa.int32())) for places in (starts, ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *placed], names=["word", "n", "starts", "ends"])

    chosen = words.select("word", "n").mapInArrow(batches, "word string, n long, starts array<int>, ends array<int>")
    placed = chosen.select("word", "n", F.explode(F.arrays_zip("starts", "ends")).alias("gram"))
    padded = f"concat(word, '{PAD * (MAX_GRAM - 1)}')"
    left = F.expr(f"xxhash64('left', gram.starts, substring({padded}, 1, gram.ends))")
    right = F.expr(f"xxhash64('right', gram.ends - gram.starts, substring({padded}, gram.starts + 1, length({padded})))")
    return placed.select(F.explode(F.array(left, right)).alias("key"), "word", "n")


def merged(words: list[str]) -> set[tuple[str, str]]:
    """Pairs of the given words that differ by one edit, each once.

    The letter that differs lies behind the words' common start and before their common end, so only those are left out in turn.
    """
    known = set(words)
    least, most = min(known), max(known)
    start = next((i for i, (x, y) in enumerate(zip(least, most)) if x != y), len(least))
    turned = [w[::-1] for w in known]
    least, most = min(turned), max(turned)
    end = next((i for i, (x, y) in enumerate(zip(least, most)) if x != y), len(least))
    found: set[tuple[str, str]] = set()
    places: dict[tuple[int, str], list[str]] = {}
    for w in known:
        for at in range(start, len(w)) if start >= end else range(len(w) - end):
            rest = w[:at] + w[at + 1:]
            if rest in known:
                found.add((rest, w))
            places.setdefault((at, rest), []).append(w)
    for own in places.values():
        if len(own) > 1:
            own.sort()
            found.update((a, b) for i, a in enumerate(own) for b in own[i + 1:])
    return found


def _met(entries: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b, n_a, n_b): near words of each list, whose length is bounded."""
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            out: list[tuple[str, str, int, int]] = []
            for own in batch.column(0).to_pylist():
                n = {x["word"]: x["n"] for x in own}
                out.extend((a, b, n[a], n[b]) for a, b in merged(list(n)))
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["a", "b", "n_a", "n_b"])

    grouped = entries.groupBy(*keys).agg(F.collect_list(F.struct("word", "n")).alias("words")).filter(F.size("words") > 1).select("words")
    return grouped.mapInArrow(batches, "a string, b string, n_a long, n_b long")


def near_pairs(words: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """(a, b, n_a, n_b), once each, of all words that differ by exactly one inserted, deleted or replaced code point.

    A list of more than `long_list` words is not gathered: its words are dealt by themselves and by what they are without one
    letter, which as many words share as the alphabet and a word's length allow, however long the list is.
    """
    entries = written(lists(words), "spelling-lists")
    long = written(entries.groupBy("key").count().filter(F.col("count") > long_list).select("key"), "spelling-long")
    if long.isEmpty():
        return _met(entries, ["key"]).distinct()
    stems = F.expr("transform(sequence(1, length(word)), i -> xxhash64(concat(substring(word, 1, i - 1), substring(word, i + 1, length(word)))))")
    dealt = entries.join(long, "key", "left_semi").withColumn("rest", F.explode(F.array_distinct(F.array_append(stems, F.xxhash64("word")))))
    return _met(entries.join(long, "key", "left_anti"), ["key"]).union(_met(dealt, ["key", "rest"])).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of `forms` (word, form): the last word that forms lead to.

    Each round doubles the steps taken; a form is at least twice as frequent as its word, so a few rounds suffice.
    """
    reached = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = written(step, "spelling-roots")
        reached = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return reached


def variants(docs: DataFrame, min_count: int = MIN_COUNT, dominance: int = DOMINANCE, long_list: int = LONG_LIST) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the texts that is long and frequent enough.

    Words are letter runs with A-Z lowered (see `vocabulary`). Two are near if one insertion, deletion or replacement of a code
    point turns one into the other. The form is the near word of largest n, the smallest in code-point order of equals, if its n is
    `dominance` times the word's own at least; root follows forms to the last. Words without a form have null and are their
    own root. Null and empty texts have no words; repeated rows count each time; an empty table gives an empty result. Columns
    other than doc_id and text are not read.
    """
    words = written(vocabulary(docs, min_count), "spelling-words")
    near = near_pairs(words, long_list)
    ends = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("form"), F.col("n_b").alias("form_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("form"), F.col("n_a").alias("form_n"))))
    both = near.select(ends.alias("end")).select("end.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("order"), "form")).alias("best"))
    told = words.join(best, "word", "left")
    taken = -F.col("best.order") >= dominance * F.col("n")
    told = told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                       F.when(taken, F.col("best.form")).alias("form"), F.when(taken, -F.col("best.order")).alias("form_n"))
    told = written(told, "spelling-forms")
    last = roots(told.filter("form IS NOT NULL").select("word", "form"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

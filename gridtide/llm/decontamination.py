"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words build one automaton, which every task makes for itself. Items with more words than one
automaton is to hold are dealt out to several, and the texts pass one after the other. Training words stream through it; the length of the longest match that ends at each
word says which windows of items end there. Stretches of a text without a short run of item words can't
advance the automaton far enough to matter; they are skipped with array operations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.llm.store import written
from gridtide.llm.words import Words, alphanumeric, byte_values, chunks, run_hash, run_starts, run_sums, words

WINDOW = 10
MOST_ITEM_WORDS = 2_000_000
PIECES = 20
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
SEED_RUN = 4


class SuffixAutomaton:
    """All word runs of the items. `owners(state, length)` are the items in which a run of that state occurs."""

    def __init__(self, items: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self._items: list[set[int]] = [set()]
        for number, item in enumerate(items):
            state = 0
            for word in item:
                state = self._extend(state, word)
            self._mark(item, number)

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self._items.append(set())
        return len(self.next) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """The state of the runs of `target` that are no longer than those `state` leads to."""
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._state(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self._items[clone] |= self._items[target]
        self.link[target] = clone
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return self._split(last, word, known)
        fresh = self._state(self.length[last] + 1, {}, 0)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = fresh
            state = self.link[state]
        if state >= 0:
            self.link[fresh] = self._split(state, word, self.next[state][word])
        return fresh

    def _mark(self, item: list[int], number: int) -> None:
        """Notes the item at every state that one of its prefixes ends in, and at their suffixes."""
        state = 0
        for word in item:
            state = self.next[state][word]
            at = state
            while at > 0 and number not in self._items[at]:
                self._items[at].add(number)
                at = self.link[at]

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """The longest match that ends with `word`, after a match of `length` at `state`."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        follow = self.next[state].get(word)
        return (follow, length + 1) if follow is not None else (0, 0)

    def shortened(self, state: int, length: int) -> int:
        """The state of the suffix of that length of a match at `state`."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def owners(self, state: int) -> set[int]:
        return self._items[state]


class Matcher:
    """Occurrences of item windows in texts: `window` consecutive item words, or a whole shorter item."""

    def __init__(self, item_ids: list, texts: list[str | None], window: int = WINDOW):
        self.window, self.ids = window, item_ids
        w = words(pa.array(texts, pa.string()), alphanumeric(), byte_values(lower=True))
        own = [w.hash[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:])]
        self.automaton = SuffixAutomaton(own)
        sizes = [len(x) for x in own if x]
        self.least = min([window, *sizes]) if sizes else window
        self.run = min(SEED_RUN, self.least)
        seeds = run_starts(w, self.run)
        self.seeds = np.unique(run_hash(run_sums(w.hash), seeds, self.run)) if len(seeds) else np.zeros(0, np.uint64)
        self.short: dict[int, list[tuple[int, int]]] = {}
        for number, item in enumerate(own):
            if 0 < len(item) < window:
                state = 0
                for word in item:
                    state = self.automaton.next[state][word]
                self.short.setdefault(state, []).append((len(item), number))
        self.short_sizes = sorted({n for x in self.short.values() for n, _ in x})

    def stretches(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of words (begin, end) of one text in which all runs of `self.run` words are runs of items."""
        starts = run_starts(w, self.run)
        if not len(starts) or not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashed = run_hash(run_sums(w.hash), starts, self.run)
        at = np.searchsorted(self.seeds, hashed)
        starts = starts[self.seeds[np.minimum(at, len(self.seeds) - 1)] == hashed]
        if not len(starts):
            return starts, starts
        fresh = np.flatnonzero((np.diff(starts) != 1) | (w.row[starts[1:]] != w.row[starts[:-1]])) + 1
        begin = starts[np.concatenate([[0], fresh])]
        end = starts[np.concatenate([fresh - 1, [len(starts) - 1]])] + self.run
        wide = end - begin >= self.least
        return begin[wide], end[wide]

    def spans(self, stretch: list[int]) -> Iterator[tuple[int, int, set[int]]]:
        """(begin, end, items) of every window of an item that the words hold."""
        automaton, state, length = self.automaton, 0, 0
        for at, word in enumerate(stretch):
            state, length = automaton.step(state, length, word)
            if length >= self.window:
                yield at + 1 - self.window, at + 1, automaton.owners(automaton.shortened(state, self.window))
            for size in self.short_sizes:
                if size > length:
                    break
                found = {number for n, number in self.short.get(automaton.shortened(state, size), ()) if n == size}
                if found:
                    yield at + 1 - size, at + 1, found

    def matches(self, column: pa.Array) -> tuple[Words, np.ndarray, list[set[int]]]:
        """Words of the texts, which of them are hit, and per row the items with occurring windows."""
        w = words(column, alphanumeric(), byte_values(lower=True))
        hit, found = np.zeros(len(w.hash) + 1, np.int64), [set() for _ in range(len(column))]
        for begin, end in zip(*(x.tolist() for x in self.stretches(w))):
            for a, b, items in self.spans(w.hash[begin:end].tolist()):
                hit[begin + a] += 1
                hit[begin + b] -= 1
                found[w.row[begin]] |= items
        return w, np.cumsum(hit)[:-1] > 0, found


def dealt_items(items: DataFrame, window: int = WINDOW, most: int = MOST_ITEM_WORDS) -> tuple[DataFrame, int]:
    """(item_id, text, deal) of the items, and the number of deals, each of about `most` words or fewer.

    Items of more than `most` / PIECES words are cut into pieces that overlap by `window` - 1 words, so every
    window lies in one piece. Pieces go to a deal by hash.
    """
    found = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    listed = items.select("item_id", "text", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n"))
    total = listed.agg(F.sum("n")).first()[0] or 0
    deals = -(-total // most)
    if deals <= 1:
        return listed.select("item_id", "text", F.lit(0).alias("deal")), 1
    piece = max(most // PIECES, window)
    cut = F.transform(F.array(found), lambda own: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(own) - window) / piece).cast("int")),
        lambda at: F.array_join(F.slice(own, at * piece + 1, piece + window - 1), " ")))[0]
    parts = listed.select("item_id", F.explode(F.when(F.col("n") > piece, cut).otherwise(F.array("text"))).alias("text"))
    return written(parts.withColumn("deal", F.pmod(F.xxhash64("text"), F.lit(deals))), "decontamination-items"), deals


def _digest(names: list[str]) -> tuple[int, str]:
    return len(names), hashlib.sha256(",".join(names).encode()).hexdigest()


SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
NAMES = pa.list_(pa.string())


def _ranges(hit: np.ndarray) -> list[tuple[int, int]]:
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).reshape(-1, 2).tolist()


def _verdicts(part: pa.Array, w: Words, hit: np.ndarray, names: list[list[str]], max_span: int, max_coverage: float) -> list[pa.Array]:
    """The columns that `scan` adds."""
    counts, all_spans, cleaned = np.bincount(w.row[hit], minlength=len(part)), [], []
    for row in range(len(part)):
        a, b = int(w.first[row]), int(w.first[row + 1])
        spans, whole = [], None
        if counts[row]:
            spans = [(x, y) for x, y in _ranges(hit[a:b]) if y - x > max_span]
        if counts[row] <= max_coverage * max(b - a, 1):
            whole = part[row].as_py()
            if spans:
                whole = _without(w, a, spans, row)
        all_spans.append([{"begin": x, "end": y} for x, y in spans])
        cleaned.append(whole)
    digests = [_digest(x) for x in names]
    return [pa.array(np.diff(w.first).astype(np.int64)), pa.array(counts.astype(np.int64)), pa.array([n for n, _ in digests], pa.int64()),
            pa.array([d for _, d in digests], pa.string()), pa.array(all_spans, SPANS), pa.array(cleaned, pa.string())]


def _notes(part: pa.Array, w: Words, hit: np.ndarray, names: list[list[str]]) -> list[pa.Array]:
    """What one deal hands to the next: ranges of hit words, names of items, the text."""
    some = np.bincount(w.row[hit], minlength=len(part)) > 0
    spans = [[{"begin": x, "end": y} for x, y in _ranges(hit[int(w.first[r]): int(w.first[r + 1])])] if some[r] else [] for r in range(len(part))]
    return [pa.array(spans, SPANS), pa.array(names, NAMES), part]


def scan(docs: DataFrame, items: DataFrame, carried: tuple[str, ...] = ("doc_id",), window: int = WINDOW,
         max_span: int = 0, max_coverage: float = 1.0, most: int = MOST_ITEM_WORDS) -> DataFrame:
    """One row per row of `docs`: `carried`, n_words, n_hit, n_items, items_sha256, spans, cleaned.

    Words are runs of ASCII letters (case ignored), digits and non-ASCII characters. `spans` are the
    merged ranges (begin, end in words) of hit words that are longer than `max_span`; `cleaned` is the
    text without them, or null if more than `max_coverage` of its words are hit. A null text has no words
    and is cleaned to null; an empty one stays empty. Items without words match nothing; repeated items
    count by their ids. Without items nothing is hit. Columns of other names are not read.

    Items of more than `most` words are dealt out; each deal is one more pass over the texts, which are
    written with what was found so far. Only one deal is on the driver at a time.
    """
    added = "n_words long, n_hit long, n_items long, items_sha256 string, spans array<struct<begin:int,end:int>>, cleaned string"
    between = "hits_ array<struct<begin:int,end:int>>, names_ array<string>, text_ string"
    kept = T.StructType([docs.schema[c] for c in carried])
    parts, deals = dealt_items(items, window, most)
    rows = docs.select(*carried, F.col("text").alias("text_"))
    for deal in range(deals):
        listed = parts.filter(F.col("deal") == deal).select("item_id", "text").collect()
        known = docs.sparkSession.sparkContext.broadcast(([str(r["item_id"]) for r in listed], [r["text"] for r in listed]))
        last = deal == deals - 1
        own = T.StructType.fromDDL(added if last else between)

        def columns(part: pa.Array, w: Words, hit: np.ndarray, found: list[list[str]], last: bool = last) -> list[pa.Array]:
            return _verdicts(part, w, hit, found, max_span, max_coverage) if last else _notes(part, w, hit, found)

        rows = rows.mapInArrow(_pass(known, window, len(carried), deal > 0, columns, [*carried, *own.names]), T.StructType(kept.fields + own.fields))
        if not last:
            rows = written(rows, "decontamination-deal")
    return rows


def _pass(known, window: int, n_carried: int, noted: bool, columns: Callable, names: list[str]) -> Callable:
    """The texts against one deal of items. With `noted`, batches hold what earlier deals found."""
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(*known.value, window=window)
        for batch in found:
            text = batch.column(batch.num_columns - 1)
            for begin, end in chunks(text):
                part = text.slice(begin, end - begin)
                w, hit, items_of = matcher.matches(part)
                own = [{matcher.ids[i] for i in x} for x in items_of]
                if noted:
                    hits, before = (batch.column(n_carried + i).slice(begin, end - begin).to_pylist() for i in (0, 1))
                    for row, (spans, ids) in enumerate(zip(hits, before)):
                        own[row].update(ids)
                        for span in spans:
                            hit[int(w.first[row]) + span["begin"]: int(w.first[row]) + span["end"]] = True
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(begin, end - begin) for i in range(n_carried)]
                                                 + columns(part, w, hit, [sorted(x) for x in own]), names=names)

    return batches


def _without(w: Words, first: int, spans: list[tuple[int, int]], row: int) -> str:
    """The text of a row without the bytes from the first to the last word of each span."""
    at, parts = int(w.offsets[row]), []
    for x, y in spans:
        parts.append(w.data[at: int(w.begin[first + x])].tobytes())
        at = int(w.end[first + y - 1])
    parts.append(w.data[at: int(w.offsets[row + 1])].tobytes())
    return b"".join(parts).decode()

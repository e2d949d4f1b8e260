"""Removal of long repeated word runs by a compacted de Bruijn graph.

The graph's edges are windows of 35 words. Consecutive windows of a text whose least anchor (a run of 16
words, by hash) is the same piece of text form one path; a path is told by the hash of all its words.
Paths are joined by anchor. Where all paths of an anchor are the same, the path doesn't branch: it is
compacted, and all its windows repeat if it occurs twice. Where paths branch, one copy of each distinct
path is taken apart into its windows again, and these are joined one by one. Source coordinates (row
key, word position) lead back to the texts, from which the covered words are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.llm.store import partitions, word_count, written
from gridtide.llm.words import Words, byte_values, chunks, mix, not_space, run_hash, run_starts, run_sums, words

WINDOW = 35
ANCHOR = 16
FLUSH_ENTRIES = 1 << 20
BUCKET_ENTRIES = 1 << 20
COVERED, TAKE_APART, SOURCE = 0, 1, 2
#: anchor, path, row key, first window, windows; seen: the path is known to occur elsewhere.
ENTRY = np.dtype([("anchor", "<u8"), ("path", "<u8"), ("rid", "<i8"), ("start", "<u4"), ("count", "<u2"), ("seen", "u1")])
#: The same between tasks: the bucket tells the low bits of the anchor, the high ones travel.
SENT = np.dtype([("anchor", "<u4"), *ENTRY.descr[1:]])
SPAN = np.dtype([("rid", "<i8"), ("start", "<u4"), ("count", "<u2")])
POSITION_BITS = 26


def row_key():
    """A key of id and text; equal rows share it and are treated alike."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def sliding_least(x: np.ndarray, length: int) -> np.ndarray:
    """Least of every `length` consecutive values."""
    have = 1
    while have < length:
        step = min(have, length - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def least_at(x: np.ndarray, length: int) -> np.ndarray:
    """Positions of the least of every `length` consecutive values, told by their high bits, the first of equals.

    Position and high bits share a word, so long arrays are taken in overlapping stretches.
    """
    mask = np.uint64((1 << POSITION_BITS) - 1)
    step, out = (1 << POSITION_BITS) - length + 1, []
    for begin in range(0, len(x) - length + 1, step):
        part = x[begin: begin + step + length - 1]
        ranked = (part & ~mask) | np.arange(len(part), dtype=np.uint64)
        out.append((sliding_least(ranked, length) & mask).astype(np.int64) + begin)
    return np.concatenate(out)


def paths(w: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor hash, path hash) of the maximal runs of windows with one least anchor."""
    starts = run_starts(w, window)
    if not len(starts):
        return starts, starts, starts.astype(np.uint64), starts.astype(np.uint64)
    sums = run_sums(w.hash)
    hashed = run_hash(sums, np.arange(len(w.hash) - anchor + 1), anchor)
    at = least_at(hashed, window - anchor + 1)[starts]
    fresh = np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(at) != 0) | (w.row[starts[1:]] != w.row[starts[:-1]])])
    begin = np.flatnonzero(fresh)
    count = np.diff(np.append(begin, len(starts)))
    first = starts[begin]
    return first, count, hashed[at[begin]], run_hash(sums, first, count + window - 1)


def _entries(anchor, path, rid, start, count, seen) -> np.ndarray:
    out = np.empty(len(path), ENTRY)
    out["anchor"], out["path"], out["rid"], out["start"], out["count"], out["seen"] = anchor, path, rid, start, count, seen
    return out


def packed(entries: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Entries by bucket of their anchor, one row per bucket.

    Paths that occur twice among these entries are settled here: their spans go on as covered, and one
    entry stands for all of them. So a path, however frequent, has one entry per batch of entries.
    """
    order = np.lexsort((entries["path"], entries["anchor"]))
    entries = entries[order]
    begin = np.flatnonzero(np.concatenate([[True], (entries["anchor"][1:] != entries["anchor"][:-1]) | (entries["path"][1:] != entries["path"][:-1])]))
    count = np.diff(np.append(begin, len(entries)))
    again = np.repeat(count > 1, count)
    spans = np.empty(int(again.sum()), SPAN)
    for name in SPAN.names:
        spans[name] = entries[name][again]
    one = entries[begin].copy()
    one["seen"] |= (count > 1).astype(np.uint8)
    bucket = (one["anchor"] % np.uint64(buckets)).astype(np.int64)
    one["anchor"] >>= np.uint64(32)
    one = one[np.argsort(bucket, kind="stable")].astype(SENT)
    names, at = np.unique(np.sort(bucket), return_index=True)
    home = (mix(spans["rid"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    spans = spans[np.argsort(home, kind="stable")]
    places, place_at = np.unique(np.sort(home), return_index=True)
    blobs = [one[a:b].tobytes() for a, b in zip(at.tolist(), [*at[1:].tolist(), len(one)])]
    settled = [spans[a:b].tobytes() for a, b in zip(place_at.tolist(), [*place_at[1:].tolist(), len(spans)])]
    return pa.RecordBatch.from_arrays(
        [pa.array([*names.tolist(), *places.tolist()], pa.int32()), pa.array([False] * len(names) + [True] * len(places)),
         pa.array([*blobs, *settled], pa.binary())], names=["bucket", "settled", "entries"])


def _spans(rid, start, count, kind) -> pa.Table:
    return pa.table([pa.array(rid, pa.int64()), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(kind.astype(np.int8))],
                    names=["rid", "start", "count", "kind"])


def settled(table: pa.Table, branching: bool) -> pa.Table:
    """Spans (rid, start, count, kind) of a bucket's entries.

    Covered: the path occurs elsewhere. With `branching`, one copy of each path whose anchor has several
    is to be taken apart, either because its windows are not settled (TAKE_APART) or for the others (SOURCE).
    """
    blobs, done = table.column("entries").to_pylist(), table.column("settled").to_pylist()
    parts = [np.frombuffer(b, SPAN) for b, d in zip(blobs, done) if d]
    out = [_spans(p["rid"], p["start"], p["count"], np.full(len(p), COVERED)) for p in parts]
    entries = np.concatenate([np.zeros(0, SENT), *[np.frombuffer(b, SENT) for b, d in zip(blobs, done) if not d]])
    if len(entries):
        entries = entries[np.lexsort((entries["seen"], entries["path"], entries["anchor"]))]
        anchor, path = entries["anchor"], entries["path"]
        fresh_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        fresh = fresh_anchor | np.concatenate([[True], path[1:] != path[:-1]])
        of_path = np.cumsum(fresh) - 1
        count = np.bincount(of_path)
        seen = np.maximum.reduceat(entries["seen"], np.flatnonzero(fresh)) > 0
        again = (count > 1) | seen
        own = again[of_path] & (entries["seen"] == 0)
        out.append(_spans(entries["rid"][own], entries["start"][own], entries["count"][own], np.full(int(own.sum()), COVERED)))
        if branching:
            first = np.flatnonzero(fresh)
            of_anchor = (np.cumsum(fresh_anchor) - 1)[first]
            branched = np.bincount(of_anchor)[of_anchor] > 1
            e = entries[first[branched]]
            out.append(_spans(e["rid"], e["start"], e["count"], np.where(again[branched], SOURCE, TAKE_APART)))
    return pa.concat_tables(out) if out else _spans(*(np.zeros(0, np.int64) for _ in range(4)))


def _resolved(entries: DataFrame, branching: bool) -> DataFrame:
    def work(table: pa.Table) -> pa.Table:
        return settled(table, branching)

    return entries.groupBy("bucket").applyInArrow(work, "rid long, start int, count int, kind byte")


def _flushed(made: Iterator[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    parts, held = [], 0
    for entries in made:
        parts.append(entries)
        held += len(entries)
        if held >= FLUSH_ENTRIES:
            yield packed(np.concatenate(parts), buckets)
            parts, held = [], 0
    if held:
        yield packed(np.concatenate(parts), buckets)


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(rid, start, count): every run of `count` windows from word `start` on that also occur elsewhere.

    rid is `row_key`. A window is `window` consecutive words `[^\\x20\\x09-\\x0D]+` of one text. Null, empty and
    short texts have none.
    """
    texts = docs.select(row_key().alias("rid"), "text")
    total = docs.agg(F.sum(word_count(F.col("text")))).first()[0] or 0
    buckets = max(partitions(docs), -(-total // (8 * BUCKET_ENTRIES)))

    def all_paths(found: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in found:
            for begin, end in chunks(batch.column(1)):
                w = words(batch.column(1).slice(begin, end - begin), not_space(), byte_values())
                rid = batch.column(0).slice(begin, end - begin).to_numpy()
                first, count, anchors, path = paths(w, window, anchor)
                row = w.row[first]
                yield _entries(anchors, path, rid[row], first - w.first[row], count, 0)

    def emit(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _flushed(all_paths(found), buckets)

    by_path = written(_resolved(texts.mapInArrow(emit, "bucket int, settled boolean, entries binary"), True), "substring-paths")
    apart = by_path.filter(F.col("kind") != COVERED).groupBy("rid").agg(F.collect_set(F.struct("start", "count", "kind")).alias("parts"))
    opened = texts.join(apart, "rid").select("rid", "text", "parts.start", "parts.count", "parts.kind")

    def all_windows(found: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in found:
            for begin, end in chunks(batch.column(1)):
                size = end - begin
                w = words(batch.column(1).slice(begin, size), not_space(), byte_values())
                rid = batch.column(0).slice(begin, size).to_numpy()
                starts, counts, kinds = (batch.column(i).slice(begin, size) for i in (2, 3, 4))
                row = np.repeat(np.arange(size), [len(x) for x in starts])
                start, count, kind = (x.flatten().to_numpy().astype(np.int64) for x in (starts, counts, kinds))
                each = np.repeat(np.arange(len(start)), count)
                at = (start + w.first[row])[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                path = run_hash(run_sums(w.hash), at, window)
                own = row[each]
                # A source is marked as seen: it settles others, and needs no settling itself.
                yield _entries(mix(path ^ np.uint64(0x2545F4914F6CDD1D)), path, rid[own], at - w.first[own], 1, kind[each] == SOURCE)

    def emit_windows(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _flushed(all_windows(found), buckets)

    single = _resolved(opened.mapInArrow(emit_windows, "bucket int, settled boolean, entries binary"), False)
    return by_path.filter(F.col("kind") == COVERED).union(single).select("rid", "start", "count")


def deduplicated(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and spans (begin, end in words) of every row of `docs`.

    Every word is removed that a window covers whose words also start anywhere else, in the same text
    too; all occurrences go, judged on the input. Null and empty texts have no words and the digest of
    the empty text. Repeated rows repeat each other, so from `window` words on they lose everything.
    Other columns are not read; an empty table gives an empty result.
    """
    spans = written(repeated_spans(docs, window, anchor), "substring-spans")
    per_text = spans.groupBy("rid").agg(F.collect_set(F.struct("start", "count")).alias("parts"))
    joined = docs.select("doc_id", "text", row_key().alias("rid")).join(per_text, "rid", "left").select("doc_id", "text", "parts.start", "parts.count")

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            out = [removed(*x, window) for x in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))))],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])

    return joined.mapInArrow(batches, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, kept_sha256 string, spans array<struct<begin:int,end:int>>")


def removed(text: str | None, start: list[int] | None, count: list[int] | None, window: int) -> tuple[int, int, str, list[dict]]:
    """Words, removed words, digest of the kept words and the removed ranges of a text."""
    found = (text or "").encode().split()
    ranges: list[list[int]] = []
    for a, n in sorted(zip(start or (), count or ())):
        if ranges and a <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], a + n + window - 1)
        else:
            ranges.append([a, a + n + window - 1])
    kept, at = [], 0
    for a, b in ranges:
        kept += found[at:a]
        at = b
    kept = kept + found[at:] if ranges else found
    return len(found), len(found) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), [{"begin": a, "end": b} for a, b in ranges]

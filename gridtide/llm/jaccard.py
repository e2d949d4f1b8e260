"""Near-duplicate join on word shingles by parity sketches.

A document's shingles are XOR-hashed into the lanes of a sketch whose width is that of its size band. Two
sketches differ in no more lanes than the sets have different shingles, so by the pigeonhole principle
two documents that link agree on one of the first d + 1 lanes of either, in any order that is the same
for all documents, where d bounds the difference of linked sets. Rare shingles come first in that order.
Lanes that agree give groups of candidates. A one-bit-per-slot parity sketch then rejects pairs by its
Hamming distance, and the shingle sets themselves decide.

Groups are not expanded into pairs. First every document is compared with one centre of its groups;
groups whose members are then connected need no more. In the other groups, members are compared by sketch
inside blocks of bounded size, which gives links between components that may join: as many as there
are components, not pairs. Components that may join form a cluster. In a cluster every document proposes
its nearest one of another component by a wider sketch, for some rounds; what still may link after
these is verified pair by pair. No pair within a component is ever looked at again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.llm.components import connected
from gridtide.llm.store import partitions, written
from gridtide.llm.words import byte_values, chunks, mix, not_space, run_hash, run_starts, run_sums, words

SHINGLE = 5
COUNTERS = 1 << 16
BUCKET_ENTRIES = 1 << 20
FLUSH_ENTRIES = 1 << 21
BLOCK = 1024
LEAST_WIDTH = 64
WIDER = 4
ROUNDS = 2
SMALL = 64
ENTRY = np.dtype([("key", "<u4"), ("cid", "<u8")])


def bands(n: np.ndarray) -> np.ndarray:
    """The upper limit of each set size's band: the next power of two."""
    return np.left_shift(1, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


def shingle_sets(column: pa.Array, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles, ordered by row and hash. A shorter text is one shingle as a whole."""
    w = words(column, not_space(), byte_values(lower=True))
    counts, sums = np.diff(w.first), run_sums(w.hash)
    starts = run_starts(w, length)
    short = np.flatnonzero((counts > 0) & (counts < length))
    hashed = np.concatenate([run_hash(sums, starts, length), run_hash(sums, w.first[short], counts[short])])
    row = np.concatenate([w.row[starts], short])
    order = np.lexsort((hashed, row))
    row, hashed = row[order], hashed[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (hashed[1:] != hashed[:-1])
    return row[fresh], hashed[fresh]


def set_ids(row: np.ndarray, hashed: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit id of every row's set; equal sets have equal ids."""
    sizes = np.bincount(row, minlength=rows)
    sums = np.zeros(rows, np.uint64)
    np.add.at(sums, row, mix(hashed ^ np.uint64(0x5851F42D4C957F2D)))
    return sizes, mix(sums + sizes.astype(np.uint64))


def rarity_levels(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Logarithm of how often each of COUNTERS hash slots is used by shingles of all documents, and the number of shingles.

    Its size is fixed. It only orders lanes, so collisions cost speed and never a link.
    """
    def counted(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in found:
            for begin, end in chunks(batch.column(0)):
                _, hashed = shingle_sets(batch.column(0).slice(begin, end - begin))
                total += np.bincount((hashed >> np.uint64(48)).astype(np.int64), minlength=COUNTERS)
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(total[slots])], names=["slot", "n"])

    rows = docs.select("text").mapInArrow(counted, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(COUNTERS, np.int64)
    for r in rows:
        total[r["slot"]] = r["n"]
    return np.log2(np.maximum(total, 1)).astype(np.int8), int(total.sum())


def lane_entries(row: np.ndarray, hashed: np.ndarray, sizes: np.ndarray, cids: np.ndarray, width: np.ndarray,
                 most: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, cid) of the first `most` + 1 lanes in use of every row's sketch with `width` lanes (0: the row takes no part).

    Small bands have as many lanes as hash values, so that each shingle has its own.
    """
    part = width[row] > 0
    row, hashed = row[part], hashed[part]
    if not len(row):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    lanes = np.where(width <= SMALL, 1 << 30, width)
    lane = (hashed >> np.uint64(8)) % lanes[row].astype(np.uint64)
    order = np.lexsort((lane, row))
    row, hashed, lane = row[order], hashed[order], lane[order]
    begin = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (lane[1:] != lane[:-1])]))
    parity = np.bitwise_xor.reduceat(mix(hashed), begin)
    level = np.minimum.reduceat(levels[(hashed >> np.uint64(48)).astype(np.int64)], begin)
    held = np.diff(np.append(begin, len(row)))
    row, lane = row[begin], lane[begin]
    key = mix(parity ^ mix(lane + (width[row].astype(np.uint64) << np.uint64(32))))
    order = np.lexsort((key, -held, level, row))
    row, key = row[order], key[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    first = place <= most[row]
    return key[first], cids[row[first]]


def document_entries(column: pa.Array, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of a chunk of documents: in their own band, and in the band below if a partner can lie there."""
    row, hashed = shingle_sets(column)
    sizes, cids = set_ids(row, hashed, len(column))
    own = np.where(sizes > 0, bands(sizes), 0)
    below = np.where((own > 1) & (3 * sizes <= 2 * own), own // 2, 0)
    parts = [lane_entries(row, hashed, sizes, cids, own, sizes // 3, levels),
             lane_entries(row, hashed, sizes, cids, below, (sizes + below) // 7, levels)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def candidate_members(docs: DataFrame) -> DataFrame:
    """(gid, cid, center) for the members of all groups of different sets that agree on a lane; center is the group's least cid.

    Entries travel packed, by key range ("bucket"); the number of buckets grows with the number of
    shingles, so that a bucket holds about BUCKET_ENTRIES. Groups with the same members share a gid.
    """
    levels, shingles = rarity_levels(docs)
    buckets = max(partitions(docs), -(-shingles // (2 * BUCKET_ENTRIES)))
    known = docs.sparkSession.sparkContext.broadcast(levels)

    def packed(parts: list) -> pa.RecordBatch:
        key, cid = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.lexsort((cid, key))
        key, cid = key[order], cid[order]
        once = np.concatenate([[True], (key[1:] != key[:-1]) | (cid[1:] != cid[:-1])])  # copies of a set count once
        key, cid = key[once], cid[once]
        bucket = (key % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        entries = np.empty(len(key), ENTRY)
        entries["key"], entries["cid"] = (key >> np.uint64(32))[order], cid[order]
        names, begin = np.unique(bucket[order], return_index=True)
        ends = [*begin[1:].tolist(), len(entries)]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(
            [entries[a:b].tobytes() for a, b in zip(begin.tolist(), ends)], pa.binary())], names=["bucket", "entries"])

    def emit(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in found:
            for begin, end in chunks(batch.column(0)):
                parts.append(document_entries(batch.column(0).slice(begin, end - begin), known.value))
                held += len(parts[-1][0])
                if held >= FLUSH_ENTRIES:
                    yield packed(parts)
                    parts, held = [], 0
        if held:
            yield packed(parts)

    def grouped(table: pa.Table) -> pa.Table:
        entries = np.concatenate([np.frombuffer(x, ENTRY) for x in table.column("entries").to_pylist()])
        order = np.lexsort((entries["cid"], entries["key"]))
        entries = entries[order]
        entries = entries[np.concatenate([[True], entries[1:] != entries[:-1]])]
        key, cid = entries["key"], entries["cid"]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(begin, len(key)))
        gid = mix(np.add.reduceat(mix(cid), begin) + count.astype(np.uint64))
        several = np.flatnonzero(count > 1)
        several = several[np.unique(gid[several], return_index=True)[1]]
        size = count[several]
        at = np.repeat(begin[several] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(several) else np.zeros(0, np.int64)
        return pa.table([np.repeat(gid[several], size).view(np.int64), cid[at].view(np.int64),
                         np.repeat(cid[begin[several]], size).view(np.int64)], names=["gid", "cid", "center"])

    entries = docs.select("text").mapInArrow(emit, "bucket int, entries binary")
    return entries.groupBy("bucket").applyInArrow(grouped, "gid long, cid long, center long").dropDuplicates(["gid", "cid"])


def _parity(row: np.ndarray, hashed: np.ndarray, width: np.ndarray) -> pa.Array:
    """Per row the parity of how many shingles fall on each of its `width` slots, as packed bits."""
    offset = np.concatenate([[0], np.cumsum(width)])
    slots = np.bincount(offset[row] + (hashed % width[row].astype(np.uint64)).astype(np.int64), minlength=offset[-1])
    bits = np.packbits((slots & 1).astype(np.uint8), bitorder="little").tobytes()
    cut = (offset // 8).tolist()
    return pa.array([bits[a:b] for a, b in zip(cut[:-1], cut[1:])], pa.binary())


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, cid, n, bits, wide) of every row: its set's id, size and parity bits, by its band's width and WIDER times that."""
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for begin, end in chunks(batch.column(1)):
                part = batch.column(1).slice(begin, end - begin)
                row, hashed = shingle_sets(part)
                sizes, cids = set_ids(row, hashed, len(part))
                width = np.maximum(bands(sizes), LEAST_WIDTH)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), pa.array(cids.view(np.int64)), pa.array(sizes.astype(np.int64)),
                     _parity(row, hashed, width), _parity(row, hashed, width * WIDER)], names=["doc_id", "cid", "n", "bits", "wide"])

    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {dict(docs.dtypes)['doc_id']}, cid long, n long, bits binary, wide binary")


def folded(bits: bytes, width: int) -> np.ndarray:
    """The parity bits at a smaller width: slots that fall together are XORed."""
    out = np.frombuffer(bits, np.uint64)
    while len(out) * 64 > width:
        out = out[: len(out) // 2] ^ out[len(out) // 2:]
    return out


def may_link(n_a: int, bits_a: bytes, n_b: int, bits_b: bytes) -> bool:
    """Whether sizes and parity bits allow 100 * common >= 75 * all: a lower bound, so no link is lost."""
    if 4 * min(n_a, n_b) < 3 * max(n_a, n_b):
        return False
    width = 8 * min(len(bits_a), len(bits_b))
    return 7 * int(np.bitwise_count(folded(bits_a, width) ^ folded(bits_b, width)).sum()) <= n_a + n_b


def _passing(joined: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows (a, b, n_a, bits_a, n_b, bits_b) that may link."""
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            a, b, *rest = (batch.column(i) for i in range(6))
            keep = [may_link(*x) for x in zip(*(c.to_pylist() for c in rest))]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(batches, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of set ids that link, by their shingle sets. `classes` has cid and doc_id, a document with that set."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(classes.select("cid", "doc_id"), "cid")

    def sets(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for begin, end in chunks(batch.column(1)):
                part = batch.column(1).slice(begin, end - begin)
                row, hashed = shingle_sets(part)
                _, cids = set_ids(row, hashed, len(part))
                own = batch.column(0).slice(begin, end - begin).to_numpy() == cids.view(np.int64)
                cut = np.searchsorted(row, np.arange(len(part) + 1)).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(cids.view(np.int64)), pa.array(
                    [hashed[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], names=["cid", "hashes"]).filter(pa.array(own))

    texts = docs.select("doc_id", "text").join(wanted, "doc_id").select("cid", "text")
    held = texts.mapInArrow(sets, "cid long, hashes binary").dropDuplicates(["cid"])
    left = pairs.join(held.select(F.col("cid").alias("b"), F.col("hashes").alias("of_b")), "b")
    both = left.join(held.select(F.col("cid").alias("a"), F.col("hashes").alias("of_a")), "a")

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * common >= 75 * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "of_a", "of_b").mapInArrow(batches, "a long, b long")


def _blocks(members: DataFrame, key: str, sketches: DataFrame) -> DataFrame:
    """Members (key, cid, comp) of groups dealt into blocks of about BLOCK, once per pair of blocks, with their sketches (cid, n, bits)."""
    sizes = members.groupBy(key).agg(F.count("*").alias("size"))
    dealt = members.join(sizes, key).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("long"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select(F.col(key).alias("gid"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "cid", "comp")
    dealt = dealt.join(sketches, "cid").select("gid", "low", "high", "block", "cid", "comp", "n", "bits")
    keys = ["gid", "low", "high"]
    return dealt.repartition(partitions(members), *keys).sortWithinPartitions(*keys)


def _near(rows: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, those of another component that row i may link with, their distances) in a pair of blocks."""
    low, high = rows.column(1)[0].as_py(), rows.column(2)[0].as_py()
    block, cid, comp, n = (rows.column(i).to_numpy() for i in (3, 4, 5, 6))
    if (comp == comp[0]).all():
        return
    bits = rows.column(7).to_pylist()
    width = 8 * min(map(len, bits))
    sketch = np.stack([folded(x, width) for x in bits])
    for i in range(len(cid)):
        fit = (comp != comp[i]) & (4 * np.minimum(n, n[i]) >= 3 * np.maximum(n, n[i]))
        if low != high:
            fit &= block != block[i]
        j = np.flatnonzero(fit)
        if len(j):
            distance = np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1, dtype=np.int64)
            near = 7 * distance <= n[j] + n[i]
            if near.any():
                yield i, j[near], distance[near]


def _bridges(rows: pa.RecordBatch) -> list[tuple[int, int, int]]:
    """Pairs of components that tie together all those of the block pair that may link, one fewer than there are at most."""
    comp = rows.column(5).to_numpy()
    root = {c: c for c in comp.tolist()}
    out = []
    for i, j, _ in _near(rows):
        for other in np.unique(comp[j]).tolist():
            x, y = comp[i].item(), other
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((comp[i].item(), other, 0))
    return out


def _nearest(rows: pa.RecordBatch) -> list[tuple[int, int, int]]:
    """For every row the nearest one of another component that it may link with."""
    cid = rows.column(4).to_numpy()
    out = []
    for i, j, distance in _near(rows):
        at = np.lexsort((cid[j], distance))[0]
        out.append((cid[i].item(), cid[j[at]].item(), int(distance[at])))
    return out


def _possible(rows: pa.RecordBatch) -> list[tuple[int, int, int]]:
    """All pairs of different components that may link, each once."""
    cid = rows.column(4).to_numpy()
    return [(cid[i].item(), other, 0) for i, j, _ in _near(rows) for other in cid[j].tolist() if other > cid[i]]


def _compared(blocks: DataFrame, work) -> DataFrame:
    """(a, b, distance) that `work` finds in each pair of blocks."""
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in found:
            pairs, rest = _runs(batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0], work, last=False)
            yield _triples(pairs)
        if rest is not None:
            yield _triples(_runs(rest, work, last=True)[0])

    return blocks.mapInArrow(batches, "a long, b long, distance long")


def _triples(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in range(3)], names=["a", "b", "distance"])


def _runs(rows: pa.RecordBatch, work, last: bool) -> tuple[list, pa.RecordBatch | None]:
    """`work` on every run of equal (gid, low, high); the last run is handed back unless it is complete."""
    if not rows.num_rows:
        return [], None
    keys = np.stack([rows.column(i).to_numpy() for i in range(3)], axis=1)
    begin = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    out = []
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(keys)]):
        if b == len(keys) and not last:
            return out, rows.slice(a, b - a)
        if b - a > 1:
            out += work(rows.slice(a, b - a))
    return out, None


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _placed(members: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Members (key, cid) of the groups that hold several components, with their component."""
    placed = written(members.join(found, "cid", "left").select(key, "cid", F.coalesce("comp", "cid").alias("comp")), "jaccard-placed")
    mixed = placed.groupBy(key).agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x != y").select(key)
    return written(placed.join(mixed, key, "left_semi"), "jaccard-mixed")


def _clusters(members: DataFrame, found: DataFrame, sketches: DataFrame) -> DataFrame:
    """(cluster, cid) of the documents in groups of several components, where components that may link share a cluster."""
    mixed = _placed(members, found, "gid")
    bridges = _compared(_blocks(mixed, "gid", sketches), _bridges)
    joined = connected(bridges.select("a", "b")).select(F.col("cid").alias("comp"), F.col("comp").alias("cluster"))
    return written(mixed.select("cid", "comp").distinct().join(joined, "comp").select("cluster", "cid"), "jaccard-clusters")


def linked(docs: DataFrame, rows: DataFrame, members: DataFrame) -> DataFrame:
    """(cid, comp) of all sets with a link. rows: `digests`; members: `candidate_members`."""
    some = rows.filter("n > 0")
    classes = written(some.groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.first("bits").alias("bits")), "jaccard-classes")
    sketches = classes.select("cid", "n", "bits")

    def agreed(pairs: DataFrame) -> DataFrame:
        return written(verified(pairs, docs, classes), "jaccard-links")

    stars = members.filter("cid != center").groupBy("cid").agg(F.min("center").alias("a")).withColumnRenamed("cid", "b")
    passing = stars.join(sketches.toDF("b", "n_b", "bits_b"), "b").join(sketches.toDF("a", "n_a", "bits_a"), "a")
    tried = written(_passing(passing), "jaccard-tried")
    links = agreed(tried)
    found = connected(links)
    clusters = _clusters(members, found, sketches)
    wide = some.join(clusters.select("cid").distinct(), "cid", "left_semi").select("cid", "n", F.col("wide").alias("bits")).dropDuplicates(["cid"])
    wide = written(wide, "jaccard-wide")
    for step in range(ROUNDS + 1):
        mixed = _placed(clusters, found, "cluster")
        if mixed.isEmpty():
            break
        blocks = _blocks(mixed, "cluster", wide)
        if step < ROUNDS:
            best = _compared(blocks, _nearest).groupBy("a").agg(F.min_by("b", F.struct("distance", "b")).alias("b"))
        else:
            best = _compared(blocks, _possible)
        fresh = written(_ordered(best).join(_ordered(tried), ["a", "b"], "left_anti"), "jaccard-tried")
        if not fresh.isEmpty():
            tried, links = tried.union(fresh), links.union(agreed(fresh))
            found = connected(links)
    return found


def join_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `docs`.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lowered; a document's set has its distinct 5-word shingles, or
    the whole sequence if it is shorter. Two documents link when 100 * common >= 75 * all. component_id is
    the least doc_id that links reach. Null or empty texts link with nothing and are their own component.
    Rows are told by a hash of id and text, so rows without an id link like others, and hand on links; they name a
    component only if all its rows lack an id, which is null then. Repeated rows are repeated in the result. Other
    columns are not read; an empty table gives an empty result.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    rows = digests(keyed.select(F.struct("doc_id", "key").alias("doc_id"), "text")).select(F.col("doc_id.doc_id").alias("own_id"), F.col("doc_id.key").alias("doc_id"), "cid", "n", "bits", "wide")
    rows = written(rows, "jaccard-digests")
    members = written(candidate_members(docs), "jaccard-members")
    found = linked(keyed.select(F.col("key").alias("doc_id"), "text"), rows, members)
    named = rows.join(found, "cid", "left").select(F.col("own_id").alias("doc_id"), "n", F.coalesce("comp", "cid").alias("comp"))
    named = written(named, "jaccard-named")
    least = named.filter("n > 0").groupBy("comp").agg(F.min("doc_id").alias("least"))
    out = named.join(least, "comp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))

"""Language identification by unigram models over the pieces of a fixed public vocabulary.

Every language has a probability for each piece. The probability of a word is the sum over all its
segmentations into pieces, which the forward algorithm gives in one pass; a text's score is the sum of
its words' logarithms. The piece probabilities are fitted by expectation maximisation on a bounded
sample of labelled texts. Each distinct word of a batch is scored once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtide.llm.words import Words, byte_values, chunks, mix, powers, words

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
MOST_SAMPLED = 800
MOST_LANGUAGES = 500
SHORT = 8
ROUNDS = 4
FILTER_BITS = 22
LONG_WORD = 512
STRETCH = 1 << 16
RESCALED = 16
LEAST, MOST = 1e-300, 1e280


def word_bytes() -> np.ndarray:
    """Bytes of words: ASCII letters and everything beyond ASCII."""
    keep = np.zeros(256, bool)
    keep[0x41:0x5B] = keep[0x61:0x7B] = keep[0x80:] = True
    return keep


def read_pieces(path: str = VOCABULARY) -> list[bytes]:
    """Lower-case letter pieces from a file of base64 pieces and ranks, and all single word bytes."""
    pieces = {bytes([b]) for b in np.flatnonzero(word_bytes())}
    with open(path, "rb") as lines:
        for line in lines:
            piece = base64.b64decode(line.split()[0]).lstrip(b" ")
            try:
                text = piece.decode()
            except UnicodeDecodeError:
                continue
            if text.isalpha() and text == text.lower():
                pieces.add(piece)
    return sorted(pieces)


class Pieces:
    """Looks up pieces by the hash of their bytes."""

    def __init__(self, pieces: list[bytes]):
        self.count, self.longest = len(pieces), max(map(len, pieces))
        self.lengths = sorted({len(p) for p in pieces})
        hashed = self._hashed(pieces)
        self.starts = np.unique(self._hashed(sorted({p[:SHORT] for p in pieces if len(p) > SHORT})))
        self.number = np.argsort(hashed, kind="stable")
        self.sorted = hashed[self.number]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(hashed >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def _hashed(self, pieces: list[bytes]) -> np.ndarray:
        values, (up, _) = byte_values(), powers(16)
        sums = np.array([np.sum(values[np.frombuffer(p, np.uint8)] * up[: len(p)], dtype=np.uint64) for p in pieces], np.uint64)
        return np.concatenate([self._mixed(sums[i: i + 1], len(p)) for i, p in enumerate(pieces)]) if pieces else sums

    def long_from(self, sums: np.ndarray) -> np.ndarray:
        """Whether the SHORT bytes from each byte on are the start of a longer piece."""
        out = np.zeros(len(sums), bool)
        if len(sums) > SHORT and len(self.starts):
            _, down = powers(len(sums))
            hashed = self._mixed((sums[SHORT:] - sums[:-SHORT]) * down[: len(sums) - SHORT], SHORT)
            at = np.minimum(np.searchsorted(self.starts, hashed), len(self.starts) - 1)
            out[: len(hashed)] = self.starts[at] == hashed
        return out

    @staticmethod
    def _mixed(sums: np.ndarray, length: int) -> np.ndarray:
        return mix(sums + np.uint64(length * 0x9E3779B97F4A7C15 % (1 << 64)))

    def find(self, sums: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
        """Numbers of the pieces at bytes begin .. begin + length - 1, or -1."""
        _, down = powers(len(sums))
        hashed = self._mixed((sums[begin + length] - sums[begin]) * down[begin], length)
        out = np.full(len(begin), -1, np.int64)
        likely = np.flatnonzero(self.filter[(hashed >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.sorted, hashed[likely]), len(self.sorted) - 1)
        own = self.sorted[at] == hashed[likely]
        out[likely[own]] = self.number[at[own]]
        return out


class WordTable:
    """Distinct words, longest first, with the pieces that end at each of their byte positions."""

    def __init__(self, w: Words, pieces: Pieces):
        self.word, first, self.of = np.unique(w.hash, return_index=True, return_inverse=True)
        size = (w.end - w.begin)[first]
        order = np.argsort(-size, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.of, self.size, self.begin, self.pieces = place[self.of], size[order], w.begin[first][order], pieces
        values = byte_values()[w.data]
        up, _ = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])
        self.long = pieces.long_from(self.sums)
        self.known: list | None = None

    def steps(self) -> Iterator[tuple[int, int, list[tuple[int, np.ndarray, np.ndarray]]]]:
        """For each position i: how many words are that long, and (length, words with a piece of that length that ends there, the pieces)."""
        for i in range(1, int(self.size[0]) + 1 if len(self.size) else 1):
            active = int(np.searchsorted(-self.size, -i, side="right"))
            begin = self.begin[:active]
            ending = []
            for n in self.pieces.lengths:
                if n > i:
                    break
                at = np.arange(active) if n <= SHORT else np.flatnonzero(self.long[begin + (i - n)])
                if len(at):
                    piece = self.pieces.find(self.sums, begin[at] + (i - n), n)
                    some = np.flatnonzero(piece >= 0)
                    if len(some):
                        ending.append((n, at[some], piece[some]))
            yield i, active, ending

    def walked(self) -> list:
        """All `steps`, kept for passes that repeat them."""
        if self.known is None:
            self.known = list(self.steps())
        return self.known


def log_likelihoods(table: WordTable, probability: np.ndarray) -> np.ndarray:
    """Logarithm of each distinct word's probability per language: the sum over all segmentations.

    `probability` has a row per piece and a last one of zeros, for no piece. Sums are rescaled for each word and language, so a
    language that is far less likely than another keeps its digits. Long words are walked one by one.
    """
    languages, longest = probability.shape[1], table.pieces.longest
    out = np.zeros((len(table.size), languages))
    alone = int(np.searchsorted(-table.size, -LONG_WORD))
    for at in range(alone):
        out[at] = _walked_alone(table, at, probability)
    rest = copy(table)
    rest.size, rest.begin, rest.known = table.size[alone:], table.begin[alone:], None
    ring = {0: np.ones((len(rest.size), languages))}
    scale = np.zeros((len(rest.size), languages))
    for i, active, ending in rest.steps():
        total = np.zeros((active, languages))
        for n, some, piece in ending:
            total[some] += ring[i - n][some] * probability[piece]
        ring[i] = total
        ring.pop(i - longest, None)
        done = np.flatnonzero(rest.size[:active] == i)
        out[alone + done] = np.log(np.maximum(total[done], LEAST)) + scale[done]
        if i % RESCALED == 0:
            most = np.maximum(total, LEAST)
            scale[:active] += np.log(most)
            ring = {k: np.minimum(v[:active] / most, MOST) for k, v in ring.items()}
    return out


def _walked_alone(table: WordTable, at: int, probability: np.ndarray) -> np.ndarray:
    """`log_likelihoods` of one word: its pieces are looked up for all places at once, by stretches, and then summed place by place."""
    begin, size, longest = int(table.begin[at]), int(table.size[at]), table.pieces.longest
    ring, scale = np.zeros((longest + 1, probability.shape[1])), np.zeros(probability.shape[1])
    ring[0] = 1.0
    for first in range(1, size + 1, STRETCH):
        ends = np.arange(first, min(first + STRETCH, size + 1))
        found = []
        for n in table.pieces.lengths:
            own = ends[ends >= n]
            own = own if n <= SHORT else own[table.long[begin + own - n]]
            piece = table.pieces.find(table.sums, begin + own - n, n) if len(own) else own
            some = piece >= 0
            found.append((own[some], np.full(int(some.sum()), n), piece[some]))
        end, length, piece = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(end, kind="stable")
        source, weight = ((end - length) % (longest + 1))[order], probability[piece[order]]
        cuts = np.searchsorted(end[order], np.append(ends, ends[-1] + 1)).tolist()
        for i, a, b in zip(ends.tolist(), cuts[:-1], cuts[1:]):
            total = (ring[source[a:b]] * weight[a:b]).sum(axis=0)
            ring[i % (longest + 1)] = total
            if i % RESCALED == 0:
                most = np.maximum(total, LEAST)
                scale += np.log(most)
                ring = np.minimum(ring / most, MOST)
    return np.log(np.maximum(ring[size % (longest + 1)], LEAST)) + scale


def expected_counts(table: WordTable, counts: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """How often one language uses each piece, over all segmentations of words that occur `counts` times.

    `probability` has one number per piece. Both passes are rescaled per word every 16 bytes, so words may have any length.
    """
    longest = table.pieces.longest
    scale = np.zeros(len(table.size))
    forward, scales, steps, ring = [np.ones(len(table.size))], [scale], [], {0: np.ones(len(table.size))}
    for i, active, ending in table.walked():
        total = np.zeros(active)
        for n, some, piece in ending:
            total[some] += ring[i - n][some] * probability[piece]
        ring[i] = total
        ring.pop(i - longest, None)
        forward.append(total)
        scales.append(scale)
        steps.append(ending)
        if i % 16 == 0:
            most = np.maximum(total, 1e-300)
            scale = scale[:active] + np.log(most)
            ring = {k: v[:active] / most for k, v in ring.items()}
    use = np.zeros(len(probability))
    backward = {}
    for i in range(len(steps), 0, -1):
        back = backward.pop(i, None)
        back = np.zeros(len(forward[i])) if back is None else back
        done = np.flatnonzero(table.size[: len(back)] == i)
        back[done] += counts[done] / forward[i][done]
        for n, some, piece in steps[i - 1]:
            flow = probability[piece] * back[some]
            if scales[i] is not scales[i - n]:
                flow *= np.exp(scales[i - n][some] - scales[i][some])
            into = backward.setdefault(i - n, np.zeros(len(forward[i - n])))
            into[some] += flow
            np.add.at(use, piece, flow * forward[i - n][some])
    return use


def fit(texts: list[str], languages: list[str], pieces: Pieces, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Names of the languages and their piece probabilities, by expectation maximisation over the given texts of each."""
    names = sorted(set(languages))
    probability = np.zeros((pieces.count + 1, len(names)))
    for k, name in enumerate(names):
        w = words(pc.utf8_lower(pa.array([t for t, x in zip(texts, languages) if x == name], pa.string())), word_bytes(), byte_values())
        table = WordTable(w, pieces)
        counts = np.bincount(table.of, minlength=len(table.size)).astype(float)
        own = np.full(pieces.count, 1.0 / pieces.count)
        for _ in range(rounds):
            use = expected_counts(table, counts, own) + 0.05
            own = use / use.sum()
        probability[:-1, k] = own
    return names, probability


def sample(docs: DataFrame, most: int = MOST_SAMPLED) -> list:
    """Text and lang of at most `most` rows to learn from, an equal share of each language, by hash of id and text.

    Rows with a null lang or text, and held-out rows, are not learned from. More than MOST_LANGUAGES languages are refused.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return []
    share = max(1, most // len(counts))
    # A hash threshold leaves little more than a share of each language before any rows are ranked.
    likely = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, 1.0 if n <= 4 * share else 2.0 * share / n)))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    some = known.select("lang", "text", place.alias("at")).filter(F.col("at") <= likely[F.col("lang")])
    ranked = some.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("at", "text")))
    return ranked.filter(F.col("place") <= share).select("lang", "text").collect()


def held_out():
    """Whether crc32 of the id as text leaves 2 when divided by 4; false without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, vocabulary: str = VOCABULARY, most: int = MOST_SAMPLED) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of `docs`.

    The prediction reads the whole text only; score is its probability among the learned languages, all
    equally likely at first. A null text, one without a letter, or any text when nothing was learned is
    `und` with score 0. Ties go to the first language by code points. Repeated rows get equal results.
    """
    pieces = read_pieces(vocabulary)
    learned = sample(docs, most)
    names, probability = fit([r["text"] for r in learned], [r["lang"] for r in learned], Pieces(pieces)) if learned else ([], None)
    known = docs.sparkSession.sparkContext.broadcast((pieces, names, probability))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, names, probability = known.value
        finder = Pieces(listed)
        for batch in found:
            for begin, end in chunks(batch.column(2)):
                part = batch.column(2).slice(begin, end - begin)
                lettered = pc.fill_null(pc.match_substring_regex(part, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                best, score = _scored(part, names, probability, finder) if names else (np.zeros(len(part), int), np.zeros(len(part)))
                told = [names[b] if names and ok else "und" for b, ok in zip(best.tolist(), lettered.tolist())]
                score = np.where(lettered, score, 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(begin, end - begin) for i in (0, 1)] + [pa.array(told, pa.string()), pa.array(score)],
                                                 names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(batches, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def _scored(column: pa.Array, names: list[str], probability: np.ndarray, finder: Pieces) -> tuple[np.ndarray, np.ndarray]:
    w = words(pc.utf8_lower(column), word_bytes(), byte_values())
    table = WordTable(w, finder)
    each = log_likelihoods(table, probability)[table.of]
    sums = np.stack([np.bincount(w.row, weights=each[:, k], minlength=len(column)) for k in range(len(names))], axis=1)
    best = sums.argmax(axis=1)
    odds = np.exp(sums - sums.max(axis=1, keepdims=True))
    return best, odds[np.arange(len(column)), best] / odds.sum(axis=1)


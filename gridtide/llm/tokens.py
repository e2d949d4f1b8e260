"""Token counts of texts: batch encoding in Arrow functions that return lengths only.

Texts are cut where their tokenizer certainly starts anew, so the parts' counts add up to the text's. A
long text is first taken in pieces of about PIECE_BYTES; pieces of many texts fill batches of about
BATCH_BYTES, and the distinct parts of a batch are encoded together, each once. Nothing but a number per
text leaves the task. Parquet scans deal out rows by bytes, so tasks are balanced by bytes too.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
PIECE_BYTES = 64 << 10
BATCH_BYTES = 1 << 20

MOST_KNOWN = 400_000

#: A byte-level tokenizer starts anew at white space after anything else. ASCII white space is so to every library; what
#: Python takes for no white space is none to any.
BYTE_LEVEL_CUT = re.compile(r"(?<=\S)(?=[ \t\n\r])")
#: A long run without white space: letters never run on with anything but letters, digits with anything but digits. A bar is
#: left alone, as special tokens hold some.
BYTE_LEVEL_CLASS_CUT = regex.compile(r"(?<=\p{L})(?=[^\p{L}|])|(?<=\p{N})(?=[^\p{N}|])|(?<=\S)(?=[ \t\n\r])")
#: One space between word characters; the part after it begins with the same mark as a text does.
WORD_MARK_CUT = re.compile(r"(?<=[^\W_]) (?=[^\W_])")


class Encoder:
    """Token counts of a list of texts, and the places at which a longer text may be cut."""

    def __init__(self, vocabulary: str = VOCABULARY):
        """`vocabulary`: a file of the public tokenizers by name, or a path that every executor has."""
        if not os.path.isabs(vocabulary):
            import public_tokenizers

            vocabulary = public_tokenizers.path(vocabulary)
        self.count, self.cut, self.long_cut = (self._sentence_pieces if vocabulary.endswith(".model") else self._tokenizers)(vocabulary)
        self.known: dict[str, int] = {}

    @staticmethod
    def _tokenizers(path: str) -> tuple:
        # Each task has one core; threads of the library's own would take those of its neighbours.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(path)
        coder.no_truncation()
        coder.no_padding()
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        before = form.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not form.get("normalizer")
        whole = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or BYTE_LEVEL_CLASS_CUT.search(t["content"])) for t in form.get("added_tokens", []))
        cuts = (BYTE_LEVEL_CUT, BYTE_LEVEL_CLASS_CUT) if plain and whole else (None, None)
        return (lambda texts: [len(x) for x in coder.encode_batch_fast(texts, add_special_tokens=False)], *cuts)

    @staticmethod
    def _sentence_pieces(path: str) -> tuple:
        import sentencepiece

        coder = sentencepiece.SentencePieceProcessor(model_file=path)
        inside = any("▁" in coder.id_to_piece(i).strip("▁") for i in range(coder.get_piece_size()))
        marked = coder.encode("a", out_type=str)[:1] == ["▁a"]
        cut = WORD_MARK_CUT if marked and not inside else None
        return lambda texts: [len(x) for x in coder.encode(texts, num_threads=1)], cut, cut

    def pieces(self, text: str, most: int = PIECE_BYTES) -> Iterator[str]:
        """Parts of `text` whose counts add up to its own: each reaches the first safe boundary beyond `most` / 4 code points.

        A code point has 4 bytes at most, so a part exceeds `most` bytes only where the text has no safe boundary.
        """
        step, begin = max(1, most // 4), 0
        while self.long_cut is not None and len(text) - begin > step:
            found = self.long_cut.search(text, begin + step)
            if found is None:
                break
            yield text[begin: found.start()]
            begin = found.end()
        yield text[begin:]

    def counts(self, texts: pa.Array, piece_bytes: int = PIECE_BYTES, batch_bytes: int = BATCH_BYTES) -> np.ndarray:
        """Tokens of each text; null has none. Counts of parts are kept for the next batches, as many as MOST_KNOWN and a batch has."""
        out = np.zeros(len(texts), np.int64)
        held: list[tuple[int, list[str]]] = []
        size = 0
        for row in range(len(texts)):
            text = texts[row].as_py()
            for piece in self.pieces(text, piece_bytes) if text else ():
                held.append((row, self.cut.split(piece) if self.cut else [piece]))
                size += len(piece)
                if 4 * size >= batch_bytes:
                    self._add(out, held)
                    held, size = [], 0
        self._add(out, held)
        return out

    def _add(self, out: np.ndarray, held: list[tuple[int, list[str]]]) -> None:
        if len(self.known) > MOST_KNOWN:
            self.known.clear()
        fresh = list(set().union(*(parts for _, parts in held)).difference(self.known))
        self.known.update(zip(fresh, self.count(fresh) if fresh else ()))
        for row, parts in held:
            out[row] += sum(map(self.known.__getitem__, parts))


def token_lengths(vocabulary: str = VOCABULARY, piece_bytes: int = PIECE_BYTES, batch_bytes: int = BATCH_BYTES) -> Callable[[Column], Column]:
    """A column function: the tokens of a text as a long; null has 0."""

    @F.arrow_udf("long")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(vocabulary)
        for texts in batches:
            yield pa.array(encoder.counts(texts, piece_bytes, batch_bytes), pa.int64())

    return lengths


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of `docs`, over its whole text.

    No begin, end or other special tokens are added; strings of special tokens inside a text count as the
    library takes them. A null text is empty: 0 bytes, 0 tokens. Repeated rows are repeated in the result.
    Other columns are not read; an empty table gives an empty result.
    """
    counted = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), token_lengths(vocabulary)(F.col("text")).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

"""Spelling variants, whitening and token counts against plain versions, on the small tables and on odd rows."""

import os
import random
import sys

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from gridtide.llm import spelling, tokens, whitening  # noqa: E402
from gridtide.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD = [
    (1, ""), (2, None), (3, "Été Élève élève ÉLÈVE Ãbcde÷×"), (4, "kitten kitten KITTEN sitten sitten sitten kitte kitte kitte"), (5, "one"), (5, "one"),
    (6, " \n \t"), (7, "y" * 70_000), (8, "abcde " * 20_000), (None, "kitten kittens kittens kittens"), (None, None), (9, "aaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaa aaaaaa aaaaaaa " * 4),
    (10, "ababab babab ababa " * 9), (11, "x<|endoftext|>y <|endoftext|>\n\n  z\u00a0 \x1c\u2003q 12ab's"), (12, "\u4e2d\u6587" * 3000),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, "w", 1, "k") for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, word string, n int, key string")


def spelled(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# spelling variants


def test_variants_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute.variants(pairs(docs))
    assert any(v[2] for v in want.values())
    assert spelled(QUERIES["op11_spelling_variants"](spark, SF)) == want


@pytest.mark.parametrize("long_list", [1, 4096])
def test_variants_of_odd_rows(odd, long_list):
    want = brute.variants(ODD)
    assert len(want) > 5
    assert spelled(spelling.variants(odd, long_list=long_list)) == want
    assert spelling.variants(odd.limit(0)).count() == 0
    assert spelling.variants(odd.filter("text IS NULL")).count() == 0


def test_near_words_share_a_list(spark):
    """All edits of random words over two letters, where grams repeat and most are frequent; no list is left whole."""
    random.seed(3)
    words = sorted({"".join(random.choice("abé") for _ in range(random.randint(5, 8))) for _ in range(700)})
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    want = {(a, b) for a in words for b in words if a < b and brute.edited_once(a, b)}
    for long_list in (2, 10_000):
        assert {tuple(sorted((r["a"], r["b"]))) for r in spelling.near_pairs(df, long_list).collect()} == want


def test_dictionary_is_bounded(spark):
    words = spark.createDataFrame([(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}", 3) for i in range(600)], "word string, n long")
    frequent = spelling.frequent_grams(words, most=20, least=1)
    assert frequent and len(frequent) <= 20
    assert spelling.decomposed("wordaa", frequent)[0] == "word"


def test_no_edit_touches_more_grams_than_the_bound():
    random.seed(5)
    frequent = {"ab", "ba", "aba", "bb"}
    for _ in range(300):
        word = "".join(random.choice("abc") for _ in range(random.randint(5, 9)))
        grams = spelling.decomposed(word, frequent)
        bound = spelling.affected(grams)
        assert bound < len(grams)
        at = random.randrange(len(word) + 1)
        for other in (word[:at] + "z" + word[at:], word[:at] + word[at + 1:], word[:at] + "z" + word[at + 1:]):
            kept = {(i, g) for i, g in enumerate(spelling.decomposed(other, frequent))}
            shift = len(other) - len(word)
            assert sum((i, g) in kept or (i + shift, g) in kept for i, g in enumerate(grams)) >= len(grams) - bound


# whitening


def reference(vectors, wanted=4):
    x = np.floor(256 * np.array(vectors, dtype=float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1][:wanted], q[:, ::-1][:, :wanted]
    return n, ((n * x.astype(object) - total) ** 2).sum(axis=1).tolist(), (x - total / n) @ q / np.sqrt(e), e / np.trace(centred.T @ centred / n)


def check_whitened(rows, ids, vectors, wanted=4):
    n, deviation, whitened, explained = reference(vectors, wanted)
    found = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(rows) == len(ids) * wanted
    for k in range(wanted):
        own = np.array([found[i, k + 1]["whitened"] for i in ids])
        sign = 1 if (own * whitened[:, k]).sum() > 0 else -1
        assert np.abs(sign * own - whitened[:, k]).max() < 1e-9
    for i, d in zip(ids, deviation):
        for k in range(wanted):
            r = found[i, k + 1]
            assert (r["n"], r["deviation"]) == (n, d)
            assert r["explained"] == pytest.approx(explained[k], rel=1e-9)
            assert r["identity_error"] < 1e-9


def test_whitening_of_the_table(spark):
    known = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check_whitened(QUERIES["op12_whitening"](spark, SF).collect(), [r["vec_id"] for r in known], [list(r["embedding"]) for r in known])


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(7)
    good = [[float(v) for v in row] for row in rng.normal(size=(60, 6)) * [9, 5, 3, 2, 1, 1]]
    good += good[:20] + [good[0]] * 50
    ids = list(range(len(good)))
    bad = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [float("nan")] * 6), (904, [float("inf")] * 6), (905, [1.0, 2.0]), (906, [1e300] * 6)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in zip(ids, good)] + [(i, v, "x", 1) for i, v in bad], "vec_id long, embedding array<double>, component string, n int")
    check_whitened(whitening.whiten(df).collect(), ids, good)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.filter("vec_id = 0")).count() == 0
    two = whitening.whiten(df.filter("vec_id IN (0, 1)")).collect()
    assert {r["component"] for r in two} == {1} and sorted(round(r["whitened"], 9) for r in two) == [-1.0, 1.0]


def test_components_of_close_and_equal_eigenvalues():
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.normal(size=(200, 200)))[0]
    e = np.concatenate(([5, 2.0, 2.0, 1.1, 1.0999], np.linspace(1, 0.5, 195)))
    v = (turn * e) @ turn.T
    calls = []

    def product(q):
        calls.append(q.shape[1])
        return v @ q

    q, found, residual = whitening.components(product, 200)
    assert np.abs(found - e[:4]).max() < 1e-12 and residual < 1e-12
    assert np.abs(v @ q - q * found).max() < 1e-11 and abs(abs(q[:, 3] @ turn[:, 3]) - 1) < 1e-9
    assert len(calls) < 120


def test_deviation_beyond_a_long():
    x = np.array([[1 << 40, 0], [0, 0]])
    fitted = whitening.Whitener(2, np.array([1 << 40, 0], dtype=object), np.eye(2), np.ones(2), 1.0, 0.0)
    assert whitening.deviations(x, fitted) == [1 << 80, 1 << 80]


# token counts


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: len(coder.encode(text or "", add_special_tokens=False).ids)


def test_tokens_of_the_table(spark, library):
    texts = dict(pairs(spark.read.parquet(f"{SF}/documents.parquet")))
    rows = QUERIES["op13_token_counts"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = library(texts[r["doc_id"]])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((texts[r["doc_id"]] or "").encode()), n, n > 512)


def test_tokens_of_odd_rows(odd, library):
    rows = sorted(map(repr, ((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in tokens.count_tokens(odd).collect())))
    assert rows == sorted(map(repr, ((i, len((t or "").encode()), library(t)) for i, t in ODD)))
    assert tokens.count_tokens(odd.limit(0)).count() == 0


ALPHABET = ["a", "b", "'s", "'t", " ", "  ", "\n", "\t", "1", "23", "é", "字", "，", "<|endoftext|>", "|", "<", "!", "'", "\u0301", "🙂", "ll", "x" * 9, "\u200b",
            "٣", "\x1c", "\x85", "\u00a0", "\u2003", "\u3000"]


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"])
def test_cut_texts_count_as_whole_ones(vocabulary):
    random.seed(2)
    coder = tokens.Encoder(vocabulary)
    texts = ["".join(random.choice(ALPHABET) for _ in range(random.randint(1, 80))) for _ in range(1500)]
    want = [coder.count([t])[0] for t in texts]
    for piece, batch in ((4, 16), (40, 1 << 20)):
        assert coder.counts(pa.array(texts), piece, batch).tolist() == want


def test_one_very_long_text(library):
    text = "Un texte sans fin, 12 fois répété; " * 20_000
    assert tokens.Encoder().counts(pa.array([text, None])).tolist() == [library(text), 0]

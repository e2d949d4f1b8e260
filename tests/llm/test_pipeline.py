"""Each stage of the pipeline against a plain version on its own input, and the whole on odd and empty tables."""

import os
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from gridtide.llm import mixing, quality  # noqa: E402
from gridtide.llm.store import written  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Input and result of every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = written(stage(spark, docs, SF), "test-stage")
        out.append((docs.collect(), made.collect(), made.columns))
        docs = made
    return out


def ids(rows):
    return Counter(r["doc_id"] for r in rows)


def test_all_but_the_last_keep_the_columns(stages):
    assert len(stages) == 5 and all(columns == COLUMNS for _, _, columns in stages[:-1])


def test_quality_stage(spark, stages):
    given, made, _ = stages[0]
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    counted = quality.statistics(frame, "doc_id")
    rules = quality.fit(counted, spark.read.parquet(f"{SF}/labels.parquet"))
    verdict = {r["doc_id"]: r["keep"] for r in counted.withColumn("keep", quality.decision_list(rules)).collect()}
    assert ids(made) == Counter(r["doc_id"] for r in given if not brute.quality(r["text"])[5] and verdict[r["doc_id"]])
    assert Counter(made) <= Counter(given) and 0 < len(made) < len(given)


def test_near_duplicate_stage(stages):
    given, made, _ = stages[1]
    component = {i: c for i, (_, c) in brute.components([(r["doc_id"], r["text"]) for r in given]).items()}
    assert ids(made) == Counter(i for i, c in component.items() if i == c) and len(made) < len(given)


def test_leak_stage(spark, stages):
    given, made, _ = stages[2]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = brute.contamination([(r["doc_id"], r["text"]) for r in given], items)
    assert ids(made) == Counter(i for i, (_, hit, _, _) in found.items() if not hit)


def test_mix_stage(spark, stages):
    given, made, _ = stages[3]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(given)).collect()}
    assert ids(made) == +Counter(copies)
    size = Counter()
    for r in given:
        size[r["source"]] += len(brute.words(r["text"]))
    taken = Counter()
    for r in made:
        taken[r["source"]] += len(brute.words(r["text"]))
    longest = max(len(brute.words(r["text"])) for r in given)
    assert all(abs(taken[s] - t) <= longest for s, t in brute.targets(size).items())


def test_shard_stage(stages):
    given, made, _ = stages[4]
    assert ids(made) == ids(given)
    slots = {}
    for r in made:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


ODD = [(1, None, "en", "a", 0), (2, "", None, "a", 0), (3, "short", "en", None, 5), (3, "short", "en", None, 5), (None, "no id " * 40, "en", "b", 9),
       (4, " ".join(f"w{i}" for i in range(80)), "en", "b", 9), (5, " ".join(f"w{i}" for i in range(81)), "en", "c", 9), (6, " ".join(f"v{i % 70}" for i in range(9000)), "en", "c", 9),
       (None, None, None, None, None)]


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_stages_on_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = docs.withColumns({"n_words": F.lit(0), "size": F.lit("x"), "row": F.lit(1), "a b": F.lit(2), "kept": F.lit(False), "copies": F.lit(9)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, extra, SF)
        assert got.columns == extra.columns, name
        assert set(ids(got.collect())) <= set(ids(rows and docs.collect()))
    assert corpus_pipeline.shards(spark, docs, SF).count() == len(rows)
    if rows:
        kept = ids(corpus_pipeline.near_duplicates(spark, docs, SF).collect())
        assert kept[4] == 1 and kept[5] == 0 and kept[None] == 2 and kept[1] == 1


def test_near_duplicates_among_repeats_null_ids_and_reused_ids(spark):
    text = [" ".join(f"{c}{i}" for i in range(80)) for c in "abcde"]
    near = [t + " more" for t in text]
    rows = [(1, text[0])] * 5 + [(2, near[0])] + [(None, text[1])] * 3 + [(None, near[1])] + [(7, text[2]), (None, near[2])]
    rows += [(8, text[3]), (9, near[3]), (9, text[4])] + [(4, "")] * 2 + [(None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    lost = [(None, t) for t in (text[1], near[1])]
    assert sum(got[x] for x in lost) == 1
    assert {k: n for k, n in got.items() if k not in lost} == {(1, text[0]): 1, (7, text[2]): 1, (8, text[3]): 1, (9, text[4]): 1, (4, ""): 2, (None, None): 2}

"""Line deduplication by spread over sites (DataFrame functions only).

A line that many sites share is boilerplate. Lines seen on one site only are left out by a plain
aggregate. For the others HyperLogLog sketches of the sites are merged by aggregation; only lines whose
estimate is near the threshold are counted exactly. Lines that make up a thousandth of these or more, which are
a thousand at most, are salted in joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.llm.store import written

MIN_SITES = 10
SKETCH_BITS = 12
NEAR = 0.25
HOT_SHARE = 1000
SALTS = 64
LINE = ["key", "key2"]


def _lines(docs: DataFrame) -> DataFrame:
    """(rid, at, line key, site) of every line with something in it but spaces and tabs; the key is 128 bits of the trimmed line."""
    line = F.btrim(F.col("line"), F.lit(" \t\r"))
    rows = docs.select(F.xxhash64("doc_id", "text").alias("rid"), F.xxhash64("source").alias("site"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    rows = rows.withColumn("line", line).filter(F.length("line") > 0)
    return rows.select("rid", "at", "site", F.xxhash64("line").alias("key"), F.xxhash64(F.lit("salt"), "line").alias("key2"))


def _hot(spread: DataFrame) -> DataFrame:
    """Keys of the most frequent lines, HOT_SHARE of them at most; `spread` has the rows of each line as n."""
    total = spread.agg(F.sum("n")).first()[0] or 0
    return spread.filter(F.col("n") * HOT_SHARE >= total).select(*LINE, F.lit(True).alias("hot"))


def _salted(keys: DataFrame, hot: DataFrame) -> DataFrame:
    """Keys with every salt if they are hot, else with salt 0."""
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return keys.join(F.broadcast(hot), LINE, "left").select(*keys.columns, F.explode(salts).alias("salt"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> tuple[DataFrame, DataFrame]:
    """Salted keys of lines that occur on `min_sites` sites at least, and the rows of all lines on more than one site, with a salt each.

    A null site is a site. The estimate's error is far below NEAR, so what it settles is exact in effect. The rows of a hot
    line have any salt, so its joins go to many tasks.
    """
    spread = lines.groupBy(*LINE).agg(F.min("site").alias("x"), F.max("site").alias("y"), F.count(F.lit(1)).alias("n"))
    spread = written(spread.filter("x != y").select(*LINE, "n"), "lines-spread")
    hot = written(_hot(spread), "lines-hot")
    salt = F.when(F.col("hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0).cast("int")
    rows = lines.join(F.broadcast(hot), LINE, "left").select(*lines.columns, salt.alias("salt"))
    shared = written(rows.join(_salted(spread.select(*LINE), hot), [*LINE, "salt"], "left_semi"), "lines-shared")
    sketched = shared.groupBy("key", "key2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS))).alias("sites"))
    sketched = written(sketched.filter(F.col("sites") >= min_sites * (1 - NEAR)), "lines-sketched")
    clear = F.col("sites") >= min_sites * (1 + NEAR)
    near = shared.join(_salted(sketched.filter(~clear).select(*LINE), hot), [*LINE, "salt"], "left_semi")
    exact = near.groupBy(*LINE).agg(F.countDistinct("site").alias("sites"))
    return _salted(sketched.filter(clear).union(exact.filter(F.col("sites") >= min_sites)).select(*LINE), hot), shared


def deduplicated(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_text of every row of `docs`, whose text loses its boilerplate lines.

    Lines are between \\n and compared without spaces, tabs and \\r at their ends; blank lines stay and
    aren't counted. A site is a source. A null text stays null with 0 lines. Repeated rows get equal
    results and count as one site. Other columns are not read; an empty table gives an empty result.
    """
    keys, shared = boilerplate(_lines(docs), min_sites)
    gone = shared.join(keys, [*LINE, "salt"], "left_semi").groupBy("rid").agg(F.array_sort(F.collect_set("at")).alias("gone"))
    # A mark per line up to the last one that goes, so that a text is cut in one pass over its lines.
    before = F.slice(F.concat(F.array(F.lit(-1)), F.col("gone")), 1, F.size("gone"))
    marks = F.flatten(F.zip_with("gone", before, lambda at, last: F.concat(F.array_repeat(F.lit(False), at - last - 1), F.array(F.lit(True)))))
    gone = gone.select("rid", F.size("gone").alias("n_gone"), marks.alias("gone"))
    texts = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid")).join(gone, "rid", "left")
    lines = F.split("text", "\n")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.zip_with(lines, F.col("gone"), lambda line, cut: F.when(~F.coalesce(cut, F.lit(False)), line)), "\n"))
    n_lines = F.coalesce(F.size(F.filter(lines, lambda line: F.length(F.btrim(line, F.lit(" \t\r"))) > 0)), F.lit(0))
    return texts.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
                        F.coalesce("n_gone", F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept_text"))


DEDUP_SQL = f"""WITH cut AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, coalesce(source, 'null') AS site, pos, trim(lines[pos], ' ' || chr(9) || chr(13)) AS line, lines[pos] AS raw
  FROM (SELECT doc_id, source, lines, unnest(range(1, len(lines) + 1)) AS pos FROM cut) x),
common AS (SELECT line FROM lines WHERE length(line) > 0 GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
told AS (SELECT l.*, c.line IS NOT NULL AS gone FROM lines l LEFT JOIN common c ON l.line = c.line),
per AS (SELECT doc_id, count(*) FILTER (WHERE length(line) > 0) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
  coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM told GROUP BY doc_id)
SELECT d.doc_id, coalesce(p.n_lines, 0) AS n_lines, coalesce(p.n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN md5(p.kept) END AS kept_md5
FROM documents d LEFT JOIN per p ON d.doc_id = p.doc_id"""

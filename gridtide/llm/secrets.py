"""Secret scan with multipart credential linking (DataFrame functions only).

Strong kinds (assignments, access keys, long hex strings) are always reported. Weak candidates (endpoint
addresses, key-like identifiers, long opaque strings) are only reported where a complementary part lies
in the same scope: an interval join of candidates and their surroundings by text and cell of positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.llm.store import written

SCOPE = 200
BLOCK = 256
SPANS = "array<struct<start:int,end:int,found:string>>"

# The base kinds, in the order in which they are listed. `least` is of the part that counts.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
ASSIGN_LEAST = 12
# End of fixed values. A run of 18 or 16 and more needs no check of its length afterwards, and a shorter
# run holds no longer one, so `{n,}` finds what `+` and a filter would.

#: Weak kinds, the part each plays, and its pattern.
WEAK = (
    ("endpoint", "place", r"(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[A-Za-z0-9_.:@/?&=%-]{4,}"),
    ("ident", "name", r"\b[A-Z0-9]{16,}\b"),
    ("opaque", "secret", r"\b[A-Za-z0-9+/_-]{32,}\b"),
)
#: The part that each base kind plays.
PARTS = {"assign": "secret", "access": "name", "hex": "secret"}
ORDER = {"assign": 0, "access": 1, "hex": 2, "endpoint": 3, "ident": 4, "opaque": 5}


def spans(text: Column, pattern: str) -> Column:
    """(start, end, found) of the leftmost non-overlapping matches, in code points: the lengths of what lies between matches and of the matches.

    Positions are summed up block by block. An array that grows is copied at each step, so none grows beyond
    BLOCK matches but that of the blocks.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    cells = F.zip_with(between, found, lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match")))
    # One element, so that the matches are looked for once and not for each block.
    blocks = F.transform(F.array(cells), lambda all_cells: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(all_cells) - 1) / BLOCK).cast("int")), lambda at: F.slice(all_cells, at * BLOCK + 1, BLOCK)))[0]

    def placed(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.length(x["match"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("found")))
        return F.when(x["match"].isNull(), state).otherwise(F.struct(end.alias("at"), F.concat(state["out"], one).alias("out")))

    def block_placed(state: Column, block: Column) -> Column:
        return F.aggregate(block, F.struct(state["at"].alias("at"), F.array().cast(SPANS).alias("out")), placed,
                           lambda own: F.struct(own["at"].alias("at"), F.concat(state["out"], F.array(own["out"])).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out"))
    everything = F.aggregate(blocks, start, block_placed, lambda state: F.flatten(state["out"]))
    return F.when(F.size(found) > 0, everything).otherwise(F.array().cast(SPANS))


def _told(text: Column, kind: str, pattern: str) -> Column:
    own = spans(text, pattern)
    if kind == "assign":
        own = F.filter(own, lambda x: F.length(F.regexp_extract(x["found"], pattern, 2)) >= ASSIGN_LEAST)
    return F.transform(own, lambda x: F.struct(x["start"].alias("start"), F.lit(ORDER[kind]).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def joined(spans_of: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans_of), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def linked(candidates: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak candidates with a complementary part within `scope` code points; candidates has rid, start, end, rank, kind, part, weak.

    Every part is spread over the cells of positions that its scope touches, and a weak candidate looks
    into the cells that it lies in. A name or place needs a secret, a secret needs a name or place; parts
    that overlap are no complement. A weak candidate that overlaps a strong span is that span and is dropped.
    """
    def cells(begin: Column, end: Column) -> Column:
        return F.explode(F.sequence(F.floor(begin / scope).cast("int"), F.floor(end / scope).cast("int")))

    around = candidates.select(F.col("rid").alias("o_rid"), cells(F.col("start") - scope, F.col("end") + scope).alias("o_cell"), F.col("start").alias("o_start"),
                               F.col("end").alias("o_end"), F.col("part").alias("o_part"), F.col("weak").alias("o_weak"))
    weak = candidates.filter("weak").withColumn("cell", cells(F.col("start"), F.col("end")))
    here = (F.col("rid") == F.col("o_rid")) & (F.col("cell") == F.col("o_cell"))
    near = (F.col("o_start") <= F.col("end") + scope) & (F.col("o_end") >= F.col("start") - scope)
    opposite = (F.col("o_part") == "secret") != (F.col("part") == "secret")
    overlap = (F.col("o_start") < F.col("end")) & (F.col("o_end") > F.col("start"))
    names = ("rid", "start", "rank", "kind", "end")
    told = weak.join(around, here & near & opposite & ~overlap, "left_semi").select(*names).distinct()
    covered = weak.join(around, here & ~F.col("o_weak") & overlap, "left_semi").select(*names).distinct()
    return told.join(covered, list(names), "left_anti")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of `docs`.

    A null text is empty and has no spans; the digest is then that of the empty string. Positions are
    code points, the end is exclusive. Repeated rows get equal results. Other columns are not read; an
    empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), text.alias("text"))
    kinds = [("assign", ASSIGN), ("access", ACCESS), ("hex", HEX)]
    told = [_told(F.col("text"), kind, pattern).alias(kind) for kind, pattern in kinds]
    told += [_told(F.col("text"), kind, pattern).alias(kind) for kind, _, pattern in WEAK]
    found = written(rows.select("doc_id", "rid", *told), "secret-candidates")
    parts = PARTS | {kind: part for kind, part, _ in WEAK}
    def with_part(kind: str) -> Column:
        part, weak = F.lit(parts[kind]), F.lit(kind not in PARTS)
        return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["rank"].alias("rank"), x["kind"].alias("kind"),
                                                    part.alias("part"), weak.alias("weak")))

    everything = [with_part(kind) for kind in ORDER]
    some = found.filter(F.exists(F.array(*[F.size(k) > 0 for k, _, _ in WEAK]), lambda x: x))
    candidates = some.select("rid", F.inline(F.concat(*everything))).distinct()
    more = linked(candidates, scope).groupBy("rid").agg(F.collect_list(F.struct("start", "rank", "kind", "end")).alias("linked"))
    base = F.concat("assign", "access", "hex")
    all_spans = F.concat(base, F.coalesce("linked", F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")))
    return found.join(more, "rid", "left").select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k, _ in kinds], F.sha2(joined(base), 256).alias("base_sha256"), joined(all_spans).alias("spans"))

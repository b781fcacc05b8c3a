"""Benchmark decontamination by spaced seeds, in DataFrame expressions only.

A spaced seed is a fixed mask over a run of tokens that looks at some positions and
ignores the others, so that a substituted token at an ignored position does not
hide a match. Every window of every document and of every benchmark item is hashed
under every mask; equal hashes of both sides are hits. The tokens around each hit are
laid side by side, and the overlap counts when some `min_tokens` aligned positions in a
row that hold the hit's window have at most `max_substitutions` different tokens.

The benchmark side is broadcast in blocks of at most `block_windows` hashed windows,
so its broadcast size is bounded whatever the benchmark's size; a larger benchmark
takes one pass over the documents per block. Documents are scanned once and never
shuffled: only hits leave the scan, with the few tokens around them, and hits of equal
surroundings are one, so a document of one repeated word makes no more of them than an
ordinary one.

No overlap is lost: every pattern of 3 substitutions in 13 tokens leaves some mask in
`MASKS` unharmed at some place, and every one in 11 tokens some mask in `SHORT_MASKS`,
which serve items of 11 and 12 tokens (the tests enumerate the patterns). Items of fewer
than 11 tokens are looked up as a whole.

Defined results: null and empty texts match nothing; items shorter than `min_tokens`
must match over their whole length, those of fewer than 11 tokens without a
substitution; repeated documents or items each get their rows; rows with a null id are
judged like others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volspan.llm.shared import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Positions that each mask looks at, for items of `min_tokens` and more.
MASKS = ((0, 1, 5, 6, 8), (0, 2, 6, 7, 8), (0, 1, 2, 7, 8), (0, 1, 3, 5, 8))
#: The same for shorter items, down to those that must be equal.
SHORT_MASKS = ((0, 2, 5, 6), (0, 1, 4, 6), (0, 1, 5, 6))
EQUAL_BELOW = 11
#: Benchmark windows times masks in one broadcast: about 100 bytes and 17 tokens each.
BLOCK_WINDOWS = 100_000
#: Documents to drop up to which their keys are broadcast.
BROADCAST_KEYS = 1_000_000


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def tokens(text: Column) -> Column:
    """Lower-cased (A-Z) words between blanks; null gives an empty array."""
    cut = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), r"[ \t\n\x0B\f\r]+")
    return F.array_remove(cut, "")


def seed_hashes(words: Column, at: Column, families: Sequence[tuple]) -> Column:
    """The hash of the window at `at` under each mask of the families, as an array; null where the window does not fit."""
    masks = [mask for _, _, family in families for mask in family]
    least = min(max(mask) for mask in masks)
    hashes = []
    for mask in masks:
        # the mask itself is hashed too: equal tokens under different masks are no hit
        seed = F.xxhash64(F.lit(str(tuple(mask))), *[F.get(words, at + F.lit(o)) for o in mask])
        hashes.append(seed if max(mask) == least else F.when(at + F.lit(max(mask)) < F.size(words), seed))
    return F.array(*hashes)


def mask_families(bench: DataFrame, text_col: str, masks: Sequence[Sequence[int]], min_tokens: int) -> list[tuple]:
    """(fewest tokens, most tokens, masks) for the item lengths that the benchmark has."""
    whole = max(min_tokens, EQUAL_BELOW)
    size = F.least(F.size(tokens(F.col(quoted(text_col)))), F.lit(whole))
    found = {r.n for r in bench.select(size.alias("n")).distinct().collect()}  # at most `whole` + 1 rows
    families = [(whole, None, masks)] if whole in found else []
    if found & set(range(EQUAL_BELOW, whole)):
        families.append((EQUAL_BELOW, whole - 1, SHORT_MASKS))
    return families + [(n, n, (tuple(range(n)),)) for n in range(1, EQUAL_BELOW) if n in found]


def benchmark_windows(bench: DataFrame, item_col: str, text_col: str, families: Sequence[tuple], min_tokens: int, max_substitutions: int) -> DataFrame:
    """Per hashed window of an item: seed, item, how many tokens must lie side by side and how many may
    differ, the tokens around the window, and how many of them stand before it.

    An overlap that holds the window lies within `item_near`. Windows of equal surroundings are one.
    """
    items = bench.select(F.col(quoted(item_col)).alias("item"), tokens(F.col(quoted(text_col))).alias("item_words"))
    size = F.size("item_words")
    items = items.select("item", "item_words", F.least(size, F.lit(min_tokens)).alias("need"), F.when(size < EQUAL_BELOW, 0).otherwise(max_substitutions).alias("allowed"))
    out = None
    for fewest, most, masks in families:
        span = min(map(max, masks)) + 1
        some = items.where((size >= fewest) & (size <= most if most else F.lit(True)))
        placed = some.select("*", F.explode(F.sequence(F.lit(0), size - span)).alias("item_at"))
        placed = placed.withColumn("item_before", F.least(F.col("item_at"), F.greatest(F.lit(0), F.col("need") - span)))
        near = F.slice("item_words", F.col("item_at") - F.col("item_before") + 1, F.col("item_before") + F.col("need"))
        seeds = placed.select("item", "need", "allowed", "item_before", near.alias("item_near"), F.explode(seed_hashes(F.col("item_words"), F.col("item_at"), [(fewest, most, masks)])).alias("seed"))
        out = seeds if out is None else out.unionByName(seeds)
    return out.where("seed is not null").distinct()


def overlaps(
    docs: DataFrame,
    bench: DataFrame,
    key_cols: Sequence[str] = ("doc_id",),
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    masks: Sequence[Sequence[int]] = MASKS,
    min_tokens: int = 13,
    max_substitutions: int = 3,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """One row per overlapping document and item: the key columns, `item_col`, `n_aligned`, `n_equal`.

    Where the two overlap best, `n_equal` of `n_aligned` tokens side by side are equal;
    `n_aligned` is `min_tokens`, or the length of a shorter item.
    """
    if item_col in key_cols:
        raise ValueError(f"{item_col} names both the items and a key of the documents")
    families = mask_families(bench, item_text_col, masks, min_tokens) or [(min_tokens, None, masks)]
    span = min(max(mask) for _, _, family in families for mask in family) + 1
    keys = [f"key {i}" for i in range(len(key_cols))]
    windows = benchmark_windows(bench, item_col, item_text_col, families, min_tokens, max_substitutions)
    blocks = max(1, -(-windows.count() // block_windows))
    words = docs.select(*[F.col(quoted(c)).alias(k) for c, k in zip(key_cols, keys, strict=True)], tokens(F.col(quoted(text_col))).alias("words"))
    # outer explodes: an inner one would have Spark test, and so compute, its array twice
    placed = words.select(*keys, "words", F.explode_outer(F.when(F.size("words") >= span, F.sequence(F.lit(0), F.size("words") - span))).alias("at"))
    seeded = placed.select(*keys, "words", "at", F.explode_outer(seed_hashes(F.col("words"), F.col("at"), families)).alias("seed"))
    before = F.least("at", "item_before")
    hits = None
    for b in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("seed"), F.lit(blocks)) == b) if blocks > 1 else windows
        found = seeded.join(F.broadcast(part), "seed").select(
            *keys,
            "item",
            "need",
            "allowed",
            F.slice("words", F.col("at") - before + 1, F.size("item_near")).alias("near"),
            F.slice("item_near", F.col("item_before") - before + 1, F.size("item_near")).alias("item_near"),
        )
        hits = found if hits is None else hits.unionByName(found)
    # Equal surroundings of hits are laid side by side once. They are written first: the test below would
    # else be pushed into the join, which then leaves generated code and copies the words for every seed.
    hits = stored(hits.distinct(), "seed_hits")
    # a place beyond either end can be in no overlap
    same = F.zip_with("near", "item_near", lambda x, y: F.coalesce((x == y).cast("int"), F.lit(-1000)))
    starts = F.sequence(F.lit(0), F.size("same") - F.col("need"))
    equal = F.array_max(F.transform(starts, lambda j: F.aggregate(F.slice("same", j + 1, F.col("need")), F.lit(0), lambda x, y: x + y)))
    laid = hits.select(*keys, "item", "need", "allowed", same.alias("same")).select(*keys, "item", "need", "allowed", F.when(F.size("same") >= F.col("need"), equal).alias("equal"))
    best = laid.where(F.col("equal") >= F.col("need") - F.col("allowed")).groupBy(*keys, "item").agg(F.max("need").alias("need"), F.max("equal").alias("equal"))
    names = [F.col(k).alias(c) for c, k in zip(key_cols, keys, strict=True)]
    return best.select(*names, F.col("item").alias(item_col), F.col("need").cast("long").alias("n_aligned"), F.col("equal").cast("long").alias("n_equal"))


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that overlap no benchmark item, with all of their columns.

    The keys of the others are written first; up to `BROADCAST_KEYS` of them are broadcast to
    the scan of the documents, more are joined by shuffle.
    """
    mark = F.xxhash64(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")))
    keyed = docs.select(F.col(quoted(id_col)).alias("document id"), mark.alias("document mark"), quoted(text_col))
    taken, bad_id, bad_mark = {c.lower() for c in docs.columns}, "bad id", "bad mark"
    while bad_id in taken or bad_mark in taken:
        bad_id, bad_mark = bad_id + "_", bad_mark + "_"
    found = overlaps(keyed, bench, ["document id", "document mark"], text_col, **options)
    bad = stored(found.select(F.col("document id").alias(bad_id), F.col("document mark").alias(bad_mark)).distinct(), "overlapping")
    if bad.count() <= BROADCAST_KEYS:
        bad = F.broadcast(bad)
    return docs.join(bad, F.col(quoted(id_col)).eqNullSafe(F.col(bad_id)) & (mark == F.col(bad_mark)), "left_anti")

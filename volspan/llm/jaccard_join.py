"""Exact self-join of documents on word-shingle Jaccard similarity, by T-occurrence search.

1. Every document becomes the set of its shingles (64-bit hashes). Documents with equal
   sets form one class; only classes are compared.
2. A class enters the index with the first n - ceil(t n) + 1 shingles of its set in one
   global order. Two classes with similarity t or more share one of these. The order
   puts shingles that are frequent in the corpus last (a bounded list of the most
   frequent, from counts over all documents), then goes by hash. Any order is exact; a
   good one keeps the inverted lists short.
3. Two classes on one inverted list are candidates unless the sizes or the parity bitmaps
   of their sets prove them too different. Lists of at most `SHORT` classes give these
   pairs themselves; longer ones give a spanning forest of them, grown from seeds over the
   list's bitmaps. The components of this graph are groups outside which no link can lie.
4. Groups are cut into blocks, and each pair of blocks is searched by DivideSkip: for a
   query set, the shortest inverted lists are merged by a heap, the longest are probed
   by binary search for those documents that the short ones leave possible, and those
   that reach the overlap are links. Links within a component found so far are not
   needed, so a block pair returns a spanning forest.
5. Components of the links give each document the smallest id that it reaches.

Defined results: null and empty texts have no shingles and link with nothing; a text
shorter than a shingle is one shingle; equal texts always link; repeated rows each get
their row; rows whose id is null take part, and have a component id only through
others. Two different sets share a class with a chance of about 2**-64 each.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspan.llm import wordhash
from volspan.llm.arrowmap import quoted, slices
from volspan.llm.components import connected_components
from volspan.llm.shared import WorkTables, stored

#: Most frequent shingles that the order knows: 16 bytes each are sent to every worker.
FREQUENT = 200_000
#: Shingles counted at once in a task, and the count there from which one is reported.
COUNT_CHUNK, COUNT_LEAST = 1_000_000, 4
#: Texts that a task remembers so as to count equal ones once.
SEEN = 100_000
SHORT = 32
BLOCK = 128
#: Classes of a long list in one task; longer lists are cut into blocks.
LIST_BLOCK = 8192
#: 64-bit words of the parity bitmap of a set of at most so many shingles; each size folds into the one before.
BITMAPS = ((1_500, 16), (6_000, 64), (24_000, 256), (None, 1024))
#: Classes in groups up to which their ids are broadcast to the scan of the texts.
BROADCAST_CLASSES = 1_000_000


def sets_of(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    words, at = wordhash.words_of(texts)
    for i in range(len(texts)):
        yield wordhash.shingle_set(words[at[i] : at[i + 1]], k)


def set_digest(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def frequent_shingles(texts: DataFrame, k: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the shingles found most often, counted over all texts."""

    def run(batches):
        held, size, seen = [], 0, set()

        def flush():
            u, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            keep = n >= COUNT_LEAST
            return pa.RecordBatch.from_arrays([pa.array(u[keep].view(np.int64)), pa.array(n[keep])], names=["h", "n"])

        for batch in batches:
            for part in slices(batch, 0):
                for s in sets_of(part.column(0), k):
                    if len(s) and (d := set_digest(s)) not in seen:
                        seen.add(d)
                        held.append(s)
                        size += len(s)
                if len(seen) > SEEN:
                    seen.clear()
                if size > COUNT_CHUNK:
                    yield flush()
                    held, size = [], 0
        yield flush()

    counted = texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "h").limit(most).toPandas()
    h = top.h.to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], top.n.to_numpy()[order]


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of the bits; their number grows with the set."""
    bits = 64 * next(words for most, words in BITMAPS if most is None or len(s) <= most)
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per document: id, n, class, prefix and bits."""
    known, counts = frequent
    source = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    fields = ["id", "n", "class", "prefix", "bits"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                n, cls, prefix, bits = [], [], [], []
                for s in sets_of(part.column(1), k):
                    n.append(len(s))
                    cls.append(set_digest(s))
                    if not len(s):
                        prefix.append(None)
                        bits.append(None)
                        continue
                    length = len(s) - -(-percent * len(s) // 100) + 1
                    if len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        often = np.where(known[at] == s, counts[at], 0)
                        s = s[np.argsort(often, kind="stable")] if often.any() else s
                    prefix.append(s[:length].view(np.int64))
                    bits.append(bitmap(s))
                arrays = [part.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=fields)

    id_type = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {id_type}, n long, class long, prefix array<long>, bits array<long>")


def scan_lists(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """From (h, class, n) sorted by h: pairs (u, v) of short lists that the sizes allow, and for long ones
    the members as (u = class, v = h) with `long`."""
    us: list[np.ndarray] = []
    vs: list[np.ndarray] = []
    long: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        u, v, s = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((us, np.int64), (vs, np.int64), (long, bool)))
        for x in (us, vs, long):
            x.clear()
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s)], names=["u", "v", "long"])

    def add(u: np.ndarray, v: np.ndarray, is_long: bool) -> None:
        us.append(u)
        vs.append(v)
        long.append(np.full(len(u), is_long))

    def lists(h: np.ndarray, c: np.ndarray, n: np.ndarray) -> None:
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.concatenate([start, [len(h)]]))
        for m in np.unique(size[(size > 1) & (size <= SHORT)]):
            rows = start[size == m][:, None] + np.arange(m)
            i, j = np.triu_indices(m, 1)
            a, b = rows[:, i].ravel(), rows[:, j].ravel()
            ok = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
            add(c[a[ok]], c[b[ok]], False)
        for x in np.flatnonzero(size > SHORT):
            own = slice(start[x], start[x] + size[x])
            add(c[own], h[own], True)

    tail = [np.zeros(0, np.int64)] * 3
    begun: int | None = None  # a long list of which members are out already
    for batch in batches:
        h, c, n = (np.concatenate([t, np.asarray(col)]) for t, col in zip(tail, batch.columns, strict=True))
        if begun is not None:
            own = int(np.searchsorted(h, begun, side="right"))
            add(c[:own], h[:own], True)
            h, c, n = h[own:], c[own:], n[own:]
        tail = [h[:0], c[:0], n[:0]]
        if len(h):
            begun = None
            last = int(np.searchsorted(h, h[-1]))  # the last list may go on in the next batch
            if len(h) - last > SHORT:
                lists(h, c, n)
                begun = int(h[-1])
            else:
                if last:
                    lists(h[:last], c[:last], n[:last])
                tail = [h[last:], c[last:], n[last:]]
        yield out()
    if len(tail[0]):
        lists(*tail)
        yield out()


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows) folded to fewer words."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, words), axis=1)


def near_forest(n: np.ndarray, bits: list[np.ndarray], percent: int, first: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that sizes and bitmaps allow, grown from seeds over what is not reached yet.

    With `first` (a mask), only pairs of a row inside it and one outside count.
    """
    words = np.array([len(b) for b in bits])
    levels = {}
    for w in np.unique(words):
        rows = np.flatnonzero(words >= w)
        table = np.zeros((len(n), w), np.int64)
        for size in np.unique(words[rows]):
            same = rows[words[rows] == size]
            table[same] = fold(np.stack([bits[i] for i in same]), int(w))
        levels[int(w)] = table
    left, out = np.ones(len(n), bool), []
    for seed in range(len(n)):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue:
            x = queue.pop()
            rest = left & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
            if first is not None:
                rest &= first != first[x]
            rest = np.flatnonzero(rest)
            for w in np.unique(np.minimum(words[rest], words[x])):
                some = rest[np.minimum(words[rest], words[x]) == w]
                apart = np.bitwise_count(levels[int(w)][some] ^ levels[int(w)][x]).sum(axis=1, dtype=np.int64)
                some = some[apart * (100 + percent) <= (n[some] + n[x]) * (100 - percent)]
                left[some] = False
                out += [(x, int(y)) for y in some]
                queue += some.tolist()
    return out


def long_list_edges(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Forest edges (u, v) of the long lists, from their members (h, class)."""
    sizes = members.groupBy("h").agg(F.ceil(F.count("*") / LIST_BLOCK).alias("blocks"))
    rows = members.join(classes.select("class", "n", "bits"), "class").join(sizes, "h")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("h", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class", "n", "bits")

    def run(table: pa.Table) -> pa.Table:
        cls, n, block = (table.column(c).to_numpy() for c in ("class", "n", "block"))
        held = table.column("bits").combine_chunks()
        at, values = held.offsets.to_numpy(), held.values.to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        found = near_forest(n, [values[at[x] : at[x + 1]] for x in range(len(n))], percent, None if i == j else block == i)
        return pa.table({"u": pa.array([int(cls[x]) for x, _ in found], pa.int64()), "v": pa.array([int(cls[y]) for _, y in found], pa.int64())})

    return rows.groupBy("h", "i", "j").applyInArrow(run, "u long, v long")


def candidate_graph(classes: DataFrame, percent: int, work: WorkTables) -> DataFrame:
    """Edges (u, v) between classes such that linked classes lie in one component."""
    postings = classes.select(F.explode("prefix").alias("h"), "class", "n").repartition("h").sortWithinPartitions("h")
    found = work.stored(postings.mapInArrow(lambda b: scan_lists(b, percent), "u long, v long, long boolean"), "candidates")
    long = long_list_edges(found.where("long").select(F.col("v").alias("h"), F.col("u").alias("class")), classes, percent)
    pairs = found.where("not long").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
    side = lambda x: classes.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    u, v = F.col("bits_u"), F.col("bits_v")
    apart = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x).cast("long")
    quarter = lambda a, w: F.transform(F.sequence(F.lit(1), w), lambda i: a[i - 1].bitwiseXOR(a[i + w - 1]).bitwiseXOR(a[i + w * 2 - 1]).bitwiseXOR(a[i + w * 3 - 1]))
    least = F.when(F.size(u) == F.size(v), apart(u, v)).when(F.size(u) == F.size(v) * 4, apart(quarter(u, F.size(v)), v)).when(F.size(v) == F.size(u) * 4, apart(u, quarter(v, F.size(u)))).otherwise(0)
    near = both.where(least * (100 + percent) <= (F.col("n_u") + F.col("n_v")) * (100 - percent))
    return near.select("u", "v").unionByName(long)


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def divide_skip(query: np.ndarray, keys: np.ndarray, offsets: np.ndarray, members: np.ndarray, least: int, mu: float = 0.0085) -> dict[int, tuple[list[np.ndarray], int]]:
    """Documents that may share `least` shingles with the query, by the short lists alone.

    Returns the candidates' counts on the short lists, and the long lists left to probe.
    """
    at = np.searchsorted(keys, query)
    at = at[keys[np.minimum(at, len(keys) - 1)] == query]  # an absent shingle falls on its successor
    lists = [members[offsets[i] : offsets[i + 1]] for i in at.tolist()]
    if len(lists) < least:
        return {}
    lists.sort(key=len)
    n_long = min(least - 1, int(least / (mu * math.log2(len(lists[-1]) + 1) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    need = least - n_long
    counts = {}
    for doc, same in groupby(heapq.merge(*[x.tolist() for x in short])):
        c = sum(1 for _ in same)
        if c >= need:
            counts[doc] = c
    return {doc: (long, c) for doc, c in counts.items()}


def search(sets: list[np.ndarray], queries: list[int], targets: list[int], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between queries and targets (both may be the same)."""
    flat = np.concatenate([sets[t] for t in targets])
    owner = np.repeat(np.array(targets), [len(sets[t]) for t in targets])
    order = np.lexsort((owner, flat))
    flat, owner = flat[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    keys, offsets = flat[begin], np.concatenate([begin, [len(flat)]])
    union, out = Union(len(sets)), []
    for q in queries:
        n = len(sets[q])
        least = -(-percent * n // 100)
        found = divide_skip(sets[q], keys, offsets, owner, least)
        root = union.find(q)
        docs = np.array([d for d in found if union.find(d) != root and 100 * min(n, len(sets[d])) >= percent * max(n, len(sets[d]))], np.int64)
        if not len(docs):
            continue
        long = next(iter(found.values()))[0]
        count = np.array([found[d][1] for d in docs.tolist()])
        need = np.array([-(-percent * (n + len(sets[d])) // (100 + percent)) for d in docs.tolist()])
        for left, x in zip(range(len(long), 0, -1), long, strict=True):
            alive = count + left >= need
            if not alive.all():
                docs, count, need = docs[alive], count[alive], need[alive]
                if not len(docs):
                    break
            place = np.searchsorted(x, docs)
            count = count + (x[np.minimum(place, len(x) - 1)] == docs)
        for d in docs[count >= need].tolist():
            if union.join(q, d):
                out.append((q, d))
    return out


def block_links(classes: DataFrame, groups: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, work: WorkTables) -> DataFrame:
    """Links (u, v) inside the groups, found block pair by block pair."""
    placed = work.stored(groups.join(classes.select(F.col("class").alias("node"), "rep"), "node"), "groups")
    # the texts of the groups' classes; a row counts only if its own set has the class
    text = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    few = placed.count() <= BROADCAST_CLASSES
    texts = text.join(F.broadcast(placed) if few else placed, F.col("id").eqNullSafe(F.col("rep"))).select("node", "component", "text")

    def to_sets(batches):
        for batch in batches:
            for part in slices(batch, 2):
                sets = list(sets_of(part.column(2), k))
                own = [i for i, c in enumerate(part.column(0).to_pylist()) if set_digest(sets[i]) == c]
                kept = part.take(pa.array(own, pa.int64()))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array([sets[i].view(np.int64) for i in own], pa.list_(pa.int64()))], names=["node", "component", "shingles"])

    sets = texts.mapInArrow(to_sets, "node long, component long, shingles array<long>")
    sizes = placed.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    blocks = sets.join(sizes, "component").withColumn("block", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    blocks = blocks.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "shingles")

    def run(table: pa.Table) -> pa.Table:
        nodes, block, i, j = (table.column(c).to_pylist() for c in ("node", "block", "i", "j"))
        flat = table.column("shingles").combine_chunks()
        at, values = flat.offsets.to_numpy(), flat.values.to_numpy().view(np.uint64)
        sets = [values[at[x] : at[x + 1]] for x in range(len(nodes))]
        first: dict[int, int] = {}
        for x, node in enumerate(nodes):
            first.setdefault(node, x)
        rows = list(first.values())
        a, b = [x for x in rows if block[x] == i[0]], [x for x in rows if block[x] == j[0]]
        found = search(sets, a, b, percent) if a and b else []
        return pa.table({"u": pa.array([nodes[q] for q, _ in found], pa.int64()), "v": pa.array([nodes[d] for _, d in found], pa.int64())})

    return blocks.groupBy("component", "i", "j").applyInArrow(run, "u long, v long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85, frequent: int = FREQUENT) -> DataFrame:
    """Per document: `id_col`, `n_shingles`, `component_id` (the smallest id reachable by links)."""
    text = docs.select(F.col(quoted(text_col)).cast("string").alias("text"))
    with WorkTables(docs.sparkSession) as work:
        docs_signed = work.stored(signatures(docs, id_col, text_col, k, percent, frequent_shingles(text, k, frequent)), "signatures")
        per_class = docs_signed.where("n > 0").groupBy("class").agg(F.count("*").alias("copies"), F.min("id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
        classes = work.stored(per_class, "classes")
        groups = connected_components(candidate_graph(classes, percent, work), work)
        links = connected_components(work.stored(block_links(classes, groups, docs, id_col, text_col, k, percent, work), "links"), work)
        named = links.join(classes.select(F.col("class").alias("node"), "rep"), "node")
        smallest = named.groupBy("component").agg(F.min("rep").alias("smallest"))
        to_component = named.join(smallest, "component").select(F.col("node").alias("class"), "smallest")
        # only rows of a class with copies or links need a look; the others are their own component
        found = classes.select("class", "copies", "rep").join(to_component, "class", "left").where("copies > 1 or smallest is not null")
        found = work.stored(found.select("class", F.coalesce("smallest", "rep").alias("smallest")), "named")
        if found.count() <= BROADCAST_CLASSES:
            found = F.broadcast(found)
        rows = docs_signed.where("n > 0").select("id", "n", "class").join(found, "class", "left").select("id", "n", "smallest")
        rows = rows.unionByName(docs_signed.where("n = 0").select("id", "n", F.lit(None).cast(rows.schema["smallest"].dataType).alias("smallest")))
        return stored(rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("smallest", "id").alias("component_id")), "jaccard_components")

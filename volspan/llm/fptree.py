"""Ranked lexical search over document FP-trees.

Documents are cut into terms once: a worker hashes the terms of a slice of texts with numpy and
keeps, of each document, its length and the counts of the terms that some item asks for (its
restricted term vector). Vectors are written as a work table, from which Spark sums the
corpus statistics: documents, terms, and documents per term, over all rows.

Then every task takes the vectors of its partition in blocks. A block's vectors, their terms
in order of falling document frequency, are sorted: equal beginnings lie together, and the
intervals of the longest common prefixes are the nodes of a trie whose paths documents share
(an FP-tree of documents). A node knows the largest count of each term, the smallest `m`
and the smallest id below it, which bound the score of every document below it from above, for
any item: the score grows with counts and falls with `m`. For each item the tree is searched depth
first, best bound first; a subtree goes unvisited when its bound lies below the item's present
`top` best (or equals the last of them with a larger id), and small subtrees are scored exactly. The
best of an item are carried from block to block of a task, so later blocks are cut down more. Tasks send
`top` rows per item at most, which Spark ranks.

Items go to the tasks in blocks of at most `BLOCK_ITEMS` items and `BLOCK_TERMS` terms (one item alone
may hold more), read from Spark one partition at a time; each block is one pass over the documents. Nothing
of the documents reaches the driver but the document frequencies of a block's terms.

Defined results: null and empty texts, and texts without a term, have none and are never ranked; a very long text is
taken whole, in its own slice; repeated documents are documents of their own, ranked by equal ids;
a null id comes after all others of equal scores; each row of the items is an item of its own, also where ids
repeat or are null; an item without matches gives no rows, as does an empty table; other columns
are ignored. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volspan.llm.arrowmap import quoted, slices
from volspan.llm.shared import WorkTables, stored
from volspan.llm.wordhash import hash_words, text_bytes, word_spans

BLOCK_ITEMS, BLOCK_TERMS = 1_000, 8_000
#: Documents times terms of the block of items in one tree: 4 bytes each.
TREE_CELLS = 8_000_000
#: Subtrees of at most so many documents are scored at once.
LEAF = 64
#: Stands for a null id.
NO_ID = np.iinfo(np.int64).max
#: Bytes that belong to terms: digits, letters, and every byte of a character beyond ASCII.
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of all texts on end, A-Z lower-cased, and the n + 1 offsets of the texts among them."""
    raw, at = text_bytes(texts)
    starts, ends = word_spans(raw, at, _INSIDE[raw])
    return hash_words(raw, starts, ends), np.searchsorted(starts, at)


def restricted(texts: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text with repeats, then (document, place in the sorted vocabulary, count) of those in the vocabulary."""
    words, at = terms_of(texts)
    lengths = np.diff(at)
    place = np.searchsorted(vocabulary, words)
    place[place == len(vocabulary)] = 0
    known = vocabulary[place] == words if len(vocabulary) else np.zeros(len(words), bool)
    owner = np.repeat(np.arange(len(lengths)), lengths)[known]
    pairs, counts = np.unique(owner * max(1, len(vocabulary)) + place[known], return_counts=True)
    return lengths, pairs // max(1, len(vocabulary)), pairs % max(1, len(vocabulary)), counts


def term_vectors(docs: DataFrame, id_col: str, text_col: str, vocabulary: np.ndarray) -> DataFrame:
    """(id, n, terms, counts): a row for each document that has a term at all."""
    source = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part in slices(batch, 1):
                    lengths, owner, place, counts = restricted(part.column(1), vocabulary)
                    bounds = pa.array(np.searchsorted(owner, np.arange(len(lengths) + 1)), pa.int32())
                    lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int64), pa.int64()).cast(t)) for x, t in ((place, pa.int32()), (counts, pa.int64()))]
                    rows = pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths, pa.int64()), *lists], names=["id", "n", "terms", "counts"])
                    yield rows.filter(pa.array(lengths > 0))
        finally:
            pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, "id long, n long, terms array<int>, counts array<long>")


class Tree:
    """The trie of one block of documents, as arrays: `counts` (documents in trie order x terms), nodes in preorder."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, at: np.ndarray, terms: np.ndarray, counts: np.ndarray, n_terms: int, leaf: int = LEAF):
        """Documents hold `terms[at[i]:at[i + 1]]`, in order of falling document frequency."""
        big = terms.astype(">u4")
        paths = [big[at[i] : at[i + 1]].tobytes() for i in range(len(ids))]
        order = sorted(range(len(ids)), key=paths.__getitem__)
        self.ids, self.m = ids[order], m[order]
        self.counts = np.zeros((len(ids), n_terms), np.int64 if counts.max(initial=0) >= 1 << 31 else np.int32)
        row_of = np.empty(len(ids), np.int64)
        row_of[order] = np.arange(len(ids))
        self.counts[np.repeat(row_of, np.diff(at)), terms] = counts
        self.shared = np.zeros(len(ids), np.int64)  # the path that a document shares with the one before
        for i in range(1, len(ids)):
            a, b = paths[order[i - 1]], paths[order[i]]
            if a == b:
                self.shared[i] = len(a) // 4
                continue
            n = min(len(a), len(b)) // 4
            other = np.flatnonzero(np.frombuffer(a, ">u4", n) != np.frombuffer(b, ">u4", n))
            self.shared[i] = other[0] if len(other) else n
        self.low: list[int] = []
        self.high: list[int] = []
        self.children: list[list[int]] = []
        self._build(leaf)
        self._bounds(n_terms)

    def _add(self, low: int, high: int) -> int:
        self.low.append(low)
        self.high.append(high)
        self.children.append([])
        return len(self.low) - 1

    def _build(self, leaf: int) -> None:
        """Split intervals where the shared path is shortest; small neighbours together make one leaf."""
        work = [self._add(0, len(self.ids))]
        while work:
            node = work.pop()
            low, high = self.low[node], self.high[node]
            if high - low <= leaf:
                continue
            inner = self.shared[low + 1 : high]
            least = inner.min()
            if least == inner.max():  # one branching, or copies only: equal steps
                cuts = np.arange(low + leaf, high, leaf)
            else:
                cuts = np.flatnonzero(inner == least) + low + 1
            start = low
            for cut, after in zip([*cuts, high], [*cuts[1:], high, high], strict=True):
                if cut < high and after - start <= leaf:
                    continue
                child = self._add(start, int(cut))
                self.children[node].append(child)
                work.append(child)
                start = int(cut)

    def _bounds(self, n_terms: int) -> None:
        """Largest counts, smallest m and id of every node: leaves from documents, others from their children."""
        n = len(self.low)
        self.most = np.zeros((n, n_terms), self.counts.dtype)
        self.least_m, self.least_id = np.zeros(n, np.int64), np.zeros(n, np.int64)
        leaves = sorted((i for i in range(n) if not self.children[i]), key=self.low.__getitem__)
        starts = [self.low[i] for i in leaves]
        if starts:
            self.most[leaves] = np.maximum.reduceat(self.counts, starts, axis=0)
            self.least_m[leaves], self.least_id[leaves] = np.minimum.reduceat(self.m, starts), np.minimum.reduceat(self.ids, starts)
        for i in range(n - 1, -1, -1):  # children come after their parents
            if c := self.children[i]:
                self.most[i] = self.most[c].max(axis=0)
                self.least_m[i], self.least_id[i] = self.least_m[c].min(), self.least_id[c].min()


def scores(counts: np.ndarray, m: np.ndarray, weights: np.ndarray) -> np.ndarray:
    tf = counts.astype(np.int64)
    return ((1_000_000_000 * tf) // (1000 * tf + 12 * m[:, None])) @ weights


class Best:
    """The `top` best documents of one item so far."""

    def __init__(self, top: int):
        self.top = top
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def hopeless(self, bound: int, least_id: int) -> bool:
        """No document with this bound and no smaller id can enter."""
        if bound <= 0:
            return True
        return len(self.scores) == self.top and (bound < self.scores[-1] or (bound == self.scores[-1] and least_id > self.ids[-1]))

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        enter = scores > 0 if len(self.scores) < self.top else scores >= self.scores[-1]
        if enter.any():
            s, i = np.concatenate([self.scores, scores[enter]]), np.concatenate([self.ids, ids[enter]])
            order = np.lexsort((i, -s))[: self.top]
            self.scores, self.ids = s[order], i[order]


def search(tree: Tree, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Depth-first branch and bound for one item; returns how many documents were scored."""
    if not len(tree.ids):
        return 0
    bounds = scores(tree.most[:, terms], tree.least_m, weights)
    stack, scored = [0], 0
    while stack:
        node = stack.pop()
        if best.hopeless(bounds[node], tree.least_id[node]):
            continue
        if tree.children[node]:
            stack.extend(sorted(tree.children[node], key=bounds.__getitem__))  # the best bound is taken first
        else:
            low, high = tree.low[node], tree.high[node]
            best.add(scores(tree.counts[low:high, terms], tree.m[low:high], weights), tree.ids[low:high])
            scored += high - low
    return scored


def trees(batch: pa.RecordBatch, place: np.ndarray, n_terms: int, n_docs: int, n_all: int, cells: int = TREE_CELLS) -> Iterator[Tree]:
    """Trees over the vectors (id, n, terms, counts) of a batch; `place` puts terms in order of falling document frequency."""
    step = max(LEAF, cells // max(1, n_terms))
    for start in range(0, batch.num_rows, step):
        part = batch.slice(start, step)
        ids = part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        n = part.column(1).to_numpy(zero_copy_only=False)
        at = part.column(2).value_lengths().to_numpy(zero_copy_only=False).cumsum()
        at = np.concatenate([[0], at])
        terms = place[part.column(2).flatten().to_numpy(zero_copy_only=False)]
        counts = part.column(3).flatten().to_numpy(zero_copy_only=False)
        within = np.lexsort((terms, np.repeat(np.arange(len(ids)), np.diff(at))))
        m = 100 - 25 + (25 * n * n_docs) // n_all
        yield Tree(ids, m, at, terms[within], counts[within], n_terms)


def best_of_partitions(vectors: DataFrame, items: Sequence[tuple[int, np.ndarray, np.ndarray]], place: np.ndarray, n_docs: int, n_all: int, top: int) -> DataFrame:
    """(item, doc_id, score): of each partition the `top` best of every item. Items: number, terms by frequency, weights."""
    n_terms = len(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in items]
        for batch in batches:
            for tree in trees(batch, place, n_terms, n_docs, n_all):
                for b, (_, terms, weights) in zip(best, items, strict=True):
                    search(tree, terms, weights, b)
        for b, (number, _, _) in zip(best, items, strict=True):
            ids = pa.array(b.ids, pa.int64(), mask=b.ids == NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.ids), number), pa.int64()), ids, pa.array(b.scores, pa.int64())], names=["item", "doc_id", "score"])

    return vectors.mapInArrow(run, "item long, doc_id long, score long")


def item_blocks(items: DataFrame, item_col: str, text_col: str, most_items: int, most_terms: int) -> Iterator[list[tuple]]:
    """The items (id, term hashes, repeats) in bounded blocks, as the rows come from Spark."""
    block, held = [], 0
    for row in items.select(F.col(quoted(item_col)), F.col(quoted(text_col)).cast("string")).toLocalIterator():
        hashes, repeats = np.unique(terms_of(pa.array([row[1]], pa.string()))[0], return_counts=True)
        if block and (len(block) == most_items or held + len(hashes) > most_terms):
            yield block
            block, held = [], 0
        block.append((row[0], hashes, repeats))
        held += len(hashes)
    if block:
        yield block


def lexical_search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    top: int = 20,
    most_items: int = BLOCK_ITEMS,
    most_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """The `top` documents of the highest score above 0 for each item: `item_col`, `rank` (int, from 1), `doc_id` and `score` (long)."""
    spark = docs.sparkSession
    item_type = items.schema[item_col].dataType.simpleString()
    out = None
    for block in item_blocks(items, item_col, item_text_col, most_items, most_terms):
        vocabulary = np.unique(np.concatenate([h for _, h, _ in block]))
        with WorkTables(spark) as work:
            vectors = work.stored(term_vectors(docs, id_col, text_col, vocabulary), "term_vectors")
            n_docs, n_all = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
            df = np.zeros(len(vocabulary), np.int64)
            for term, held in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each term of the block
                df[term] = held
            place = np.empty(len(vocabulary), np.int64)
            place[np.argsort(-df, kind="stable")] = np.arange(len(vocabulary))
            asked = []
            for number, (_, hashes, repeats) in enumerate(block):
                at = np.searchsorted(vocabulary, hashes)
                weights = repeats * np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df[at]], np.int64)
                asked.append((number, place[at], weights))
            found = best_of_partitions(vectors, asked, place, n_docs, n_all, top)
            order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            names = spark.createDataFrame([(i, item) for i, (item, _, _) in enumerate(block)], f"item long, `item id` {item_type}")
            ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            ranked = ranked.join(F.broadcast(names), "item").select(F.col("item id").alias(item_col), "rank", "doc_id", "score")
            part = stored(ranked, "ranked")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], f"`{item_col}` {item_type}, rank int, doc_id long, score long")
    return out

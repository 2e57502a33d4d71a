"""Ranked lexical search by dual trees.

A document is a vector over the items' terms (its impacts), an item a vector of
term weights, the score their product.  Documents that share their heaviest
terms are brought together and cut into trees; a tree's nodes hold the coordinate
maxima of the documents below them, those of the tree of items the maxima of the
items below.  The product of two nodes' maxima bounds every score between them:
a pair of nodes whose bound is below the weakest k-th score that the node's items
have already is left, with all its documents and items, and nothing is lost.

    items -> terms, weights: one bounded set of items at a time  (broadcast)
    documents -> counts of those terms                 (narrow), written
    -> impacts, dealt by the heaviest term, trees      (one shuffle), written
    -> first round: every item in the trees that are led by its heaviest terms
       -> its k-th score so far                        (k rows an item and task)
    -> second round: every item in all other trees, from those scores on
    -> the k best of both rounds

Items are worked on in sets of a bounded number of terms, whatever their number;
each set is one pass over the documents' vectors.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .common import ascii_lower, slices, whole_text

#: Fixed value: a term.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Different (item, term) pairs of a set of items, which is broadcast.
SET_PAIRS = 500_000
#: A tree: documents, and cells of its matrix of documents and terms.
TREE_DOCS = 2048
TREE_CELLS = 4_000_000
#: Children of a node, in both kinds of trees, and items searched at once.
FAN = 8
ITEM_BATCH = 512
#: An item's heaviest terms, whose trees it visits first.
LEADING_TERMS = 4
BATCH_CHARS = 4_000_000
#: Products up to here are exact in doubles.
EXACT = 1 << 52


# -- terms and vectors ------------------------------------------------------


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, term, times): one row per item row and term."""
    numbered = materialize(
        items.select(F.col(id_col).alias("item_id"), ascii_lower(whole_text(text_col)).alias("text")).withColumn(
            "item", F.monotonically_increasing_id()
        ),
        "search-items",
    )
    terms = numbered.select("item", "item_id", F.explode(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).alias("term"))
    return terms.groupBy("item", "item_id", "term").agg(F.count("*").alias("times"))


def count_terms(df: DataFrame, id_col: str, text_col: str, places: dict[str, int]) -> DataFrame:
    """(doc_id, n, terms, times) of documents with a term: all its terms, and how
    often each of those in ``places`` (by number) occurs."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(places)
    rows = df.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    find = re.compile(TERM).findall

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, BATCH_CHARS):
                keep, n, ends, terms, times = [], [], [0], [], []
                for i in range(a, b):
                    text = texts[i]
                    found = find(text.lower() if text.isascii() else text.translate(LOWER))
                    if not found:
                        continue
                    counts = Counter(map(number, found))
                    counts.pop(None, None)
                    keep.append(i)
                    n.append(len(found))
                    terms += counts.keys()
                    times += counts.values()
                    ends.append(len(terms))
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(keep, pa.int32())),
                        pa.array(n, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                        pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
                    ],
                    ["doc_id", "n", "terms", "times"],
                )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(vectors, f"doc_id {id_type}, n long, terms array<int>, times array<long>")


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(vectors: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(doc_id, terms, impacts) of documents with a term of the items."""
    m = F.expr(f"25L + (75L * n * {n_docs}L) div {n_terms}L")
    return vectors.where(F.size("terms") > 0).withColumn("m", m).select(
        "doc_id",
        "terms",
        F.expr("transform(times, tf -> (1000000000L * tf) div (1000L * tf + 8L * m))").alias("impacts"),
    )


# -- trees of documents -----------------------------------------------------


def plant_trees(scored: DataFrame, weights: np.ndarray, tree_docs: int = TREE_DOCS) -> DataFrame:
    """Trees of documents that share their heaviest terms: docs (ids), ends, terms,
    impacts, leads (the terms that lead them, distinct)."""
    spark = scored.sparkSession
    shared = spark.sparkContext.broadcast(weights)

    @F.arrow_udf("array<int>")
    def heaviest(terms: pa.Array, values: pa.Array) -> pa.Array:
        ends = terms.offsets.to_numpy()
        t = terms.values.to_numpy()
        heavy = shared.value[t] * values.values.to_numpy()
        # Per document by falling weight, ties by the term's number.
        owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        order = np.lexsort((t, -heavy, owner))
        first = ends[:-1]
        second = np.minimum(first + 1, ends[1:] - 1)
        two = np.stack([t[order[first]], t[order[second]]], axis=1).ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(two) + 1, 2), pa.int32()), pa.array(two, pa.int32()))

    led = scored.withColumn("lead", heaviest("terms", "impacts"))
    # A term may lead a third of all documents: the hash spreads them.
    order = [F.col("lead"), F.xxhash64("doc_id", "impacts")]
    dealt = led.repartitionByRange(*order).sortWithinPartitions(*order)
    id_type = scored.schema["doc_id"].dataType.simpleString()

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            ends = table.column("terms").chunk(0).offsets.to_numpy()
            flat = table.column("terms").chunk(0).values.to_numpy()
            first, used = 0, set()
            for i in range(table.num_rows + 1):
                done = i == table.num_rows
                more = set() if done else used.union(flat[ends[i] : ends[i + 1]].tolist())
                if i > first and (done or i - first >= tree_docs or (i - first + 1) * len(more) > TREE_CELLS):
                    yield _tree(table.slice(first, i - first))
                    first, more = i, set() if done else set(flat[ends[i] : ends[i + 1]].tolist())
                used = more

    return dealt.select("doc_id", "terms", "impacts", "lead").mapInArrow(
        trees, f"docs array<{id_type}>, ends array<int>, terms array<int>, impacts array<long>, leads array<int>"
    )


def _tree(rows: pa.Table) -> pa.RecordBatch:
    one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
    terms = rows.column("terms").combine_chunks()
    sizes = pc.list_value_length(terms).to_numpy()
    leads = np.unique(rows.column("lead").combine_chunks().flatten().to_numpy()[::2])
    return pa.RecordBatch.from_arrays(
        [
            one(rows.column("doc_id").combine_chunks()),
            one(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())),
            one(terms.flatten()),
            one(rows.column("impacts").combine_chunks().flatten()),
            one(pa.array(leads, pa.int32())),
        ],
        ["docs", "ends", "terms", "impacts", "leads"],
    )


# -- the search -------------------------------------------------------------


class ItemSet:
    """The items of a set as weight vectors (rows sorted so that items of the same
    heaviest term are neighbours)."""

    def __init__(self, items: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        # Per item: its terms by falling weight.
        order = np.lexsort((terms, -weights, items))
        items, terms, weights = items[order], terms[order], weights[order]
        names, start = np.unique(items, return_index=True)
        lead = terms[start]
        rank = np.argsort(lead, kind="stable")
        ends = np.append(start, len(items))
        self.names = names[rank]
        pick = np.concatenate([np.arange(ends[r], ends[r + 1]) for r in rank]) if len(rank) else np.zeros(0, dtype=np.int64)
        self.ends = np.concatenate(([0], np.cumsum((ends[1:] - ends[:-1])[rank]))) if len(rank) else np.zeros(1, dtype=np.int64)
        self.terms, self.weights = terms[pick], weights[pick]

    def leading(self, i: int) -> np.ndarray:
        return self.terms[self.ends[i] : min(self.ends[i] + LEADING_TERMS, self.ends[i + 1])]

    def matrix(self, a: int, b: int, columns: np.ndarray) -> np.ndarray:
        """Weights of items a..b-1 over ``columns`` (sorted term numbers)."""
        lo, hi = self.ends[a], self.ends[b]
        terms = self.terms[lo:hi]
        at = np.minimum(np.searchsorted(columns, terms), len(columns) - 1)
        hit = columns[at] == terms
        row = np.repeat(np.arange(b - a), np.diff(self.ends[a : b + 1]))
        out = np.zeros((b - a, len(columns)), dtype=np.int64)
        out[row[hit], at[hit]] = self.weights[lo:hi][hit]
        return out


def maxima(matrix: np.ndarray) -> list[np.ndarray]:
    """The levels of a tree over the rows, from the rows up to one node: coordinate
    maxima of FAN nodes each."""
    levels = [matrix]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FAN), axis=0))
    return levels


def surviving_pairs(items: list[np.ndarray], docs: list[np.ndarray], weakest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, doc, score) of the pairs that no bound prunes, and that score at
    least the item's ``weakest`` and above 0.

    Both trees are descended together, a level at a time; a pair of nodes lives
    on while its bound reaches the smallest ``weakest`` of the items below.
    """
    floors = [np.maximum(weakest, 1)]
    for _ in items[1:]:
        floors.append(np.minimum.reduceat(floors[-1], np.arange(0, len(floors[-1]), FAN)))
    i, d = len(items) - 1, len(docs) - 1
    left, right = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    while True:
        bound = _products(items[i], docs[d], left, right)
        alive = bound >= floors[i][left]
        left, right, bound = left[alive], right[alive], bound[alive]
        if not len(left) or (i == 0 and d == 0):
            return left, right, bound
        if i:
            i -= 1
            left, right = _children(left, right, len(items[i]))
        if d:
            d -= 1
            right, left = _children(right, left, len(docs[d]))


def _children(nodes: np.ndarray, others: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    below = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
    others = np.repeat(others, FAN)
    return below[below < size], others[below < size]


def _products(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Products of the rows ``left`` of a and ``right`` of b."""
    rows, r = np.unique(left, return_inverse=True)
    cols, c = np.unique(right, return_inverse=True)
    # One dense product if most of it is wanted, else pair by pair.
    if len(rows) * len(cols) <= 8 * len(left):
        return (a[rows] @ b[cols].T)[r, c]
    out = np.empty(len(left), dtype=a.dtype)
    step = max(1, TREE_CELLS // a.shape[1])
    for s in range(0, len(left), step):
        out[s : s + step] = np.einsum("ij,ij->i", a[left[s : s + step]], b[right[s : s + step]])
    return out


class TopK:
    """The k best documents of each item so far: score falling, then id rising
    (null ids last)."""

    def __init__(self, k: int, floors: np.ndarray):
        self.k, self.floors = k, floors.copy()
        self.best: dict[int, list[tuple]] = {}

    def add(self, item: int, rows: list[tuple]) -> None:
        best = sorted(self.best.get(item, []) + rows)[: self.k]
        self.best[item] = best
        if len(best) == self.k:
            self.floors[item] = max(self.floors[item], -best[-1][0])


def search_tree(tree: dict, items: ItemSet, top: TopK, led: bool) -> None:
    """One tree against the items that its leading terms pick (``led``), or all
    others."""
    leads = set(tree["leads"])
    picked = np.array([not leads.isdisjoint(items.leading(i).tolist()) for i in range(len(items.names))], dtype=bool) == led
    if not picked.any():
        return
    terms = np.array(tree["terms"], dtype=np.int64)
    columns, at = np.unique(terms, return_inverse=True)
    ids = tree["docs"]
    values = np.zeros((len(ids), len(columns)), dtype=np.int64)
    values[np.repeat(np.arange(len(ids)), np.diff(tree["ends"])), at] = tree["impacts"]
    docs = None
    for a in range(0, len(items.names), ITEM_BATCH):
        b = min(a + ITEM_BATCH, len(items.names))
        chosen = np.flatnonzero(picked[a:b])
        if not len(chosen):
            continue
        rows = items.matrix(a, b, columns)[chosen]
        # The largest product of any two nodes tells whether doubles are exact.
        kind = np.float64 if float(rows.max(axis=0).astype(object) @ values.max(axis=0).astype(object)) < EXACT else np.int64
        if docs is None or docs[0].dtype != kind:
            docs = maxima(values.astype(kind))
        found_items, found_docs, scores = surviving_pairs(maxima(rows.astype(kind)), docs, top.floors[a + chosen])
        if not len(found_items):
            continue
        order = np.lexsort((-scores, found_items))
        found_items, found_docs, scores = found_items[order], found_docs[order], scores[order]
        names, start = np.unique(found_items, return_index=True)
        for name, lo, hi in zip(names, start, [*start[1:], len(found_items)], strict=True):
            # All that tie with the k-th: ids decide among them.
            if hi - lo > top.k:
                hi = lo + int(np.searchsorted(-scores[lo:hi], -scores[lo + top.k - 1], side="right"))
            top.add(
                int(a + chosen[name]),
                [(-int(s), ids[d] is None, ids[d] if ids[d] is not None else 0) for s, d in zip(scores[lo:hi], found_docs[lo:hi], strict=True)],
            )


def search_trees(trees: DataFrame, items: ItemSet, floors: np.ndarray, k: int, led: bool) -> DataFrame:
    """(item, doc_id, score): each task's k best per item."""
    spark = trees.sparkSession
    shared = spark.sparkContext.broadcast((items, floors))
    id_type = trees.schema["docs"].dataType.elementType.simpleString()
    arrow_id = pa.string() if id_type == "string" else pa.int32() if id_type == "int" else pa.int64()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, floors = shared.value
        top = TopK(k, floors)
        for batch in batches:
            for row in range(batch.num_rows):
                tree = {c: batch.column(c)[row].values for c in ("ends", "terms", "impacts", "leads")}
                tree = {c: v.to_numpy() for c, v in tree.items()}
                tree["docs"] = batch.column("docs")[row].values.to_pylist()
                search_tree(tree, items, top, led)
        out = [(int(items.names[i]), None if null else d, -s) for i, rows in top.best.items() for s, null, d in rows]
        if out:
            names, docs, scores = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(docs, arrow_id), pa.array(scores, pa.int64())], ["item", "doc_id", "score"]
            )

    return trees.mapInArrow(search, f"item long, doc_id {id_type}, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_set(spark: SparkSession, df: DataFrame, id_col: str, text_col: str, pairs: list, k: int, tree_docs: int) -> DataFrame:
    """The k best of each item of one set; ``pairs``: (item, term, times)."""
    names = sorted({p.term for p in pairs})
    places = {t: i for i, t in enumerate(names)}
    vectors = materialize(count_terms(df, id_col, text_col, places), "search-vectors")
    n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # One row per term of the set, which is as bounded as the set.
    df_of = vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()
    weights = np.zeros(len(names), dtype=np.int64)
    weights[:] = term_weight(n_docs, 0)
    for r in df_of:
        weights[r.t] = term_weight(n_docs, r.df)
    terms = np.array([places[p.term] for p in pairs], dtype=np.int64)
    items = ItemSet(
        np.array([p.item for p in pairs], dtype=np.int64), terms, weights[terms] * np.array([p.times for p in pairs], dtype=np.int64)
    )
    trees = materialize(plant_trees(impacts(vectors, n_docs, max(n_terms, 1)), weights, tree_docs), "search-trees")
    none = np.zeros(len(items.names), dtype=np.int64)
    first = materialize(_best(search_trees(trees, items, none, k, led=True), k), "search-first")
    at = {int(x): i for i, x in enumerate(items.names)}
    floors = none.copy()
    for r in first.where(F.col("rank") == k).select("item", "score").collect():  # one row per item of the set
        floors[at[r["item"]]] = r["score"]
    second = search_trees(trees, items, floors, k, led=False)
    return _best(first.drop("rank").unionByName(second), k)


def ranked_search(
    df: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    set_pairs: int = SET_PAIRS,
    tree_docs: int = TREE_DOCS,
) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` documents of the highest
    score above 0, equal scores by rising id.

    All documents with a term are counted and searched; the result is exact.
    Defined cases: a null or empty text has no term (as an item it has no rows, as
    a document it counts nowhere); each document row is a document and each item
    row a query of its own, also if ids repeat; null document ids come last among
    equal scores; texts are read whole; an empty table on either side gives no
    rows; other columns are ignored.  Ids of documents are integers or strings.
    """
    spark = df.sparkSession
    terms = materialize(item_terms(items, item_id_col, item_text_col), "search-item-terms")
    n_pairs = terms.count()
    sets = max(1, -(-n_pairs // set_pairs))
    found = None
    for s in range(sets):
        # A set is bounded: about set_pairs rows, whatever the number of items.
        of_set = F.pmod(F.xxhash64("item"), F.lit(sets)) == s
        pairs = terms.where(of_set).select("item", "term", "times").collect()
        if not pairs:
            continue
        best = _search_set(spark, df, id_col, text_col, pairs, k, tree_docs)
        best = best if sets == 1 else materialize(best, "search-best")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], f"item_id {items.schema[item_id_col].dataType.simpleString()}, rank int, doc_id {df.schema[id_col].dataType.simpleString()}, score long")
    ids = terms.select("item", "item_id").distinct()
    return found.join(ids, "item").select("item_id", "rank", "doc_id", "score")

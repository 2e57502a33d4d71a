"""Nearest neighbours by a forest of hash prefixes.

Every tree has a long hash string per vector (signs of the centred vector on
random directions) and keeps its strings in sorted order, so the vectors that
share a prefix with a query are one slice of the order.  A query descends to its
longest matches in every tree, then all trees go up together, one bit at a
time, until their slices hold enough candidates; these are ranked exactly.

Spark holds the sorted arrays in parts: by tree and the first bits of the hash,
and by salt where such a part is large (a crowd of similar vectors).  Queries
travel only to the parts that their prefix covers.  How many candidates are
enough is measured: a bounded sample of queries is compared with all vectors,
and the smallest number that reaches the target recall on it is used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

TREES = 16
BITS = 32
#: Vectors in a part of a tree (a task's memory).
PART_ROWS = 8192
#: Queries that the number of candidates is measured on, and the recall aimed at.
SAMPLE_QUERIES = 96
TARGET_RECALL = 0.96
SEED = 5


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): rows whose vector takes part."""
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("v", lambda x: x != 0)
    return rows.filter(F.col("vec_id").isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.coalesce(some, F.lit(False)))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(rep, ids, v): each distinct vector once with its k + 1 smallest ids, which
    are all that a list of k neighbours can need of it.  Repeated rows go first,
    so that they take no id's place.  A vector may be a third of all rows: the
    limit is applied before the shuffle by vector."""
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.select("vec_id", "v").distinct().withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(
        F.element_at("ids", 1).alias("rep"), "ids", "v"
    )


def mean_vectors(rows: DataFrame) -> dict[int, np.ndarray]:
    """Mean vector of each dimension over all rows (sums per task, added up)."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        for b in batches:
            for v in b["v"]:
                d = len(v)
                total[d] = total.get(d, 0.0) + np.asarray(v, dtype=np.float64)
                count[d] = count.get(d, 0) + 1
        if total:
            yield pd.DataFrame(
                {"dim": list(total), "n": [count[d] for d in total], "s": [t.tolist() for t in total.values()]}
            )

    parts = rows.select("v").mapInPandas(sums, "dim int, n long, s array<double>")
    place = parts.select("dim", "n", F.posexplode("s").alias("i", "x"))
    found = place.groupBy("dim", "i").agg((F.sum("x") / F.sum("n")).alias("m")).collect()  # one row per component
    out: dict[int, np.ndarray] = {}
    for r in found:
        out.setdefault(r["dim"], np.zeros(r["dim"]))[r["i"]] = r["m"]
    return out


def directions(dim: int, trees: int) -> np.ndarray:
    """dim x (trees * BITS) random directions."""
    return np.random.default_rng([SEED, dim]).standard_normal((dim, trees * BITS))


def hash_strings(x: np.ndarray, mean: np.ndarray, trees: int) -> np.ndarray:
    """Codes (rows x trees) of vectors of one dimension."""
    signs = ((x - mean) @ directions(x.shape[1], trees) > 0).reshape(len(x), trees, BITS)
    return signs @ (1 << np.arange(BITS, dtype=np.int64)[::-1])


def with_codes(uniq: DataFrame, means: dict[int, np.ndarray], trees: int) -> DataFrame:
    """(rep, ids, dim, vec, codes): vec holds the components as 64-bit floats."""

    @F.pandas_udf("dim int, vec binary, codes array<long>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vs in batches:
            dims = vs.map(len).to_numpy()
            vec: list = [None] * len(vs)
            codes: list = [None] * len(vs)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = np.array([np.asarray(vs.iloc[i], dtype=np.float64) for i in at])
                for i, row, c in zip(at.tolist(), x, hash_strings(x, means[d], trees), strict=True):
                    vec[i], codes[i] = row.astype("<f8").tobytes(), c
            yield pd.DataFrame({"dim": dims.astype(np.int32), "vec": vec, "codes": codes})

    return uniq.select("rep", "ids", encode("v").alias("e")).select("rep", "ids", "e.dim", "e.vec", "e.codes")


def nearest(x: np.ndarray, order_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` nearest to ``q`` with their exact distances: the k nearest and
    those tied with the last.  A fast product finds them with a margin."""
    rough = np.einsum("ij,ij->i", x, x) - 2.0 * (x @ q)
    if len(x) > k:
        last = np.partition(rough, k - 1)[k - 1]
        rows = np.flatnonzero(rough <= last + 1e-9 * (1.0 + abs(last) + q @ q))
    else:
        rows = np.arange(len(x))
    exact = np.sqrt(((x[rows] - q) ** 2).sum(axis=1))
    best = np.lexsort((order_ids[rows], exact))
    if len(best) > k:
        best = best[exact[best] <= exact[best[k - 1]]]
    return rows[best], exact[best]


def _matrix(vecs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), dtype="<f8").reshape(len(vecs), -1)


def _slices(codes: np.ndarray, q: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds in sorted ``codes`` of those that share the first ``depth`` bits with q."""
    low = (q >> (BITS - depth)) << (BITS - depth)
    return np.searchsorted(codes, low), np.searchsorted(codes, low + (np.int64(1) << (BITS - depth)))


def _exact_sample(index: DataFrame, sample: list, k: int) -> dict[int, list[int]]:
    """The k true neighbours (representatives) of a bounded sample of queries,
    which travels to every task; each task returns its best for each."""
    qs = [(r["rep"], r["dim"], np.frombuffer(r["vec"], dtype="<f8")) for r in sample]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, part in b.groupby("dim"):
                x, reps = _matrix(part["vec"]), part["rep"].to_numpy()
                for rep, dim, q in qs:
                    if dim == d:
                        rows, dist = nearest(x, reps, q, k + 1)
                        out += [(rep, int(reps[i]), float(s)) for i, s in zip(rows[: k + 1], dist, strict=False)]
            if out:
                yield pd.DataFrame(out, columns=["q", "rep", "score"])

    near = index.select("rep", "dim", "vec").mapInPandas(scan, "q long, rep long, score double")
    nth = F.row_number().over(Window.partitionBy("q").orderBy("score", "rep"))
    found: dict[int, list[int]] = {}
    for r in near.filter("q <> rep").withColumn("nth", nth).filter(F.col("nth") <= k).collect():
        found.setdefault(r["q"], []).append(r["rep"])
    return found


def shared_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bits that codes have in common."""
    x = a ^ b
    return np.where(x == 0, BITS, BITS - 1 - np.floor(np.log2(np.maximum(x, 1))).astype(np.int64))


class Forest:
    """The index of a table of vectors, and searches in it."""

    def __init__(self, df: DataFrame, id_col: str, vec_col: str, k: int, trees: int = TREES, part_rows: int = PART_ROWS):
        self.k, self.trees, self.part_rows = k, trees, part_rows
        self.rows = usable(df, id_col, vec_col)
        uniq = materialize(distinct_vectors(self.rows, k), "vectors")
        self.uniq = uniq
        self.index = materialize(with_codes(uniq, mean_vectors(uniq), trees), "hash-strings")
        self.size = self.index.count()
        # First bits that name a part, so that parts have about part_rows vectors.
        self.part_bits = max(0, min(20, int(np.ceil(np.log2(max(1, self.size / part_rows))))))
        self.parts = materialize(
            self._by_tree(self.index).groupBy("dim", "tree", "part").agg(F.count("*").alias("n")), "parts"
        ).withColumn("salts", F.ceil(F.col("n") / F.lit(part_rows)).cast("int"))

    def _by_tree(self, rows: DataFrame, *more: str) -> DataFrame:
        return rows.select("dim", *more, F.posexplode("codes").alias("tree", "code")).withColumn(
            "part", F.shiftright("code", BITS - self.part_bits)
        )

    def _salted_index(self, *more: str) -> DataFrame:
        rows = self._by_tree(self.index, "rep", *more).join(self.parts, ["dim", "tree", "part"])
        return rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts"))).drop("n", "salts")

    def _visit(self, queries: DataFrame) -> DataFrame:
        """Queries at all salts of their parts."""
        return queries.join(self.parts.drop("n"), ["dim", "tree", "part"]).withColumn(
            "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1))
        ).drop("salts")

    def tallies(self, queries: DataFrame) -> DataFrame:
        """(q, depth, n): candidates over all trees that share ``depth`` bits."""
        bits = self.part_bits

        def count(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if not len(asked):
                return pd.DataFrame({"q": [], "depth": [], "n": []}).astype("int64")
            codes = np.sort(index["code"].to_numpy(dtype=np.int64))
            depth = np.arange(bits, BITS + 1)
            q = asked["code"].to_numpy(dtype=np.int64)
            lo, hi = _slices(codes, q[:, None], depth[None, :])
            return pd.DataFrame(
                {"q": np.repeat(asked["q"].to_numpy(), len(depth)), "depth": np.tile(depth, len(q)), "n": (hi - lo).ravel()}
            )

        key = ["dim", "tree", "part", "salt"]
        asked_key = [f"asked_{c}" for c in key]  # both sides come from one table
        asked = self._by_tree(queries, "q")
        deep = (
            self._salted_index()
            .select(*key, "code")
            .groupBy(*key)
            .cogroup(self._visit(asked).select(*key, "q", "code").toDF(*asked_key, "q", "code").groupBy(*asked_key))
            .applyInPandas(count, "q long, depth long, n long")
        )
        if bits:
            # Above the parts the sizes of the parts say it all.
            up = F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("depth")
            above = self.parts.select("dim", "tree", "part", "n", up).withColumn(
                "prefix", F.expr(f"shiftright(part, {bits} - depth)")
            )
            above = above.groupBy("dim", "tree", "depth", "prefix").agg(F.sum("n").alias("n"))
            high = asked.select("dim", "tree", "part", "q", up).withColumn(
                "prefix", F.expr(f"shiftright(part, {bits} - depth)")
            )
            deep = deep.union(high.join(above, ["dim", "tree", "depth", "prefix"]).select("q", F.col("depth").cast("long"), "n"))
        return deep.groupBy("q", "depth").agg(F.sum("n").alias("n"))

    def enough(self, tallies: DataFrame, queries: DataFrame, target: float = TARGET_RECALL) -> int:
        """The smallest number of candidates whose slices hold the share ``target``
        of the true neighbours of the sample."""
        sample = queries.orderBy(F.xxhash64("q"), "q").limit(SAMPLE_QUERIES).select(F.col("q").alias("rep"), "dim", "vec", "codes").collect()
        if not sample:
            return 1
        truth = _exact_sample(self.index, sample, self.k)
        spark = self.index.sparkSession
        wanted = sorted({r for reps in truth.values() for r in reps})
        ids = spark.createDataFrame([(r,) for r in wanted], "rep long")
        codes = {r["rep"]: np.array(r["codes"]) for r in self.index.join(F.broadcast(ids), "rep").select("rep", "codes").collect()}
        depths: dict[int, np.ndarray] = {}
        asked = spark.createDataFrame([(r["rep"],) for r in sample], "q long")
        for r in tallies.join(F.broadcast(asked), "q").collect():
            depths.setdefault(r["q"], np.zeros(BITS + 1, dtype=np.int64))[r["depth"]] = r["n"]
        # A neighbour is found when the tally asked for is over that of the
        # slices one bit below the first that hold it.
        needs = []
        for r in sample:
            for rep in truth.get(r["rep"], ()):
                deepest = int(shared_prefix(np.array(r["codes"]), codes[rep]).max())
                n = depths[r["rep"]]
                needs.append(int(n[deepest + 1]) + 1 if deepest < BITS else 1)
        if not needs:
            return 1
        needs.sort()
        return max(2 * self.k, needs[min(len(needs) - 1, int(np.ceil(target * len(needs))) - 1)])

    def search(self, query_rows: DataFrame, candidates: int | None = None) -> DataFrame:
        """(query_id, rank, vec_id, score) for rows (vec_id, v) of the table."""
        k, bits = self.k, self.part_bits
        asked = query_rows.select(F.col("vec_id").alias("query_id"), "v").join(self.uniq.select("rep", "v"), "v")
        asked = materialize(asked.select("query_id", F.col("rep").alias("q")).distinct(), "queries")
        queries = self.index.withColumnRenamed("rep", "q").join(asked.select("q").distinct(), "q", "left_semi")
        tallies = materialize(self.tallies(queries), "tallies")
        m = self.enough(tallies, queries) if candidates is None else candidates
        # The deepest level with enough candidates over all trees; the root if none.
        depth = tallies.groupBy("q").agg(
            F.coalesce(F.max(F.when(F.col("n") >= m, F.col("depth"))), F.lit(0)).alias("depth")
        )
        going = self._by_tree(queries, "q", "vec").join(depth, "q")
        if bits:
            width = F.expr(f"greatest({bits} - depth, 0)")
            first = F.expr(f"shiftleft(shiftright(part, cast(greatest({bits} - depth, 0) as int)), cast(greatest({bits} - depth, 0) as int))")
            going = going.withColumn("__w", width).withColumn("__first", first)
            going = going.withColumn(
                "part", F.explode(F.expr("sequence(__first, __first + shiftleft(1L, cast(__w as int)) - 1)"))
            ).drop("__w", "__first")

        def rank(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            out: list[tuple[int, int, float]] = []
            if len(asked) and len(index):
                index = index.sort_values(["code", "rep"])
                codes, reps = index["code"].to_numpy(dtype=np.int64), index["rep"].to_numpy()
                x = _matrix(index["vec"])
                lo, hi = _slices(codes, asked["code"].to_numpy(dtype=np.int64), asked["depth"].to_numpy(dtype=np.int64))
                for q, vec, a, b in zip(asked["q"].tolist(), asked["vec"], lo.tolist(), hi.tolist(), strict=True):
                    if a < b:
                        rows, dist = nearest(x[a:b], reps[a:b], np.frombuffer(vec, dtype="<f8"), k + 1)
                        out += [(q, int(reps[a + i]), float(s)) for i, s in zip(rows, dist, strict=True)]
            return pd.DataFrame(out, columns=["q", "rep", "score"]).astype({"q": "int64", "rep": "int64", "score": "float64"})

        key = ["dim", "tree", "part", "salt"]
        asked_key = [f"asked_{c}" for c in key]  # both sides come from one table
        found = (
            self._salted_index("vec")
            .select(*key, "rep", "code", "vec")
            .groupBy(*key)
            .cogroup(
                self._visit(going)
                .select(*key, "q", "code", "depth", "vec")
                .toDF(*asked_key, "q", "code", "depth", "vec")
                .groupBy(*asked_key)
            )
            .applyInPandas(rank, "q long, rep long, score double")
            .distinct()
        )
        # k + 1 ids per distinct query vector, then each query without itself.
        ids = found.join(self.index.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("vec_id"))
        nth = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))
        lists = ids.withColumn("nth", nth).filter(F.col("nth") <= k + 1)
        mine = asked.join(lists, "q").filter("query_id <> vec_id")
        rank_ = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return mine.withColumn("rank", rank_).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 10,
    query_every: int = 100,
    trees: int = TREES,
    part_rows: int = PART_ROWS,
    candidates: int | None = None,
) -> DataFrame:
    """The k nearest rows of every row whose id is divisible by ``query_every``:
    query_id, rank, vec_id, score (Euclidean distance in double precision).

    Defined cases: vectors that are null, zero, or hold null or non-finite
    components take no part, nor do rows without an id; equal distances rank by
    the smaller id; equal vectors are distance 0 from each other; rows that
    repeat id and vector are one row; vectors are compared with those of their
    own dimension only; with fewer than k candidates all are returned; an empty
    table gives no rows; other columns are ignored.
    """
    forest = Forest(df, id_col, vec_col, k, trees, part_rows)
    return forest.search(forest.rows.filter(F.col("vec_id") % query_every == 0), candidates)

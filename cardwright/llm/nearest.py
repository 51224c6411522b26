"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample, every vector is dealt to a leaf. A query walks the tree through a priority queue of
nodes, nearest centre first, which orders the leaves for it. How many leaves are visited is calibrated: for a sample of
queries the true neighbours are found among all vectors, and visits widen until their leaves hold the asked share of them. Leaves
are then searched in two rounds; in the second only what can still enter a query's best is told.
"""

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import tidy, written

#: Vectors on which the tree is fitted, children of a node, leaves at most, and queries on which visits are calibrated.
SAMPLE, BRANCHES, LEAVES, CALIBRATED = 65_536, 8, 4_096, 256
#: Share of true neighbours that visited leaves of the calibration queries hold at least.
RECALL = 0.96
#: Vectors and queries of a block, about; leaves of the first round.
BLOCK, ASKED, FIRST = 2_048, 2_048, 4

_PACK = "leaf int, block int, ids binary, vectors binary"


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows, in doubles; the same for the same two vectors wherever they are compared."""
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


class Tree:
    """Nodes with unit centres; node 0 is the root. ``leaf`` numbers nodes without children, -1 elsewhere."""

    def __init__(self, vectors: np.ndarray, n_leaves: int, seed: int = 1):
        unit, rng = _unit(vectors), np.random.default_rng(seed)
        self.children, centres, members = [[]], [unit.mean(0) if len(unit) else np.zeros(vectors.shape[1])], {0: np.arange(len(unit))}
        n, queue = 1, [(-len(unit), 0)]
        while n < n_leaves and queue:  # the largest node is divided first
            size, node = heapq.heappop(queue)
            mine = members.pop(node)
            parts = _parted(unit[mine], min(BRANCHES, n_leaves - n + 1), rng) if -size > 1 else []
            if len(parts) < 2:
                continue
            for part in parts:
                new = len(centres)
                self.children[node].append(new)
                self.children.append([])
                centres.append(unit[mine[part]].mean(0))
                members[new] = mine[part]
                heapq.heappush(queue, (-len(part), new))
            n += len(parts) - 1
        self.centres = _unit(np.array(centres))
        self.leaf = np.full(len(centres), -1, np.int64)
        ends = [i for i, c in enumerate(self.children) if not c]
        self.leaf[ends] = np.arange(len(ends))
        self.n_leaves = len(ends)

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector, from the root to the nearest child each time."""
        unit, node = _unit(vectors), np.zeros(len(vectors), np.int64)
        level = [0]
        while level:
            below = []
            for at in level:
                if (kids := self.children[at]) and len(mine := np.flatnonzero(node == at)):
                    node[mine] = np.array(kids)[np.argmax(unit[mine] @ self.centres[kids].T, axis=1)]
                    below += kids
            level = below
        return self.leaf[node]

    def visits(self, vector: np.ndarray, n: int) -> list[int]:
        """The first ``n`` leaves, best bin first."""
        nearness, queue, out = self.centres @ _unit(vector[None])[0], [(0.0, 0)], []
        while queue and len(out) < n:
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(queue, (-float(nearness[child]), child))
            else:
                out.append(int(self.leaf[node]))
        return out


def _parted(unit: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> list[np.ndarray]:
    """k-means by cosine; fewer parts where vectors coincide."""
    centres = unit[rng.choice(len(unit), min(k, len(unit)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(unit @ centres.T, axis=1)
        used = np.unique(near)
        centres = _unit(np.array([unit[near == c].mean(0) for c in used]))
    near = np.argmax(unit @ centres.T, axis=1)
    return [np.flatnonzero(near == c) for c in np.unique(near)]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors kept as bytes of doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


def _bytes(x: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in np.ascontiguousarray(x, np.float64)]


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = batch.column("v")
        x = np.asarray(v.flatten().cast(pa.float64())).reshape(len(v), -1) if len(v) else np.zeros((0, 1))
        # a power of two, which changes no digit: greatest components near 1
        x = np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=1e-300))[1][:, None])
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_bytes(x), pa.binary())], ["id", "v"])


def _assigned(tree, dims: int):
    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.value.assign(_matrix(batch.column("v"), dims))
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), batch.column("class"), batch.column("v")], ["leaf", "class", "v"])

    return assigned


def _packed(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    ids = rows["class"].to_numpy().tobytes()
    return pa.table([[key[0].as_py()], [key[1].as_py()], [ids], [b"".join(rows["v"].to_pylist())]], schema=_PACKED)


_PACKED = pa.schema([("leaf", pa.int32()), ("block", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])


class _Best:
    """The best ``k`` of each of some queries, kept as blocks of vectors pass."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.norms = np.sqrt((queries * queries).sum(1))
        self.ids, self.scores, self.leaves = (np.full((len(queries), k), fill, kind) for fill, kind in ((2**63 - 1, np.int64), (-np.inf, np.float64), (-1, np.int64)))

    def add(self, ids: np.ndarray, vectors: np.ndarray, leaf: int) -> None:
        near = self.queries @ (vectors / np.sqrt((vectors * vectors).sum(1))[:, None]).T / self.norms[:, None]
        some = min(len(ids), 2 * self.k + 4)  # a few more, as sums in another order may differ in the last digit
        place = np.argpartition(-near, some - 1, axis=1)[:, :some] if some < len(ids) else np.broadcast_to(np.arange(len(ids)), near.shape)
        exact = cosines(np.repeat(self.queries, some, axis=0), vectors[place.ravel()]).reshape(place.shape)
        # ties at the edge of what argpartition took: every vector as near as the last one takes part
        last = np.take_along_axis(near, place, 1).min(1)
        tied = (near >= last[:, None] - 1e-12).sum(1) > some
        for q in np.flatnonzero(tied).tolist():
            extra = np.flatnonzero(near[q] >= last[q] - 1e-12)
            self._put(np.array([q]), ids[extra][None], cosines(np.broadcast_to(self.queries[q], vectors[extra].shape), vectors[extra])[None], leaf)
        rest = np.flatnonzero(~tied)
        self._put(rest, ids[place[rest]], exact[rest], leaf)

    def _put(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray, leaf: int) -> None:
        ids, scores = np.hstack([self.ids[q], ids]), np.hstack([self.scores[q], scores])
        leaves = np.hstack([self.leaves[q], np.full((len(q), ids.shape[1] - self.k), leaf)])
        order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        self.ids[q], self.scores[q], self.leaves[q] = (np.take_along_axis(x, order, 1) for x in (ids, scores, leaves))


_FOUND = "asked long, class long, score double"


def _searched(dims: int, k: int):
    def searched(key: tuple[pa.Scalar, ...], asked: pa.Table, packs: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(asked) and len(packs):
            best = _Best(_matrix(asked["v"], dims), k)
            for ids, vectors in zip(packs["ids"].to_pylist(), packs["vectors"].to_pylist(), strict=True):
                best.add(np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, dims), 0)
            floor = asked["floor"].to_numpy()
            row, col = np.nonzero((best.scores >= floor[:, None]) & (best.scores > -np.inf))
            out.append((asked["asked"].to_numpy()[row], best.ids[row, col], best.scores[row, col]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["asked", "class", "score"])

    return searched


def _judged(queries, dims: int, k: int):
    """Of the calibration queries the best of the task's packs and their leaves."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(queries.value, k)
        for batch in batches:
            for leaf, ids, vectors in zip(*(batch.column(c).to_pylist() for c in ("leaf", "ids", "vectors")), strict=True):
                best.add(np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, dims), leaf)
        row, col = np.nonzero(best.scores > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(best.ids[row, col]), pa.array(best.scores[row, col]), pa.array(best.leaves[row, col])], ["asked", "class", "score", "leaf"])

    return judged


def _walked(tree, dims: int, first: int, last: int):
    """A row for each query and each of its leaves from place ``first`` to ``last``."""

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = [tree.value.visits(v, last)[first:] for v in _matrix(batch.column("v"), dims)]
            row = pa.array(np.repeat(np.arange(len(leaves)), [len(x) for x in leaves]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([y for x in leaves for y in x], pa.int32()), *(batch.column(c).take(row) for c in ("asked", "v", "floor"))], ["leaf", "asked", "v", "floor"])

    return walked


def valid_vectors(df: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): rows with an id and a vector that is neither null nor zero and whose components are finite numbers."""
    v = F.col(vector).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = v.isNotNull() & F.col(id).isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)
    return df.where(whole).select(F.col(id).cast("long").alias("id"), v.alias("v"))


def _top(df: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def _parts(df: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``df`` with ``parts``, the number of parts of its leaf: 1, or as counted (a row a leaf, ``LEAVES`` at most, so it is broadcast)."""
    known = df.sparkSession.createDataFrame(sorted(counts.items()), "leaf int, parts int")
    return df.join(F.broadcast(known), "leaf", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))


def nearest(df: DataFrame, asked: Column | str, k: int = 5, id: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row for which ``asked`` holds the ``k`` nearest others found, by cosine.

    ``asked`` is a condition on ``id`` alone. Nearest first, ties to the smaller id; fewer than ``k`` only where there are fewer others. Scores are exact, in doubles, on
    the vectors as given. Rows without id, and vectors that are null, empty, zero or hold null or non-finite components take no
    part, nor do those of another length than most have (of equally many, the shorter length). Rows that share an id are one vector: the first in order. Without
    vectors or queries the result is empty. Other columns, however named, are not read.

    Equal vectors are one class with its ``k`` + 1 smallest ids, so copies cost nothing. The tree is fitted on about
    ``SAMPLE`` classes chosen by a hash and has about the square root of their number in leaves, ``LEAVES`` at most; every class
    is dealt to a leaf. Leaves are searched in blocks of about ``BLOCK`` vectors against ``ASKED`` queries, so a leaf that holds
    a third of all rows is as many tasks as it has blocks. Visits are calibrated on about ``CALIBRATED`` queries
    against all vectors: the fewest leaves that hold the share ``recall`` of their true neighbours.
    """
    spark = df.sparkSession
    valid = written(valid_vectors(df, id, vector), "vectors")
    lengths = sorted(valid.groupBy(F.size("v").alias("d")).count().collect(), key=lambda r: (-r["count"], r["d"]))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not lengths:
        return empty
    dims = lengths[0]["d"]
    valid = valid.where(F.size("v") == dims)
    if not valid.groupBy("id").count().where("count > 1").isEmpty():
        valid = valid.groupBy("id").agg(F.min("v").alias("v"))
    coded = valid.mapInArrow(tidy(_encoded), "id long, v binary")
    key = [F.xxhash64("v").alias("a"), F.xxhash64(F.lit("v"), "v").alias("b")]  # 128 bits
    copies = _top(coded.select("id", "v", *key), ["a", "b"], k + 1, F.col("id"))
    members = written(copies.select("id", "v", "a", "b", F.min("id").over(Window.partitionBy("a", "b")).alias("class")), "classes")
    classes = members.where("id = class").select("class", "v")
    n = classes.count()
    ask = coded.withColumnRenamed("id", id).where(asked).select(F.col(id).alias("query_id"), *key)
    asks = written(ask.join(members.where("id = class").select("a", "b", "class"), ["a", "b"]).select("query_id", F.col("class").alias("asked")), "asks")

    some = lambda frame, name, most, of: frame.where(F.pmod(F.xxhash64(F.lit("pick"), name), F.lit(1 << 30)) < math.ceil(most / max(of, 1) * (1 << 30)))
    sample = _matrix(some(classes, "class", SAMPLE, n).orderBy("class").toArrow()["v"], dims)
    tree = Tree(sample, max(1, min(LEAVES, round(math.sqrt(n)), len(sample))))
    shared = spark.sparkContext.broadcast(tree)
    dealt = written(classes.mapInArrow(tidy(_assigned(shared, dims)), "leaf int, class long, v binary"), "dealt")
    blocks = {r["leaf"]: max(1, round(r["count"] / BLOCK)) for r in dealt.groupBy("leaf").count().collect()}  # LEAVES rows at most
    split = {i: c for i, c in blocks.items() if c > 1}
    block = F.pmod(F.xxhash64("class"), "parts").cast("int")
    packs = written(_parts(dealt, split).withColumn("block", block).groupBy("leaf", "block").applyInArrow(_packed, _PACK), "packs")

    wanted = asks.select("asked").distinct()
    queries = written(classes.join(wanted, F.col("class") == F.col("asked")).select("asked", "v"), "asked")
    n_asked = queries.count()
    if not n_asked:
        return empty
    trial = some(queries, "asked", CALIBRATED, n_asked).orderBy("asked").toArrow()
    visits = _calibrated(tree, trial if len(trial) else queries.limit(1).toArrow(), packs, dims, k, recall)

    found, floor = None, queries.withColumn("floor", F.lit(float("-inf")))
    for first, last in ((0, min(FIRST, visits)), (FIRST, visits)):
        if last <= first:
            break
        walked = written(floor.mapInArrow(tidy(_walked(shared, dims, first, last)), "leaf int, asked long, v binary, floor double"), "walked")
        chunks = {r["leaf"]: max(1, round(r["count"] / ASKED)) for r in walked.groupBy("leaf").count().collect()}
        chunks = {i: c for i, c in chunks.items() if c > 1}
        left = _parts(walked, chunks).withColumn("chunk", F.pmod(F.xxhash64("asked"), "parts").cast("int")).drop("parts")
        left = _parts(left, split).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        right = _parts(packs, chunks).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        place = ["leaf", "block", "chunk"]
        new = left.groupBy(*place).cogroup(right.groupBy(*place)).applyInArrow(_searched(dims, k + 1), _FOUND)
        new = new if found is None else found.unionByName(new)
        found = written(_top(new, ["asked"], k + 1, F.col("score").desc(), F.col("class")), "nearest")
        full = found.groupBy("asked").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        least = full.select("asked", F.when(F.col("n") > k, F.col("least")).otherwise(float("-inf")).alias("floor"))
        floor = queries.join(least, "asked", "left").select("asked", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))

    order = [F.col("score").desc(), F.col("vec_id")]
    named = _top(found.join(members.select("class", F.col("id").alias("vec_id")), "class").select("asked", "vec_id", "score"), ["asked"], k + 1, *order)
    result = asks.join(named, "asked").where("query_id != vec_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return result.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _calibrated(tree: Tree, trial: pa.Table, packs: DataFrame, dims: int, k: int, recall: float) -> int:
    """The fewest leaves, best bin first, that hold the share ``recall`` of the ``k`` true neighbours of the trial queries."""
    vectors, names = _matrix(trial["v"], dims), trial["asked"].to_pylist()
    shared = packs.sparkSession.sparkContext.broadcast(vectors)
    found = packs.mapInArrow(tidy(_judged(shared, dims, k + 1)), "asked long, class long, score double, leaf long")
    true = _top(found, ["asked"], k + 1, F.col("score").desc(), F.col("class")).collect()
    place = [{leaf: i for i, leaf in enumerate(tree.visits(v, tree.n_leaves))} for v in vectors]
    needed = sorted(place[r["asked"]][r["leaf"]] + 1 for r in true if r["class"] != names[r["asked"]])
    return needed[min(len(needed), math.ceil(recall * len(needed))) - 1] if needed else 1

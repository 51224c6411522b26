"""N-gram Jaccard self-join with several global token orders.

A document's set holds its distinct 5-word shingles. Two sets whose Jaccard similarity reaches the threshold share a token
among their first ``n - ceil(t * n) + 1`` tokens under any one order of all tokens, so candidates have to share a prefix
token under each of ORDERS orders before their sets are compared. All orders put common shingles last, which keeps
widely shared passages out of the prefixes; within a frequency class each order is its own permutation.

Groups are not expanded into all pairs. Equal texts are one node. Under the first order, each token's nodes are compared
with one of them, and nodes linked that way form components; a pair inside a component needs no comparison, as the
result is the component. Only tokens whose nodes still lie in different components are looked at again. Where those are
few, pairs from different components are compared. Tokens with many nodes join these into families, whose sets are
packed into blocks of like size, each written once; blocks are compared inside tasks, by counting matrices, and give
back the links that join their nodes and no pairs.

The first count of shingles misses those that are spread thinly over very many documents. Postings show their true
number; where such tokens take up much of the prefixes, the orders learn them and the postings are made again.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .hashing import NOT_SPACE, SMALL_CHUNK, Words, chunks, mix, utf8
from .shared import ROWS_AT_ONCE, rows_at_once, tables_dropped, tidy, written

ORDERS = 3
#: Shingles seen this often within one batch of documents are counted across batches.
LOCAL_COUNT = 2
#: The most frequent of those that the orders know; all others are of the lowest class. This bounds a broadcast, 16 bytes each; any order is correct.
KNOWN_SHINGLES = 150_000
#: Shingles counted, and postings sorted, by a task at a time.
COUNTED_AT_ONCE, POSTED_AT_ONCE = 1_500_000, 400_000
#: Postings of a bucket, about, which a task holds at a time; and of a partition of buckets.
BUCKET, PARTITION = 250_000, 2_000_000
#: A token with more postings than one in this many of all, and than so many, is hot: what is joined to its postings is broadcast, a row a token, so at most so many rows.
HOT_TOKENS, HOT = 20_000, 16
#: Nodes of a token from which they are compared as a family; nodes and shingles of a block then, about, and bytes of blocks that a task holds.
FAMILY, BLOCK, BLOCK_SHINGLES, BLOCK_BYTES = 48, 384, 200_000, 32_000_000
#: Nodes of a token from which the orders should know it; they learn such tokens if these have more than one in so many of the postings, so often at
#: most, and know so many tokens in all then, 16 bytes each.
THIN, THIN_SHARE, RELEARNT, KNOWN_LATER = 12, 20, 2, 2_000_000
#: Ids up to which a list of candidate documents is broadcast; above, a shuffle join is used.
BROADCAST_IDS = 1_000_000

_SEEDS = np.random.default_rng(4).integers(0, 2**64, ORDERS, dtype=np.uint64)


class Sets:
    """Shingle sets of a range of documents: ``of(d)`` is the sorted unsigned 64-bit hashes of document d's shingles."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, n: int = 5):
        words = Words(data, offsets, lo, hi, NOT_SPACE)
        hashes = words.hashes()
        at, runs = words.runs(hashes, n)
        self.counts, self.first = words.counts, np.searchsorted(at, words.first)
        self.runs, self.words, self.hashes, self.n = runs, words, hashes, n

    def of(self, d: int) -> np.ndarray:
        if not self.counts[d]:
            return np.zeros(0, np.uint64)
        if self.counts[d] < self.n:
            a, b = self.words.first[d], self.words.first[d + 1]
            total = np.uint64(b - a)
            for k, h in enumerate(self.hashes[a:b]):
                total = mix(np.array([total * np.uint64(0x9E3779B97F4A7C15) + h + np.uint64(k)]))[0]
            return np.array([total])
        return np.unique(self.runs[self.first[d] : self.first[d + 1]])


def each_set(column: pa.Array) -> Iterator[np.ndarray]:
    data, offsets = utf8(column)
    with np.errstate(over="ignore"):
        for lo, hi in chunks(offsets, SMALL_CHUNK):
            sets = Sets(data, offsets, lo, hi)
            for d in range(hi - lo):
                yield sets.of(d)


_WEIGHTS = mix(np.arange(1, 4097, dtype=np.uint64))


def _weights(n: int) -> np.ndarray:
    return _WEIGHTS[:n] if n <= len(_WEIGHTS) else mix(np.arange(1, n + 1, dtype=np.uint64))


def node_of(tokens: np.ndarray, clashing: frozenset[int] = frozenset()) -> int:
    """A signed 64-bit fingerprint of a set; its check instead, if several sets have that fingerprint."""
    node = int(mix(np.array([np.bitwise_xor.reduce(mix(tokens * _weights(len(tokens)) + np.uint64(7))) + np.uint64(len(tokens))])).view(np.int64)[0])
    return check_of(tokens) if node in clashing else node


def check_of(tokens: np.ndarray) -> int:
    """A second fingerprint, of other sums: sets with equal fingerprints and equal checks count as equal, 128 bits in all."""
    return int(mix(np.array([np.add.reduce(mix((tokens ^ _SEEDS[0]) + _weights(len(tokens)))) + np.uint64(len(tokens))])).view(np.int64)[0])


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


class Order:
    """The orders: ``keys(k, tokens)`` sorts by class of frequency, then by permutation k."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        at = np.argsort(tokens)
        self.tokens, self.classes = tokens[at], np.minimum(np.log2(counts[at].astype(np.float64)), 62).astype(np.uint64) + np.uint64(1)
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[self.tokens >> np.uint64(42)] = True

    def keys(self, k: int, tokens: np.ndarray) -> np.ndarray:
        key = mix(tokens ^ _SEEDS[k]) >> np.uint64(6)
        if len(self.tokens):
            maybe = np.flatnonzero(self.maybe[tokens >> np.uint64(42)])
            where = np.minimum(np.searchsorted(self.tokens, tokens[maybe]), len(self.tokens) - 1)
            key[maybe] |= np.where(self.tokens[where] == tokens[maybe], self.classes[where], np.uint64(0)) << np.uint64(58)
        return key

    def prefix(self, k: int, tokens: np.ndarray, percent: int) -> np.ndarray:
        """The set's prefix under order k, in that order."""
        keys, p = self.keys(k, tokens), prefix_length(len(tokens), percent)
        first = np.argpartition(keys, p - 1)[:p] if p < len(tokens) else np.arange(len(tokens))
        return tokens[first[np.argsort(keys[first])]]


_LIGHT = pa.schema([("id", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("n", pa.int64()), ("token", pa.int64()), ("count", pa.int64())])
_POSTINGS = pa.schema([("bucket", pa.int32()), ("tokens", pa.binary()), ("nodes", pa.binary()), ("token", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])
_LIVE = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])
_CANDIDATES = pa.schema([("node", pa.int64()), *((f"p{k}", pa.list_(pa.int32())) for k in range(1, ORDERS)), ("tokens", pa.binary())])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _columns(schema: pa.Schema, rows_: int, **known) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(known[f.name], f.type) if f.name in known else pa.nulls(rows_, f.type) for f in schema], schema=schema)


def _light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, node, check, n) of documents, and rows (token, count) of shingles common within some thousand documents."""
    held, n_held = [], 0

    def common() -> pa.RecordBatch:
        tokens = np.concatenate(held)
        held.clear()
        tokens.sort()
        at = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        counts = np.diff(np.append(at, len(tokens)))
        often = counts >= LOCAL_COUNT
        return _columns(_LIGHT, int(often.sum()), token=tokens[at[often]].view(np.int64), count=counts[often])

    for batch in batches:
        nodes, checks, sizes = [], [], []
        for tokens in each_set(batch.column(1)):
            nodes.append(node_of(tokens) if len(tokens) else None)
            checks.append(check_of(tokens) if len(tokens) else None)
            sizes.append(len(tokens))
            held.append(tokens)
            n_held += len(tokens)
            if n_held > COUNTED_AT_ONCE:
                yield common()
                n_held = 0
        yield _columns(_LIGHT, len(nodes), id=batch.column(0), node=nodes, check=checks, n=sizes)
    if n_held:
        yield common()


def _postings(broadcast, buckets: int, percent: int, clashing: frozenset[int]):
    """Prefix postings under the first order.

    Tokens that several nodes of a batch share are known to be live, so their postings are final; of each other token, and
    of one node for each live one, postings go packed into buckets by token, to meet those of other batches.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, held, seen, n_held = broadcast.value, [], set(), 0

        def flushed() -> Iterator[pa.RecordBatch]:
            tokens = np.concatenate([p for p, _, _ in held])
            lengths = [len(p) for p, _, _ in held]
            nodes = np.repeat(np.array([node for _, node, _ in held], np.int64), lengths)
            sizes = np.repeat(np.array([n for _, _, n in held], np.int32), lengths)
            places = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])
            held.clear()
            at = np.argsort(tokens, kind="stable")
            tokens, nodes, sizes, places = tokens[at], nodes[at], sizes[at], places[at]
            new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
            live = ~new | np.concatenate([~new[1:], [False]])
            yield _columns(_POSTINGS, int(live.sum()), token=tokens[live].view(np.int64), node=nodes[live], n=sizes[live], pos=places[live])
            tokens, rows = tokens[new], np.stack([nodes[new], sizes[new].astype(np.int64) << 32 | places[new]], 1)
            cuts = np.searchsorted(tokens, (np.arange(buckets + 1, dtype=np.float64) * (2.0**64 / buckets)).clip(0, 2.0**64 - 2048).astype(np.uint64))
            cuts[-1] = len(tokens)
            full = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
            yield _columns(_POSTINGS, len(full), bucket=full, tokens=[tokens[cuts[b] : cuts[b + 1]].tobytes() for b in full], nodes=[rows[cuts[b] : cuts[b + 1]].tobytes() for b in full])

        for batch in batches:
            for s in each_set(batch.column(0)):
                if not len(s) or (node := node_of(s, clashing)) in seen:
                    continue
                seen.add(node)
                held.append((order.prefix(0, s, percent), node, len(s)))
                n_held += len(held[-1][0])
                if n_held > POSTED_AT_ONCE:
                    yield from flushed()
                    n_held = 0
                    seen.clear()
        if held:
            yield from flushed()

    return post


def _met(tokens: list[np.ndarray], rows: list[np.ndarray]) -> pa.RecordBatch:
    """Postings of the tokens of a bucket that came from several batches with different nodes."""
    tokens, rows = np.concatenate(tokens), np.concatenate(rows).reshape(-1, 2)
    at = np.lexsort((rows[:, 0], tokens))
    tokens, rows = tokens[at], rows[at]
    new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (rows[1:, 0] != rows[:-1, 0])])
    tokens, rows = tokens[new], rows[new]
    same = tokens[1:] == tokens[:-1]
    live = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    tokens, rows = tokens[live], rows[live]
    return _columns(_LIVE, len(tokens), token=tokens.view(np.int64), node=rows[:, 0], n=(rows[:, 1] >> 32).astype(np.int32), pos=(rows[:, 1] & 0xFFFFFFFF).astype(np.int32))


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Final postings as they are, and those of packed buckets that meet; rows come in the order of buckets, so one bucket is held at a time."""
    bucket, tokens, rows = None, [], []
    for batch in batches:
        final = batch.column("bucket").is_null()
        yield pa.RecordBatch.from_arrays(batch.filter(final).select(_LIVE.names).columns, schema=_LIVE)
        packed = batch.filter(pa.compute.invert(final))
        for b, t, r in zip(packed.column("bucket").to_pylist(), packed.column("tokens"), packed.column("nodes"), strict=True):
            if b != bucket and tokens:
                yield _met(tokens, rows)
                tokens, rows = [], []
            bucket = b
            tokens.append(np.frombuffer(t.as_py(), np.uint64))
            rows.append(np.frombuffer(r.as_py(), np.int64))
    if tokens:
        yield _met(tokens, rows)


def _candidates(broadcast, percent: int, clashing: frozenset[int]):
    """Of each text its node, its prefixes under the further orders (32 bits a token, which can only let more pairs through), and its set."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = broadcast.value
        for batch in batches:
            rows = [(node_of(s, clashing), [order.prefix(k, s, percent).astype(np.uint32).view(np.int32) for k in range(1, ORDERS)], s.tobytes()) for s in each_set(batch.column(0)) if len(s)]
            prefixes = {f"p{k}": [r[1][k - 1] for r in rows] for k in range(1, ORDERS)}
            yield _columns(_CANDIDATES, len(rows), node=[r[0] for r in rows], tokens=[r[2] for r in rows], **prefixes)

    return make


def _linked(percent: int):
    """The pairs whose sets reach the threshold."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("tokens_a"), batch.column("tokens_b"), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([s, t])
                both.sort()
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(100 * same >= percent * (len(s) + len(t) - same))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], schema=_PAIRS)

    return verify


def _incidence(rows: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """How many elements each of ``rows`` has in common with each of ``other``; elements are distinct within a row."""
    owner = np.repeat(np.arange(len(rows) + len(other)), [len(r) for r in rows] + [len(r) for r in other])
    tokens = np.concatenate([*rows, *other])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.concatenate([[True], tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, dtype=bool)
    column = np.cumsum(new) - 1
    kept = np.bincount(column)[column] > 1 if len(tokens) else new
    column, owner = np.unique(column[kept], return_inverse=True)[1], owner[kept]
    out = np.zeros((len(rows), len(other)), np.float32)
    for lo in range(0, int(column.max()) + 1 if len(column) else 0, 4096):
        part = (column >= lo) & (column < lo + 4096)
        there = np.zeros((len(rows) + len(other), 4096), np.float32)
        there[owner[part], column[part] - lo] = 1
        out += there[: len(rows)] @ there[len(rows) :].T
    return out


def _within(percent: int):
    """Links within a block of a family, or between two: only those that first join two of its nodes' groups."""

    def compare(one: pa.StructArray, two: pa.StructArray) -> list[tuple[int, int]]:
        share = np.ones((len(one), len(two)), dtype=bool)
        for k in range(1, ORDERS):
            share &= _incidence(*([np.unique(v.values.to_numpy()) for v in x.field(f"p{k}")] for x in (one, two))) > 0
        if not share.any():
            return []
        a, b = ([np.frombuffer(t.as_buffer(), np.uint64) for t in x.field("tokens")] for x in (one, two))
        both, n, m = _incidence(a, b).astype(np.int64), np.array([len(x) for x in a]), np.array([len(x) for x in b])
        linked = share & (100 * both >= percent * (n[:, None] + m[None, :] - both))
        x, y, parent = one.field("node").to_pylist(), two.field("node").to_pylist(), {}

        def root(v: int) -> int:
            while parent.setdefault(v, v) != v:
                parent[v] = v = parent[parent[v]]
            return v

        found = []
        for i, j in np.argwhere(linked).tolist():
            u, v = root(x[i]), root(y[j])
            if u != v:
                parent[v] = u
                found.append((x[i], y[j]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column("one"), batch.column("two"), strict=True):
                found = compare(one.values, two.values)
                yield _columns(_PAIRS, len(found), a=[u for u, _ in found], b=[v for _, v in found])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable over ``edges`` (a, b), for each node with an edge.

    Alternating large and small stars; each round is written, so nothing is recomputed when an executor is lost. A node
    with very many neighbours is a skewed key of a plain join, which adaptive execution splits.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    check = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
    before = check(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = written(small, "edges")
        after = check(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def by_token(posts: DataFrame, per_token: DataFrame, hot: DataFrame) -> DataFrame:
    """Join postings with a table that has one row a token. Those of ``hot`` tokens (token) stay where they are, as their few rows are broadcast: no task gets all postings of such a token."""
    few = F.broadcast(per_token.join(F.broadcast(hot), "token", "left_semi"))
    others = posts.join(F.broadcast(hot), "token", "left_anti").join(per_token, "token")
    return posts.join(few, "token").unionByName(others)


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """(``id_col``, n_shingles, component_id): one row for each row of ``docs``.

    Words are runs of anything but space and \\\\x09-\\\\x0D, A-Z folded; a text of fewer than 5 words is one shingle. Two
    rows link when 100 * intersection >= ``percent`` * union of their sets; component_id is the smallest id reachable.
    Null, empty and blank texts have no shingles and are linked with nothing: component_id is their own id. Repeated rows
    are linked with each other. Extra columns of ``docs`` are ignored. Ids are integers; a null id counts as no id for
    the smallest of a component. Sets are held as 64-bit hashes of their shingles and known by 64-bit fingerprints; where a
    second fingerprint shows that different sets share one, they go by the second. An empty table gives no rows.
    """
    with rows_at_once(docs.sparkSession, ROWS_AT_ONCE), tables_dropped(docs.sparkSession):
        return written(_ngram_components(docs, id_col, text, percent), "components", keep=True)


def _ngram_components(docs: DataFrame, id_col: str, text: str, percent: int) -> DataFrame:
    spark = docs.sparkSession
    ddl = lambda schema: from_arrow_schema(schema)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    texts = rows.select("text")
    tokens_of = lambda t: (t["token"].to_numpy().view(np.uint64), t["count"].to_numpy())
    light = written(rows.mapInArrow(tidy(_light), ddl(_LIGHT)), "light")
    known = light.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "token").limit(KNOWN_SHINGLES).toArrow()
    order = spark.sparkContext.broadcast(Order(*tokens_of(known)))
    ids = light.where(F.col("token").isNull()).select("id", "node", "check", "n")
    # different sets with one fingerprint: of n sets about n * n / 2 ** 65, so hardly ever any
    twice = ids.groupBy("node").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x != y").select("node")
    clashing = frozenset(r["node"] for r in twice.collect())
    if clashing:
        ids = ids.withColumn("node", F.when(F.col("node").isin(*clashing), F.col("check")).otherwise(F.col("node")))
    ids = ids.drop("check")

    # each text's smallest id: found where rows lie before they are dealt by text, so that many copies of one come as few rows
    smallest = written(ids.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("least")), "smallest")

    # buckets and partitions by the number of postings, each about 1 / 5 of a set's shingles
    partitions, total = int(spark.conf.get("spark.sql.shuffle.partitions")), ids.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    postings = total - percent * total // 100
    buckets, partitions = max(4 * partitions, postings // BUCKET), max(partitions, postings // PARTITION)

    def few(ids: DataFrame) -> DataFrame:
        """A list of ids as it is joined: broadcast where its size allows."""
        return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def posted(order) -> tuple[DataFrame, DataFrame]:
        """Postings of the tokens that several nodes have in their prefixes, and for each token one of the nodes and their number."""
        found = texts.mapInArrow(tidy(_postings(order, buckets, percent, clashing)), ddl(_POSTINGS))
        # one pass: final postings have no bucket and go through the same exchange, spread by token and node
        spread = found.repartition(partitions, F.coalesce("bucket", F.xxhash64("token", "node"))).sortWithinPartitions("bucket")
        live = written(spread.mapInArrow(tidy(_settled), ddl(_LIVE)), "live")
        return live, written(live.groupBy("token").agg(F.min(F.struct("node", "n", "pos")).alias("c"), F.count("*").alias("nodes")), "centres")

    live, centre = posted(order)
    for _ in range(RELEARNT):
        old = written(spark.createDataFrame(known), "known")
        thin = centre.where(F.col("nodes") > THIN).select("token", F.col("nodes").alias("count")).join(few(old.withColumnRenamed("count", "before")), "token", "left")
        thin = written(thin.where("before IS NULL OR count > 4 * before").select("token", "count"), "thin")
        n = thin.crossJoin(F.broadcast(centre.agg(F.sum("nodes").alias("all")))).agg(F.sum("count").alias("thin"), F.first("all").alias("all")).first()
        if not n["all"] or n["thin"] * THIN_SHARE <= n["all"]:
            break
        known = old.unionByName(thin).groupBy("token").agg(F.max("count").alias("count")).orderBy(F.desc("count"), "token").limit(KNOWN_LATER).toArrow()
        order = spark.sparkContext.broadcast(Order(*tokens_of(known)))
        live, centre = posted(order)

    def can(n: Column, pos: Column, m: Column, at: Column) -> Column:
        """Whether sets of n and m tokens that first meet at these places of their prefixes can still reach the threshold."""
        reach = F.least(n - pos, m - at)
        return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (reach * (100 + percent) >= percent * (n + m))

    def candidate_sets(nodes: DataFrame) -> DataFrame:
        """Prefixes and sets of the nodes, from one text each."""
        chosen = written(smallest.join(nodes, "node", "left_semi").select("node", F.col("least").alias("chosen")), "chosen")
        wanted = written(chosen.select("chosen").distinct(), "wanted")
        of_wanted = rows.join(few(wanted), rows["id"].eqNullSafe(F.col("chosen")), "left_semi").select("text")
        found = written(of_wanted.mapInArrow(tidy(_candidates(order, percent, clashing)), ddl(_CANDIDATES)).join(few(chosen.select("node")), "node", "left_semi"), "sets")
        n = found.agg(F.count("*").alias("all"), F.countDistinct("node").alias("distinct")).first()
        # an id that several texts have gives more rows than nodes
        return found if n["all"] == n["distinct"] else written(found.dropDuplicates(["node"]), "sets")

    def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs that share a prefix token under the further orders as well, and whose sets reach the threshold."""
        side = lambda of, x, *columns: of.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns))
        further = [f"p{k}" for k in range(1, ORDERS)]
        shared = pairs.join(side(sets, "a", *further), "a").join(side(sets, "b", *further), "b")
        for c in further:
            shared = shared.where(F.arrays_overlap(f"{c}_a", f"{c}_b"))
        shared = written(shared.select("a", "b"), "shared")
        whole = sets.join(few(written(ends(shared), "ends")), "node", "left_semi")
        whole = shared.join(side(whole, "b", "tokens"), "b").join(side(whole, "a", "tokens"), "a")
        return written(whole.mapInArrow(tidy(_linked(percent)), ddl(_PAIRS)), "links")

    ends = lambda pairs: pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ordered = lambda pairs, x, y: pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
    # each token's nodes against one of them
    most = max(HOT, centre.agg(F.coalesce(F.sum("nodes"), F.lit(0)).alias("n")).first()["n"] / HOT_TOKENS)
    hot = written(centre.where(F.col("nodes") > most).select("token"), "hot")
    stars = by_token(live, centre.select("token", "c"), hot).where((F.col("node") != F.col("c.node")) & can(F.col("n"), F.col("pos"), F.col("c.n"), F.col("c.pos")))
    stars = written(ordered(stars, "node", "c.node"), "pairs")
    sets = candidate_sets(ends(stars))
    links = verified(stars, sets)
    comps = components(links)
    placed = live.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    apart = placed.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("nodes")).where("x != y").select("token", "nodes")
    mixed = written(by_token(placed, written(apart, "apart"), hot), "mixed")

    # families of the tokens that very many nodes share
    many, more = mixed.where(F.col("nodes") > FAMILY), []
    centre = written(many.groupBy("token").agg(F.min("node").alias("a")), "firsts")
    families = written(by_token(many, centre, hot).select("a", F.col("node").alias("b")).distinct(), "families")
    if families.limit(1).count():
        sets = sets.unionByName(candidate_sets(ends(families).join(sets, "node", "left_anti")))
        member = components(families).withColumnRenamed("comp", "family")
        # sets that link are of one band of sizes or of neighbouring ones
        n = sets.select("node", (F.length("tokens") / 8).alias("n"))
        band = F.floor(F.log("n") / (1.001 * np.log(100 / percent))) if 0 < percent < 100 else F.col("n").cast("long") if percent >= 100 else F.lit(0)
        member = written(member.join(n, "node").withColumn("band", band.cast("long")), "members")
        size = member.groupBy("family", "band").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
        at = member.join(size, ["family", "band"]).select("node", "family", (F.shiftleft("band", 32) + F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("k"))
        packed = at.join(sets, "node").groupBy("family", "k").agg(F.collect_list(F.struct("node", *(f"p{k}" for k in range(1, ORDERS)), "tokens")).alias("sets"))
        packed = written(packed, "blocks")
        # no block is copied: a task reads the others' blocks from the table. Ranges instead of equal families, which would deal a family to one task
        held = 1 + int((member.agg(F.sum("n")).first()[0] or 0) * 10 // BLOCK_BYTES)
        one = packed.select(F.col("family").alias("f"), F.col("k").alias("i"), F.col("sets").alias("one")).repartition(max(held, 2 * spark.sparkContext.defaultParallelism))
        two = packed.select(F.col("family").alias("from"), F.col("family").alias("to"), F.col("k").alias("j"), F.col("sets").alias("two")).repartition(held)
        near = (F.col("f") >= F.col("from")) & (F.col("f") <= F.col("to")) & (F.col("j") >= F.col("i")) & (F.shiftright("j", 32) <= F.shiftright("i", 32) + 1)
        with rows_at_once(spark, 4):
            more.append(written(one.join(two.hint("shuffle_replicate_nl"), near).select("one", "two").mapInArrow(tidy(_within(percent)), ddl(_PAIRS)), "links"))

    # the others, pair by pair
    rest = mixed.where(F.col("nodes") <= FAMILY)
    a, b = rest.alias("a"), rest.alias("b")
    across = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.comp") < F.col("b.comp")) & can(F.col("a.n"), F.col("a.pos"), F.col("b.n"), F.col("b.pos")))
    across = written(ordered(across, "a.node", "b.node").join(stars, ["a", "b"], "left_anti"), "pairs")
    sets = sets.unionByName(candidate_sets(ends(across).join(sets, "node", "left_anti")))
    more.append(verified(across, sets))
    if any(x.limit(1).count() for x in more):
        for x in more:
            links = links.unionByName(x)
        comps = components(links)

    joined = smallest.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    of_comp = joined.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_node = joined.join(of_comp, "comp").select("node", "component_id")
    out = ids.join(by_node, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))

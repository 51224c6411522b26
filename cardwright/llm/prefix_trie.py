"""Prefix trie of conversations, with totals of subtrees by parallel tree contraction.

Nodes are prefixes of conversations, known by their length and 128 bits: the exclusive or of hashes of (place, turn), so a running
value over a conversation gives the keys of all its prefixes, also where the conversation is dealt over several tasks.
Totals come from rounds of joins. Each round rakes the leaves (their totals are added to their parents) and compresses chains of
nodes with one child (pointers are doubled until all of a chain point to its end). Then the rounds are gone through
backwards: a raked node had its total, a node of a chain has what stands between it and the chain's end besides the end's total.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import tables_dropped, tidy, written

#: Turns of a conversation whose keys one task works out, and conversations' ids joined to a text at a time.
BLOCK, IDS = 1_024, 12

_SUMS = ("leaves", "tokens")


def numbered(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, k, l, size, n): turns with their place in the conversation (from 0), two hashes of role and text, bytes of
    the text and the conversation's number of turns. Ordered by turn, null first, equal turns by role and text.

    Rows are dealt by ranges of (conversation, turn, role, text), so a long conversation is several tasks' work; each task's turns follow those
    of the ones before it.
    """
    rows = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    keys = [F.xxhash64("role", "text").alias("k"), F.xxhash64(F.lit("turn"), "text", "role").alias("l"), F.octet_length("text").cast("long").alias("size")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", *keys, F.monotonically_increasing_id().alias("place"))
    dealt = written(dealt.withColumn("task", F.shiftright("place", 33)), "turns")
    parts = dealt.groupBy("conv_id", "task").agg(F.min("place").alias("first"), F.count("*").alias("some"))
    whole = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("some").over(whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("conv_id", "task", (before - F.col("first")).alias("shift"), F.sum("some").over(whole).alias("n"))
    return dealt.join(parts, ["conv_id", "task"]).select("conv_id", (F.col("place") + F.col("shift")).alias("pos"), "k", "l", "size", "n")


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, pos, k, l, size, n) of rebuilt conversations: the first h turns of conversation c - c % ``group``, then c's own
    after its first h; h is crc32(c) % ``most``. A conversation that has no turn then is a row without place and n = 0."""
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    base = F.col("conv_id") - F.col("conv_id") % group
    convs = turns.groupBy("conv_id").agg(F.max("n").alias("own")).select("conv_id", "own", taken.alias("h"), base.alias("base"))
    heads = turns.where((F.col("pos") < most - 1) & (F.col("conv_id") % group == 0))
    length = heads.groupBy("conv_id").agg(F.count("*").alias("there")).withColumnRenamed("conv_id", "base")
    convs = convs.join(length, "base", "left").withColumn("there", F.least("h", F.coalesce("there", F.lit(0))))
    convs = written(convs.withColumn("n", F.col("there") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "rebuilt")
    heads = heads.select(F.col("conv_id").alias("base"), "pos", "k", "l", "size").join(convs.where("there > 0").select("conv_id", "base", "h", "n"), "base").where("pos < h")
    own = turns.drop("n").join(convs.select("conv_id", "h", "there", "n"), "conv_id").where("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("there"))
    none = convs.where("n = 0").select("conv_id", *(F.lit(None).cast("long").alias(c) for c in ("pos", "k", "l", "size")), "n")
    columns = ["conv_id", "pos", "k", "l", "size", "n"]
    return heads.select(columns).unionByName(own.select(columns)).unionByName(none)


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, pa, pb, size, ends): a row for each prefix of each conversation, but the empty one; pa and pb are the key of the prefix before."""
    block = F.floor(F.col("pos") / BLOCK).alias("block")
    rows = turns.where("pos IS NOT NULL").select("conv_id", block, "pos", "size", "n", F.xxhash64("pos", "k").alias("x"), F.xxhash64("l", "pos").alias("y"))
    inside = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.where(f"n > {BLOCK}").groupBy("conv_id", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    totals = totals.select("conv_id", "block", F.bit_xor("x").over(before).alias("tx"), F.bit_xor("y").over(before).alias("ty"))
    keyed = rows.withColumns({"a": F.bit_xor("x").over(inside), "b": F.bit_xor("y").over(inside)}).join(totals, ["conv_id", "block"], "left")
    a, b = (F.col(c).bitwiseXOR(F.coalesce(t, F.lit(0))) for c, t in (("a", "tx"), ("b", "ty")))
    return keyed.select(
        "conv_id", (F.col("pos") + 1).alias("depth"), a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("x")).alias("pa"), b.bitwiseXOR(F.col("y")).alias("pb"),
        "size", (F.col("pos") + 1 == F.col("n")).alias("ends"),
    )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined texts of each node, whose rows follow each other; only the node at hand is kept."""
    node, state, out = None, None, []
    for batch in batches:
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "a", "b", "ids")), strict=True):
            if key != node:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(out) > 10_000:
            yield _hashes(out)
            out = []
    if node is not None:
        out.append((*node, state.hexdigest()))
    yield _hashes(out)


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)] + [pa.array([r[3] for r in rows], pa.string())], ["depth", "a", "b", "ends_sha256"])


def ends_digest(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) from (depth, a, b, conv_id): ids are joined to texts a range at a time, and the texts are hashed in their order."""
    texts = ends.groupBy("depth", "a", "b", F.shiftright("conv_id", IDS).alias("range")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ordered = texts.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "range")
    return ordered.select("depth", "a", "b", "ids").mapInArrow(tidy(_hashed), "depth long, a long, b long, ends_sha256 string")


def _plus(df: DataFrame, more: DataFrame) -> DataFrame:
    """``df`` with the sums of ``more`` (key, leaves, tokens) added where its id is the key."""
    sums = more.groupBy("key").agg(*(F.sum(c).alias(f"more_{c}") for c in _SUMS), F.count("*").alias("gone"))
    return df.join(sums, F.col("id") == F.col("key"), "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in _SUMS})


def contract(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(raked and compressed nodes' values): from (id, parent, kids, leaves, tokens), the root's parent null, to totals by ``expand``.

    A node that was raked stands with its total; one that was compressed stands with ``next``, the end of its chain, and the sum from it up to that end.
    """
    live, raked, chains = written(nodes, "live"), [], []
    while True:
        leaf = live.where("kids = 0 AND parent IS NOT NULL")
        raked.append(live.where("kids = 0").select("id", *_SUMS))
        stay = _plus(live.where("kids > 0"), leaf.select(F.col("parent").alias("key"), *_SUMS))
        live = written(stay.select("id", "parent", (F.col("kids") - F.coalesce("gone", F.lit(0))).alias("kids"), *_SUMS), "raked")
        if live.isEmpty():
            return raked, chains
        single = F.col("kids").eqNullSafe(1) & F.col("parent").isNotNull()
        unary = live.where(single).select("id", "parent", *_SUMS)
        child = live.where("parent IS NOT NULL").select(F.col("id").alias("next"), F.col("parent").alias("of"), single.alias("open"))
        above = unary.select(F.col("id").alias("above"))
        chain = unary.join(child, F.col("id") == F.col("of")).join(above, F.col("parent") == F.col("above"), "left")
        chain = written(chain.select("id", "parent", F.col("above").isNull().alias("top"), "next", "open", *_SUMS), "chain")
        if chain.isEmpty():
            continue
        ready = chain.where("NOT open")
        while not chain.where("open").isEmpty():
            there = chain.select(F.col("id").alias("there"), F.col("next").alias("then"), F.col("open").alias("then_open"), *(F.col(c).alias(f"more_{c}") for c in _SUMS))
            hop = chain.where("open").join(there, F.col("next") == F.col("there"))
            hop = hop.select("id", "parent", "top", F.col("then").alias("next"), F.col("then_open").alias("open"), *((F.col(c) + F.col(f"more_{c}")).alias(c) for c in _SUMS))
            chain = written(chain.where("NOT open").unionByName(hop), "hop")
            ready = chain
        chains.append((len(raked), ready.select("id", "next", *_SUMS)))
        tops = ready.where("top")
        rest = _plus(live.where(~single), tops.select(F.col("parent").alias("key"), *_SUMS)).select("id", "parent", "kids", *_SUMS)
        moved = tops.select(F.col("next").alias("moved"), F.col("parent").alias("to"))
        rest = rest.join(moved, F.col("id") == F.col("moved"), "left")
        live = written(rest.select("id", F.coalesce("to", "parent").alias("parent"), "kids", *_SUMS), "live")


def expand(raked: list[DataFrame], chains: list[tuple[int, DataFrame]]) -> DataFrame:
    """(id, leaves, tokens): the totals of all nodes, from the last round back to the first."""
    totals, n = None, len(raked)
    for after, chain in reversed(chains):
        for part in raked[after:n]:
            totals = part if totals is None else totals.unionByName(part)
        n = after
        ends = totals.select(F.col("id").alias("end"), *(F.col(c).alias(f"more_{c}") for c in _SUMS))
        found = chain.join(ends, F.col("next") == F.col("end")).select("id", *((F.col(c) + F.col(f"more_{c}")).alias(c) for c in _SUMS))
        totals = totals.unionByName(written(found, "expanded"))
    for part in raked[:n]:
        totals = part if totals is None else totals.unionByName(part)
    return totals


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rebuild: bool = True) -> DataFrame:
    """A row for each node of the trie of (rebuilt) conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of first turns (role, text), its members the conversations that start with it; the root has depth 0 and no
    parent. n_leaves counts the childless nodes of the subtree, itself included; saved_tokens sums (n_convs - 1) times the bytes of the node's last
    text over the subtree; ends_sha256 is of the ids of members without further turns, ascending, comma-joined.

    Null roles and texts are empty, null turns come first, rows of equal turn go by role and text, and repeated rows are repeated turns. Rows
    without conversation take no part. An empty table has no nodes. Other columns are not read. With ``rebuild``, see ``rebuilt``.
    """
    with tables_dropped(conversations.sparkSession):
        turns = numbered(conversations, conv, turn, role, text)
        turns = written(rebuilt(written(turns, "numbered")) if rebuild else turns, "places")
        paths = written(_prefixes(turns), "prefixes")
        root = turns.groupBy("conv_id").agg(F.max("n").alias("n")).agg(F.min("conv_id").alias("root"), F.count("*").alias("all")).first()
        if not root["all"]:
            return turns.limit(0).select(*(F.col("conv_id").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), F.lit("").alias("ends_sha256"))
        spark, zero = turns.sparkSession, F.lit(0).cast("long")
        found = paths.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *(F.min(c).alias(c) for c in ("pa", "pb", "size")))
        found = written(found, "nodes")
        up = found.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
        first = found.where("depth = 1").withColumn("parent_conv_id", F.lit(root["root"]))
        nodes = first.unionByName(found.where("depth > 1").join(up, ["depth", "pa", "pb"]), allowMissingColumns=True).drop("pa", "pb")
        top = spark.range(1).select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), F.lit(root["root"]).alias("conv_id"), F.lit(root["all"]).alias("n_convs"), zero.alias("size"), F.lit(None).cast("long").alias("parent_conv_id"))
        kids = nodes.groupBy("parent_conv_id", (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children")).withColumnRenamed("parent_conv_id", "conv_id")
        nodes = nodes.unionByName(top).join(kids, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", zero))
        ends = paths.where("ends").select("depth", "a", "b", "conv_id").unionByName(turns.where("n = 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id"))
        nodes = nodes.join(ends_digest(ends), ["depth", "a", "b"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
        nodes = written(nodes.drop("a", "b").withColumn("id", F.struct("conv_id", "depth")), "tree")
        parent = F.when(F.col("depth") > 0, F.struct(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")))
        values = nodes.select("id", parent.alias("parent"), F.col("n_children").alias("kids"), (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("tokens"))
        totals = expand(*contract(values))
        columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("tokens").alias("saved_tokens"), "ends_sha256"]
        return written(nodes.join(totals, "id").select(columns), "trie", keep=True)

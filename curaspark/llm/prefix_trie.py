"""Prefix trie of conversations as a z-fast trie: compacted nodes in a hash table, found by fat binary search.

A conversation is a sequence of turns, and a prefix of it is known by a 128-bit digest. Conversations that are equal are one
*path* with its number of copies. A compacted node stands for an edge: the depths (top, depth] below its parent, the digests of
the prefixes that end there and the bytes of text up to each. Its *handle* is the digest at the two-fattest depth of
(top, depth], the one that the highest power of two divides; handles are the keys of the hash table.

Paths enter in batches. Every waiting path finds its exit node by fat binary search: it looks up its own digest at the
two-fattest depth of the range that is left; a hit whose digest at the node's depth agrees goes below that node, a
hit that does not agree is the exit, a miss goes above. A search takes a logarithm of the length in lookups, each a join of the
waiting paths with the handles; a last one by the digest of the next turn finds the edge below. Then the edges where paths part are cut,
and of all paths that leave the trie by one same turn one, chosen by a hash, becomes a new edge; the others wait. A path waits
once for every time that the chosen one parts from it, so the number of batches grows with the logarithm of the paths only.

Sums over subtrees come from pointers doubled to the root. Only at the end are the edges expanded to one row per depth.
Digests travel, texts do not; lookups split keys that many rows share off and broadcast their few matches.

Rows without a conversation id belong to no conversation. Turns are ordered by turn (null first), then role, then digest; null
roles and texts are empty; repeated rows are turns of their own. A conversation is one row of 24 bytes a turn. An empty table
gives no nodes. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.llm.common import STEP, mix, slices
from curaspark.session import checkpoint

#: A key with more than this share of the rows is looked up apart, so at most that many keys are.
HOT_SHARE = 1 / 500
#: Digest of the empty prefix.
ROOT = bytes(16)
#: Bytes of member lists that are handed on in one row.
CHUNK = 1 << 14


def lookup(rows: DataFrame, table: DataFrame, on: str, key: str) -> DataFrame:
    """Left join of ``rows`` with ``table``, whose ``key`` is unique, where ``rows.on`` equals it.

    A few keys may hold most rows: those over ``HOT_SHARE`` of the rows are found by counting and their matches broadcast.
    Rows without a key ask for nothing and are not shuffled.
    """
    limit = max(1000, int(rows.count() * HOT_SHARE))
    asking = rows.filter(F.col(on).isNotNull())
    hot = [bytes(r[on]) for r in asking.groupBy(on).count().filter(F.col("count") > limit).collect()]  # 1 / HOT_SHARE rows at most
    idle = rows.filter(F.col(on).isNull())
    for field in table.schema:
        idle = idle.withColumn(field.name, F.lit(None).cast(field.dataType))
    same = F.col(on) == F.col(key)
    if not hot:
        return idle.unionByName(asking.join(table, same, "left"))
    few = F.broadcast(table.filter(F.col(key).isin(hot)))
    cold = asking.filter(~F.col(on).isin(hot)).join(table, same, "left")
    return idle.unionByName(cold).unionByName(asking.filter(F.col(on).isin(hot)).join(few, same, "left"))


# ------------------------------------------------------------------ conversations and their prefixes


def turn_lists(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns): the ordered turns of every conversation as (digest, bytes of text)."""
    said = F.coalesce(F.col(text), F.lit(""))
    who = F.coalesce(F.col(role), F.lit(""))
    digest = F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, said))
    turns = rows.filter(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv"),
        F.struct(F.col(turn).alias("turn"), who.alias("role"), digest.alias("digest"), F.octet_length(said).cast("bigint").alias("bytes")).alias("t"),
    )
    listed = turns.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return listed.select("conv", F.transform("t", lambda t: F.struct(F.unhex(t["digest"]).alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv, path): the digest of every prefix of ``turns`` (one turn at least) and the bytes of text in it.

    A prefix is the exclusive or of its turns' digests, each mixed with its place.
    """
    element = pa.struct([("digest", pa.binary()), ("bytes", pa.int64())])
    schema = pa.schema([("conv", conversations_type(conversations)), ("path", pa.list_(element))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            lists = part.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            words = np.frombuffer(b"".join(flat.field(0).to_pylist()), np.uint64).reshape(-1, 2)
            starts = np.cumsum(sizes) - sizes
            place = (np.arange(len(words)) - np.repeat(starts, sizes) + 1).astype(np.uint64)[:, None]
            mixed = mix(mix(words + place * STEP) + np.array([1, 2], np.uint64))
            running = np.vstack([np.zeros((1, 2), np.uint64), np.bitwise_xor.accumulate(mixed, axis=0)]) if len(words) else np.zeros((1, 2), np.uint64)
            digests = running[1:] ^ np.repeat(running[starts], sizes, axis=0)
            total = np.concatenate([[0], np.cumsum(flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64))])
            upto = total[1:] - np.repeat(total[starts], sizes)
            offsets = pa.array(np.arange(0, 16 * len(words) + 1, 16, dtype=np.int32))
            keys = pa.Array.from_buffers(pa.binary(), len(words), [None, offsets.buffers()[1], pa.py_buffer(digests.tobytes())])
            turns = pa.StructArray.from_arrays([keys, pa.array(upto, pa.int64())], fields=list(element))
            paths = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), turns)
            yield pa.RecordBatch.from_arrays([part.column(0), paths], schema=schema)

    kind = conversations.schema["conv"].dataType.simpleString()
    return conversations.select("conv", "turns").mapInArrow(run, f"conv {kind}, path array<struct<digest: binary, bytes: bigint>>")


def conversations_type(conversations: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(conversations.schema["conv"].dataType)


# ------------------------------------------------------------------ the trie


def two_fattest(low: str, high: str) -> Column:
    """The number in (low, high] that the highest power of two divides."""
    return F.expr(f"shiftleft(shiftright({high}, length(bin({low} ^ {high})) - 1), length(bin({low} ^ {high})) - 1)")


def at(path: str, depth: str) -> Column:
    """Digest of the prefix of length ``depth`` (1 at least)."""
    return F.get(path, F.col(depth) - 1)["digest"]


def exits(waiting: DataFrame, edges: DataFrame) -> DataFrame:
    """Where the paths (path_key, path, length, above) leave the trie: ``above`` is the depth of the deepest node that they
    pass, ``edge``, ``edge_top``, ``edge_depth`` the edge below it that they follow up to depth ``reach``, if there is one.

    ``above`` comes in as a depth at which each path is known to pass a node, 0 at least.
    """
    handles = checkpoint(
        edges.withColumn("fat", two_fattest("top", "depth")).select(
            F.get("path", F.col("fat") - F.col("top") - 1)["digest"].alias("handle"), F.col("top").alias("h_top"), F.col("depth").alias("h_depth"), F.col("key").alias("h_key")
        )
    )
    state = waiting.select("path_key", "path", "length", "above", F.col("length").alias("right"))
    settled = None
    while True:
        searching = state.filter("above < right")
        rest = state.filter("above >= right")
        settled = rest if settled is None else settled.unionByName(rest)
        if searching.isEmpty():
            break
        asked = searching.withColumn("fat", two_fattest("above", "right")).withColumn("ask", at("path", "fat"))
        met = lookup(asked, handles, "ask", "handle")
        hit = F.col("handle").isNotNull()
        passes = hit & (F.col("h_depth") <= F.col("length"))
        passes = F.when(passes, at("path", "h_depth") == F.col("h_key")).otherwise(False)
        state = checkpoint(
            met.select(
                "path_key", "path", "length",
                F.when(passes, F.col("h_depth")).when(hit, F.col("h_top")).otherwise(F.col("above")).alias("above"),
                # a node that is met but not passed is the exit: the range closes above it
                F.when(passes, F.col("right")).when(hit, F.col("h_top")).otherwise(F.col("fat") - 1).alias("right"),
            )
        )
    below = edges.select(
        F.get("path", F.lit(0))["digest"].alias("name"), F.col("key").alias("edge"), F.col("top").alias("edge_top"), F.col("depth").alias("edge_depth"),
        F.col("path").alias("edge_path"),
    )
    asked = settled.withColumn("ask", F.when(F.col("above") < F.col("length"), F.get("path", F.col("above"))["digest"]))
    met = lookup(asked, below, "ask", "name")
    own = F.slice("path", F.col("above") + 1, F.size("edge_path"))
    same = F.filter(F.zip_with("edge_path", own, lambda x, y: F.coalesce(x["digest"] == y["digest"], F.lit(False))), lambda x: x)
    reach = F.when(F.col("edge").isNotNull(), F.col("above") + F.size(same)).otherwise(F.col("above"))
    return met.select("path_key", "path", "length", "above", "edge", "edge_top", "edge_depth", reach.alias("reach"))


def cut(edges: DataFrame, places: DataFrame) -> DataFrame:
    """Edges cut at the depths in ``places`` (edge, reach)."""
    # a set of depths of one edge is at most as long as the edge
    sets = places.groupBy("edge").agg(F.sort_array(F.collect_set("reach")).alias("cuts"))
    joined = edges.join(sets, F.col("key") == F.col("edge"), "left")
    stops = F.concat(F.coalesce("cuts", F.array().cast("array<int>")), F.array("depth"))
    pieces = joined.select(
        "key", "up", "top", "path", "base", F.posexplode(F.arrays_zip(F.concat(F.array("top"), F.coalesce("cuts", F.array().cast("array<int>"))).alias("a"), stops.alias("b"))).alias("n", "p")
    )
    first = F.col("p.a") == F.col("top")
    before = F.get("path", F.col("p.a") - F.col("top") - 1)
    return pieces.select(
        F.get("path", F.col("p.b") - F.col("top") - 1)["digest"].alias("key"), F.when(first, F.col("up")).otherwise(before["digest"]).alias("up"),
        F.col("p.a").alias("top"), F.col("p.b").alias("depth"),
        F.slice("path", F.col("p.a") - F.col("top") + 1, F.col("p.b") - F.col("p.a")).alias("path"),
        F.when(first, F.col("base")).otherwise(before["bytes"]).alias("base"),
    )


def new_edges(chosen: DataFrame) -> DataFrame:
    """One edge for the rest of every path (path, length, reach)."""
    inside = F.col("reach") > 0
    before = F.get("path", F.col("reach") - 1)
    return chosen.select(
        at("path", "length").alias("key"), F.when(inside, before["digest"]).otherwise(F.lit(ROOT)).alias("up"), F.col("reach").alias("top"),
        F.col("length").alias("depth"), F.slice("path", F.col("reach") + 1, F.col("length") - F.col("reach")).alias("path"),
        F.when(inside, before["bytes"]).otherwise(F.lit(0).cast("bigint")).alias("base"),
    )


def build(paths: DataFrame) -> DataFrame:
    """Edges (key, up, top, depth, path, base) of the compacted trie of distinct (path_key, path), none of them empty.

    ``key`` and ``up`` are the digests at depth and top (all zeros at the root), ``path`` the prefixes of (top, depth], ``base``
    the bytes of text up to top.
    """
    waiting = paths.select("path_key", "path", F.size("path").alias("length"), F.lit(0).alias("above"))
    edges = None
    while True:
        if edges is None:  # nothing is there to be found: every path leaves at the root
            nothing = F.lit(None).cast("binary").alias("edge"), F.lit(0).alias("edge_depth"), F.lit(0).alias("reach")
            placed = checkpoint(waiting.select("path_key", "path", "length", *nothing))
        else:
            placed = checkpoint(exits(waiting, edges))
        leaving = placed.filter("reach < length").withColumn("turn_off", F.get("path", F.col("reach"))["digest"])
        chosen = leaving.groupBy("turn_off").agg(F.min(F.struct(F.xxhash64("path_key"), "path_key")).alias("c")).select(F.col("c.path_key").alias("path_key"))
        chosen = checkpoint(chosen)
        added = new_edges(leaving.join(chosen, "path_key", "left_semi"))
        if edges is None:
            edges = checkpoint(added)
        else:
            parted = placed.filter("edge is not null and reach < edge_depth").select("edge", "reach")
            edges = checkpoint(cut(edges, parted).unionByName(added))
        waiting = checkpoint(
            leaving.join(chosen, "path_key", "left_anti").select("path_key", "path", "length", F.col("reach").alias("above"))
        )
        if waiting.isEmpty():
            return edges


# ------------------------------------------------------------------ sums and member lists


def subtree_sums(nodes: DataFrame, sums: list[str], least: str) -> DataFrame:
    """(key, sums..., least) over all nodes below and at each node (key, up); the root's ``up`` is null.

    After round k a node holds what lies fewer than 2**k steps below it, and ``up`` is 2**k steps above.
    """
    current = checkpoint(nodes.select("key", "up", *sums, least))
    while not current.filter("up is not null").isEmpty():
        more = current.filter("up is not null").groupBy(F.col("up").alias("_at")).agg(
            *[F.sum(c).alias(f"_{c}") for c in sums], F.min(least).alias(f"_{least}")
        )
        asking = current.withColumn("_ask", F.when(F.col("up") != F.lit(ROOT), F.col("up")))
        jumped = lookup(asking, current.select(F.col("key").alias("_key"), F.col("up").alias("_up")), "_ask", "_key")
        current = checkpoint(
            jumped.join(more, F.col("key") == F.col("_at"), "left").select(
                "key", F.col("_up").alias("up"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums],
                F.least(least, f"_{least}").alias(least),
            )
        )
    return current.drop("up")


def member_digests(members: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the ascending ids (key, conv) of every key, in decimal, with commas between.

    Members are sorted by ranges. A key whose members lie inside one range is digested there; the others hand on chunks of
    joined ids, and only these are read in order by one task for each key, which holds one chunk at a time.
    """
    schema = pa.schema([("key", pa.binary()), ("part", pa.int32()), ("seq", pa.int64()), ("ids", pa.binary()), ("ends_sha256", pa.string())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        key, held, size, whole, seq = None, [], 0, False, 0

        def chunk() -> None:
            nonlocal held, size, seq
            out.append((key, part, seq, b",".join(held), None))
            held, size, seq = [], 0, seq + 1

        def rows() -> pa.RecordBatch:
            columns = zip(*out) if out else ([] for _ in schema)
            made = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)
            out.clear()
            return made

        for batch in slices(batches):
            for k, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key:
                    if key is not None and whole:
                        out.append((key, part, 0, None, hashlib.sha256(b",".join(held)).hexdigest()))
                        held, size = [], 0
                    elif key is not None:
                        chunk()
                    # the first key of a range may have begun in the one before
                    whole, key = key is not None, k
                held.append(b"%d" % conv)
                size += len(held[-1]) + 1
                if size >= CHUNK:
                    chunk()
                    whole = False
            yield rows()
        if key is not None:  # the last one may go on in the next range
            chunk()
        yield rows()

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([schema.field("key"), schema.field("ends_sha256")])
        key, state = None, None

        def rows(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], schema=kinds)

        for batch in slices(batches):
            done = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if k != key:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids)
                elif ids:
                    state.update(b"," + ids)
            yield rows(done)
        if key is not None:
            yield rows([(key, state.hexdigest())])

    laid = members.select("key", "conv").repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")
    parts = checkpoint(laid.mapInArrow(local, "key binary, part int, seq bigint, ids binary, ends_sha256 string"))
    chunks = parts.filter("ends_sha256 is null").repartition("key").sortWithinPartitions("key", "part", "seq")
    return parts.filter("ends_sha256 is not null").select("key", "ends_sha256").unionByName(chunks.mapInArrow(across, "key binary, ends_sha256 string"))


# ------------------------------------------------------------------ nodes


def nodes(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations (conv, turns), the empty one included.

    (prefix, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): ``conv_id`` is the smallest
    conversation with this prefix, ``saved_tokens`` the bytes of text that need not be kept again below and at the node.
    """
    placed = checkpoint(prefixes(conversations).withColumn("key", F.coalesce(F.get("path", F.size("path") - 1)["digest"], F.lit(ROOT))))
    ends = checkpoint(placed.groupBy("key").agg(F.count(F.lit(1)).alias("n_own"), F.min("conv").alias("first_own")))
    distinct = placed.filter(F.size("path") > 0).groupBy(F.col("key").alias("path_key")).agg(F.first("path").alias("path"))
    edges = build(checkpoint(distinct))

    bottom = F.get("path", F.size("path") - 1)["bytes"]
    # one edge above the root, of no length, if there is any conversation
    root = placed.limit(1).select(
        F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("up"), F.lit(-1).alias("top"), F.lit(0).alias("depth"),
        F.array(F.struct(F.lit(ROOT).alias("digest"), F.lit(0).cast("bigint").alias("bytes"))).alias("path"), F.lit(0).cast("bigint").alias("base"),
    )
    tree = edges.unionByName(root)
    children = tree.filter("up is not null").groupBy(F.col("up").alias("_up")).agg(F.count(F.lit(1)).alias("n_below"))
    plain = checkpoint(
        tree.join(ends.withColumnRenamed("key", "_end"), F.col("key") == F.col("_end"), "left")
        .join(children, F.col("key") == F.col("_up"), "left")
        .select(
            "key", "up", "top", "path", "base", F.coalesce("n_below", F.lit(0)).alias("n_below"), F.coalesce("n_own", F.lit(0)).alias("n_convs"), "first_own",
            F.col("n_below").isNull().cast("bigint").alias("n_leaves"), (F.coalesce("n_own", F.lit(0)) * bottom).alias("all_bytes"),
            (bottom - F.col("base")).alias("own_bytes"),
        )
    )
    total = checkpoint(subtree_sums(plain, ["n_convs", "n_leaves", "all_bytes", "own_bytes"], "first_own").withColumnRenamed("first_own", "first"))
    full = plain.select("key", "up", "top", "path", "base", "n_below").join(total, "key")
    full = lookup(checkpoint(full), total.select(F.col("key").alias("_parent"), F.col("first").alias("first_above")), "up", "_parent")
    full = full.join(member_digests(placed.select("key", "conv")).withColumnRenamed("key", "_end"), F.col("key") == F.col("_end"), "left")

    step = F.transform(
        "path", lambda x, i: F.struct(x["digest"].alias("prefix"), i.alias("i"), F.when(i > 0, F.get("path", i - 1)["bytes"]).otherwise(F.col("base")).alias("before"))
    )
    rows = full.withColumn("s", F.explode(step)).withColumn("at_end", F.col("s.i") == F.size("path") - 1)
    # bytes of all members from here on, less what one copy of every node here and below takes
    members_bytes = F.col("all_bytes") - F.col("n_convs") * F.col("s.before")
    once = F.col("own_bytes") - (F.col("s.before") - F.col("base"))
    return rows.select(
        F.col("s.prefix").alias("prefix"), F.col("first").alias("conv_id"), (F.col("top") + 1 + F.col("s.i")).cast("bigint").alias("depth"),
        F.when(F.col("s.i") > 0, F.col("first")).otherwise(F.col("first_above")).alias("parent_conv_id"), "n_convs",
        F.when(F.col("at_end"), F.col("n_below")).otherwise(1).cast("bigint").alias("n_children"), "n_leaves", (members_bytes - once).alias("saved_tokens"),
        F.when(F.col("at_end"), F.col("ends_sha256")).alias("_ends"),
    ).withColumn("ends_sha256", F.coalesce("_ends", F.lit(hashlib.sha256(b"").hexdigest()))).drop("_ends")

"""Conversation prefix trie, rolled up by pointer jumping.

Each distinct sequence of first turns is a node, named by a digest of the sequence, with an edge to its parent's digest.
In round k every node hands what it holds to its ancestor 2^k above and learns that ancestor's pointer, so leaf counts and
savings reach all ancestors in as many rounds as the depth has binary digits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nebulark.llm.common import stash

#: Turns of a conversation that one task digests in a row; longer conversations are split into blocks of this size.
BLOCK = 1024
#: Ids of conversations in a row of the lists that are hashed.
LISTED = 1 << 16
#: A key that more than one in HEAVY rows ask for is looked up by broadcast; there are fewer than HEAVY such keys.
HEAVY = 1000
#: The name of the textless root.
ROOT = hashlib.md5(b"").digest()


def ordered(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Turns as (conv_id, ord from 0, digest, bytes), and conversations as (conv_id, n).

    Turns go by turn, null first; equal ones by role and then by the digest of the text; repeated rows each count. Null
    role and text are empty; rows without a conversation are left out. Only digests are shuffled, by ranges of the whole
    order, so a conversation of any length is numbered by many tasks; a broadcast of at most one row a task adds what
    stands in earlier ranges.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.md5(F.concat(F.md5(role.cast("binary")), F.md5(text.cast("binary"))).cast("binary")))
    turns = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    turns = stash(turns.withColumn("row", F.monotonically_increasing_id()))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "row"]
    spread = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "bytes", F.spark_partition_id().alias("part"))
    rows = stash(spread.mapInArrow(numbered, "conv_id long, digest binary, bytes long, part int, n long"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stash(rows.groupBy("conv_id", "part").agg(F.count("*").alias("held")).withColumn("before", F.coalesce(F.sum("held").over(earlier), F.lit(0))))
    begun = F.broadcast(parts.where(F.col("before") > 0).select("conv_id", "part", "before"))  # at most one row a part
    turns = rows.join(begun, ["conv_id", "part"], "left").select("conv_id", (F.col("n") + F.coalesce("before", F.lit(0))).alias("ord"), "digest", "bytes")
    return turns, parts.groupBy("conv_id").agg(F.sum("held").alias("n"))


def numbered(batches):
    """Numbers the rows of each conversation from 0 within a sorted partition."""
    last, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0).to_numpy()
        at = np.arange(len(conv))
        begins = np.concatenate(([True], conv[1:] != conv[:-1]))
        n = at - np.maximum.accumulate(np.where(begins, at, 0))
        if conv[0] == last:
            n[: len(conv) if begins.sum() == 1 else int(np.flatnonzero(begins)[1])] += seen
        last, seen = conv[-1], int(n[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n.astype(np.int64))], names=[*batch.schema.names, "n"])


def branched(turns: DataFrame, convs: DataFrame, *, base: Column, taken: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on others: the first `taken` turns of conversation `base`, then the own turns after the first `taken`.

    base and taken are expressions of conv_id, taken at most `most`; a base that isn't there gives no turns. Returns
    (conv_id, pos from 0, digest, bytes, length) and (conv_id, length).
    """
    heads = convs.select(F.col("conv_id").alias("base"), F.least("n", F.lit(most)).alias("there"))
    plan = convs.select("conv_id", "n", base.alias("base"), taken.alias("taken")).join(heads, "base", "left")
    plan = plan.withColumn("head", F.least("taken", F.coalesce("there", F.lit(0))))
    plan = stash(plan.select("conv_id", "n", "base", "taken", "head", (F.col("head") + F.greatest(F.lit(0), F.col("n") - F.col("taken"))).alias("length")))
    # Joined by blocks of turns, so that a long conversation is met in many tasks.
    blocks = plan.where(F.col("n") > F.col("taken")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {BLOCK}"))))
    own = turns.withColumn("block", F.expr(f"ord div {BLOCK}")).join(blocks, ["conv_id", "block"]).where(F.col("ord") >= F.col("taken"))
    own = own.select("conv_id", (F.col("head") + F.col("ord") - F.col("taken")).alias("pos"), "digest", "bytes", "length")
    shared = turns.where(F.col("ord") < most).withColumnRenamed("conv_id", "base").join(plan.drop("n"), "base").where(F.col("ord") < F.col("head"))
    shared = shared.select("conv_id", F.col("ord").alias("pos"), "digest", "bytes", "length")
    return own.unionByName(shared), plan.select("conv_id", "length")


def chained(batches):
    """The digest of each block's turns up to each turn, and up to the one before it."""
    last, inner = None, None
    for batch in batches:
        now, before = [], []
        for conv, block, digest in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if (conv, block) != last:
                last, inner = (conv, block), None
            before.append(inner)
            inner = hashlib.md5((inner or b"") + digest).digest()
            now.append(inner)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(now, pa.binary()), pa.array(before, pa.binary())], names=[*batch.schema.names, "now", "before"])


def carried(batches):
    """The name of the node at the end of each block of a long conversation, for the block that follows."""
    last, carry = None, ROOT
    for batch in batches:
        out = []
        for conv, now in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if conv != last:
                last, carry = conv, ROOT
            carry = hashlib.md5(carry + now).digest()
            out.append(carry)
        yield pa.RecordBatch.from_arrays([batch.column(0), pc.add(batch.column(1), 1), pa.array(out, pa.binary())], names=["conv_id", "block", "carry"])


def named(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, key, parent, bytes, last) of each rebuilt turn: the digests of the turns up to it and up to its predecessor."""
    block = turns.withColumn("block", F.expr(f"pos div {BLOCK}"))
    spread = block.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos").select("conv_id", "block", "digest", "pos", "bytes", "length")
    rows = stash(spread.mapInArrow(chained, "conv_id long, block long, digest binary, pos long, bytes long, length long, now binary, before binary"))
    ends = rows.where((F.col("pos") % BLOCK == BLOCK - 1) & (F.col("pos") + 1 < F.col("length"))).select("conv_id", "block", "now")
    carry = stash(ends.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(carried, "conv_id long, block long, carry binary"))
    carry_of = F.coalesce("carry", F.lit(ROOT))
    key = lambda c: F.unhex(F.md5(F.concat(carry_of, F.col(c))))
    parent = F.when(F.col("before").isNull(), carry_of).otherwise(key("before"))
    return rows.join(carry, ["conv_id", "block"], "left").select("conv_id", (F.col("pos") + 1).alias("depth"), key("now").alias("key"), parent.alias("parent"), "bytes", (F.col("pos") + 1 == F.col("length")).alias("last"))


def looked_up(rows: DataFrame, table: DataFrame, on: str, heavy: DataFrame) -> DataFrame:
    """rows joined with table, one row a key there; the heavy keys, fewer than HEAVY, are met by a broadcast."""
    heavy = F.broadcast(heavy)
    few = rows.join(heavy, on, "left_semi").join(F.broadcast(table.join(heavy, on, "left_semi")), on)
    return few.unionByName(rows.join(heavy, on, "left_anti").join(table, on))


def rolled_up(nodes: DataFrame, deepest: int) -> DataFrame:
    """key with n_leaves and saved_tokens of each subtree, from nodes (key, depth, parent, n_children, saved)."""
    total = nodes.count()
    own = nodes.select("key", "depth", F.col("parent").alias("up"), (F.col("n_children") == 0).cast("long").alias("leaves"), "saved")
    pieces = [own.where(F.col("depth") == 0).select("key", "leaves", "saved")]
    live, step = own.where(F.col("depth") > 0), 1
    while step <= deepest:
        # Nodes as deep as `step` hold the sums of their descendants nearer than that, and hand them on.
        sent = stash(live.groupBy("up", (F.col("depth") - step).alias("depth")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count("*").alias("asked")))
        whole = sent.select(F.col("up").alias("key"), "depth", "leaves", "saved")
        # What is less deep than the next step hands nothing more on.
        pieces += [x.where(F.col("depth") < 2 * step).select("key", "leaves", "saved") for x in (live, whole)]
        held = live.select("key", "depth", "leaves", "saved").unionByName(whole).where(F.col("depth") >= 2 * step)
        held = held.groupBy("key", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        above = live.select(F.col("key").alias("up"), F.col("up").alias("further"))
        heavy = sent.where(F.col("asked") * HEAVY > total).select("up")
        jumps = looked_up(live.where(F.col("depth") >= 2 * step).select("key", "up"), above, "up", heavy).select("key", F.col("further").alias("up"))
        step *= 2
        if step <= deepest:
            live = stash(held.join(jumps, "key").select("key", "depth", "up", "leaves", "saved"))
    summed = pieces[0]
    for x in pieces[1:]:
        summed = summed.unionByName(x)
    return summed.groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def listed(batches):
    """Ascending ids of each node, comma-joined, LISTED to a row."""
    held, ids = None, []
    for batch in batches:
        rows = []
        for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (key != held or len(ids) == LISTED):
                rows.append((held, ids[0], ",".join(map(str, ids))))
                ids = []
            held = key
            ids.append(conv)
        yield of_lists(rows)
    if ids:
        yield of_lists([(held, ids[0], ",".join(map(str, ids)))])


def of_lists(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(3)], names=["key", "first", "ids"])


def hashed(batches):
    """The SHA-256 of each node's lists, joined by commas; a node's lists come in a row."""
    held, state = None, None
    done = lambda rows: pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([x for _, x in rows], pa.string())], names=["key", "ends_sha256"])
    for batch in batches:
        rows = []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if key == held:
                state.update(b"," + ids.encode())
                continue
            if state:
                rows.append((held, state.hexdigest()))
            held, state = key, hashlib.sha256(ids.encode())
        yield done(rows)
    if state:
        yield done([(held, state.hexdigest())])


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of conversations given as (conv_id, pos, digest, bytes, length) and (conv_id, length).

    conv_id (least member), depth, parent_conv_id (null for the root), n_convs (members), n_children, n_leaves (childless
    nodes of the subtree), saved_tokens (over the subtree, (n_convs - 1) times the bytes of the last text), ends_sha256 (of
    the decimal ids of the members that end there, ascending, comma-joined). Without conversations there is no node.

    The ids that end at a node are listed by ranges and hashed list by list, so that no task holds those of a text that
    very many conversations repeat.
    """
    rows = stash(named(turns))
    root = convs.groupBy(F.lit(ROOT).alias("key")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    root = root.selectExpr("key", "cast(null as binary) as parent", "0L as depth", "0L as bytes", "conv_id", "n_convs")
    found = rows.groupBy("key", "parent", "depth", "bytes").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).unionByName(root)
    found = stash(found)
    children = stash(found.where(F.col("depth") > 0).groupBy("parent").agg(F.count("*").alias("n_children")))
    nodes = found.join(children.withColumnRenamed("parent", "key"), "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = stash(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")))
    total, deepest = nodes.agg(F.count("*"), F.max("depth")).first()
    sums = rolled_up(nodes, deepest or 0)
    ends = rows.where("last").select("key", "conv_id").unionByName(convs.where(F.col("length") == 0).select(F.lit(ROOT).alias("key"), "conv_id"))
    lists = stash(ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(listed, "key binary, first long, ids string"))
    digests = lists.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key binary, ends_sha256 string")
    heavy = children.where(F.col("n_children") * HEAVY > total).select("parent")
    parents = looked_up(nodes.where(F.col("depth") > 0).select("key", "parent"), nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", heavy).drop("parent")
    out = nodes.join(sums, "key").join(digests, "key", "left").join(parents, "key", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))

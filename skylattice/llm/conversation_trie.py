"""Conversation prefix trie: level-synchronous construction by grouping, and a roll-up of the levels by joins.

``conversation_trie`` takes conversations as rows (conv_id, depth from 1, key of the turn, bytes of its text) and builds the trie of
their prefixes. Conversations that are equal throughout are one path with a weight, so a large group of copies costs one path. Per
depth the live paths are grouped by (parent node, next turn); the smallest conv_id names the node. A node that only one path goes
through is closed: the rest of that path is a chain, whose rows follow from the path's own turns without further rounds. So there are
as many rounds as the depth at which two different conversations are still together, whatever the longest one's length. Then the
levels are joined from the deepest one upwards to sum leaves and savings. Every level is a table in the shared folder.

``numbered`` gives the turns of a conversation their places by range partitions and their sizes, so one conversation may hold any
share of all rows; ``rebuilt`` applies the query's rule (first h turns of conversation c - c % 5, then c's own after its first h).
Turns are told apart by the SHA-256 of role and text, equal conversations by length, bytes and two 64-bit sums over such keys at
their places. Hashes of members' ids are taken from strings of at most 2 ** ID_BITS ids each, read in order, so memory is bounded; a
node's ids pass through one task as SHA-256 reads them one after the other.

Defined cases: rows without a conv_id are ignored; null role or text is empty; null turns come first; equal turns are ordered by
role, then text, and repeated rows are turns of their own; c % 5 has the sign of c; a conversation whose base is absent starts with its
own turns after the first h; a rebuilt conversation may have no turns and ends at the root; an empty table gives no rows, not even a
root; very long texts only count by hash and bytes; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.llm.common import dropped, table, written

#: Members' ids that differ in so many last bits only are one string.
ID_BITS = 12
#: Turns taken over at most, and distance of the conversations they come from.
MOST_TAKEN, FAMILY = 9, 5


def numbered(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text, ...) -> conv_id, place (from 1), key, bytes."""
    rows = conversations.filter("conv_id is not null").select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    # texts travel only where a turn's number does not settle the order
    tied = rows.groupBy("conv_id", "turn").count().filter("count > 1").select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"))
    key = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    turns = rows.join(tied, (F.col("conv_id") == F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")), "left").select(
        "conv_id", "turn", *(F.when(F.col("_c").isNotNull(), F.col(c)).alias(c) for c in ("role", "text")), key.alias("key"), F.octet_length("text").cast("long").alias("bytes")
    )
    order = ["conv_id", "turn", "role", "text"]
    dealt = written(turns.repartitionByRange(*order, "key").withColumn("part", F.spark_partition_id()))
    within = dealt.withColumn("place", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text", "key")).cast("long"))
    # only conversations that go on over a boundary of partitions need the sizes of their parts before
    sizes = dealt.groupBy("conv_id", "part").count()
    before = sizes.withColumn("_before", F.coalesce(F.sum("count").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.filter("_before > 0").select("conv_id", "part", "_before")
    return within.join(before, ["conv_id", "part"], "left").select("conv_id", (F.col("place") + F.coalesce("_before", F.lit(0))).alias("place"), "key", "bytes")


def taken_over(conv_id: Column) -> Column:
    """The rule's h: so many first turns come from the conversation that a family starts with."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % MOST_TAKEN).cast("long")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns as numbered() gives them -> (conv_id, depth, key, bytes) of the rebuilt conversations, and all conv_ids."""
    lengths = written(turns.groupBy("conv_id").agg(F.max("place").alias("length")))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    first = lengths.select(F.col("conv_id").alias("_base"), F.col("length").alias("_length"))
    h = taken_over(F.col("conv_id"))
    shifts = lengths.select("conv_id", base.alias("_base"), h.alias("h")).join(first, "_base", "left").select("conv_id", "h", (F.col("h") - F.least("h", F.coalesce("_length", F.lit(0)))).alias("gap"))
    own = turns.join(shifts, "conv_id").filter((F.col("place") > F.col("h")) | (F.col("conv_id") % FAMILY == 0)).select(
        "conv_id", F.when(F.col("conv_id") % FAMILY == 0, F.col("place")).otherwise(F.col("place") - F.col("gap")).alias("depth"), "key", "bytes"
    )
    heads = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("place") < MOST_TAKEN))
    kin = F.explode(F.array(*(F.try_add("conv_id", F.lit(k).cast("long")) for k in range(1 - FAMILY, FAMILY) if k)))
    heirs = heads.select(F.col("conv_id").alias("_base"), "place", "key", "bytes", kin.alias("conv_id")).filter((F.col("_base") == base) & (F.col("place") <= h))
    heirs = heirs.join(lengths.select("conv_id"), "conv_id", "left_semi").select("conv_id", F.col("place").alias("depth"), "key", "bytes")
    return own.unionByName(heirs), lengths.select("conv_id")


def id_hashes(blocks: DataFrame) -> DataFrame:
    """blocks (path, block, conv_id, members, depth, bytes, ids) in ascending order within a path -> one row a path: path_id (its
    smallest conv_id), weight, depth, bytes, ends_sha256 of all its ids. Blocks are read one by one, so memory is bounded."""
    rows = blocks.repartition("path").sortWithinPartitions("path", "block").select("path", "conv_id", "members", "depth", "bytes", "ids")
    names = ["path_id", "weight", "depth", "bytes", "ends_sha256"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, row, digest = None, None, None

        def out(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], pa.string() if k == 4 else pa.int64()) for k in range(5)], names)

        for batch in batches:
            done = []
            for p, conv_id, members, depth, size, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if p != path:
                    if row:
                        done.append([*row, digest.hexdigest()])
                    path, row, digest = p, [conv_id, 0, depth, size], hashlib.sha256()
                else:
                    digest.update(b",")
                row[1] += members
                digest.update(ids.encode())
            yield out(done)
        if row:
            yield out([[*row, digest.hexdigest()]])

    return rows.mapInArrow(hashed, "path_id long, weight long, depth long, bytes long, ends_sha256 string")


def paths_of(turns: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """The different conversations: path_id (the smallest of equal ones), weight (how many), depth, bytes, ends_sha256."""
    at_place = lambda salt: F.xxhash64(F.lit(salt), "key", "depth").cast("decimal(20,0)")
    told = turns.groupBy("conv_id").agg(F.count("*").alias("depth"), F.sum("bytes").alias("bytes"), *(F.sum(at_place(k)).alias(f"s{k}") for k in (1, 2)))
    told = conv_ids.join(told, "conv_id", "left")
    path = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("depth", "bytes", "s1", "s2")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    members = told.select("conv_id", path.alias("path"), zero("depth"), zero("bytes"), F.shiftright("conv_id", ID_BITS).alias("block"))
    blocks = members.groupBy("path", "block").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("members"), F.first("depth").alias("depth"), F.first("bytes").alias("bytes"), F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids")
    )
    return id_hashes(blocks)


def grown(turns: DataFrame, paths: DataFrame) -> list[DataFrame]:
    """Per depth from 0, the nodes that two or more paths reach or that have such a parent: depth, conv_id, parent_conv_id, n_convs,
    n_paths, bytes (of the last text), rest (bytes of the only path below a closed node), length (of the only path), ending (the path
    that ends here)."""
    by = ["parent_conv_id", "key"]
    node = [F.min("path_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count("*").alias("n_paths"), F.max("bytes").alias("bytes"), F.max("rest").alias("rest"), F.max("length").alias("length"), F.max(F.when(F.col("length") == F.col("depth"), F.col("path_id"))).alias("ending")]
    live = paths.select("path_id", "weight", F.lit(None).cast("long").alias("parent_conv_id"), F.lit(b"").alias("key"), F.lit(0).cast("long").alias("bytes"), F.col("bytes").alias("rest"), F.col("depth").alias("length"))
    levels: list[DataFrame] = []
    live, depth = written(live), 0
    while not live.isEmpty():
        level = written(live.withColumn("depth", F.lit(depth).cast("long")).groupBy(*by, "depth").agg(*node))
        levels.append(level)
        # a common turn is one row of the level, so the join back splits a skewed side or sends a small one
        open_nodes = level.filter("n_paths > 1").select(*by, "conv_id")
        on = live.join(open_nodes, [live[c].eqNullSafe(open_nodes[c]) for c in by]).select("path_id", "weight", F.col("conv_id").alias("parent_conv_id"), "rest", "length").filter(F.col("length") > depth)
        depth += 1
        step = turns.filter(F.col("depth") == depth).select(F.col("conv_id").alias("path_id"), "key", "bytes")
        done, live = live, written(on.join(step, "path_id").select("path_id", "weight", "parent_conv_id", "key", "bytes", (F.col("rest") - F.col("bytes")).alias("rest"), "length"))
        dropped(done)
    return levels


def rolled_up(levels: list[DataFrame]) -> list[DataFrame]:
    """The levels with n_children, n_leaves and saved_tokens, joined from the deepest one upwards."""
    out, below = [], None
    for level in reversed(levels):
        own = (F.col("n_convs") - 1) * F.col("bytes")
        closed, further = F.col("n_paths") == 1, F.col("length") > F.col("depth")
        if below is None:
            sums = [F.lit(0).cast("long").alias(c) for c in ("_children", "_leaves", "_saved")]
            joined = level.select("*", *sums)
        else:
            up = below.groupBy(F.col("parent_conv_id").alias("_up")).agg(F.count("*").alias("_children"), F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"))
            joined = level.join(up, F.col("conv_id") == F.col("_up"), "left").select(level["*"], *(F.coalesce(c, F.lit(0)).alias(c) for c in ("_children", "_leaves", "_saved")))
        below = written(
            joined.select(
                "conv_id", "depth", "parent_conv_id", "n_convs",
                F.when(closed, further.cast("long")).otherwise(F.col("_children")).alias("n_children"),
                F.when(closed | (F.col("_leaves") == 0), 1).otherwise(F.col("_leaves")).cast("long").alias("n_leaves"),
                (own + F.when(closed, (F.col("n_convs") - 1) * F.col("rest")).otherwise(F.col("_saved"))).alias("saved_tokens"),
            )
        )
        out.append(below)
    return out


def chains(turns: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """The nodes below the closed ones: each is all that is left of one path."""
    tops = None
    for level in levels:
        top = level.filter("n_paths = 1 and length > depth").select(F.col("conv_id").alias("path_id"), F.col("depth").alias("top"), "n_convs", "rest", "length")
        tops = top if tops is None else tops.unionByName(top)
    on = turns.join(tops, turns["conv_id"] == tops["path_id"]).filter(F.col("depth") > F.col("top"))
    # bytes before a turn: within stretches of turns, and of the stretches before
    on = on.filter("n_convs = 1").withColumn("_before", F.lit(0).cast("long")).unionByName(with_bytes_before(on.filter("n_convs > 1")))
    return on.select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), "n_convs", (F.col("length") > F.col("depth")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * (F.col("rest") - F.col("_before"))).alias("saved_tokens"),
    )


def with_bytes_before(rows: DataFrame, stretch: int = 4096) -> DataFrame:
    """Adds `_before`: the bytes of a conversation's earlier rows, summed within stretches of depths and over the stretches before."""
    part = F.floor(F.col("depth") / stretch)
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", part.alias("_part")).agg(F.sum("bytes").alias("_sum"))
    sums = sums.select("conv_id", "_part", F.coalesce(F.sum("_sum").over(earlier(Window.partitionBy("conv_id").orderBy("_part"))), F.lit(0)).alias("_parts"))
    within = rows.withColumn("_part", part).withColumn("_within", F.coalesce(F.sum("bytes").over(earlier(Window.partitionBy("conv_id", "_part").orderBy("depth"))), F.lit(0)))
    return within.join(sums, ["conv_id", "_part"]).withColumn("_before", F.col("_parts") + F.col("_within")).drop("_part", "_parts", "_within")


def ends_of(paths: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """conv_id, depth, ends_sha256 of the nodes that a conversation ends at."""
    ends = None
    for level in levels:
        closed = F.col("n_paths") == 1
        end = level.select("conv_id", F.when(closed, F.col("length")).otherwise(F.col("depth")).alias("depth"), F.when(closed, F.col("conv_id")).otherwise(F.col("ending")).alias("path_id")).filter("path_id is not null")
        ends = end if ends is None else ends.unionByName(end)
    return ends.join(paths.select("path_id", "ends_sha256"), "path_id").drop("path_id")


def conversation_trie(turns: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """turns (conv_id, depth from 1 without gaps, key binary, bytes long), conv_ids (all conversations, also those without turns) ->
    one row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = written(turns)
    paths = written(paths_of(turns, conv_ids))
    # by depth, so that a round reads its own rows of the files only
    own = written(turns.join(paths.select(F.col("path_id").alias("conv_id")), "conv_id", "left_semi").repartitionByRange("depth", "conv_id").sortWithinPartitions("depth"))
    dropped(turns)
    levels = grown(own, paths)
    if not levels:
        return paths.select(*(F.lit(None).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), "ends_sha256").limit(0)
    nodes = chains(own, levels)
    for level in rolled_up(levels):
        nodes = nodes.unionByName(level)
    nodes = nodes.join(ends_of(paths, levels), ["conv_id", "depth"], "left")
    return nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(*rebuilt(numbered(table(spark, sf_dir, "conversations"))))


ORACLE = """
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
    SELECT conv_id, max(place) AS length, conv_id - conv_id % 5 AS base,
           xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
               lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 9 AS h
    FROM turns GROUP BY conv_id),
rebuilt AS (
    SELECT c.conv_id, t.place AS depth, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place <= c.h
    UNION ALL
    SELECT c.conv_id, t.place - c.h + least(c.h, coalesce(b.length, 0)), role, text
    FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h LEFT JOIN convs b ON b.conv_id = c.base),
prefixes AS (
    SELECT conv_id, depth, strlen(text) AS bytes, string_agg(sha256(strlen(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM rebuilt
    UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
nodes AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved FROM prefixes GROUP BY depth, path),
members AS (SELECT p.conv_id AS member, depth, n.conv_id FROM prefixes p JOIN nodes n USING (depth, path)),
lengths AS (SELECT member, max(depth) AS depth FROM members GROUP BY member),
ends AS (SELECT m.depth, m.conv_id, string_agg(m.member::VARCHAR, ',' ORDER BY m.member) AS ids FROM members m JOIN lengths USING (member, depth) GROUP BY m.depth, m.conv_id),
children AS (SELECT p.depth, p.conv_id, count(*) AS n FROM nodes n JOIN members p ON p.member = n.conv_id AND p.depth = n.depth - 1 GROUP BY p.depth, p.conv_id),
own AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c USING (depth, conv_id)),
sums AS (
    SELECT m.depth, m.conv_id, count(*) FILTER (o.n_children = 0) AS n_leaves, sum(o.saved)::BIGINT AS saved_tokens
    FROM own o JOIN members m ON m.member = o.conv_id AND m.depth <= o.depth GROUP BY m.depth, m.conv_id)
SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM own o JOIN sums s USING (depth, conv_id) LEFT JOIN ends e USING (depth, conv_id) LEFT JOIN members p ON p.member = o.conv_id AND p.depth = o.depth - 1
"""

"""Operator 11: prefix trie of conversations.

A conversation is the list of its turns, each known by a digest of role and text and by the text's length.  Equal
conversations become one path with a number of members first, so copies cost one row.  Paths are dealt by the digest of their
first turn into buckets, and each bucket's dictionary trie is built inside applyInPandas, parents before children, so that one
backward pass (an iterative postorder) adds up leaves and savings.

A subtrie with more than ``PATHS`` paths (or ``SLOTS`` turns) is not left to one task: its top becomes a row of the spine,
and its paths are dealt by the next turns instead.  Rounds look 1, 2, 4, ... turns ahead, so their number grows
with the logarithm of the depth, and each works only on the paths of oversized subtries.  What the buckets found of their tops
is then added up along the spine.

The members that end at a node are hashed in order: ids of one range of ``RANGE`` become one string, and one pass over a
node's strings updates the hash, so that nothing larger than such a string is held.

Defined cases: null role or text is empty; rows without conv_id take no part; equal turn numbers are ordered by the turn's digest
(repeated rows therefore stand side by side); null turns come first; an empty table gives an empty result; extra columns
are not read.  One conversation's digests (about 50 bytes a turn) must fit a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentia.llm.common import Scratch, cut

#: Most turns of one prefix that a conversation takes over from its group's first.
HEAD = 5
GROUP = 100
#: A subtrie with more paths, or with several paths and more turns, is dealt by the next turns.
PATHS, SLOTS = 256, 1 << 20
#: Turns that a bucket holds on average.
BUCKET = 4096
RANGE = 4096
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, trail array<string>"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(x: Column) -> Column:
    """128 bits of SHA-256 as 32 letters."""
    return F.substring(F.sha2(x, 256), 1, 32)


def after(key: Column, turn: Column) -> Column:
    """The key of a prefix and one more turn."""
    return digest(F.concat(key, turn))


def turn_lists(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: array of (turn, d, c), in order; d is the digest of role and text, c the text's code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct("turn", digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("d"), F.length(text).alias("c"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """turn_lists after each conversation took its first h turns from the first conversation of its hundred; h = crc32(id) % 6."""
    own = turn_lists(conversations)
    base = own.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEAD).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("int")
    joined = own.join(base, F.col("conv_id") - F.col("conv_id") % GROUP == F.col("base"), "left")
    rest = F.slice("turns", h + 1, F.size("turns"))
    return joined.select("conv_id", F.when(F.col("head").isNull(), rest).otherwise(F.concat(F.slice("head", 1, h), rest)).alias("turns"))


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of equal keys: members and smallest id added up, the hash of all ids in order."""
    key = None
    for batch in batches:
        keys, ids, n, first = (batch.column(c).to_pylist() for c in ("key", "ids", "n", "first"))
        turns, done, at = [], [], []
        if key is not None:
            turns.append(kept)  # noqa: F821 - set at the end of the batch before
        for i, k in enumerate(keys):
            if k == key:
                sha.update(b"," + ids[i].encode())  # noqa: F821 - set with key
                members, least = members + n[i], min(least, first[i])
                continue
            if key is not None:
                done.append((key, members, least, sha.hexdigest()))
            key, members, least, sha = k, n[i], first[i], hashlib.sha256(ids[i].encode())
            at.append(i)
        turns.append(batch.column("turns").take(pa.array(at, pa.int64())))
        whole = pa.concat_arrays(turns)
        kept = whole.slice(len(whole) - 1)
        if done:
            yield paths_batch(done, whole.slice(0, len(done)))
    if key is not None:
        yield paths_batch([(key, members, least, sha.hexdigest())], kept)


def paths_batch(rows: list[tuple], turns: pa.Array) -> pa.RecordBatch:
    key, n, first, sha = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(key), turns, pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(sha)], names=["key", "turns", "n", "first", "sha"])


def distinct_paths(convs: DataFrame) -> DataFrame:
    """key, d, c (arrays), n, first, sha: one row for equal conversations (conv_id, turns)."""
    key = F.aggregate("turns", F.lit(""), lambda k, t: after(k, t["d"]))
    pairs = F.transform("turns", lambda t: F.struct(t["d"].alias("d"), t["c"].alias("c")))
    ranged = convs.select(key.alias("key"), F.floor(F.col("conv_id") / RANGE).alias("range"), "conv_id", pairs.alias("turns"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    strings = ranged.groupBy("key", "range").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"), ids.alias("ids"), F.first("turns").alias("turns"))
    dealt = strings.repartition("key").sortWithinPartitions("key", "range")
    out = dealt.mapInArrow(folded, "key string, turns array<struct<d:string,c:int>>, n long, first long, sha string")
    return out.select("key", F.col("turns.d").alias("d"), F.col("turns.c").alias("c"), "n", "first", "sha")


def spine_and_rest(scratch: Scratch, paths: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """Rows at, up, depth, chars, n_convs, conv_id of every oversized prefix, and the paths with their trails.

    A trail holds the keys of the oversized prefixes that a path passes, from the root's '' on; the rest of the path
    lies in a subtrie small enough for one task.  Sizes fall along a path, so its oversized prefixes are its first ones.
    """
    rest = paths.where(F.size("d") > 0).withColumn("trail", F.array(F.lit("")))
    spine, small, ahead = [], [], 1
    while True:
        passed = F.size("trail") - 1
        keys = F.aggregate(F.slice("d", passed + 1, F.lit(ahead)), F.array(F.element_at("trail", -1)), lambda ks, d: F.concat(ks, F.array(after(F.element_at(ks, -1), d))))
        rest = rest.withColumn("keys", keys)
        seen = rest.select("key", "n", "first", "c", passed.alias("passed"), (F.size("d") - passed).alias("turns"), "keys", F.posexplode(F.slice("keys", 2, F.lit(ahead))).alias("i", "at"))
        sizes = seen.groupBy("at").agg(
            F.count(F.lit(1)).alias("paths"),
            F.sum(F.col("turns") - F.col("i")).alias("slots"),
            F.first(F.get("keys", F.col("i"))).alias("up"),
            F.first(F.col("passed") + F.col("i") + 1).cast("long").alias("depth"),
            F.first(F.get("c", F.col("passed") + F.col("i"))).alias("chars"),
            F.sum("n").alias("n_convs"),
            F.min("first").alias("conv_id"),
        )
        large = sizes.where((F.col("paths") > PATHS) | (F.col("paths") > 1) & (F.col("slots") > SLOTS)).drop("paths", "slots")
        large, n = scratch.counted(large, F.lit(True))
        if not n:
            small.append(rest.drop("keys"))
            break
        spine.append(large)
        through = seen.join(large.select("at"), "at").groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("m"))
        moved = rest.join(through, "key", "left").withColumn("m", F.coalesce("m", F.lit(0)))
        moved = scratch.cut(moved.withColumn("trail", F.concat("trail", F.slice("keys", F.lit(2), F.col("m")))))
        left = F.size("d") > F.size("trail") - 1
        small.append(moved.where(left & (F.col("m") < ahead)).drop("keys", "m"))
        rest, ahead = moved.where(left & (F.col("m") == ahead)).drop("keys", "m"), ahead * 2
    union = lambda frames: frames[0] if len(frames) == 1 else union([*frames[:-2], frames[-2].unionByName(frames[-1])])
    return (union(spine) if spine else None), union(small)


def trie(part: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a bucket's subtries; only their tops carry the trail of prefixes above them."""
    tops: dict[tuple[str, str], int] = {}
    kids, depth, up, n, least, chars, ends, trails = [], [], [], [], [], [], [], []

    def node(level: int, parent: int, length: int, trail: list[str] | None) -> int:
        for column, x in ((kids, {}), (depth, level), (up, parent), (n, 0), (least, None), (chars, length), (ends, NOTHING), (trails, trail)):
            column.append(x)
        return len(kids) - 1

    for trail, d, c, members, first, sha in zip(part["trail"], part["d"], part["c"], part["n"].tolist(), part["first"].tolist(), part["sha"], strict=True):
        at = tops.get((trail[-1], d[0]))
        if at is None:
            at = tops[trail[-1], d[0]] = node(len(trail), -1, int(c[0]), list(trail))
        for i in range(len(d)):
            if i:
                below = kids[at].get(d[i])
                if below is None:
                    below = kids[at][d[i]] = node(depth[at] + 1, at, int(c[i]), None)
                at = below
            n[at] += members
            least[at] = first if least[at] is None else min(least[at], first)
        ends[at] = sha
    leaves, saved = [0] * len(kids), [0] * len(kids)
    for at in range(len(kids) - 1, -1, -1):  # children come after their parents, so each is finished before its parent
        leaves[at] = leaves[at] or 1
        saved[at] += (n[at] - 1) * chars[at]
        if up[at] >= 0:
            leaves[up[at]] += leaves[at]
            saved[up[at]] += saved[at]
    above = pd.array([least[p] if p >= 0 else None for p in up], "Int64")
    return pd.DataFrame({"conv_id": least, "depth": depth, "parent_conv_id": above, "n_convs": n, "n_children": [len(k) for k in kids], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "trail": trails})


def trie_nodes(convs: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations (conv_id, turns: array of (.., d, c)), the textless root included."""
    with Scratch(convs.sparkSession, "trie") as scratch:
        paths = scratch.cut(distinct_paths(convs))
        spine, small = spine_and_rest(scratch, paths)
        total = paths.agg(F.sum(F.size("d").cast("long")).alias("slots")).first()["slots"] or 0
        buckets = -(-total // BUCKET) or 1
        rest = F.slice("d", F.size("trail"), F.size("d"))
        dealt = small.select(
            "trail", rest.alias("d"), F.slice("c", F.size("trail"), F.size("c")).alias("c"), "n", "first", "sha", F.pmod(F.xxhash64(F.element_at("trail", -1), F.get("d", F.size("trail") - 1)), F.lit(buckets)).alias("bucket")
        )
        nodes = scratch.cut(dealt.groupBy("bucket").applyInPandas(trie, NODE))

        root = paths.agg(F.sum("n").alias("n_convs"), F.min("first").alias("conv_id")).where("n_convs > 0").select(F.lit("").alias("at"), F.lit(None).cast("string").alias("up"), F.lit(0).cast("long").alias("depth"), F.lit(0).alias("chars"), "n_convs", "conv_id")
        spine = scratch.cut(root if spine is None else root.unionByName(spine))
        tops = nodes.where("trail IS NOT NULL")
        below = tops.select("n_leaves", "saved_tokens", "trail", F.posexplode("trail").alias("i", "at"))
        found = scratch.cut(
            below.groupBy("at").agg(
                F.sum("n_leaves").alias("leaves"),
                F.sum("saved_tokens").alias("saved"),
                F.count_if(F.col("i") == F.size("trail") - 1).alias("kids"),
                F.first(F.slice("trail", F.lit(1), F.col("i") + 1)).alias("trail"),
            )
        )
        own = spine.join(found.select("at", "trail"), "at").select(((F.col("n_convs") - 1) * F.col("chars")).alias("own"), F.explode("trail").alias("at")).groupBy("at").agg(F.sum("own").alias("own"))
        inner = spine.where("up IS NOT NULL").groupBy(F.col("up").alias("at")).agg(F.count(F.lit(1)).alias("inner"))
        ends = paths.select(F.col("key").alias("at"), "sha").join(spine.select("at"), "at", "left_semi")
        whole = spine.join(found.drop("trail"), "at", "left").join(own, "at", "left").join(inner, "at", "left").join(ends, "at", "left")
        zero = lambda c: F.coalesce(c, F.lit(0))
        named = spine.select(F.col("at").alias("up"), F.col("conv_id").alias("parent"))
        stem = whole.join(named, "up", "left").select(
            "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", (zero("kids") + zero("inner")).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"), (zero("saved") + zero("own")).alias("saved_tokens"), F.coalesce("sha", F.lit(NOTHING)).alias("ends_sha256")
        )
        hung = tops.withColumn("up", F.element_at("trail", -1)).join(named, "up").withColumn("parent_conv_id", F.col("parent"))
        return cut(nodes.where("trail IS NULL").select(*COLUMNS).unionByName(hung.select(*COLUMNS)).unionByName(stem))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations, one row per node."""
    return trie_nodes(rebuilt(conversations))


SQL = """
    WITH t AS (
      SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS turns
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
    ), h AS (
      SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ord(substr(conv_id::VARCHAR, i::INT, 1))::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % 6 AS h
      FROM t
    ), r AS (
      SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 100
    ), p AS (SELECT conv_id, turns, len(turns) AS n, unnest(range(len(turns) + 1)) AS depth FROM r
    ), k AS (SELECT conv_id, n, depth, turns[1:depth] AS key, turns[1:depth - 1] AS up, CASE WHEN depth > 0 THEN length(turns[depth].text) ELSE 0 END AS chars FROM p
    ), node AS (
      SELECT depth, key, any_value(up) AS up, any_value(chars) AS chars, count(*) AS n_convs, min(conv_id) AS conv_id,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
      FROM k GROUP BY depth, key
    ), kids AS (SELECT depth - 1 AS depth, up AS key, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL
    ), full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (depth, key)
    ), above AS (SELECT key AS below, n_children, (n_convs - 1) * chars AS own, unnest(range(depth + 1)) AS depth FROM full_node
    ), sums AS (SELECT depth, below[1:depth] AS key, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved_tokens FROM above GROUP BY ALL)
    SELECT x.conv_id, x.depth, u.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, x.ends_sha256
    FROM full_node x JOIN sums USING (depth, key) LEFT JOIN node u ON u.depth = x.depth - 1 AND u.key = x.up
"""

"""The prefix trie of conversations, rolled up by centroid decomposition of its parent-edge forest.

A node is a distinct sequence of first turns. It is known by the XOR of hashes of (place, role, text), 128 bits, so the key of every
prefix of a conversation comes from a running XOR that tasks share: a conversation of any length is dealt over ranges of its turns.

Sums over subtrees need as many rounds as the trie is deep if they climb from level to level. Here each round splits every large component
of the forest at its centroid, the deepest node that has more than half of the component's weight below it. The totals of the components
under a centroid are added to it and to all nodes on the way from it to its component's top; then it is taken out, and what is left are
components of at most half the weight. A node's weight is the number of turns at or below it, known from the first grouping. Components
of few nodes are finished in one task each by the same method, many to a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleargrain.llm.common import WORD, cut_lineage

#: A conversation borrows its first turns from the one whose number is the multiple of BORROW at or toward 0 from its own; at most LENT - 1 turns.
BORROW, LENT = 20, 4
#: Nodes of a component that one task rolls up by itself.
LOCAL_NODES = 20_000
#: Tasks over which the nodes of a component are dealt when they meet its centroid; depths of a path that meet together.
SALTS, BLOCK = 64, 4_096
#: Rows of a table that is broadcast at most (five or six longs each).
BROADCAST_ROWS = 50_000
#: A parent of more children than this, and of more than a thousandth of all nodes, is hot: there are a thousand at most.
HOT_CHILDREN = 100_000

PATH = ["conv_id", "depth", "a", "b", "parent_a", "parent_b", "words", "length"]
MEASURES = ["leaves", "saved"]


def _mark(seed: int, depth: Column, a: Column, b: Column) -> Column:
    return F.xxhash64(F.lit(seed), depth.cast("long"), a, b)


def _xor(*columns: Column) -> Column:
    return reduce(Column.bitwiseXOR, columns)


def _met(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left joined to a checkpointed table, which is broadcast if it has BROADCAST_ROWS rows at most."""
    return left.join(F.broadcast(right) if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else right, on, how)


def _salted(rows: DataFrame, small: DataFrame, on: list[str], salt: Column, how: str = "inner") -> DataFrame:
    """rows joined to a checkpointed table of one row a key: broadcast, or copied to SALTS tasks a key, as many rows may share one."""
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), on, how)
    spread = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(spread, [*on, "salt"], how).drop("salt")


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """A row for each conversation and each number of its first rebuilt turns, 0 too: PATH columns, where (a, b) is the node's key,
    (parent_a, parent_b) its parent's, words those of the last text, and length all turns of the rebuilt conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.xxhash64(F.lit(1), role, text).alias("ta"), F.xxhash64(F.lit(2), role, text).alias("tb"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("copy"),
    )
    order = [F.col("turn").asc_nulls_first(), "ta", "tb", "copy"]
    dealt = cut_lineage(turns.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()))
    in_part = Window.partitionBy("conv_id", "part").orderBy(*order)
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    of_conv = Window.partitionBy("conv_id")
    parts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    parts = cut_lineage(
        parts.select(
            "conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"), F.sum("n").over(of_conv).alias("total"), (F.count("*").over(of_conv) > 1).alias("split")
        )
    )
    own = (F.col("start") + F.row_number().over(in_part)).alias("own")

    lenders = dealt.where(f"conv_id % {BORROW} = 0").join(parts, ["conv_id", "part"]).select("conv_id", own, "ta", "tb", "words").where(f"own < {LENT}")
    heads = lenders.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("own", "ta", "tb", "words"))).alias("head"))  # LENT - 1 turns at most
    borrowed = F.crc32(F.col("conv_id").cast("string").cast("binary")) % LENT
    convs = parts.groupBy("conv_id").agg(F.max("total").alias("total")).withColumn("cut", borrowed).withColumn("lender", F.expr(f"conv_id - conv_id % {BORROW}"))
    convs = convs.join(heads.withColumnRenamed("conv_id", "lender"), "lender", "left")
    taken = F.coalesce(F.slice("head", F.lit(1), F.col("cut").cast("int")), F.array().cast("array<struct<own:bigint,ta:bigint,tb:bigint,words:bigint>>"))
    convs = convs.withColumn("taken", F.transform(taken, lambda t: F.struct(_mark(1, t.own, t.ta, t.tb).alias("ma"), _mark(2, t.own, t.ta, t.tb).alias("mb"), t.words.alias("words"))))
    total_of = lambda marks, name: F.aggregate(marks, F.lit(0).cast("long"), lambda s, t: s.bitwiseXOR(t[name]))
    convs = cut_lineage(
        convs.select(
            "conv_id", "cut", "taken", F.size("taken").alias("lent"), total_of(F.col("taken"), "ma").alias("head_a"), total_of(F.col("taken"), "mb").alias("head_b"),
            (F.size("taken") + F.greatest(F.col("total") - F.col("cut"), F.lit(0))).alias("length"),
        )
    )

    root = convs.select("conv_id", F.lit(0).alias("depth"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(None).alias("parent_a"), F.lit(None).alias("parent_b"), F.lit(0).alias("words"), "length")
    first = convs.select("conv_id", "length", "taken", F.posexplode("taken").alias("i", "t")).withColumn("upto", F.slice("taken", F.lit(1), F.col("i") + 1))
    first = first.select("conv_id", (F.col("i") + 1).alias("depth"), total_of(F.col("upto"), "ma").alias("a"), total_of(F.col("upto"), "mb").alias("b"), "t.ma", "t.mb", "t.words", "length")

    known = parts.join(convs.drop("taken"), "conv_id")
    rows = dealt.join(known, ["conv_id", "part"]).select("*", own).where("own > cut").withColumn("depth", F.col("own") - F.col("cut") + F.col("lent"))
    rows = rows.withColumn("ma", _mark(1, F.col("depth"), F.col("ta"), F.col("tb"))).withColumn("mb", _mark(2, F.col("depth"), F.col("ta"), F.col("tb")))
    so_far = in_part.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("conv_id", "part", "split", "depth", "ma", "mb", "words", "length", *[_xor(F.col(f"head_{x}"), F.bit_xor(f"m{x}").over(so_far)).alias(x) for x in "ab"])
    rows = cut_lineage(rows)
    # only a conversation that lies in several ranges carries anything from one to the next: two rows a range at most
    carried = rows.where("split").groupBy("conv_id", "part").agg(F.bit_xor("ma").alias("ma"), F.bit_xor("mb").alias("mb"))
    carried = carried.select("conv_id", "part", *[F.coalesce(F.bit_xor(f"m{x}").over(earlier), F.lit(0)).alias(f"carry_{x}") for x in "ab"])
    rows = rows.join(F.broadcast(carried), ["conv_id", "part"], "left")
    rows = rows.select("conv_id", "depth", *[_xor(F.col(x), F.coalesce(f"carry_{x}", F.lit(0))).alias(x) for x in "ab"], "ma", "mb", "words", "length")
    later = first.unionByName(rows).select("conv_id", "depth", "a", "b", *[_xor(F.col(x), F.col(f"m{x}")).alias(f"parent_{x}") for x in "ab"], "words", "length")
    return root.unionByName(later).select(*[F.col(c).cast("long").alias(c) for c in PATH])


def tops_of(parent: np.ndarray) -> np.ndarray:
    """For each node the one that its parents lead to; -1 ends the way."""
    up = np.where(parent < 0, np.arange(len(parent)), parent)
    while True:
        twice = up[up]
        if np.array_equal(twice, up):
            return up
        up = twice


def roll_up(parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values (a row a node) over each node's subtree in a forest, by centroid decomposition of all its trees at once.

    weight: of each node's whole subtree, every node counting something.
    """
    parent, weight, out = parent.copy(), weight.copy(), np.zeros_like(values)
    alive, top = np.ones(len(parent), bool), tops_of(parent)
    while alive.any():
        live = np.flatnonzero(alive)
        heavy = live[2 * weight[live] > weight[top[live]]]
        heavy = heavy[np.lexsort((depth[heavy], top[heavy]))]
        centroids = heavy[np.append(top[heavy][1:] != top[heavy][:-1], True)]
        taken_out = np.zeros(len(parent), bool)
        taken_out[centroids] = True
        cut = np.where((parent >= 0) & taken_out[parent], -1, parent)
        new_top = tops_of(cut)
        moved = live[new_top[live] != top[live]]
        below = np.zeros_like(values)
        np.add.at(below, new_top[moved], values[moved])  # component totals
        under = np.flatnonzero(below.any(axis=1))
        own = values * taken_out[:, None]
        np.add.at(own, parent[under], below[under])
        out[centroids] += own[centroids]
        at, of = parent[centroids], centroids
        while (on := at >= 0).any():  # from all centroids to their tops, a step a turn
            at, of = at[on], of[on]
            out[at] += own[of]
            weight[at] -= weight[of]
            at = parent[at]
        alive[centroids] = False
        parent, top = cut, new_top
        parent[centroids] = -1
    return out


def _solve(nodes: pd.DataFrame) -> pd.DataFrame:
    """Subtree sums of whole small components."""
    number = {key: i for i, key in enumerate(zip(nodes["a"], nodes["b"]))}
    is_top = ((nodes["a"] == nodes["top_a"]) & (nodes["b"] == nodes["top_b"])).to_numpy()
    parent = np.array([-1 if t else number[p] for t, p in zip(is_top, zip(nodes["parent_a"], nodes["parent_b"]))], dtype=np.int64)
    sums = roll_up(parent, nodes["depth"].to_numpy(np.int64), nodes["weight"].to_numpy(np.int64), nodes[MEASURES].to_numpy(np.int64))
    return nodes[["a", "b"]].assign(**{m: sums[:, k] for k, m in enumerate(MEASURES)})


def _split(open_: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round: the open components' nodes without the centroids, relabelled (large: the component goes on), and the sums added to nodes."""
    top = ["top_a", "top_b"]
    heaviest = F.max(F.struct("depth", "a", "b", "weight", "total", "top_depth", "conv_id", *MEASURES)).alias("c")
    centroids = open_.where("2 * weight > total").groupBy(*top).agg(heaviest)
    centroids = cut_lineage(centroids.select(*top, *[F.col(f"c.{x}").alias(f"c_{x}") for x in ("depth", "a", "b", "weight", "total", "top_depth", "conv_id", *MEASURES)]))

    # which nodes lie under their centroid: a node's path is its conversation's, looked up once a block of depths
    block = F.expr(f"depth div {BLOCK}")
    asked = open_.groupBy(*top, "conv_id", block.alias("block")).agg(F.max("depth").alias("deepest"))
    asked = _salted(asked, centroids.select(*top, "c_depth", "c_a", "c_b"), top, F.xxhash64("conv_id", "block")).where("deepest > c_depth")
    step = paths.select("conv_id", (F.col("depth") - 1).alias("c_depth"), F.col("parent_a").alias("c_a"), F.col("parent_b").alias("c_b"), F.col("a").alias("child_a"), F.col("b").alias("child_b"))
    under = asked.join(step, ["conv_id", "c_depth", "c_a", "c_b"]).select(*top, "conv_id", "block", "c_depth", "child_a", "child_b")
    rows = open_.withColumn("block", block).join(under, [*top, "conv_id", "block"], "left").withColumn("under", F.coalesce(F.col("depth") > F.col("c_depth"), F.lit(False)))
    rows = cut_lineage(
        rows.select(
            "a", "b", "parent_a", "parent_b", "conv_id", "depth", "weight", *MEASURES, "under", *[F.col(t).alias(f"old_{t}") for t in top],
            *[F.when(F.col("under"), F.col(f"child_{x}")).otherwise(F.col(f"top_{x}")).alias(f"top_{x}") for x in "ab"],
            F.when(F.col("under"), F.col("c_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
        )
    )

    # component totals, and from them those of the centroids
    pieces = rows.groupBy("old_top_a", "old_top_b", *top, "under").agg(F.count("*").alias("nodes"), F.max("weight").alias("total"), *[F.sum(m).alias(m) for m in MEASURES])
    pieces = cut_lineage(pieces)
    below = pieces.where("under").groupBy(F.col("old_top_a").alias("top_a"), F.col("old_top_b").alias("top_b")).agg(*[F.sum(m).alias(m) for m in MEASURES])
    summed = centroids.join(below, top, "left").withColumns({m: F.coalesce(F.col(m), F.lit(0)) + F.col(f"c_{m}") for m in MEASURES})
    summed = cut_lineage(summed)

    # along the way from each centroid to its component's top
    ways = summed.where("c_depth > c_top_depth").select(F.col("c_conv_id").alias("conv_id"), "c_depth", "c_top_depth", "c_weight", *MEASURES)
    way = _met(paths.select("conv_id", "depth", "a", "b"), cut_lineage(ways), ["conv_id"]).where("depth >= c_top_depth and depth < c_depth")
    marks = way.select("a", "b", F.col("c_weight").alias("less"), F.lit(False).alias("gone"), *MEASURES)
    marks = marks.unionByName(summed.select(F.col("c_a").alias("a"), F.col("c_b").alias("b"), F.lit(0).cast("long").alias("less"), F.lit(True).alias("gone"), *MEASURES))
    marks = cut_lineage(marks)

    upper = pieces.where("not under").join(summed.select(*top, "c_total", "c_weight"), top)
    large = pieces.where(f"under and nodes > {LOCAL_NODES}").select(*top, "total")
    large = large.unionByName(upper.where(f"nodes - 1 > {LOCAL_NODES}").select(*top, (F.col("c_total") - F.col("c_weight")).alias("total")))
    left = rows.drop("old_top_a", "old_top_b", "under").join(marks.select("a", "b", "less", "gone"), ["a", "b"], "left").where("gone is null or not gone")
    left = left.withColumn("weight", F.col("weight") - F.coalesce("less", F.lit(0))).drop("less", "gone")
    left = _salted(left, cut_lineage(large), top, F.xxhash64("a", "b"), "left")
    return cut_lineage(left), marks.select("a", "b", *MEASURES)


def subtree_sums(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """a, b and the sums of MEASURES over each node's subtree. nodes has a, b, their parent's, conv_id (a conversation through the node), depth,
    weight (turns at or below) and the MEASURES; paths is rebuilt_paths() of the conversations."""
    whole = nodes.where("parent_a is null").select("weight").first()
    state = ["a", "b", "parent_a", "parent_b", "conv_id", "depth", "weight", *MEASURES]
    total = whole[0] if whole else 0
    open_ = nodes.select(*state, *[F.lit(0).cast("long").alias(c) for c in ("top_a", "top_b", "top_depth")], F.lit(total).cast("long").alias("total"))
    small, sums = [], []
    while not open_.isEmpty():
        left, added = _split(open_, paths)
        small.append(left.where("total is null").drop("total"))
        sums.append(added)
        open_ = left.where("total is not null")
    if not small:
        return nodes.select("a", "b", *MEASURES)
    rest = reduce(DataFrame.unionByName, small)
    shuffles = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    buckets = max(shuffles, -(-rest.count() // LOCAL_NODES))
    bucket = F.pmod(F.xxhash64("top_a", "top_b"), F.lit(buckets)).alias("bucket")
    whole_keys = rest.fillna(0, ["parent_a", "parent_b"])  # pandas would turn longs beside nulls into doubles
    solved = whole_keys.groupBy(bucket).applyInPandas(_solve, "a long, b long, leaves long, saved long")
    return reduce(DataFrame.unionByName, [solved, *sums]).groupBy("a", "b").agg(*[F.sum(m).alias(m) for m in MEASURES])


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the comma-joined ids of each run of equal (a, b), which may reach over any number of batches."""
    key, held = None, None
    for batch in batches:
        if not len(batch):
            continue
        a, b, ids = (batch[c].to_numpy() for c in ("a", "b", "conv_id"))
        starts = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        done = []
        for start, stop in zip(starts, [*starts[1:], len(a)]):
            joined = ",".join(map(str, ids[start:stop].tolist())).encode()
            if key == (a[start], b[start]):
                held.update(b"," + joined)
                continue
            if key is not None:
                done.append((*key, held.hexdigest()))
            key, held = (a[start], b[start]), hashlib.sha256(joined)
        yield pd.DataFrame(done, columns=["a", "b", "ends"])
    if key is not None:
        yield pd.DataFrame([(*key, held.hexdigest())], columns=["a", "b", "ends"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct sequence of first rebuilt turns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    Turns go by turn, nulls first, ties by a hash of role and text; repeated rows are turns of their own. Null role or text: empty. Rows
    without conv_id belong to no conversation and don't count. A turnless rebuilt conversation is a member of the root alone. An
    empty table has no root. Columns besides conv_id, turn, role and text are ignored. Keys are 128-bit hashes. The ids of one node's ends
    are sorted by Spark and digested as a stream, in one task a node, since the digest has no parts that could be joined.
    """
    paths = cut_lineage(rebuilt_paths(conversations))
    nodes = paths.groupBy("a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("parent_a").alias("parent_a"), F.max("parent_b").alias("parent_b"),
        F.max("words").alias("words"), F.sum(F.col("length") - F.col("depth") + 1).alias("weight"), F.max(F.col("length") > F.col("depth")).alias("inner"),
    )
    nodes = nodes.withColumn("leaves", (~F.col("inner")).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    nodes = cut_lineage(nodes)
    ends = paths.where("depth = length").select("a", "b", "conv_id").repartition("a", "b").sortWithinPartitions("a", "b", "conv_id")
    facts = [
        nodes.select("a", "b", "conv_id", "depth", "n_convs", "parent_a", "parent_b"),
        nodes.where("parent_a is not null").groupBy(F.col("parent_a").alias("a"), F.col("parent_b").alias("b")).agg(F.count("*").alias("n_children")),
        subtree_sums(nodes, paths),
        ends.mapInPandas(_digests, "a long, b long, ends string"),
    ]
    whole = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), facts).groupBy("a", "b")
    whole = cut_lineage(whole.agg(*[F.max(c).alias(c) for c in ("conv_id", "depth", "n_convs", "parent_a", "parent_b", "n_children", *MEASURES, "ends")]))

    # a parent's number: a thousand hot parents at most are broadcast, the children of others are dealt by parent
    edge = max(HOT_CHILDREN, whole.count() // 1_000)
    parents = whole.where("n_children > 0").select(F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = parents.where(F.col("n_children") > edge).drop("n_children")
    met = whole.join(F.broadcast(hot), ["parent_a", "parent_b"])
    cold = whole.join(F.broadcast(hot), ["parent_a", "parent_b"], "left_anti").join(parents.where(F.col("n_children") <= edge).drop("n_children"), ["parent_a", "parent_b"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return met.unionByName(cold).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", nothing).alias("ends_sha256"),
    )


#: The same trie in DuckDB SQL: nodes by the joined digests of their turns, each added up over all its ancestors.
PREFIX_TRIE_SQL = rf"""
WITH steps AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)),
                          lambda c, bit: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
turns AS (
  SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS own
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % {BORROW} AS lender,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT)),
             lambda c, b: xor(c >> 8, steps.t[(xor(c, b) & 255) + 1])), 4294967295) % {LENT} AS cut
  FROM (SELECT DISTINCT conv_id FROM turns), steps),
rebuilt AS (
  SELECT c.conv_id, 0 AS side, t.own, t.mark, t.words FROM convs c JOIN turns t ON t.conv_id = c.lender AND t.own <= c.cut
  UNION ALL
  SELECT c.conv_id, 1, t.own, t.mark, t.words FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.own > c.cut),
paths AS (
  SELECT conv_id, string_agg(mark, '') OVER (PARTITION BY conv_id ORDER BY side, own) AS path, words FROM rebuilt
  UNION ALL SELECT conv_id, '', 0 FROM convs),
ending AS (
  SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends
  FROM (SELECT conv_id, max_by(path, length(path)) AS path FROM paths GROUP BY conv_id) GROUP BY path),
nodes AS (
  SELECT path, min(conv_id) AS conv_id, length(path) // 32 AS depth, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved FROM paths GROUP BY path),
children AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
ups AS (
  SELECT left(n.path, 32 * k) AS path, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(n.saved)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS k FROM nodes) n LEFT JOIN children c ON c.path = n.path GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0)::BIGINT AS n_children, u.n_leaves, u.saved_tokens,
       coalesce(e.ends, sha256('')) AS ends_sha256
FROM nodes n JOIN ups u ON u.path = n.path LEFT JOIN children c ON c.path = n.path LEFT JOIN ending e ON e.path = n.path
LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, length(n.path) - 32)
"""

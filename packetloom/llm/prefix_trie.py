"""Trie of conversation prefixes, with sums over subtrees by the Euler-tour technique.

Conversations that begin with the same turns share their nodes. Each node is entered and left once in
a walk around the tree; the arcs of that walk form one linked list, whose ranks are found
distributedly. Over the arcs in order, sums up to the one that leaves a node less those before the
one that enters it are sums over its subtree, whatever the depth or width of the tree is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import lookup, partitions, stored, table
from packetloom.operators.prefix import Before, Sum, Xor, prefix_scan

#: A linked list of up to so many elements is ranked by one task; longer ones are contracted to it first.
SMALL = 100_000
#: Conversations whose ids share all but their last two digits begin like the first of them.
FAMILY, HEADS = 100, 6


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, k1, k2, chars): turns by number, null first; k1 and k2 are a digest of role and text.

    Turns of the same number stand in order of md5(md5(role) || md5(text)).
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.md5(F.concat(F.md5(role), F.md5(text))).alias("tie"), F.char_length(text).cast("long").alias("chars"))
    number = lambda at: F.conv(F.substring("tie", at, 15), 16, 10).cast("long")
    return prefix_scan(rows, ["turn", "tie"], ["conv_id"], place=Sum(F.lit(1))).select(
        "conv_id", "place", number(1).alias("k1"), number(16).alias("k2"), "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of the first of their family, as (turns, conversations).

    Conversation c takes the first crc32(c) % HEADS turns of conversation c - c % FAMILY, or what it has
    of them, in place of as many of its own. Conversations are (conv_id, n), n their turns.
    """
    own = stored(turns.groupBy("conv_id").agg(F.max("place").alias("n")), "conversations")
    h = F.crc32(F.col("conv_id").cast("string")) % HEADS
    own_h = own.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"))
    lent = F.least(F.col("h"), F.coalesce("lender_n", F.lit(0)))
    plan = stored(own_h.join(own.select(F.col("conv_id").alias("first"), F.col("n").alias("lender_n")), "first", "left").select(
        "conv_id", "n", "h", "first", lent.cast("long").alias("lent")), "plan")
    heads = plan.filter("lent > 0").join(turns.filter(F.col("place") < HEADS).withColumnRenamed("conv_id", "first"), "first").filter(
        F.col("place") <= F.col("lent")).select("conv_id", "place", "k1", "k2", "chars")
    tails = lookup(turns, plan.select("conv_id", "n", "h", "lent"), "conv_id", F.col("n"), turns.count()).filter(
        F.col("place") > F.col("h")).select(
        "conv_id", (F.col("place") - F.col("h") + F.col("lent")).alias("place"), "k1", "k2", "chars")
    sizes = plan.select("conv_id", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))
    return heads.unionByName(tails), sizes


def _joined(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, sha256) of the conv_ids of each node, ascending and joined by commas.

    Ids are put in order and joined over even ranges; what is left to one task is the hash itself,
    which takes the pieces of a node one after the other and holds none of them.
    """
    keys = ["depth", "p1", "p2"]
    ordered = ends.repartitionByRange(partitions(ends.sparkSession), *keys, "conv_id").sortWithinPartitions(*keys, "conv_id")

    def piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
            new = np.ones(b.num_rows, dtype=bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            at = np.flatnonzero(new)
            ids = b.column("conv_id").to_pylist()
            text = [",".join(map(str, ids[lo:hi])) for lo, hi in zip(at, [*at[1:], len(ids)])]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c[at]) for c in columns), pa.array([ids[i] for i in at], pa.int64()), pa.array(text, pa.string())],
                names=[*keys, "conv_id", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        done = lambda: pa.RecordBatch.from_pylist([dict(zip(keys, node)) | {"sha256": state.hexdigest()}])
        for b in batches:
            for *key, ids in zip(*(b.column(k).to_pylist() for k in (*keys, "ids"))):
                if key == node:
                    state.update(b",")
                else:
                    if node:
                        yield done()
                    node, state = key, hashlib.sha256()
                state.update(ids.encode())
        if node:
            yield done()

    numbers = "depth long, p1 long, p2 long"
    pieces = ordered.mapInArrow(piece, f"{numbers}, conv_id long, ids string")
    return pieces.repartition(*keys).sortWithinPartitions(*keys, "conv_id").mapInArrow(digest, f"{numbers}, sha256 string")


def _follow(before: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First element and distance from it, for elements that point to the one before or to themselves."""
    while True:
        dist, further = dist + dist[before], before[before]
        if (further == before).all():
            return before, dist
        before = further


def _pointers(ids: np.ndarray, pred: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Place of each element's predecessor among ids, in order, and which have it there."""
    wanted = pred.fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
    here = ids[at] == wanted
    return np.where(here, at, np.arange(len(ids))), here


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follow chains inside each batch, which is in order of id."""
    for b in batches:
        if b.num_rows:
            ids = b.column("id").to_numpy(zero_copy_only=False)
            before, here = _pointers(ids, b.column("pred"))
            head, dist = _follow(before, here.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(ids[head]), pa.array(dist), b.column("pred")], names=["id", "head", "dist", "pred"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rank a list of at most SMALL weighted elements."""
    rows = [b for b in batches if b.num_rows]
    if rows:
        whole = pa.Table.from_batches(rows).sort_by("id").combine_chunks()
        ids = whole.column("id").to_numpy()
        before, here = _pointers(ids, whole.column("pred").combine_chunks())
        weight = np.where(here, whole.column("w").to_numpy(), 0)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(_follow(before, weight)[1])], names=["id", "rank"])


def list_ranks(arcs: DataFrame, small: int = SMALL) -> DataFrame:
    """(id, rank) of the elements of a linked list (id, pred), both at least 0; the first has a null pred and rank 0.

    Chains inside blocks of the id order shrink to their first element. Of what is left an
    independent set, drawn by hashes, is spliced out until one task can rank the rest; then the
    elements come back in reverse order, each behind its predecessor.
    """
    spark = arcs.sparkSession
    blocks = stored(arcs.select("id", "pred").repartitionByRange(partitions(spark), "id").sortWithinPartitions("id").mapInArrow(
        _blocks, "id long, head long, dist long, pred long"), "blocks")
    heads = blocks.filter("id = head").select("id", "pred")
    inner = blocks.select(F.col("id").alias("pred"), F.col("head").alias("to"), (F.col("dist") + 1).alias("w"))
    rest = stored(heads.join(inner, "pred", "left").select(
        "id", F.col("to").alias("pred"), F.coalesce("w", F.lit(0)).alias("w")), "list")
    spliced = []
    while rest.count() > small:
        coin = lambda c: F.xxhash64(F.lit(len(spliced)), c) % 2 == 0
        leaves = F.coalesce(coin(F.col("id")) & ~coin(F.col("pred")) & F.col("pred").isNotNull(), F.lit(False))
        gone = rest.filter(leaves)
        bridge = gone.select(F.col("id").alias("pred"), F.col("pred").alias("to"), F.col("w").alias("more"))
        spliced.append(gone)
        rest = stored(rest.filter(~leaves).join(bridge, "pred", "left").select(
            "id", F.coalesce("to", "pred").alias("pred"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w")), "list")
    ranks = stored(rest.repartition(1).mapInArrow(_whole, "id long, rank long"), "ranks")
    for gone in reversed(spliced):
        known = ranks.select(F.col("id").alias("pred"), "rank")
        ranks = stored(ranks.unionByName(gone.join(known, "pred").select("id", (F.col("rank") + F.col("w")).alias("rank"))), "ranks")
    return blocks.join(ranks.select(F.col("id").alias("head"), "rank"), "head").select(
        "id", (F.col("rank") + F.col("dist")).alias("rank"))


def prefix_nodes(turns: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trie with their parents, and where each conversation ends.

    A node is known by its depth and two numbers, p1 and p2, that the turns up to it add up to by
    exclusive or of hashes of place, role and text (128 bits). Nodes are numbered by
    smallest member and depth: num, the parent's number, and conv_id, the smallest member.
    """
    mark = lambda *more: F.xxhash64("place", *more)
    paths = prefix_scan(
        turns.withColumns({"x1": mark("k1", "k2"), "x2": mark(F.lit(2), "k2", "k1")}), ["place"], ["conv_id"],
        p1=Xor(F.col("x1")), p2=Xor(F.col("x2")))
    ends = paths.groupBy("conv_id").agg(F.max(F.struct(F.col("place").alias("depth"), "p1", "p2")).alias("e")).select("conv_id", "e.*")
    zero = F.lit(0).cast("long")
    ends = ends.unionByName(conversations.filter("n = 0").select(
        "conv_id", zero.alias("depth"), zero.alias("p1"), zero.alias("p2")))
    members = paths.select(
        "conv_id", F.col("place").alias("depth"), "p1", "p2", "chars", F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"),
        F.col("p2").bitwiseXOR(F.col("x2")).alias("q2")).unionByName(conversations.select(
            "conv_id", *[zero.alias(c) for c in ("depth", "p1", "p2", "chars", "q1", "q2")]))
    nodes = members.groupBy("depth", "p1", "p2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"),
        F.min("q1").alias("q1"), F.min("q2").alias("q2"))
    numbered = prefix_scan(nodes, ["conv_id", "depth"], num=Sum(F.lit(1)))
    key = lambda d, a, b: F.struct(d.alias("depth"), F.col(a).alias("a"), F.col(b).alias("b"))
    below = numbered.filter("depth > 0").withColumn("key", key(F.col("depth") - 1, "q1", "q2"))
    kids = below.groupBy("key").agg(F.count("*").alias("n_children"), F.max("num").alias("last"))
    facts = stored(numbered.select(
        key(F.col("depth"), "p1", "p2").alias("key"), F.col("num").alias("parent"), F.col("conv_id").alias("parent_conv_id")).join(
            kids, "key"), "parents")
    up = lookup(below.select("num", "key"), facts.select("key", "parent", "parent_conv_id", "n_children"), "key",
                F.col("n_children"), numbered.count()).select("num", "parent", "parent_conv_id")
    down = facts.select(F.col("parent").alias("num"), "n_children", "last")
    tree = numbered.drop("q1", "q2").join(up, "num", "left").join(down, "num", "left")
    return stored(tree.withColumn("n_children", F.coalesce("n_children", zero)), "tree"), ends


def tour_arcs(tree: DataFrame) -> DataFrame:
    """(id, pred): 2 num enters a node and 2 num + 1 leaves it; pred is the arc before in the walk.

    Children are walked by number. A node is entered after its last sibling was left, the first
    after its parent was entered; it is left after its last child was left, or else as soon as entered.
    """
    enter, leave = lambda n: 2 * F.col(n), lambda n: 2 * F.col(n) + 1
    siblings = prefix_scan(tree.filter("parent IS NOT NULL").select("num", "parent"), ["num"], ["parent"], prev=Before(F.col("num")))
    into = siblings.select(enter("num").alias("id"), F.coalesce(leave("prev"), enter("parent")).alias("pred"))
    root = tree.filter("parent IS NULL").select(enter("num").alias("id"), F.lit(None).cast("long").alias("pred"))
    out = tree.select(leave("num").alias("id"), F.coalesce(leave("last"), enter("num")).alias("pred"))
    return into.unionByName(root).unionByName(out)


def subtree_sums(tree: DataFrame, small: int = SMALL) -> DataFrame:
    """(num, n_leaves, saved_tokens) by sums over the tour."""
    ranks = list_ranks(tour_arcs(tree), small).withColumn("num", F.shiftright("id", 1))
    own = tree.select("num", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    enters = F.col("id") % 2 == 0
    arcs = ranks.join(own, "num").select(
        "num", "rank", enters.alias("enters"), F.when(enters, F.col("leaf")).otherwise(0).alias("leaf"),
        F.when(enters, F.col("saved")).otherwise(0).alias("saved"))
    upto = prefix_scan(arcs, ["rank"], leaves=Sum(F.col("leaf")), all_saved=Sum(F.col("saved")))
    inside = lambda total, mine: F.sum(F.when(F.col("enters"), F.col(mine) - F.col(total)).otherwise(F.col(total)))
    return upto.groupBy("num").agg(inside("leaves", "leaf").alias("n_leaves"), inside("all_saved", "saved").alias("saved_tokens"))


def prefix_trie(turns: DataFrame, conversations: DataFrame, small: int = SMALL) -> DataFrame:
    """Nodes of the trie of turns (conv_id, place from 1, k1, k2, chars) of conversations (conv_id, n turns).

    One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    No conversations, no nodes.
    """
    tree, ends = prefix_nodes(turns, conversations)
    nothing = F.lit(hashlib.sha256().hexdigest())
    return tree.join(subtree_sums(tree, small), "num").join(_joined(ends), ["depth", "p1", "p2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha256", nothing).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, small: int = SMALL) -> DataFrame:
    """Trie of the rebuilt conversations (conv_id, turn, role, text); see `rebuilt` and `prefix_trie`.

    Rows without conv_id belong to no conversation and are left out. A null role or text is empty,
    a null turn comes first. Repeated rows are turns of their own. Other columns are not looked at.
    """
    turns, sizes = rebuilt(ordered_turns(conversations))
    return prefix_trie(turns, stored(sizes, "sizes"), small)


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH turns AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           md5(md5(coalesce(role, '')) || md5(coalesce(text, '')))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(t ORDER BY place) AS turns FROM turns GROUP BY conv_id),
crc AS (
  SELECT conv_id, turns, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
           range(1, length(conv_id::VARCHAR) + 1),
           lambda i: list_concat([ord(substr(conv_id::VARCHAR, i, 1))::BIGINT], list_transform(range(8), lambda j: (-1)::BIGINT))))),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384::BIGINT * (a & 1)) END)) % 6 AS h
  FROM own),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns[1:h], []), a.turns[h + 1:]) AS turns
  FROM crc a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100),
members AS (
  SELECT conv_id, depth, turns[1:depth] AS path, len(turns) = depth AS ends
  FROM rebuilt, unnest(range(0, len(turns) + 1)) AS r(depth)),
nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY depth, path),
family AS (
  SELECT n.*, p.conv_id AS parent_conv_id, count(c.depth) AS n_children
  FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
  LEFT JOIN nodes c ON c.depth = n.depth + 1 AND c.path[1:n.depth] = n.path
  GROUP BY ALL),
sums AS (
  SELECT k AS depth, path[1:k] AS path, count(*) FILTER (n_children = 0) AS n_leaves,
         sum(CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(path[depth].text) END) AS saved_tokens
  FROM family, unnest(range(0, depth + 1)) AS r(k) GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM family JOIN sums USING (depth, path)
"""

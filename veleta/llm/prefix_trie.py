"""Prefix trie of conversations by union-find over sorted neighbours (operator 11)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veleta.llm.common import stored, text_of

FAMILY = 5  # conversations c - c % FAMILY ... share the head of the first of them
HEAD = 9  # a head has crc32(c) % HEAD turns
BLOCK_PATHS = 50_000  # distinct conversations that one task sorts into a forest
FAN_IN = 64  # contracted forests that meet in one forest of the next level
IDS_IN_CHUNK = 500

# A turn is 40 characters of a path: 32 hex digits of its digest, 8 of its text's length in UTF-8 bytes.
DIGEST, SIZE = 32, 8
TURN = DIGEST + SIZE

ENTRIES = "path STRING, convs LONG, conv_id LONG, kids LONG, leaves LONG, saved LONG"
FOREST = f"block LONG, done BOOLEAN, above LONG, savings array<long>, {ENTRIES}"


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, sort fields and the path element of every turn. Texts stay behind here."""
    role, text = text_of("role"), text_of("text")
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, DIGEST)
    size = F.lpad(F.lower(F.hex(F.octet_length(text).cast("long"))), SIZE, "0")
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.concat(digest, size).alias("element"),
    ).filter(F.col("conv_id").isNotNull())


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """conv_id and path: the head of the family's first conversation, then the conversation's own turns after as many.

    Turns are ordered by turn, null first; turns of one number by the digest of role and text. A path has 40 characters
    a turn, so a conversation of a million turns is one value of 40 MB.
    """
    item = F.struct(F.col("turn").isNotNull().alias("set"), F.coalesce("turn", F.lit(0)).alias("turn"), "element")
    own = _turns(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    own = stored(own.select("conv_id", F.array_join("items.element", "").alias("own")), "conversations")
    heads = own.select(F.col("conv_id").alias("donor"), F.substring("own", 1, (HEAD - 1) * TURN).alias("head"))
    keyed = own.withColumn("donor", F.col("conv_id") - F.col("conv_id") % FAMILY)
    cut = (F.crc32(F.col("conv_id").cast("string")) % HEAD).cast("int") * TURN
    whole = F.concat(F.coalesce(F.substring("head", F.lit(1), cut), F.lit("")), F.substring("own", cut + 1, F.length("own")))
    return keyed.join(heads, "donor", "left").select("conv_id", whole.alias("path"))


def _common(a: str, b: str) -> int:
    """Leading turns that two paths share."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        middle = (low + high + 1) // 2
        if a.startswith(b[: middle * TURN]):
            low = middle
        else:
            high = middle - 1
    return low


def _size(path: str, depth: int) -> int:
    """Bytes of the text of the turn at a depth."""
    return int(path[(depth - 1) * TURN + DIGEST : depth * TURN], 16)


class _Node:
    """A branching or final node with what is known of its subtree: members, closed children, their leaves and savings."""

    __slots__ = ("path", "depth", "convs", "conv_id", "kids", "leaves", "saved", "spine")

    def __init__(self, path, convs=0, conv_id=None, kids=0, leaves=0, saved=0, spine=False):
        self.path, self.depth, self.convs, self.conv_id = path, len(path) // TURN, convs, conv_id
        self.kids, self.leaves, self.saved, self.spine = kids, leaves, saved, spine

    def add(self, other: _Node) -> None:
        """Take in another part of the same node."""
        self.convs += other.convs
        if other.conv_id is not None:
            self.conv_id = other.conv_id if self.conv_id is None else min(self.conv_id, other.conv_id)
        self.kids, self.leaves, self.saved = self.kids + other.kids, self.leaves + other.leaves, self.saved + other.saved
        self.spine |= other.spine

    def savings(self, above: int) -> list[int]:
        """Saved by each turn below depth ``above`` with all that follows it, top first: all members but one save it."""
        out = [self.saved]
        for depth in range(self.depth, above, -1):
            out.append(out[-1] + (self.convs - 1) * _size(self.path, depth))
        return out[:0:-1]

    def adopt(self, child: _Node, savings: list[int]) -> None:
        """Attach a closed child."""
        self.convs, self.kids, self.leaves = self.convs + child.convs, self.kids + 1, self.leaves + (child.leaves or 1)
        self.conv_id = child.conv_id if self.conv_id is None else min(self.conv_id, child.conv_id)
        self.saved += savings[0]

    def row(self, block: int, done: bool, above: int, savings: list[int]) -> tuple:
        return block, done, above, savings, self.path, self.convs, self.conv_id, self.kids, self.leaves, self.saved


def grow_forest(entries: list[tuple], block: int, first: bool, last: bool) -> list[tuple]:
    """Nodes of one block of sorted entries.

    Neighbours are joined in descending depth of their common turns; every merge of two components makes a
    branching node at that depth, or adds to one that is there. A component that reaches an edge of the block, beyond
    which other blocks lie, stays open: it is handed on as an entry by itself, and so are the nodes above it.
    """
    nodes: list[_Node] = []
    for entry in sorted(entries, key=lambda e: e[0]):
        node = _Node(*entry)
        if nodes and nodes[-1].path == node.path:
            nodes[-1].add(node)
        else:
            nodes.append(node)
    if first and last and nodes and nodes[0].path:
        nodes.insert(0, _Node(""))
    if not nodes:
        return []
    nodes[0].spine |= not first
    for above, node in zip(nodes, nodes[1:]):  # nodes on the way down to the first sequence sort before it
        if not (above.spine and node.path.startswith(above.path)):
            break
        node.spine = True
    nodes[-1].spine |= not last
    up, top, out = list(range(len(nodes))), nodes, []

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def attach(parent: _Node, child: _Node) -> None:
        if child.spine:
            parent.spine = True
            out.append(child.row(block, False, -1, []))
        else:
            savings = child.savings(parent.depth)
            parent.adopt(child, savings)
            out.append(child.row(block, True, parent.depth, savings))

    edges = [(-_common(a.path, b.path), i) for i, (a, b) in enumerate(zip(nodes, nodes[1:]))]
    for negative, i in sorted(edges):
        depth, a, b = -negative, find(i), find(i + 1)
        left, right = top[a], top[b]
        if left.depth == depth and right.depth == depth:
            left.add(right)
            parent = left
        elif left.depth == depth:
            attach(parent := left, right)
        elif right.depth == depth:
            attach(parent := right, left)
        else:
            parent = _Node(left.path[: depth * TURN])
            attach(parent, left)
            attach(parent, right)
        up[b], top[a] = a, parent
    root = top[find(0)]
    out.append(root.row(block, not root.spine, -1, [root.saved]))
    return out


def _forest(fan_in: int, last_block: int):
    """Forest of a group of blocks; ``last_block`` is the greatest group number of this level."""

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        block = int(key[0])
        firsts = [None if pd.isna(x) else int(x) for x in frame["conv_id"]]
        entries = list(zip(frame["path"], frame["convs"].tolist(), firsts, frame["kids"].tolist(), frame["leaves"].tolist(), frame["saved"].tolist()))
        rows = grow_forest(entries, block, block == 0, block == last_block)
        return pd.DataFrame(rows, columns=[f.split()[0] for f in FOREST.split(", ")]).astype({"conv_id": "Int64"})

    return run


def _node_id(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, DIGEST)


def compact_nodes(paths: DataFrame, block_paths: int = BLOCK_PATHS, fan_in: int = FAN_IN) -> DataFrame:
    """Branching and final nodes: path, above (the depth of the node above, -1 for the root) and the subtree's figures.

    Equal paths are folded first, so a conversation that a third of the rows repeat is one entry. Distinct paths are
    range-sorted into blocks; the forests of neighbouring blocks, contracted to their outer spines, meet in a tree of
    forests until one is left.
    """
    distinct = stored(paths.groupBy("path").agg(F.count(F.lit(1)).alias("convs"), F.min("conv_id").alias("conv_id")), "paths")
    blocks = max(1, -(-distinct.count() // block_paths))
    dealt = distinct.repartitionByRange(blocks, "path").select(
        F.spark_partition_id().cast("long").alias("block"), "path", "convs", "conv_id",
        *[F.lit(0).cast("long").alias(x) for x in ("kids", "leaves", "saved")])
    level = stored(dealt, "blocks")
    # an empty range leaves a gap in the numbers, so blocks are counted by the greatest one
    low, high = level.agg(F.min("block"), F.max("block")).first()
    if high is None:
        return level.sparkSession.createDataFrame([], FOREST).drop("done", "block")
    level, last = level.withColumn("block", F.col("block") - F.lit(low)), high - low
    done = []
    while True:
        grown = stored(level.groupBy("block").applyInPandas(_forest(fan_in, last), FOREST), "forest")
        done.append(grown.filter("done").drop("done", "block"))
        if last == 0:
            break
        level = grown.filter(~F.col("done")).drop("done", "above").withColumn("block", F.floor(F.col("block") / fan_in).cast("long"))
        last //= fan_in
    nodes = done[0]
    for other in done[1:]:
        nodes = nodes.unionByName(other)
    return nodes


def _chunked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (node, conv_id) to runs of ids of one node, joined by commas."""
    for frame in frames:
        ids, nodes = frame["conv_id"].astype(str).tolist(), frame["node"].tolist()
        out, start = [], 0
        for i in range(1, len(ids) + 1):
            if i == len(ids) or nodes[i] != nodes[start] or i - start == IDS_IN_CHUNK:
                out.append((nodes[start], int(ids[start]), ",".join(ids[start:i])))
                start = i
        yield pd.DataFrame(out, columns=["node", "first", "ids"])


def _hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs sorted by (node, first id) to one digest per node, fed run by run."""
    node, state = None, None
    for frame in frames:
        out = []
        for name, ids in zip(frame["node"], frame["ids"]):
            if name == node:
                state.update(b"," + ids.encode())
            else:
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = name, hashlib.sha256(ids.encode())
        yield pd.DataFrame(out, columns=["node", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(node, state.hexdigest())], columns=["node", "ends_sha256"])


def ends_digests(paths: DataFrame) -> DataFrame:
    """node, ends_sha256 for nodes at which conversations end.

    SHA-256 reads its ids in order, so the ids of one node end in one task; there they pass as runs, never as a whole.
    """
    ends = paths.select(_node_id(F.col("path")).alias("node"), "conv_id")
    blocks = max(1, -(-ends.count() // (20 * BLOCK_PATHS)))
    ordered = ends.repartitionByRange(blocks, "node", "conv_id").sortWithinPartitions("node", "conv_id")
    runs = ordered.mapInPandas(_chunked, "node STRING, first LONG, ids STRING")
    return runs.repartition(F.col("node")).sortWithinPartitions("node", "first").mapInPandas(_hashed, "node STRING, ends_sha256 STRING")


def prefix_trie(conversations: DataFrame, block_paths: int = BLOCK_PATHS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (the smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without a conv_id take no part; null roles and texts are empty ones; repeated rows are turns of their own. An
    empty table gives no rows, any other at least the root. Other columns are ignored.
    """
    paths = stored(rebuilt_paths(conversations), "rebuilt")
    nodes = stored(compact_nodes(paths, block_paths, fan_in).select(
        _node_id(F.col("path")).alias("node"), (F.length("path") / TURN).cast("int").alias("bottom"), F.col("above").cast("int").alias("above"),
        F.when(F.col("above") >= 0, _node_id(F.expr(f"substring(path, 1, above * {TURN})"))).alias("parent"),
        "savings", "convs", "conv_id", "kids", "leaves"), "nodes")
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("upper"))
    joined = nodes.join(above, "parent", "left").join(ends_digests(paths), "node", "left")
    every = joined.select("*", F.posexplode("savings").alias("step", "saved_tokens"))  # turns without a branch are nodes too
    depth = F.col("above") + 1 + F.col("step")
    at_bottom = depth == F.col("bottom")
    return every.select(
        "conv_id", depth.cast("long").alias("depth"),
        F.when(F.col("step") == 0, F.col("upper")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("convs").alias("n_convs"),
        F.when(at_bottom, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.greatest("leaves", F.lit(1)).cast("long").alias("n_leaves"), "saved_tokens",
        F.when(at_bottom & F.col("ends_sha256").isNotNull(), F.col("ends_sha256")).otherwise(F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


ORACLE_SQL = """
with t as (
  select conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as e,
    strlen(coalesce(text, '')) as b,
    row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as pos
  from conversations where conv_id is not null),
c as (
  select conv_id, conv_id - conv_id % 5 as donor,
    xor(list_reduce(flatten([[4294967295::bigint]] || list_transform(string_split(conv_id::varchar, ''), lambda d: [unicode(d)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda r, s: case when s >= 0 then xor(r, s) else xor(r >> 1, 3988292384 * (r & 1)) end), 4294967295::bigint) % 9 as h
  from (select distinct conv_id from t)),
moved as (
  select c.conv_id, 0 as part, t.pos, e, b from c join t on t.conv_id = donor where t.pos < h
  union all select c.conv_id, 1, t.pos, e, b from c join t on t.conv_id = c.conv_id where t.pos >= h),
placed as (select *, row_number() over (partition by conv_id order by part, pos) as depth from moved),
steps as (
  select conv_id, depth, b, string_agg(e, '') over (partition by conv_id order by depth) as path from placed
  union all select conv_id, 0, 0, '' from c),
own as (select conv_id, max(depth) as depth from steps group by 1),
node as (
  select s.path, s.depth, any_value(s.b) as b, min(s.conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(s.conv_id::varchar, ',' order by s.conv_id) filter (where s.depth = own.depth), '')) as ends_sha256
  from steps s join own using (conv_id) group by 1, 2),
linked as (
  select n.*, p.conv_id as parent_conv_id, (select count(*) from node k where k.depth = n.depth + 1 and left(k.path, length(n.path)) = n.path) as n_children
  from node n left join node p on n.depth > 0 and p.depth = n.depth - 1 and p.path = left(n.path, 64 * (n.depth::int - 1)))
select n.conv_id, n.depth::bigint as depth, n.parent_conv_id, n.n_convs, n.n_children, n.ends_sha256,
  count(*) filter (where x.n_children = 0) as n_leaves, sum((x.n_convs - 1) * x.b)::bigint as saved_tokens
from linked n join linked x on x.depth >= n.depth and left(x.path, length(n.path)) = n.path
group by 1, 2, 3, 4, 5, 6, n.path
"""

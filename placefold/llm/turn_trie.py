"""Prefix trie of conversations: ternary search trees per range of sequences.

A conversation is the sequence of its turns' digests (16 bytes a turn), so a
sequence is one binary value whose order is that of its turns. Equal sequences
are counted first. The distinct ones are dealt by range, and each range is cut
into shards of bounded size, of which each is one ternary search tree. A node
that two shards have lies on the path of the first or last sequence of either:
only those nodes are merged across shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

WIDTH = 16  # bytes of a turn's digest
HEAD = 16  # turns by which sequences are dealt; a hash spreads those that share them
SHARD_TURNS = 100_000
ID_BITS = 12  # members are joined in runs of 2^12 ids before they meet

NODE = "shard long, conv long, depth long, up long, up_key binary, n long, children long, leaves long, saved long, ends string, key binary, size long"
NODE_TYPES = pa.schema(
    [(n, {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[t]) for n, t in (c.split() for c in NODE.split(", "))]
)


def turn_sequences(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv, path, sizes) per conversation: digests of its turns, and the UTF-8 bytes of their texts.

    Turns are ordered by number, null first; those with equal numbers by their
    digest. Null roles and texts are empty. Rows without an id belong to no
    conversation. Repeated rows are repeated turns.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat_ws(":", F.octet_length(role), role, text).cast("binary"))
    each = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"),
        F.struct(F.col(turn_col).alias("t"), digest.alias("d"), F.octet_length(text).cast("long").alias("s")).alias("turn"),
    )
    own = each.groupBy("conv").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return own.select("conv", F.unhex(F.array_join("turns.d", "")).alias("path"), F.col("turns.s").alias("sizes"))


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """(path, sizes, n, least, ends) per distinct sequence; ends is the hash of its members' ids.

    Ids are joined in runs first (at most 2^12 to a row), so that a sequence
    which very many conversations share is put together from few rows. One
    SHA-256 over all members has to go through them in order; the task that
    does it holds one run at a time.
    """
    runs = sequences.groupBy("path", F.shiftright("conv", ID_BITS).alias("run")).agg(
        F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("n"), F.min("conv").alias("least"),
        F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"),
    )

    def close(batches):
        last, sizes, n, least, ids = None, None, 0, None, None
        for batch in batches:
            done: list[tuple] = []
            for path, _, new_sizes, count, first, text in zip(*(c.to_pylist() for c in batch.columns)):
                if path != last:
                    if last is not None:
                        done.append((last, sizes, n, least, ids.hexdigest()))
                    last, sizes, n, least, ids = path, new_sizes, 0, first, hashlib.sha256()
                ids.update((("," if n else "") + text).encode())
                n += count
            if done:
                yield _closed(done)
        if last is not None:
            yield _closed([(last, sizes, n, least, ids.hexdigest())])

    def _closed(done: list[tuple]) -> pa.RecordBatch:
        types = (pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string())
        return pa.record_batch(
            [pa.array(c, t) for c, t in zip(zip(*done), types)], names=["path", "sizes", "n", "least", "ends"]
        )

    sorted_runs = runs.repartition("path").sortWithinPartitions("path", "run")
    return sorted_runs.mapInArrow(close, "path binary, sizes array<long>, n long, least long, ends string")


class TernaryTree:
    """Sequences of numbers. Node 0 is the root; ``down`` leads to the next turn, the sides to its siblings."""

    def __init__(self) -> None:
        self.turn, self.size, self.ends = [-1], [0], [-1]
        self.lower, self.higher, self.down = [0], [0], [0]

    def _new(self, turn: int, size: int) -> int:
        for column, value in (
            (self.turn, turn), (self.size, size), (self.ends, -1), (self.lower, 0), (self.higher, 0), (self.down, 0),
        ):
            column.append(value)
        return len(self.turn) - 1

    def insert(self, sequence: list[int], sizes: list[int], row: int) -> None:
        at = 0
        for x, size in zip(sequence, sizes):
            up, at = at, self.down[at]
            if not at:
                at = self.down[up] = self._new(x, size)
            while self.turn[at] != x:
                side = self.lower if x < self.turn[at] else self.higher
                if not side[at]:
                    side[at] = self._new(x, size)
                at = side[at]
        self.ends[at] = row

    def walk(self) -> Iterator[tuple[int, int, int]]:
        """(node, its parent, depth), parents before children, without recursion."""
        stack = [(0, -1, 0)]
        while stack:
            node, up, depth = stack.pop()
            yield node, up, depth
            for beside in (self.lower[node], self.higher[node]):
                if beside:
                    stack.append((beside, up, depth))
            if self.down[node]:
                stack.append((self.down[node], node, depth + 1))


def medians(n: int) -> Iterator[int]:
    """0 .. n-1, the middle of each range before either half."""
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if a < b:
            mid = (a + b) // 2
            yield mid
            stack += [(mid + 1, b), (a, mid)]


def shard_nodes(rows: list[tuple], shard: int) -> pa.RecordBatch:
    """All nodes of one shard; those on its first or last path carry a key and only what hangs on them here.

    Inner nodes are finished: members, children, leaves and savings of their
    whole subtree, and the least member of the parent, unless the parent is a
    border node, which they name by its key.
    """
    rows = sorted(rows)
    cut = [[p[i : i + WIDTH] for i in range(0, len(p), WIDTH)] for p, *_ in rows]
    number = {t: i for i, t in enumerate(sorted({t for own in cut for t in own}))}
    coded = [[number[t] for t in own] for own in cut]
    turns = list(number)
    tree = TernaryTree()
    for i in medians(len(rows)):
        tree.insert(coded[i], rows[i][1], i)

    total = len(tree.turn)
    order, ups, depths = [], [-1] * total, [0] * total
    first, last = [coded[i][:HEAD] for i in (0, -1)]
    on_first, on_last = [False] * total, [False] * total
    keys: list[bytes | None] = [None] * total
    for node, up, depth in tree.walk():
        order.append(node)
        ups[node], depths[node] = up, depth
        if up < 0:
            on_first[node] = on_last[node] = True
            keys[node] = b""
            continue
        for on, path in ((on_first, first), (on_last, last)):
            # Below the turns that deal the sequences, all that hangs on a border is border.
            on[node] = on[up] and (depth > HEAD or path[depth - 1 : depth] == [tree.turn[node]])
        if on_first[node] or on_last[node]:
            keys[node] = hashlib.md5(keys[up] + turns[tree.turn[node]]).digest()

    n, least = [0] * total, [None] * total
    children, leaves, saved = [0] * total, [0] * total, [0] * total
    for node in reversed(order):
        if tree.ends[node] >= 0:
            _, _, count, smallest, _ = rows[tree.ends[node]]
            n[node] += count
            least[node] = smallest if least[node] is None else min(least[node], smallest)
        inner = keys[node] is None
        if inner:
            leaves[node] += not children[node]
            saved[node] += (n[node] - 1) * tree.size[node]
        up = ups[node]
        if up >= 0:
            n[up] += n[node]
            least[up] = least[node] if least[up] is None else min(least[up], least[node])
            if inner:
                children[up] += 1
                leaves[up] += leaves[node]
                saved[up] += saved[node]
    columns = [
        [shard] * total, [least[i] for i in order], [depths[i] for i in order],
        [least[ups[i]] if ups[i] >= 0 and keys[ups[i]] is None else None for i in order],
        [keys[ups[i]] if ups[i] >= 0 else None for i in order],
        *([c[i] for i in order] for c in (n, children, leaves, saved)),
        [rows[tree.ends[i]][4] if tree.ends[i] >= 0 else None for i in order],
        [keys[i] for i in order], [tree.size[i] for i in order],
    ]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, NODE_TYPES)], schema=NODE_TYPES)


def _sharded(distinct: DataFrame, shard_turns: int) -> DataFrame:
    """Nodes of all shards. A range is cut into shards as its sequences come by."""

    def grow(batches):
        part = TaskContext.get().partitionId()
        rows, turns, done = [], 0, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and turns + len(row[1]) > shard_turns:
                    yield shard_nodes(rows, (part << 32) + done)
                    rows, turns, done = [], 0, done + 1
                rows.append(row)
                turns += len(row[1]) + 1
        if rows:
            yield shard_nodes(rows, (part << 32) + done)

    by = [F.substring("path", 1, HEAD * WIDTH), F.xxhash64("path")]
    dealt = distinct.repartitionByRange(*by).sortWithinPartitions(*by)
    return dealt.mapInArrow(grow, NODE)


def _merged_borders(nodes: DataFrame) -> DataFrame:
    """(key, conv, up_key, depth, n, children, leaves, saved, ends) of the border nodes, over all shards.

    Sums over subtrees take as many rounds as the logarithm of the depth: in
    each, a node hands what it has gathered to the ancestor twice as far up as
    in the round before.
    """
    border = nodes.where("key IS NOT NULL")
    once = border.groupBy("key").agg(
        F.min("conv").alias("conv"), F.max("up_key").alias("up_key"), F.max("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")], F.max("ends").alias("ends"),
        F.max("size").alias("size"),
    )
    below = border.where("up_key IS NOT NULL").groupBy(F.col("up_key").alias("key")).agg(F.countDistinct("key").alias("more"))
    children = F.col("children") + F.coalesce("more", F.lit(0))
    merged = written(
        once.join(below, "key", "left").select(
            "key", "conv", "up_key", "depth", "n", children.alias("children"), "ends",
            (F.col("leaves") + (children == 0).cast("long")).alias("leaves"),
            (F.col("saved") + (F.col("n") - 1) * F.col("size")).alias("saved"),
        ),
        "trie-borders",
    )
    sums = merged.select("key", F.col("up_key").alias("far"), "leaves", "saved")
    while not sums.where("far IS NOT NULL").isEmpty():
        given = sums.where("far IS NOT NULL").groupBy(F.col("far").alias("key")).agg(
            F.sum("leaves").alias("l"), F.sum("saved").alias("s")
        )
        further = sums.select(F.col("key").alias("far"), F.col("far").alias("next"))
        sums = written(
            sums.join(given, "key", "left").join(further, "far", "left").select(
                "key", F.col("next").alias("far"),
                (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"),
            ),
            "trie-sums",
        )
    return merged.drop("leaves", "saved").join(sums.drop("far"), "key")


def trie_nodes(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the prefix trie of (conv, path, sizes).

    Per node: conv_id (its smallest member), depth, parent_conv_id (null for the
    root), n_convs, n_children, n_leaves (childless nodes of its subtree),
    saved_tokens (over its subtree, (n_convs - 1) times the bytes of a node's
    last text), ends_sha256 (over the ids of the members that end here). No
    sequences give no nodes; empty sequences are members of the root only.
    """
    nodes = written(_sharded(written(distinct_sequences(sequences), "trie-sequences"), shard_turns), "trie-nodes")
    borders = _merged_borders(nodes)
    of_key = borders.select("key", "conv")
    parents = borders.join(of_key.select(F.col("key").alias("up_key"), F.col("conv").alias("up")), "up_key", "left")
    inner = nodes.where("key IS NULL")
    # Looked up per shard, so that no key has more rows than a shard.
    known = nodes.where("key IS NOT NULL").select("shard", "key").join(of_key, "key").select(
        "shard", F.col("key").alias("up_key"), F.col("conv").alias("above")
    )
    hung = inner.where("up_key IS NOT NULL").join(known, ["shard", "up_key"]).withColumn("up", F.col("above"))
    columns = ("conv", "depth", "up", "n", "children", "leaves", "saved", "ends")
    found = inner.where("up_key IS NULL").select(*columns).unionByName(hung.select(*columns)).unionByName(
        parents.select(*columns)
    )
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return found.select(
        *(F.col(c).alias(name) for c, name in zip(columns, names)),
        F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(turns: DataFrame, **columns: str) -> DataFrame:
    """``trie_nodes`` of a table of turns as it is; ``columns`` as in ``turn_sequences``."""
    return trie_nodes(turn_sequences(turns, **columns))


#: The nodes of the rebuilt conversations (see ``queries.rebuilt``); crc32 is folded bit by bit.
SQL = r"""
WITH t AS (
  SELECT conv_id AS c, turn, strlen(x) AS s, md5(strlen(r) || ':' || r || ':' || x) AS d
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)
), k AS (
  SELECT c, list(struct_pack(d := d, s := s) ORDER BY turn NULLS FIRST, d) AS seq FROM t GROUP BY c
), steps AS (
  SELECT c, seq, list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(c::VARCHAR, ''),
    lambda ch: [(256 + ascii(ch))::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0]))) AS bits FROM k
), h AS (
  SELECT c, seq, CAST(xor(list_reduce(bits, lambda crc, e: CASE WHEN e >= 256 THEN xor(crc, e - 256)
    ELSE xor(crc >> 1, 3988292384::UBIGINT * (crc & 1)) END), 4294967295::UBIGINT) % 9 AS INT) AS h FROM steps
), rebuilt AS (
  SELECT h.c, list_concat(CASE WHEN b.seq IS NULL THEN [] ELSE b.seq[1:h.h] END, h.seq[h.h + 1:]) AS seq
  FROM h LEFT JOIN k b ON b.c = h.c - h.c % 5
), pre AS (
  SELECT c, d, len(seq) AS n, CASE WHEN d = 0 THEN 0 ELSE seq[d].s END AS size,
    array_to_string(list_transform(seq[1:d], lambda e: e.d), '') AS p
  FROM (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)
), node AS (
  SELECT p, d, min(c) AS conv, count(*) AS n, max(size) AS size,
    coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '') AS ends FROM pre GROUP BY p, d
), kids AS (
  SELECT p[1:32 * (d - 1)] AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1
), own AS (
  SELECT node.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * size END AS saved FROM node LEFT JOIN kids USING (p)
), below AS (
  SELECT p[1:32 * j] AS p, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM own) GROUP BY 1
)
SELECT o.conv AS conv_id, CAST(o.d AS BIGINT) AS depth, u.conv AS parent_conv_id, o.n AS n_convs, o.n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(o.ends) AS ends_sha256
FROM own o JOIN below USING (p) LEFT JOIN node u ON o.d > 0 AND u.p = o.p[1:32 * (o.d - 1)]
"""

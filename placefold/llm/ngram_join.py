"""N-gram Jaccard join: rare-first prefixes, length, positional and suffix filters.

The sets are ordered by how many documents have a shingle, rarest first. Two
sets that are similar enough share a shingle among the first
n - ceil(0.8 n) + 1 of either, so only these prefixes are joined. A shingle
that one document alone has takes a place in the prefix and meets nobody:
most documents are settled by that.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ID, ODD, ROW, discard, id_type, keyed, mix, text_slices, with_list, written
from .components import connected
from .minhash import shingles

STORED = 6  # bytes of a shingle's hash that are sent; its shard gives the leading bits
SHARD_CHARS = 4_000_000
BINS = 16


@dataclass(frozen=True)
class JoinRule:
    """Sets of ``words``-word shingles link at a Jaccard similarity of ``percent`` / 100.

    In each of ``stars`` rounds a prefix posting list names one centre that its
    sets are compared with; what lies in different components after that is
    joined pair by pair.
    """

    words: int = 5
    percent: int = 80
    stars: int = 3
    slice_chars: int = 2_000_000
    slice_docs: int = 50_000


@dataclass(frozen=True)
class Shards:
    """How hashes are dealt to shards: by their leading ``bits``."""

    bits: int

    @property
    def low_bits(self) -> int:
        return 64 - self.bits - max(0, 8 * (8 - STORED) - self.bits)

    def keys(self, h: np.ndarray) -> np.ndarray:
        """Hashes cut to the bits that are sent: 48 beside the shard's (40 for very many shards)."""
        return h >> np.uint64(64 - self.bits - self.low_bits)

    def cut(self, keys: np.ndarray):
        """(shard, begin, end) of sorted keys."""
        shard = (keys >> np.uint64(self.low_bits)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(keys) else np.empty(0, int)
        return zip(shard[first].tolist(), first.tolist(), [*first[1:].tolist(), len(keys)])

    def pack(self, keys: np.ndarray) -> bytes:
        low = (keys & np.uint64((1 << self.low_bits) - 1)).astype("<u8")
        return low.view(np.uint8).reshape(-1, 8)[:, :STORED].tobytes()

    def unpack(self, data: bytes, shard: int) -> np.ndarray:
        low = np.zeros((len(data) // STORED, 8), np.uint8)
        low[:, :STORED] = np.frombuffer(data, np.uint8).reshape(-1, STORED)
        return low.reshape(-1).view("<u8") | (np.uint64(shard) << np.uint64(self.low_bits))


def _stream(kind: str) -> str:
    return (
        "target long, slice long, shard long, low binary, docs binary, times binary, class binary,"
        f" ids array<{kind}>, rows array<long>, nodes array<binary>, ns array<long>"
    )


EMPTY = dict.fromkeys(("low", "docs", "times", "class", "ids", "rows", "nodes", "ns"))


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def _slice_rows(part: pa.RecordBatch, texts: list[str], number: int, rule: JoinRule, shards: Shards) -> list[dict]:
    """What a slice of documents sends: to each shard its shingles, to itself what it knows already.

    A shingle goes to its shard once, with its first document and how many
    documents of the slice have it; the other documents stay with the slice.
    """
    h, starts = shingles(texts, rule.words)
    n = np.diff(starts)
    doc = np.repeat(np.arange(len(texts)), n)
    sums = np.zeros((2, len(texts)), np.uint64)
    for s, seed in enumerate((ODD, mix(np.full(1, 5, np.uint64)))):  # sums are the same in any order
        np.add.at(sums[s], doc, mix(h ^ seed))
    names = np.ascontiguousarray(sums.T).tobytes()
    rows = [
        EMPTY | {
            "target": -number - 1, "slice": number, "shard": None, "ids": part.column(0).to_pylist(),
            "rows": part.column(1).to_pylist(), "nodes": [names[i : i + 16] for i in range(0, len(names), 16)], "ns": n.tolist(),
        }
    ]
    keys = shards.keys(h)
    order = np.argsort(keys, kind="stable")
    keys, doc = keys[order], doc[order].astype("<u2")
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, bool)
    if len(keys) and not first.all():
        rows.append(
            EMPTY | {
                "target": -number - 1, "slice": number, "shard": -1,
                "low": keys[~first].astype("<u8").tobytes(), "docs": doc[~first].tobytes(),
            }
        )
    at = np.flatnonzero(first)
    times = np.diff(np.append(at, len(keys))).astype("<u2")
    keys, doc = keys[at], doc[at]
    for shard, a, b in shards.cut(keys):
        rows.append(
            EMPTY | {
                "target": shard, "slice": number, "shard": shard, "low": shards.pack(keys[a:b]),
                "docs": doc[a:b].tobytes(), "times": times[a:b].tobytes(),
            }
        )
    return rows


def _classed(shard: int, rows: list[tuple], shards: Shards) -> list[dict]:
    """The shingles of a shard that two or more documents have, back to their slices.

    The class is four times the binary logarithm of the number of documents:
    finer than that the order of shingles makes no difference to the join.
    """
    keys = np.concatenate([shards.unpack(low, shard) for _, low, _, _ in rows])
    times = np.concatenate([np.frombuffer(t, "<u2") for *_, t in rows]).astype(np.int64)
    docs = np.concatenate([np.frombuffer(d, "<u2") for _, _, d, _ in rows])
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    group = np.cumsum(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) - 1
    df = np.empty(len(keys), np.int64)
    df[order] = np.bincount(group, weights=times[order]).astype(np.int64)[group]
    kind = np.minimum(np.floor(4 * np.log2(df)), 255).astype(np.uint8)
    bounds = np.cumsum([0, *(len(low) // STORED for _, low, _, _ in rows)])
    found = []
    for (number, *_), a, b in zip(rows, bounds[:-1].tolist(), bounds[1:].tolist()):
        common = a + np.flatnonzero(df[a:b] > 1)
        if len(common):
            found.append(
                EMPTY | {
                    "target": number, "slice": number, "shard": shard, "low": shards.pack(keys[common]),
                    "docs": docs[common].tobytes(), "class": kind[common].tobytes(),
                }
            )
    return found


def _suffixes(keys: np.ndarray, prefix: int, shift: np.uint64) -> list[list[int]]:
    """For each place of the prefix, how many shingles behind it fall into each bin of hashes."""
    bins = (keys >> shift).astype(np.int64) & (BINS - 1)
    behind = np.zeros((prefix, BINS), np.int32)
    behind[prefix - 1] = np.bincount(bins[prefix:], minlength=BINS)
    for i in range(prefix - 2, -1, -1):
        behind[i] = behind[i + 1]
        behind[i, bins[i + 1]] += 1
    return behind.tolist()


def _ranked_rows(table: pa.Table, rule: JoinRule, shards: Shards, kind: pa.DataType) -> pa.Table:
    """Documents of one slice: shared shingles, rarest first, where these suffice for any link."""
    rows = table.select(["shard", "low", "docs", "class", "ids", "rows", "nodes", "ns"]).to_pylist()
    head = next(r for r in rows if r["shard"] is None)
    back = [r for r in rows if r["shard"] is not None and r["shard"] >= 0]
    ns = np.array(head["ns"], np.int64)
    shared: dict[int, np.ndarray] = {}
    if back:
        keys = np.concatenate([shards.unpack(r["low"], r["shard"]) for r in back])
        doc = np.concatenate([np.frombuffer(r["docs"], "<u2") for r in back]).astype(np.int64)
        cls = np.concatenate([np.frombuffer(r["class"], np.uint8) for r in back])
        order = np.argsort(keys, kind="stable")
        more = [r for r in rows if r["shard"] == -1]
        if more:
            own = np.concatenate([np.frombuffer(r["low"], "<u8") for r in more])
            at = order[np.searchsorted(keys[order], own)]
            doc = np.concatenate([doc, *(np.frombuffer(r["docs"], "<u2").astype(np.int64) for r in more)])
            keys, cls = np.concatenate([keys, own]), np.concatenate([cls, cls[at]])
        order = np.lexsort((keys, cls, doc))
        keys, doc = keys[order], doc[order]
        bounds = np.searchsorted(doc, np.arange(len(ns) + 1))
        enough = (np.diff(bounds) * 100 >= rule.percent * ns) & (ns > 0)
        shared = {i: keys[bounds[i] : bounds[i + 1]] for i in np.flatnonzero(enough).tolist()}
    top = np.uint64(shards.low_bits - 4)
    lists, suffixes = [], []
    for i, n in enumerate(ns.tolist()):
        own = shared.get(i)
        lists.append(None if own is None else own.astype(np.int64))
        # All of the prefix that is not taken by shingles nobody else has.
        prefix = 0 if own is None else n - -(-rule.percent * n // 100) + 1 - (n - len(own))
        suffixes.append(None if own is None else _suffixes(own, prefix, top))
    return pa.table(
        {
            ID: pa.array(head["ids"], kind), ROW: pa.array(head["rows"], pa.int64()),
            "node": pa.array(head["nodes"], pa.binary()), "n": pa.array(ns), "shared": pa.array(lists, pa.list_(pa.int64())),
            "suffixes": pa.array(suffixes, pa.list_(pa.list_(pa.int32()))),
        }
    )


def ranked_sets(docs: DataFrame, id_col: str, text_col: str, rule: JoinRule) -> DataFrame:
    """(_id, _row, node, n, shared, suffixes) per document, written to the shared folder.

    ``node`` names the set, ``n`` is its size. ``shared`` are the shingles that
    another document has, too, rarest first; null where they are too few for a
    link. The shingles cross the network once, packed: slices of documents send
    them to shards of hashes, which count documents and send back what is
    shared. A shingle that very many documents have counts once per slice. A
    task holds one shard (its size is set by the texts' total) or one slice.
    """
    texts = keyed(docs, id_col, text_col)
    chars = texts.agg(F.sum(F.length("_text"))).first()[0] or 0
    shards = Shards(min(24, max(6, int(chars // SHARD_CHARS).bit_length())))
    kind = id_type(docs, id_col)

    def send(batches):
        part, number = TaskContext.get().partitionId() << 32, 0
        for batch, own in text_slices(batches, limit=rule.slice_chars):
            for a in range(0, len(own), rule.slice_docs):
                some = batch.slice(a, rule.slice_docs)
                yield _rows(_slice_rows(some, own[a : a + rule.slice_docs], part + number, rule, shards), schema(batch))
                number += 1

    def schema(batch: pa.RecordBatch) -> pa.Schema:
        ids = batch.schema.field(ID).type if ID in batch.schema.names else batch.schema.field("ids").type.value_type
        types = [pa.int64()] * 3 + [pa.binary()] * 4 + [pa.list_(t) for t in (ids, pa.int64(), pa.binary(), pa.int64())]
        names = [n for c in _stream("x").split(",") for n in [c.split()[0]]]
        return pa.schema(zip(names, types))

    def count(batches):
        shard, held = None, []
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("shard", "slice", "low", "docs", "times")]
            numbers = columns[0].to_numpy(zero_copy_only=False)
            passed = np.flatnonzero(~(numbers >= 0))  # what slices keep; null and -1 sort first
            if len(passed):
                yield batch.take(pa.array(passed))
            for i in np.flatnonzero(numbers >= 0).tolist():
                s = int(numbers[i])
                if s != shard and held:
                    yield _rows(_classed(shard, held, shards), schema(batch))
                    held = []
                shard = s
                held.append(tuple(c[i].as_py() for c in columns[1:]))
            last = schema(batch)
        if held:
            yield _rows(_classed(shard, held, shards), last)

    def rank(table: pa.Table) -> pa.Table:
        return _ranked_rows(table, rule, shards, table.schema.field("ids").type.value_type)

    sent = texts.mapInArrow(send, _stream(kind))
    # The sent hashes are twice the input on disk: they go before the slices get theirs back.
    counted = written(sent.repartition("target").sortWithinPartitions("shard").mapInArrow(count, _stream(kind)), "counted")
    ranked = written(
        counted.groupBy("slice").applyInArrow(
            rank, f"{ID} {kind}, {ROW} long, node binary, n long, shared array<long>, suffixes array<array<int>>"
        ),
        "ranked",
    )
    discard(counted)
    return ranked


def _needed(rule: JoinRule) -> Column:
    """100 times the shingles that sets of n and n_b must share, times (100 + percent) / 100."""
    return rule.percent * (F.col("n") + F.col("n_b"))


def _passes(rule: JoinRule) -> Column:
    """Length, positional and suffix filter of a row and the columns *_b of another with the same shingle.

    ``u`` shingles of a set are its own; up to ``pos`` at most min(pos - u) are
    shared before this one, behind it no more than either has left, and no more
    than the bins of both hold.
    """
    fits = 100 * F.least("n", "n_b") >= rule.percent * F.greatest("n", "n_b")
    before = F.least(F.col("pos") - F.col("u"), F.col("pos_b") - F.col("u_b")) + 1
    left = F.least(F.col("n") - F.col("pos"), F.col("n_b") - F.col("pos_b")) - 1
    bins = F.aggregate(
        F.zip_with("behind", "behind_b", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x
    )
    most = lambda x: (100 + rule.percent) * (before + x) >= _needed(rule)
    return fits & most(left) & most(bins)


def _other(centre: str) -> list[Column]:
    return [F.col(f"{centre}.{c}").alias(f"{c}_b") for c in ("node", "comp", "n", "pos", "u", "behind")]


def _verified(pairs: DataFrame, lists: DataFrame, rule: JoinRule) -> DataFrame:
    """Pairs (a, b) with ``linked``: whether their sets are similar enough.

    Shingles that a set has alone are in no intersection: the shared ones and
    the sizes decide.
    """
    sized = lists.select("node", F.struct("n", "shared").alias("own"))
    both = with_list(with_list(pairs, "a", sized, "own", "_x"), "b", sized, "own", "_y")
    common = F.size(F.array_intersect("_x.shared", "_y.shared")).cast("long")
    linked = (100 + rule.percent) * common >= rule.percent * (F.col("_x.n") + F.col("_y.n"))
    return both.select("a", "b", linked.alias("linked"))


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _to_centres(open_rows: DataFrame, rule: JoinRule) -> DataFrame:
    """Each set with one centre that lies in another component and passes the filters."""
    met = open_rows.where(F.col("comp") != F.col("centre.comp")).select("*", *_other("centre"), F.col("centre.o").alias("o"))
    best = met.where(_passes(rule)).groupBy("node").agg(F.max(F.struct("o", "node_b")).alias("best"))
    return best.select(*_pair("node", "best.node_b")).distinct()


def _across(open_rows: DataFrame, rule: JoinRule) -> DataFrame:
    """Pairs of different components that share a prefix shingle and pass the filters.

    Of a posting list the component with most sets is only met by the others.
    """
    most = (
        open_rows.groupBy("tok", "comp").agg(F.count(F.lit(1)).alias("m"))
        .groupBy("tok").agg(F.max(F.struct("m", "comp")).alias("top")).select("tok", F.col("top.comp").alias("top"))
    )
    columns = ("node", "comp", "n", "pos", "u", "behind")
    outside = open_rows.select("tok", *columns).join(most, "tok").where("comp != top")
    others = open_rows.select("tok", *(F.col(c).alias(f"{c}_b") for c in columns))
    once = (F.col("comp") != F.col("comp_b")) & ((F.col("comp_b") == F.col("top")) | (F.col("comp") < F.col("comp_b")))
    return outside.join(others, "tok").where(once & _passes(rule)).select(*_pair("node", "node_b")).distinct()


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Component labels (node, comp) after the linked sets' components have become one."""
    of = lambda side: comp.select(F.col("node").alias(side), F.col("comp").alias(f"c_{side}"))
    ends = links.join(of("a"), "a").join(of("b"), "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
    new = connected(ends).select(F.col("node").alias("comp"), F.col("comp").alias("_new"))
    return written(comp.join(new, "comp", "left").select("node", F.coalesce("_new", "comp").alias("comp")), "join-labels")


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: JoinRule = JoinRule()
) -> DataFrame:
    """Per document: ``id_col``, its row hash, n_shingles, component_id.

    Documents with equal sets are one node. Posting lists of prefix shingles
    are not expanded into all pairs: in each round a list names a centre, and
    its sets of other components are compared with one centre each; linked
    components merge, and lists within one component are done. What is left
    is joined pair by pair across components under all filters. A pair that was
    compared is not compared again. Every link joins two sets of one list, so
    the components are those of all links.

    component_id is the smallest id reachable by links. Null, empty and
    wordless texts have no shingles and are their own component. Repeated rows
    and rows that share an id are documents like others; null ids count only
    where a component has no other. An empty table gives no rows.
    """
    ranked = ranked_sets(docs, id_col, text_col, rule)
    picked = ranked.where("shared IS NOT NULL").groupBy("node").agg(F.min(F.struct(ID, ROW)).alias("_at"))
    lists = written(
        ranked.where("shared IS NOT NULL")
        .join(picked, "node").where(F.col("_at")[ID].eqNullSafe(F.col(ID)) & (F.col("_at")[ROW] == F.col(ROW)))
        .dropDuplicates(["node"]).select("node", "n", "shared", "suffixes"),
        "join-sets",
    )
    own = F.col("n") - F.size("shared")
    postings = lists.select("node", "n", own.alias("u"), F.posexplode(F.arrays_zip(
        F.slice("shared", F.lit(1), F.size("suffixes")).alias("tok"), F.col("suffixes").alias("behind")
    )).alias("i", "t")).select("node", "n", "u", (F.col("u") + F.col("i")).alias("pos"), "t.tok", "t.behind")
    met = postings.groupBy("tok").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("tok")
    rows = written(postings.join(met, "tok"), "postings")
    comp = written(rows.select("node", F.col("node").alias("comp")).distinct(), "join-labels")
    done, told, last = None, [], [rows]
    for turn in range(rule.stars + 1):
        labelled = rows.join(comp, "node")
        # Sets with few shingles of their own are amid the others: they link the most at once.
        order = F.xxhash64("node", F.lit(turn)) if turn else F.col("n") - 2 * F.col("u")
        centre = F.max(F.struct(order.alias("o"), "node", "comp", "n", "pos", "u", "behind")).alias("centre")
        split = labelled.groupBy("tok").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), centre)
        open_rows = written(labelled.join(split.where("_lo != _hi").select("tok", "centre"), "tok"), "postings")
        discard(*last)
        pairs = _to_centres(open_rows, rule) if turn < rule.stars else _across(open_rows, rule)
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = written(pairs, "join-pairs")
        told.append(written(_verified(pairs, lists, rule), "join-links"))
        done = told[-1].select("a", "b") if done is None else done.unionByName(told[-1].select("a", "b"))
        merged = _joined(comp, told[-1].where("linked"))
        discard(comp, pairs)
        comp, last = merged, [open_rows]
        rows = open_rows.select(*rows.columns)
    discard(*last, *told, lists)
    return _per_document(ranked, comp, id_col)


def _per_document(ranked: DataFrame, comp: DataFrame, id_col: str) -> DataFrame:
    rows = ranked.select(ID, ROW, "n", "node")
    some = rows.where("n > 0")
    least = some.groupBy("node").agg(F.min(ID).alias("_least"))
    named = least.join(comp, "node", "left").select("node", "_least", F.coalesce("comp", "node").alias("comp"))
    whole = named.groupBy("comp").agg(F.min("_least").alias("component_id"))
    of_node = named.join(whole, "comp").select("node", "component_id")
    linked = some.join(of_node, "node").select(ID, ROW, "n", "component_id")
    alone = rows.where("n = 0").select(ID, ROW, "n", F.col(ID).alias("component_id"))
    return linked.unionByName(alone).select(F.col(ID).alias(id_col), ROW, F.col("n").alias("n_shingles"), "component_id")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), edge AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT a, b FROM edge UNION SELECT r.a, l.b FROM reach r JOIN edge l ON l.a = r.b
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(r.least, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) r ON r.a = w.doc_id
"""

"""Near-duplicate groups: fast similarity sketches, banding, exact verification."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    ID,
    ODD,
    ROW,
    TEXT,
    discard,
    gram_hashes,
    gram_starts,
    keyed,
    mix,
    only_rows,
    text_slices,
    with_list,
    word_hashes,
    written,
)
from .components import connected

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class NearRule:
    """Documents are linked at a Jaccard similarity of ``percent`` / 100 or more.

    ``bands`` x ``rows`` coordinates are sketched. A pair at the least
    similarity s shares a band with probability 1 - (1 - s^rows)^bands: all but
    5 in 10^8 for 0.8, 32 bands and 4 rows. ``stars`` rounds compare each
    document with one other per round; what is still open then is paired, with
    exact bounds first. A shingle of at most ``rare`` open nodes is rare.
    """

    words: int = 4
    percent: int = 80
    bands: int = 32
    rows: int = 4
    stars: int = 2
    rare: int = 16
    slice_chars: int = 2_000_000

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows


def shingles(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and where each begins."""
    flat, starts = word_hashes([t.encode("utf-8", "replace").lower().split() for t in texts])
    lens = np.diff(starts)
    parts = [(gram_starts(starts, width), width)]
    parts += [(starts[:-1][lens == w], w) for w in range(1, width)]
    at = np.concatenate([p for p, _ in parts])
    h = np.concatenate([(gram_hashes(flat, w) ^ mix(np.full(1, w, np.uint64)))[p] for p, w in parts])
    doc = np.searchsorted(starts, at, side="right") - 1
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
        h, doc = h[new], doc[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))]).astype(np.int64)


def sketch(h: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Similarity sketches: one row of ``size`` (a power of two) coordinates per set.

    Round r hashes every element anew to a place and a value and keeps the
    smallest value of a place; values of later rounds are larger, so a filled
    place never changes. After ``size`` rounds each further round serves one
    place alone, so every place of a non-empty set is filled by round 2 * size.
    Sets that are full take no part in further rounds. Two sets agree in a
    coordinate with the probability of their similarity, and the number of
    equal coordinates is as concentrated as for independent draws.
    """
    bits = size.bit_length() - 1
    docs = len(starts) - 1
    kept = np.full(docs * size, EMPTY)
    doc = np.repeat(np.arange(docs), np.diff(starts))
    open_sets = np.diff(starts) > 0
    for r in range(2 * size):
        if not len(h):
            break
        z = mix(h ^ mix(np.full(1, r + 1, np.uint64) * ODD))
        place = (z >> np.uint64(64 - bits)).astype(np.int64) if r < size else r - size
        value = (np.uint64(r) << np.uint64(48)) | (z & np.uint64((1 << 48) - 1))
        np.minimum.at(kept, doc * size + place, value)
        open_sets[open_sets] = (kept.reshape(docs, size)[open_sets] == EMPTY).any(axis=1)
        go_on = open_sets[doc]
        if not go_on.all():
            h, doc = h[go_on], doc[go_on]
    return kept.reshape(docs, size)


def _sketched(part: pa.RecordBatch, own: list[str], rule: NearRule) -> pa.RecordBatch:
    h, starts = shingles(own, rule.words)
    kept = sketch(h, starts, rule.coordinates).reshape(len(own), rule.bands, rule.rows)
    keys = np.arange(1, rule.bands + 1, dtype=np.uint64)[None, :] * np.ones((len(own), 1), np.uint64)
    for k in range(rule.rows):
        keys = keys * ODD + kept[:, :, k]
    keys = mix(keys).view(np.int64)
    n = np.diff(starts)
    doc = np.repeat(np.arange(len(own)), n)
    sums = np.zeros((2, len(own)), np.uint64)
    for s, seed in enumerate((ODD, mix(np.full(1, 3, np.uint64)))):  # sums are the same in any order
        np.add.at(sums[s], doc, mix(h ^ seed))
    node = np.ascontiguousarray(sums.T).tobytes()
    nodes = [node[i : i + 16] for i in range(0, len(node), 16)]
    some = n > 0
    begin = np.concatenate([[0], np.cumsum(some * rule.bands)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(begin), pa.array(keys[some].reshape(-1)))
    return pa.record_batch(
        [*part.select([ID, ROW]).columns, pa.array(n), pa.array(nodes, pa.binary()), lists],
        names=[ID, ROW, "n_shingles", "node", "bands"],
    )


def sketches(texts: DataFrame, rule: NearRule) -> DataFrame:
    """(_id, _row, n_shingles, node, bands): node is a 128-bit hash of the shingle set."""

    def make(batches):
        for part, own in text_slices(batches, limit=rule.slice_chars):
            yield _sketched(part, own, rule)

    kind = texts.schema[ID].dataType.simpleString()
    made = texts.mapInArrow(make, f"{ID} {kind}, {ROW} long, n_shingles long, node binary, bands array<long>")
    return written(made, "sketches")


def _sets(texts: DataFrame, rows: DataFrame, rule: NearRule) -> DataFrame:
    """(node, shingles) of the texts named by ``rows`` (_i, _r, node), one per node."""

    def make(batches):
        for part, own in text_slices(batches, limit=rule.slice_chars):
            h, starts = shingles(own, rule.words)
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.record_batch([part.column(part.schema.get_field_index("node")), lists], names=["node", "shingles"])

    pulled = texts.join(
        rows.hint("shuffle_hash"), texts[ID].eqNullSafe(F.col("_i")) & (texts[ROW] == F.col("_r"))
    ).dropDuplicates(["node"])
    made = pulled.select("node", TEXT).mapInArrow(make, "node binary, shingles array<long>")
    return written(made, "sets")


def _verified(pairs: DataFrame, sets: DataFrame, rule: NearRule) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = with_list(with_list(pairs, "a", sets, "shingles", "_x"), "b", sets, "shingles", "_y")
    common = F.size(F.array_intersect("_x", "_y")).cast("long")
    return both.select("a", "b", common.alias("_c"), (F.size("_x") + F.size("_y")).cast("long").alias("_t")).where(
        100 * F.col("_c") >= rule.percent * (F.col("_t") - F.col("_c"))
    ).select("a", "b")


def _fits(rule: NearRule):
    return 100 * F.least("n_a", "n_b").cast("long") >= rule.percent * F.greatest("n_a", "n_b").cast("long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: NearRule = NearRule()
) -> DataFrame:
    """Per document: ``id_col``, its row hash, n_shingles, component_id, kept.

    Documents with equal shingle sets are one node. Nodes that share a band are
    candidates; a bucket's nodes are not paired with each other. In each round
    a bucket names one node as its centre (at first the one whose buckets hold
    most nodes, then any), and each node of another component is compared with
    one centre on full sets; components then merge. Buckets
    that lie in one component are done, which settles even very large groups
    in a few rounds. Nodes of buckets that are still open after the last round
    are paired across components, but for those that bounds on their shingles
    rule out, so no link between candidates is lost.

    component_id is the smallest id reachable by links, kept says that it is
    the document's own. Null, empty and wordless texts have no shingles, are
    their own component and kept. Repeated rows and rows that share an id are
    documents like others; null ids count only where a component has no other.
    """
    texts = keyed(docs, id_col, text_col)
    drawn = sketches(texts, rule)
    some = drawn.where("n_shingles > 0")
    nodes = some.groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    in_band = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = in_band.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = written(in_band.join(shared, "key"), "members")
    met = members.groupBy("node").agg(F.sum("m").alias("met"))
    comp = written(met.select("node", F.col("node").alias("comp"), "met"), "components")
    rows = some.join(comp, "node").groupBy("node").agg(
        F.min(F.struct(F.col(ID).alias("_i"), F.col(ROW).alias("_r"))).alias("at")
    )
    sets = _sets(texts, rows.select("node", "at.*"), rule)
    last = [members]
    for turn in range(rule.stars + 1):
        labelled = members.join(comp, "node")
        # The nodes that meet most others lie amid them: they link the most at once.
        order = F.xxhash64("node", F.lit(turn)) if turn else F.col("met")
        split = labelled.groupBy("key").agg(
            F.min("comp").alias("_lo"), F.max("comp").alias("_hi"),
            F.max(F.struct(order.alias("o"), "node", "n", "comp")).alias("centre"),
        ).where("_lo != _hi").select("key", "centre")
        left = written(labelled.join(split, "key"), "open")
        discard(*last)
        pairs = written(_to_centres(left, rule) if turn < rule.stars else _across(left, sets, rule), "pairs")
        links = written(_verified(pairs, sets, rule), "links")
        merged = _merged(comp, links)
        discard(comp, pairs, links)
        comp, last = merged, [left]
        # Closed buckets are done for good: components only grow.
        members = left.select("node", "n", "key")
    result = _per_document(drawn, comp, id_col)
    discard(*last, comp, sets)
    return result


def _to_centres(left: DataFrame, rule: NearRule) -> DataFrame:
    """Each node with one centre of its buckets that lies in another component."""
    pairs = left.where(F.col("comp") != F.col("centre.comp")).select(
        F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("centre.node").alias("b"),
        F.col("centre.n").alias("n_b"), F.col("centre.o").alias("o"),
    )
    return pairs.where(_fits(rule)).groupBy("a").agg(F.max(F.struct("o", "b")).alias("best")).select("a", "best.b")


def _across(left: DataFrame, sets: DataFrame, rule: NearRule) -> DataFrame:
    """Pairs of different components that can be similar enough, each once.

    A shingle that only one component has is in no wanted intersection. The
    others are rare or common by the number of open nodes that have them. The
    rare ones that two nodes share are counted by a join on the shingle, which
    yields at most ``rule.rare`` rows per shingle and node. Two nodes that share
    none can only be similar by their common shingles; of these pairs, those of
    one bucket are made where both nodes have enough. Each bound is exact, so no
    pair of a bucket is lost: in near-copy groups most sets outside the
    component fail by their own edits.
    """
    nodes = left.select("node", "comp", "n").distinct()
    own = sets.join(nodes, "node").select("node", "comp", "n", F.explode("shingles").alias("t"))
    shared = (
        own.groupBy("t").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("f"))
        .where("lo != hi").select("t", (F.col("f") > rule.rare).alias("common"))
    )
    met = written(own.join(shared, "t"), "met")
    counts = written(
        met.groupBy("node", "comp", "n").agg(F.count(F.lit(1)).alias("s"), F.count_if("common").alias("k"))
        .where(100 * F.col("s") >= rule.percent * F.col("n")),
        "across",
    )
    return _by_rare(met.where("NOT common").select("node", "t"), counts, rule).unionByName(
        _by_common(left, counts.where(100 * F.col("k") >= rule.percent * F.col("n")), rule)
    ).distinct()


def _sides(of: DataFrame, *columns: str) -> list[DataFrame]:
    """``of`` twice, with columns named for either side of a pair."""
    return [of.select(*[c for c in of.columns if c not in columns], *[F.col(c).alias(f"{c}_{x}") for c in columns]) for x in "ab"]


def _can_share(most, rule: NearRule):
    """Whether ``most`` shared shingles suffice for sets of n_a and n_b."""
    return (100 + rule.percent) * most >= rule.percent * (F.col("n_a") + F.col("n_b"))


def _by_rare(rare: DataFrame, counts: DataFrame, rule: NearRule) -> DataFrame:
    """Pairs that share rare shingles: these and the fewer common ones bound what they share."""
    first, second = _sides(rare.join(counts, "node"), "node", "comp", "n", "s", "k")
    met = first.join(second, "t").where(
        (F.col("comp_a") < F.col("comp_b")) & _fits(rule) & _can_share(F.least("s_a", "s_b"), rule)
    )
    pairs = met.groupBy("node_a", "node_b").agg(
        F.count(F.lit(1)).alias("r"), *[F.first(c).alias(c) for c in ("n_a", "n_b", "k_a", "k_b")]
    )
    return pairs.where(_can_share(F.col("r") + F.least("k_a", "k_b"), rule)).select(
        F.col("node_a").alias("a"), F.col("node_b").alias("b")
    )


def _by_common(left: DataFrame, counts: DataFrame, rule: NearRule) -> DataFrame:
    """Pairs of a bucket that have enough common shingles.

    Of each bucket the component with most nodes is only met, never paired with
    itself, and of all buckets that two nodes share only the one with the least
    key gives a row.
    """
    open_nodes = left.groupBy("node").agg(F.collect_list("key").alias("keys")).join(counts, "node")
    in_key = written(open_nodes.select("*", F.explode("keys").alias("key")), "common")
    most = (
        in_key.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
        .groupBy("key").agg(F.max(F.struct("m", "comp")).alias("top"), F.count(F.lit(1)).alias("c"))
        .where("c > 1").select("key", F.col("top.comp").alias("top"))
    )
    first, second = _sides(in_key, "node", "comp", "n", "s", "k", "keys")
    outside = first.join(most, "key").where("comp_a != top")
    once = (F.col("comp_a") != F.col("comp_b")) & (
        (F.col("comp_b") == F.col("top")) | (F.col("comp_a") < F.col("comp_b"))
    )
    least = F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key")
    found = outside.join(second, "key").where(once & _fits(rule) & _can_share(F.least("k_a", "k_b"), rule) & least)
    return found.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after joining the components of linked nodes."""
    of_a = links.join(comp.select(F.col("node").alias("a"), F.col("comp").alias("c_a")), "a")
    of_b = of_a.join(comp.select(F.col("node").alias("b"), F.col("comp").alias("c_b")), "b")
    joined = connected(of_b.select(F.col("c_a").alias("a"), F.col("c_b").alias("b")))
    new = joined.select(F.col("node").alias("comp"), F.col("comp").alias("_new"))
    named = F.coalesce("_new", "comp").alias("comp")
    return written(comp.join(new, "comp", "left").select("node", named, "met"), "components")


def _per_document(drawn: DataFrame, comp: DataFrame, id_col: str) -> DataFrame:
    rows = drawn.select(ID, ROW, "n_shingles", "node")
    some = rows.where("n_shingles > 0")
    least = some.groupBy("node").agg(F.min(ID).alias("_least"))
    known = least.join(comp, "node", "left").select("node", "_least", F.coalesce("comp", "node").alias("comp"))
    whole = known.groupBy("comp").agg(F.min("_least").alias("component_id"))
    of_node = written(known.join(whole, "comp").select("node", "component_id"), "labels")
    linked = some.join(of_node, "node").drop("node")
    alone = rows.where("n_shingles = 0").drop("node").withColumn("component_id", F.col(ID))
    return linked.unionByName(alone).select(
        F.col(ID).alias(id_col), ROW, "n_shingles", "component_id", F.col(ID).eqNullSafe(F.col("component_id")).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with one document of each group, all columns as they were.

    Of a group the document with the smallest id stays; rows that share this
    id are one document, of which any row stays.
    """
    kept = near_duplicates(docs, id_col, text_col, **kw).where("kept")
    some = kept.where("n_shingles > 0").groupBy(F.col(id_col).alias(ID)).agg(F.min(ROW).alias(ROW))
    # Empty texts are no copies of each other; all of them stay.
    none = kept.where("n_shingles = 0").select(F.col(id_col).alias(ID), ROW)
    return only_rows(docs, some.unionByName(none), "left_semi", id_col, text_col)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)
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
), found AS (
  SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(r.least, w.doc_id)) AS component_id
  FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) r ON r.a = w.doc_id
)
SELECT *, doc_id = component_id AS kept FROM found
"""

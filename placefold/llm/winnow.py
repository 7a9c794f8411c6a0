"""Benchmark decontamination by winnowing: fingerprints, a join, extended hits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (
    ID, ROW, TEXT, gram_hashes, gram_starts, keyed, mix, only_rows, ranges, text_slices, word_hashes, written,
)

SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TO_SPACE = bytes.maketrans(SEPARATORS, b" " * len(SEPARATORS))
HITS = "array<struct<start:int,width:int,hash:long>>"
MARKS = "array<struct<start:int,width:int,fp:long>>"


@dataclass(frozen=True)
class WinnowRule:
    """Shared spans of ``span`` words or more are all found.

    Of every ``span - gram + 1`` consecutive grams the smallest hash is kept,
    so two texts that share ``span`` words share a kept gram. Items shorter
    than a span are one gram, sought at every position. The benchmark's
    fingerprints and windows are sent to the tasks while they number
    ``sent_rows`` at most (16 bytes each); beyond that both sides are joined
    by a shuffle, with the same result.
    """

    span: int = 13
    gram: int = 6
    sent_rows: int = 2_000_000


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().translate(_TO_SPACE).split()


def _hashes(flat: np.ndarray, width: int) -> np.ndarray:
    return gram_hashes(flat, width) ^ mix(np.full(1, width, np.uint64))


def winnowed(flat: np.ndarray, starts: np.ndarray, rule: WinnowRule) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the kept grams: the rightmost smallest of each window."""
    spans = gram_starts(starts, rule.span)
    if not len(spans):
        return spans, np.empty(0, np.uint64)
    grams = _hashes(flat, rule.gram)
    width = rule.span - rule.gram + 1
    n = len(grams) - width + 1
    best, at = grams[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, width):
        less = grams[j : j + n] <= best
        at[less] = j
        np.minimum(best, grams[j : j + n], out=best)
    kept = np.unique(spans + at[spans])
    return kept, grams[kept]


def _texts(words: list[list[bytes]], rule: WinnowRule, short: tuple[int, ...]):
    """Fingerprints of a slice: (position, width, hash), grams of full spans first."""
    flat, starts = word_hashes(words)
    pos, fp = winnowed(flat, starts, rule)
    found = [(pos, np.full(len(pos), rule.span), fp)]
    for width in short:
        at = gram_starts(starts, width)
        found.append((at, np.full(len(at), width), _hashes(flat, width)[at]))
    return flat, starts, *map(np.concatenate, zip(*found))


def _among(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return sorted_values[at] == values


def _windows_near(flat, starts, pos, width, rule: WinnowRule):
    """Windows that hold a hit gram: (start, width, hash), each once."""
    long = width == rule.span
    doc = np.searchsorted(starts, pos, side="right") - 1
    reach = rule.span - rule.gram
    first = np.maximum(pos - reach, starts[doc])
    last = np.minimum(pos, starts[doc + 1] - rule.span)
    begin = np.unique(ranges(first[long], np.maximum(last[long] + 1, first[long])))
    found = [(begin, np.full(len(begin), rule.span))]
    for w in np.unique(width[~long]):
        found.append((p := pos[width == w], np.full(len(p), w)))
    at, size = map(np.concatenate, zip(*found))
    hashed = np.empty(len(at), np.uint64)
    for w in np.unique(size):
        own = size == w
        h = np.zeros(int(own.sum()), np.uint64)
        for k in range(int(w)):
            h = h * np.uint64(0x9E3779B97F4A7C15) + flat[at[own] + k]
        hashed[own] = mix(h) ^ mix(np.full(1, w, np.uint64))
    return at, size, hashed


def _lists(docs: int, starts: np.ndarray, at: np.ndarray, names: tuple[str, ...], columns) -> pa.ListArray:
    """One list of structs per document; positions are made relative to it."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    doc = np.searchsorted(starts, at, side="right") - 1
    begin = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=docs))]).astype(np.int32)
    arrays = [pa.array((at - starts[doc]).astype(np.int32))]
    arrays += [pa.array(c[order].astype(np.int32) if n == "width" else c[order].view(np.int64)) for n, c in zip(names[1:], columns)]
    return pa.ListArray.from_arrays(pa.array(begin), pa.StructArray.from_arrays(arrays, names=list(names)))


def item_windows(items: DataFrame, rule: WinnowRule, id_col: str, text_col: str) -> DataFrame:
    """(item, width, hash, is_window): the windows of each item, and its fingerprints."""

    def cut(batches):
        for part, texts in text_slices(batches):
            words = [words_of(t) for t in texts]
            names = part.column(part.schema.get_field_index(ID)).to_pylist()
            flat, starts = word_hashes(words)
            pos, fp = winnowed(flat, starts, rule)
            rows = [(pos, rule.span, fp, False)]
            lens = np.diff(starts)
            at = gram_starts(starts, rule.span)
            rows.append((at, rule.span, _hashes(flat, rule.span)[at], True))
            for w in np.unique(lens[(lens > 0) & (lens < rule.span)]):
                at = starts[:-1][lens == w]
                h = _hashes(flat, int(w))[at]
                rows += [(at, int(w), h, False), (at, int(w), h, True)]
            for at, w, h, window in rows:
                doc = np.searchsorted(starts, at, side="right") - 1
                yield pa.record_batch(
                    [pa.array([names[i] for i in doc], pa.string()), pa.array(np.full(len(at), w), pa.int32()),
                     pa.array(h.view(np.int64)), pa.array(np.full(len(at), window))],
                    names=["item", "width", "hash", "is_window"],
                )

    named = items.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias(ID), F.col(text_col).cast("string").alias(TEXT)
    )
    cut_rows = named.mapInArrow(cut, "item string, width int, hash long, is_window boolean")
    return written(cut_rows.distinct(), "items")


def _sorted_hashes(rows: DataFrame) -> np.ndarray:
    return np.sort(rows.select("hash").distinct().toPandas()["hash"].to_numpy(np.int64).view(np.uint64))


def _hits_sent(texts: DataFrame, rows: DataFrame, rule: WinnowRule, short: tuple[int, ...]) -> DataFrame:
    """Hit windows of each document in one pass; the benchmark's hashes go to the tasks."""
    context = texts.sparkSession.sparkContext
    marks = context.broadcast(_sorted_hashes(rows.where("NOT is_window")))
    wanted = context.broadcast(_sorted_hashes(rows.where("is_window")))

    def find(batches):
        for part, own in text_slices(batches):
            words = [words_of(t) for t in own]
            flat, starts, pos, width, fp = _texts(words, rule, short)
            near = _among(marks.value, fp)
            at, size, hashed = _windows_near(flat, starts, pos[near], width[near], rule)
            true = _among(wanted.value, hashed)
            hits = _lists(len(own), starts, at[true], ("start", "width", "hash"), (size[true], hashed[true]))
            yield pa.record_batch(
                [*part.select([ID, ROW]).columns, pa.array(np.diff(starts)), hits], names=[ID, ROW, "n_words", "hits"]
            )

    kind = texts.schema[ID].dataType.simpleString()
    return written(texts.mapInArrow(find, f"{ID} {kind}, {ROW} long, n_words long, hits {HITS}"), "hits")


def _hits_joined(texts: DataFrame, rows: DataFrame, rule: WinnowRule, short: tuple[int, ...]) -> DataFrame:
    """The same with both sides shuffled by fingerprint, for a benchmark of any size."""
    kind = texts.schema[ID].dataType.simpleString()

    def mark(batches):
        for part, own in text_slices(batches):
            _, starts, pos, width, fp = _texts([words_of(t) for t in own], rule, short)
            marks = _lists(len(own), starts, pos, ("start", "width", "fp"), (width, fp))
            yield pa.record_batch(
                [*part.select([ID, ROW]).columns, pa.array(np.diff(starts)), marks], names=[ID, ROW, "n_words", "marks"]
            )

    def extend(batches):
        for part, own in text_slices(batches):
            flat, starts = word_hashes([words_of(t) for t in own])
            near = part.column(part.schema.get_field_index("near")).to_pylist()
            pos = np.array([m["start"] + s for s, ms in zip(starts, near) for m in ms], np.int64)
            width = np.array([m["width"] for ms in near for m in ms], np.int64)
            at, size, hashed = _windows_near(flat, starts, pos, width, rule)
            hits = _lists(len(own), starts, at, ("start", "width", "hash"), (size, hashed))
            yield pa.record_batch([*part.select([ID, ROW]).columns, hits], names=[ID, ROW, "hits"])

    marked = written(texts.mapInArrow(mark, f"{ID} {kind}, {ROW} long, n_words long, marks {MARKS}"), "marks")
    prints = rows.where("NOT is_window").select(F.col("hash").alias("fp")).distinct()
    each = marked.select(ID, ROW, F.explode("marks").alias("m")).select(ID, ROW, "m.*").distinct()
    near = (
        each.join(prints, "fp").groupBy(ID, ROW).agg(F.collect_set(F.struct("start", "width")).alias("near"))
    )
    known = near.select(F.col(ID).alias("_i"), F.col(ROW).alias("_r"), "near")
    pulled = texts.dropDuplicates([ID, ROW]).join(known, texts[ID].eqNullSafe(F.col("_i")) & (texts[ROW] == F.col("_r")))
    windows = pulled.select(ID, ROW, TEXT, "near").mapInArrow(extend, f"{ID} {kind}, {ROW} long, hits {HITS}")
    wanted = rows.where("is_window").select("hash").distinct()
    true = (
        windows.select(ID, ROW, F.explode("hits").alias("h")).select(ID, ROW, "h.*").join(wanted, "hash")
        .groupBy(ID, ROW).agg(F.collect_list(F.struct("start", "width", "hash")).alias("hits"))
        .select(F.col(ID).alias("_i"), F.col(ROW).alias("_r"), "hits")
    )
    counted = marked.select(ID, ROW, "n_words")
    return written(
        counted.join(true, counted[ID].eqNullSafe(F.col("_i")) & (counted[ROW] == F.col("_r")), "left")
        .select(ID, ROW, "n_words", F.coalesce("hits", F.array().cast(HITS)).alias("hits")),
        "hits",
    )


def union_length(hits: Column) -> Column:
    """Positions inside any of the spans (start, width)."""
    by_start = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("s"), (h["start"] + h["width"]).alias("e"))))
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        by_start,
        begin,
        lambda acc, h: F.struct(
            F.greatest(acc["end"], h["e"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), h["e"] - F.greatest(acc["end"], h["s"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    rule: WinnowRule = WinnowRule(),
) -> DataFrame:
    """Per document: ``id_col``, its row hash, n_words, n_hit, items (sorted array).

    Words are runs of ASCII letters and digits and of all other non-ASCII
    characters, A-Z lower-cased. A word is hit if it lies in an occurrence of
    ``rule.span`` consecutive words of an item, or of a whole shorter item;
    ``items`` are the distinct ids (as strings, null as '') of items with an
    occurring window. Null and empty texts have no words and no hits, items
    without words occur nowhere; an empty benchmark hits nothing. Repeated
    documents each get their row, repeated items count once per id. Texts are
    compared by 64-bit hashes of whole windows near a shared fingerprint.
    """
    texts = keyed(docs, id_col, text_col)
    rows = item_windows(items, rule, item_id, item_text)
    short = tuple(r["width"] for r in rows.where(F.col("width") < rule.span).select("width").distinct().collect())
    few = rows.select("hash", "is_window").distinct().count() <= rule.sent_rows
    found = (_hits_sent if few else _hits_joined)(texts, rows, rule, tuple(sorted(short)))

    windows = rows.where("is_window").select("hash", "item")
    each = found.where(F.size("hits") > 0).select(ID, ROW, F.explode(F.array_distinct("hits.hash")).alias("hash"))
    items_of = (
        each.join(windows, "hash").select(ID, ROW, "item").distinct()
        .groupBy(ID, ROW).agg(F.array_sort(F.collect_list("item")).alias("items"))
        .select(F.col(ID).alias("_i"), F.col(ROW).alias("_r"), "items")
    )
    joined = found.join(items_of, found[ID].eqNullSafe(F.col("_i")) & (found[ROW] == F.col("_r")), "left")
    return joined.select(
        F.col(ID).alias(id_col),
        ROW,
        "n_words",
        union_length(F.col("hits")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def contaminated() -> Column:
    """A twentieth of the words or more is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without the contaminated rows, all columns as they were."""
    bad = find_contamination(docs, items, id_col, text_col, **kw).where(contaminated())
    return only_rows(docs, bad.select(F.col(id_col).alias(ID), ROW), "left_anti", id_col, text_col)


SQL = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id::VARCHAR AS id, doc_id, text FROM documents UNION ALL SELECT 'b', item_id::VARCHAR, NULL, text FROM benchmark
), w AS (
  SELECT side, id, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM words
), item AS (
  SELECT DISTINCT id, k, array_to_string(ws[i:i + k - 1], ' ') AS g
  FROM (SELECT id, ws, least(len(ws), 13) AS k, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i FROM w WHERE side = 'b' AND len(ws) > 0)
), width AS (
  SELECT DISTINCT k FROM item
), met AS (
  SELECT doc_id, i, m.k, item.id FROM (
    SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS g
    FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, width WHERE side = 'd' AND len(ws) >= k)) m
  JOIN item ON item.k = m.k AND item.g = m.g
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM met) GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS listed FROM (SELECT DISTINCT doc_id, id FROM met) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hit ON hit.doc_id = w.doc_id LEFT JOIN ids ON ids.doc_id = w.doc_id WHERE side = 'd'
"""

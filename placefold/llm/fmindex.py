"""Substring dedup: compressed FM-indexes over content-routed shards.

A window is ``span`` consecutive words. Windows with the same words have the
same least gram hash, and all windows of a document that share it follow each
other in runs. The hash says which shard a run goes to, so equal windows always
meet in one shard, and a run is routed at all only if its hash occurs again.
Each shard builds one FM-index over the words of its runs and streams the runs
through it from right to left: the number of occurrences of each window is the
width of its suffix interval.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (
    ID, ODD, ROW, TEXT, covered, gram_hashes, gram_starts, keyed, mix, ranges, text_slices, word_hashes, written,
)

WORD_BYTES = 6  # of a 64-bit word hash, enough for words at equal places of like contexts


@dataclass(frozen=True)
class ShardRule:
    """``shard_words`` is the mean number of words in a shard. A gram hash whose
    runs alone have more than ``hot_words`` words, and more than two mean
    shards, is not routed to one shard; its windows are counted by hash."""

    span: int = 35
    gram: int = 6
    run: int = 64
    shard_words: int = 1_000_000
    hot_words: int = 64_000


# --- the index -------------------------------------------------------------


class WaveletMatrix:
    """Rank of symbols in a sequence: one bit vector per bit of the symbols.

    Bits are packed 64 to a word, with the count of ones before each word.
    """

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels = []
        n = len(symbols)
        words = (n >> 6) + 1
        for level in range(self.depth - 1, -1, -1):
            ones = (symbols >> level) & 1 == 1
            padded = np.zeros(words * 64, np.uint8)
            padded[:n] = ones
            bits = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits))[:-1]]).astype(np.int64)
            self.levels.append((level, bits, before, n - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        self.start = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits, before, zeros in self.levels:
            block = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[block] + np.bitwise_count(bits[block] & mask)
            at = np.where((symbols >> level) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._walk(symbols, at) - self.start[symbols]


def suffix_array(text: np.ndarray, keep: tuple[int, ...]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Suffix array by prefix doubling, and the ranks by prefixes of the lengths in ``keep``.

    The text must end each of its parts with a symbol of its own.
    """
    n = len(text)
    rank = text.astype(np.int64)
    kept = {}
    width = 1
    while True:
        if width in keep:
            kept[width] = rank
        second = np.full(n, -1, np.int64)
        second[: n - width] = rank[width:]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[False], sorted_key[1:] != sorted_key[:-1]]))
        rank, width = new, 2 * width
        if int(rank.max()) == n - 1 and width > max(keep):
            return order, kept


class FMIndex:
    """BWT in a wavelet matrix, symbol counts, and the intervals of ``span - 1`` words."""

    def __init__(self, words: np.ndarray, lens: np.ndarray, span: int) -> None:
        parts = len(lens)
        known, codes = np.unique(words, return_inverse=True)
        ends = np.cumsum(lens)
        sigma = len(known) + parts  # every part ends with a symbol of its own
        self.text = np.empty(len(words) + parts, np.int64)
        last = ends + np.arange(parts)
        inner = np.ones(len(self.text), bool)
        inner[last] = False
        self.text[inner] = codes
        self.text[last] = len(known) + np.arange(parts)
        self.begin = np.concatenate([[0], last[:-1] + 1])
        self.end = last
        self.span = span
        short = span - 1
        power = 1 << (short.bit_length() - 1)
        rest = short - power
        steps = {power} | {1 << b for b in range(rest.bit_length()) if rest >> b & 1}
        order, ranks = suffix_array(self.text, tuple(steps))
        n = len(order)
        same = np.ones(n - 1, bool) if n else np.ones(0, bool)
        offset = 0
        for step in sorted(steps, reverse=True):
            at = order + offset
            r = np.where(at < n, ranks[step][np.minimum(at, n - 1)], -1 - order)
            same &= r[1:] == r[:-1]
            offset += step
        cut = np.flatnonzero(~same) + 1
        group = np.zeros(n, np.int64)
        group[cut] = 1
        group = np.cumsum(group)
        first = np.concatenate([[0], cut])
        self.low_of, self.high_of = first[group], np.concatenate([cut, [n]])[group]
        self.matrix = WaveletMatrix(self.text[order - 1], sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=sigma))[:-1]])

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one symbol put before them."""
        both = self.matrix.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        n = len(symbols)
        return self.before[symbols] + both[:n], self.before[symbols] + both[n:]

    def occurrences(self) -> np.ndarray:
        """For each text position the occurrences of the window that begins there (0 if none does).

        Parts are streamed side by side. The first window of a part is found
        word by word; each further one widens the interval to the first
        ``span - 1`` words, then puts the next word before it. Statistics
        stop at the span, which is all that the threshold needs.
        """
        count = np.zeros(len(self.text), np.int64)
        part = np.flatnonzero(self.end - self.begin >= self.span)
        at = self.end[part].copy()
        low, high = np.zeros(len(part), np.int64), np.full(len(part), len(self.text))
        for step in range(int((self.end - self.begin).max(initial=0))):
            if step:
                go_on = at > self.begin[part]
                part, at, low, high = part[go_on], at[go_on], low[go_on], high[go_on]
            if not len(part):
                break
            if step >= self.span:
                low, high = self.low_of[low], self.high_of[low]
            at = at - 1
            low, high = self.extend(self.text[at], low, high)
            if step >= self.span - 1:
                count[at] = high - low
        return count


# --- routing ---------------------------------------------------------------


def window_runs(flat: np.ndarray, starts: np.ndarray, rule: ShardRule):
    """Runs of windows with one least gram hash: (start, windows, hash, again).

    ``again`` says that the run has this gram at two places, so that it might
    repeat itself. Runs are cut at ``rule.run`` windows.
    """
    at = gram_starts(starts, rule.span)
    if not len(at):
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64), np.empty(0, bool)
    grams = gram_hashes(flat, rule.gram)
    width = rule.span - rule.gram + 1
    n = len(grams) - width + 1
    least, left, right = grams[:n].copy(), np.zeros(n, np.int16), np.zeros(n, np.int16)
    for j in range(1, width):
        other = grams[j : j + n]
        less = other < least
        left[less] = j
        right[other <= least] = j
        np.minimum(least, other, out=least)
    m, first, last = least[at], at + left[at], at + right[at]
    new = np.concatenate([[True], (m[1:] != m[:-1]) | (at[1:] != at[:-1] + 1)])
    run = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    since = np.arange(len(at)) - head[run]
    cut = since % rule.run == 0
    head = np.flatnonzero(cut)
    many = np.diff(np.concatenate([head, [len(at)]]))
    again = np.minimum.reduceat(first, head) != np.maximum.reduceat(last, head)
    again |= many == rule.run  # a run that long has its gram again and again
    return at[head], many, m[head], again


RUNS = "array<struct<start:int,windows:int,hash:long,again:boolean>>"


def _drawn(texts: DataFrame, rule: ShardRule) -> DataFrame:
    """(_id, _row, n, wa, wb, runs): word count, 128-bit hash of all words, window runs."""

    def make(batches):
        for part, own in text_slices(batches, limit=2_000_000):
            yield _drawn_slice(part, own, rule)

    kind = texts.schema[ID].dataType.simpleString()
    return written(texts.mapInArrow(make, f"{ID} {kind}, {ROW} long, n long, wa long, wb long, runs {RUNS}"), "runs")


def _drawn_slice(part: pa.RecordBatch, own: list[str], rule: ShardRule) -> pa.RecordBatch:
    flat, starts = word_hashes([t.encode("utf-8", "replace").split() for t in own])
    lens = np.diff(starts)
    place = (np.arange(len(flat)) - np.repeat(starts[:-1], lens)).astype(np.uint64)
    doc = np.repeat(np.arange(len(own)), lens)
    whole = np.zeros((2, len(own)), np.uint64)
    for s, seed in enumerate((ODD, mix(np.full(1, 5, np.uint64)))):
        np.add.at(whole[s], doc, mix(flat + mix(place + seed)))
    start, many, hashed, again = window_runs(flat, starts, rule)
    of = np.searchsorted(starts, start, side="right") - 1
    begin = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(own)))]).astype(np.int32)
    arrays = [
        pa.array((start - starts[of]).astype(np.int32)), pa.array(many.astype(np.int32)),
        pa.array(hashed.view(np.int64)), pa.array(again),
    ]
    runs = pa.ListArray.from_arrays(
        pa.array(begin), pa.StructArray.from_arrays(arrays, names=["start", "windows", "hash", "again"])
    )
    return pa.record_batch(
        [*part.select([ID, ROW]).columns, pa.array(lens), pa.array(whole[0].view(np.int64)), pa.array(whole[1].view(np.int64)), runs],
        names=[ID, ROW, "n", "wa", "wb", "runs"],
    )


def _wanted(batch: pa.RecordBatch, own: list[str]):
    """Word hashes of a slice and its runs: (flat, doc of run, start in flat, windows, hash)."""
    flat, starts = word_hashes([t.encode("utf-8", "replace").split() for t in own])
    runs = batch.column(batch.schema.get_field_index("runs"))
    fields = runs.flatten()
    doc = np.repeat(np.arange(len(own)), runs.value_lengths().to_numpy(zero_copy_only=False))
    start, many, hashed = (fields.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "windows", "hash"))
    return flat, doc, starts[doc] + start, start, many, hashed


def _cut_runs(pulled: DataFrame, rule: ShardRule, shards: int) -> DataFrame:
    """One row per run with its shard and words."""
    kind = pulled.schema[ID].dataType.simpleString()

    def cut(batches):
        for part, own in text_slices(batches, limit=1_000_000):
            flat, doc, at, start, many, hashed = _wanted(part, own)
            data = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]).tobytes()
            ends = at + many + rule.span - 1
            words = [data[a * WORD_BYTES : b * WORD_BYTES] for a, b in zip(at.tolist(), ends.tolist())]
            rows = part.select([ID, ROW]).take(pa.array(doc))
            shard = (mix(hashed.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
            yield pa.record_batch(
                [*rows.columns, pa.array(shard), pa.array(start.astype(np.int32)), pa.array(words, pa.binary())],
                names=[ID, ROW, "shard", "start", "words"],
            )

    return pulled.mapInArrow(cut, f"{ID} {kind}, {ROW} long, shard long, start int, words binary")


def _searched(runs: DataFrame, rule: ShardRule) -> DataFrame:
    """(_id, _row, starts): windows that occur more than once in their shard."""
    kind = runs.schema[ID].dataType.simpleString()

    def search(table: pa.Table) -> pa.Table:
        # Rows that are in the table twice are one document.
        names = zip(*(table.column(c).to_pylist() for c in (ID, ROW, "start")))
        table = table.take(pa.array(list({k: i for i, k in enumerate(names)}.values()))).combine_chunks()
        data = table.column("words").to_pylist()
        lens = np.fromiter(map(len, data), np.int64, len(data)) // WORD_BYTES
        words = np.zeros((int(lens.sum()), 8), np.uint8)
        words[:, :WORD_BYTES] = np.frombuffer(b"".join(data), np.uint8).reshape(-1, WORD_BYTES)
        index = FMIndex(words.view(np.uint64).reshape(-1), lens, rule.span)
        hit = np.flatnonzero(index.occurrences() > 1)
        part = np.searchsorted(index.begin, hit, side="right") - 1
        first = table.column("start").to_numpy().astype(np.int64)
        at = (first[part] + hit - index.begin[part]).astype(np.int32)
        some, many = np.unique(part, return_counts=True)
        begin = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
        rows = table.select([ID, ROW]).take(pa.array(some))
        starts = pa.ListArray.from_arrays(pa.array(begin), pa.array(at))
        return pa.table([*rows.columns, starts], names=[ID, ROW, "starts"])

    return runs.groupBy("shard").applyInArrow(search, f"{ID} {kind}, {ROW} long, starts array<int>")


def _counted(pulled: DataFrame, rule: ShardRule) -> DataFrame:
    """The same for runs of hot grams: windows as 128-bit hashes, counted with partial sums.

    A document lists each of its windows once, with all its places.
    """
    kind = pulled.schema[ID].dataType.simpleString()

    def cut(batches):
        for part, own in text_slices(batches, limit=1_000_000):
            flat, doc, at, start, many, _ = _wanted(part, own)
            begin = ranges(at, at + many)
            doc, place = np.repeat(doc, many), ranges(start, start + many)
            hashes = []
            for seed in (np.uint64(0), ODD):
                h = np.zeros(len(begin), np.uint64)
                for k in range(rule.span):
                    h = h * ODD + mix(flat[begin + k] ^ seed)
                hashes.append(mix(h).view(np.int64))
            order = np.lexsort((place, hashes[1], hashes[0], doc))
            doc, place, a, b = doc[order], place[order], hashes[0][order], hashes[1][order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            head = np.flatnonzero(new)
            bounds = np.concatenate([head, [len(doc)]]).astype(np.int32)
            rows = part.select([ID, ROW]).take(pa.array(doc[head]))
            places = pa.ListArray.from_arrays(pa.array(bounds), pa.array(place.astype(np.int32)))
            yield pa.record_batch(
                [*rows.columns, pa.array(a[head]), pa.array(b[head]), places], names=[ID, ROW, "ka", "kb", "starts"]
            )

    windows = pulled.mapInArrow(cut, f"{ID} {kind}, {ROW} long, ka long, kb long, starts array<int>")
    at = F.struct(ID, ROW)
    repeated = windows.groupBy("ka", "kb").agg(
        F.min(at).alias("lo"), F.max(at).alias("hi"), F.max(F.size("starts")).alias("m")
    ).where("lo != hi OR m > 1").select("ka", "kb")
    return windows.join(repeated, ["ka", "kb"]).select(ID, ROW, "starts")


def _matched(texts: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """``texts`` with the row of ``other`` (_i, _r, ...) for the same document."""
    return texts.join(
        other.hint("shuffle_hash"), texts[ID].eqNullSafe(F.col("_i")) & (texts[ROW] == F.col("_r")), how
    )


def _per_row(hits: DataFrame, kept: Column) -> DataFrame:
    run = F.struct("start", "windows", "hash")
    return hits.where(kept).groupBy(F.col(ID).alias("_i"), F.col(ROW).alias("_r")).agg(F.collect_list(run).alias("runs"))


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, rule: ShardRule) -> DataFrame:
    """(_id, _row, _text, starts, whole): each document with its repeated windows.

    Documents with equal words are one text for the search; if there are two
    of them and they have a window, ``whole`` says that all their words repeat.
    """
    texts = keyed(docs, id_col, text_col)
    drawn = _drawn(texts, rule)
    row = F.struct(ID, ROW)
    classes = written(
        drawn.where(F.col("n") >= rule.span).groupBy("wa", "wb", "n")
        .agg(F.min(row).alias("at"), (F.min(row) != F.max(row)).alias("whole"), F.first("runs").alias("runs")),
        "classes",
    )
    runs = classes.select("at.*", F.explode("runs").alias("r")).select(ID, ROW, "r.*")
    load = F.sum(F.col("windows") + rule.span - 1).alias("load")
    again = (
        runs.groupBy("hash").agg(F.count(F.lit(1)).alias("m"), F.bool_or("again").alias("again"), load)
        .where("m > 1 OR again").select("hash", "load")
    )
    hits = written(runs.drop("again").join(again, "hash"), "hits")
    words = hits.agg(load).first()[0] or 0
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(width, -(-words // rule.shard_words))
    limit = max(rule.hot_words, 2 * words // shards)
    hot = F.col("load") > limit

    found = _searched(_cut_runs(_matched(texts, _per_row(hits, ~hot), "inner").select(ID, ROW, TEXT, "runs"), rule, shards), rule)
    if not hits.where(hot).isEmpty():
        counted = _counted(_matched(texts, _per_row(hits, hot), "inner").select(ID, ROW, TEXT, "runs"), rule)
        found = found.unionByName(counted)
    starts = found.groupBy(F.col(ID).alias("_i"), F.col(ROW).alias("_r")).agg(F.flatten(F.collect_list("starts")).alias("starts"))
    copies = drawn.join(classes.where("whole").select("wa", "wb", "n"), ["wa", "wb", "n"])
    marks = starts.withColumn("whole", F.lit(False)).unionByName(
        copies.select(F.col(ID).alias("_i"), F.col(ROW).alias("_r"), F.array().cast("array<int>").alias("starts"), F.lit(True).alias("whole"))
    )
    marks = marks.groupBy("_i", "_r").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.max("whole").alias("whole"))
    return _matched(texts, marks, "left").select(ID, ROW, TEXT, "starts", F.coalesce("whole", F.lit(False)).alias("whole"))


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: ShardRule = ShardRule()
) -> DataFrame:
    """Per document: ``id_col``, n_words, n_removed, kept (kept words joined by a space).

    Words are what ASCII white space separates. A word goes if a window of
    ``rule.span`` words covers it whose words also begin anywhere else, in
    another document or the same; all windows are judged on the input. Shorter,
    null and empty texts lose nothing. Rows that agree in id and text are one
    document: they are no repeats of each other and get the same result.
    """

    def cut(batches):
        for part, own in text_slices(batches):
            starts = part.column(part.schema.get_field_index("starts")).to_pylist()
            whole = part.column(part.schema.get_field_index("whole")).to_pylist()
            n, gone, kept = [], [], []
            for text, at, all_go in zip(own, starts, whole):
                words = text.encode("utf-8", "replace").split()
                n.append(len(words))
                if all_go:
                    left = []
                elif at:
                    hit = covered(len(words), np.array(at), rule.span)
                    left = [w for w, h in zip(words, hit.tolist()) if not h]
                else:
                    left = words
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8"))
            ids = part.column(part.schema.get_field_index(ID))
            yield pa.record_batch(
                [ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                names=[ID, "n_words", "n_removed", "kept"],
            )

    marked = repeated_windows(docs, id_col, text_col, rule).select(ID, TEXT, "starts", "whole")
    kind = docs.schema[id_col].dataType.simpleString()
    return marked.mapInArrow(cut, f"{ID} {kind}, n_words long, n_removed long, kept string").withColumnRenamed(ID, id_col)


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
), gone AS (
  SELECT DISTINCT doc_id, i + k AS p FROM win, range(35) r(k) WHERE g IN (SELECT g FROM win GROUP BY g HAVING count(*) > 1)
), each AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w
), kept AS (
  SELECT e.doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY e.p) FILTER (g.p IS NULL) AS kept
  FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

"""Compression bands: repetitive or incompressible text by zstandard ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    ID, TEXT, Numbered, covered, gram_hashes, gram_starts, id_type, keyed, mix, out, text_slices,
)

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
WINDOW = 8


@dataclass(frozen=True)
class Bands:
    """Limits of compressed size / size in bytes; a text inside all of them is kept.

    ``whole`` has (shortest length in bytes, lowest, highest ratio) by rising
    length: short texts compress badly, long ones well, so each length class
    has limits of its own. Below the first length nothing is judged. Texts of
    ``chunk`` bytes and more are also judged by fixed chunks: at most
    ``bad_share`` of them may lie outside ``chunk_band``.
    """

    level: int = 3
    whole: tuple[tuple[int, float, float], ...] = (
        (128, 0.30, 1.00),
        (512, 0.22, 0.92),
        (2048, 0.18, 0.75),
        (8192, 0.14, 0.72),
        (32768, 0.10, 0.70),
    )
    chunk: int = 2048
    chunk_band: tuple[float, float] = (0.16, 0.80)
    bad_share: float = 0.34


def _repeated_words(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per document, words inside 8-word windows that it has twice or more."""
    docs = len(starts) - 1
    lens = np.diff(starts)
    at = gram_starts(starts, WINDOW)
    if not len(at):
        return np.zeros(docs, np.int64)
    doc = np.repeat(np.arange(docs), np.maximum(lens - WINDOW + 1, 0))
    key = gram_hashes(mix(ids.astype(np.uint64) + np.uint64(1)), WINDOW)[at]
    key = mix(key + doc.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    near = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    a, b = order[near], order[near + 1]
    same = doc[a] == doc[b]
    for k in range(WINDOW):
        same &= ids[at[a] + k] == ids[at[b] + k]
    twice = np.unique(np.concatenate([at[a[same]], at[b[same]]]))
    hit = covered(int(starts[-1]), twice, WINDOW)
    return np.bincount(np.repeat(np.arange(docs), lens), weights=hit, minlength=docs).astype(np.int64)


def _duplicate_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(SPACES):
            seen.add(line)
    return n


def _ratios(data: bytes, bands: Bands, press: zstandard.ZstdCompressor) -> tuple[float, int, int]:
    whole = len(press.compress(data)) / len(data) if data else 1.0
    chunks = bad = 0
    for a in range(0, len(data) - bands.chunk + 1, bands.chunk):
        ratio = len(press.compress(data[a : a + bands.chunk])) / bands.chunk
        chunks += 1
        bad += not bands.chunk_band[0] <= ratio <= bands.chunk_band[1]
    return whole, chunks, bad


def compression_bands(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()
) -> DataFrame:
    """Word and line counts, compression ratios and the verdict of each document.

    Returns ``id_col``, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_bytes, ratio, n_chunks, n_bad_chunks, base_failed, kept;
    other input columns are not read. Null and empty texts have no words, ratio
    1 and fail the base rule. Repeated rows are judged one by one, alike. Every
    text is compressed whole; one pass, no shuffle.
    """
    schema = pa.schema(
        [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
         ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("n_bytes", pa.int64()),
         ("ratio", pa.float64()), ("n_chunks", pa.int64()), ("n_bad_chunks", pa.int64())]
    )

    def scan(batches):
        press = zstandard.ZstdCompressor(level=bands.level, write_content_size=False)
        for part, texts in text_slices(batches):
            data = [t.encode("utf-8", "replace") for t in texts]
            words = [d.split() for d in data]
            number = Numbered()
            starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
            ids = np.fromiter((number[w] for ws in words for w in ws), np.int64, starts[-1])
            ratios = [_ratios(d, bands, press) for d in data]
            columns = [
                np.diff(starts),
                [len(t) - sum(map(t.count, SPACES)) for t in texts],
                [sum(map(t.count, SYMBOLS)) for t in texts],
                [_duplicate_lines(t) for t in texts],
                _repeated_words(ids, starts),
                [len(d) for d in data],
                *map(list, zip(*ratios)),
            ]
            ids_in = part.column(part.schema.get_field_index(ID))
            yield out(pa.schema([pa.field(ID, ids_in.type), *schema]), [ids_in, *columns])

    kind = id_type(docs, id_col)
    read = keyed(docs, id_col, text_col).select(ID, TEXT)
    counted = read.mapInArrow(
        scan,
        f"{ID} {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
        " n_repeat_words long, n_bytes long, ratio double, n_chunks long, n_bad_chunks long",
    )
    inside = F.lit(True)
    for shortest, low, high in bands.whole:  # the last class that fits decides
        inside = F.when(F.col("n_bytes") >= shortest, F.col("ratio").between(low, high)).otherwise(inside)
    inside &= F.col("n_bad_chunks") <= bands.bad_share * F.col("n_chunks")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).select(
        F.col(ID).alias(id_col), *schema.names, "base_failed", (~F.col("base_failed") & inside).alias("kept")
    )

"""Row identity, word splitting and batch slicing shared by the text operators.

A row is identified by its id and a hash of its text. Two rows that agree in
both are the same document and get the same result; rows that share an id but
not the text are separate documents. Null ids are a value like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import fresh_dir, remove_dir

ID, ROW, TEXT = "_id", "_row", "_text"
PACKED = "_packed"
BATCH_CHARS = 4_000_000
ODD = np.uint64(0x9E3779B97F4A7C15)
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only what the operators need, under names no input column has."""
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).alias(ID), F.xxhash64(text, F.length(text)).alias(ROW), text.alias(TEXT)
    )


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", without: tuple[str, ...] = ()) -> DataFrame:
    """Every input row as one struct beside its id, row hash and text.

    No column of the input can clash with those of an operator, whatever its
    name. ``without`` are columns that the caller puts back himself.
    """
    own = [quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in without]
    text = F.col(text_col).cast("string")
    return docs.select(
        F.struct(F.lit(True).alias("row"), *own).alias(PACKED),
        F.col(id_col).alias(ID), F.xxhash64(text, F.length(text)).alias(ROW), text.alias(TEXT),
    )


def unpacked(docs: DataFrame, name: str) -> Column:
    return F.col(PACKED)[f"c{docs.columns.index(name)}"].alias(name)


def only_rows(docs: DataFrame, named: DataFrame, how: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose (_id, _row) are in ``named`` (``left_semi``) or are not (``left_anti``)."""
    rows = packed(docs, id_col, text_col).drop(TEXT)
    keys = named.select(F.col(ID).alias("_i"), F.col(ROW).alias("_r")).distinct()
    kept = rows.join(keys.hint("shuffle_hash"), F.col(ID).eqNullSafe(F.col("_i")) & (F.col(ROW) == F.col("_r")), how)
    return kept.select(*(unpacked(docs, c) for c in docs.columns))


def same_row(left: DataFrame, right: DataFrame) -> Column:
    return left[ID].eqNullSafe(right[ID]) & (left[ROW] == right[ROW])


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """What begins here deletes its shuffle files when it ends, not when the driver's JVM has collected its plan."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Cut the lineage by a table in the shared folder; survives lost executors. Its shuffle files go at once."""
    path = fresh_dir(df.sparkSession, purpose)
    with shuffles_end(df.sparkSession):
        df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` gave, once nothing reads them any more."""
    for table in tables:
        remove_dir(table.sparkSession, table.written_to)


def with_list(pairs: DataFrame, side: str, lists: DataFrame, values: str, name: str, share: int = 256) -> DataFrame:
    """``pairs`` (a, b) with the array ``values`` of one side's row in ``lists`` (node, ...), as ``name``.

    A node that is in many pairs is a hot key, and its array would go to one
    task with all of them: its row is read in copies, one for ``share`` pairs,
    among which the pairs are dealt.
    """
    copies = pairs.groupBy(side).agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("_m"))
    dealt = pairs.join(copies, side).withColumn("_k", F.pmod(F.xxhash64("a", "b"), "_m").cast("int")).drop("_m")
    own = lists.select(F.col("node").alias(side), F.col(values).alias(name)).join(copies, side)
    each = own.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_m") - 1))).drop("_m")
    return dealt.join(each, [side, "_k"]).drop("_k")


def id_type(docs: DataFrame, name: str) -> str:
    return docs.schema[name].dataType.simpleString()


def slices(texts: list[str], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``limit`` characters, or one longer text."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def text_slices(batches: Iterator[pa.RecordBatch], text: str = TEXT, limit: int = BATCH_CHARS):
    """Each Arrow batch cut to bounded slices: (slice, its texts); null is empty."""
    for batch in batches:
        texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        for a, b in slices(texts, limit):
            yield batch.slice(a, b - a), texts[a:b]


class Numbered(dict):
    """Gives each new word the next number."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class Hashed(dict):
    """64-bit hash of a word, the same in every process."""

    def __missing__(self, word):
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all documents in one array, and where each begins."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lens)])
    known = Hashed()
    flat = np.empty(starts[-1], np.uint64)
    for a, ws in zip(starts, words):
        flat[a : a + len(ws)] = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
    return flat, starts


def gram_hashes(flat: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each position (document ends not regarded)."""
    n = max(0, len(flat) - width + 1)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * ODD + flat[k : k + n]
    return mix(h)


def gram_starts(starts: np.ndarray, width: int) -> np.ndarray:
    """Positions from which ``width`` words lie in one document."""
    ends = starts[1:] - width + 1
    return ranges(starts[:-1], np.maximum(ends, starts[:-1]))


def ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All integers of [begin, end) of each pair, one after the other."""
    lens = end - begin
    total = int(lens.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = np.repeat(begin - (np.cumsum(lens) - lens), lens)
    return shift + np.arange(total)


def covered(total: int, begin: np.ndarray, width) -> np.ndarray:
    """Which of ``total`` positions lie in a range [begin, begin + width)."""
    change = np.bincount(begin, minlength=total + 1)[: total + 1].astype(np.int64)
    change -= np.bincount(begin + width, minlength=total + 1)[: total + 1]
    return np.cumsum(change[:total]) > 0


def out(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.record_batch(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema)],
        schema=schema,
    )

"""Token ids as flat unsigned integer files with 64-bit document offsets.

A part of the output is three files: ``.bin`` (ids, little-endian unsigned 16
or 32 bit, whichever holds the vocabulary), ``.idx`` (unsigned 64-bit offsets
in tokens, one per document and the end) and a row of the manifest table. Parts
follow each other in ascending id order; the sum of the tokens of all parts
before gives a part's base.
"""

from __future__ import annotations

import functools
import string
import uuid
from itertools import chain, islice
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workspace import fresh_dir
from .common import ID, ROW, TEXT, Numbered, keyed, ranges

KEPT_CHUNKS = 1_000_000
SLICE_BYTES = 4_000_000
MANIFEST = "part int, name string, n_docs long, n_tokens long, width int"


class ChunkCoder:
    """Ids of texts by the tokenizers library, which sees each new chunk once.

    A chunk is what lies between ASCII white space. That gives the ids of the
    whole text where the tokenizer itself drops white space and lets no token
    span it; a probe makes sure of that for the file in use. Where the
    tokenizer lower-cases, ASCII chunks that name no added token are
    lower-cased first, so that they are seen once in either case. Others are
    not touched: an added token is cut out before its letters are lowered, and
    a capital before a combining mark may compose otherwise than the small one.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = self.library.get_added_tokens_decoder()
        self.added = [t.content for t in added.values()]
        probe = "Ab c\n\tdé 'll  x1\r\v\f|| <|endoftext|> Σς e"
        whole = self._library_ids([probe])[0]
        self.by_chunk = whole == [i for ids in self._library_ids(probe.split()) for i in ids] and not any(
            any(c.isspace() for c in t) for t in self.added
        )
        letters = [a + b for a in string.ascii_uppercase for b in ("", *string.ascii_letters)]
        lower = [t.lower() for t in letters]
        self.folds = self.by_chunk and self._library_ids(letters) == self._library_ids(lower)
        plain = [
            (t.content, i) for i, t in added.items() if not (t.lstrip or t.rstrip or t.single_word or t.normalized)
        ]
        self.between = min(plain, key=lambda t: t[1], default=None)
        self._forget()

    def _library_ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk.

        Many chunks go to the library as one text, with an added token between
        them, which it cuts out before anything else.
        """
        if self.between is None:
            return self._library_ids(chunks)
        token, mark = self.between
        each: list[list[int]] = []
        for i in range(0, len(chunks), 1000):
            group = chunks[i : i + 1000]
            joined = token.join(group)
            if joined.count(token) != len(group) - 1:
                each += self._library_ids(group)
                continue
            ids = self._library_ids([joined])[0]
            ends = [k for k, x in enumerate(ids) if x == mark]
            each += [ids[a + 1 : b] for a, b in zip([-1, *ends], [*ends, len(ids)])]
        return each

    def _forget(self) -> None:
        self.known = Numbered()
        self.ids = np.empty(0, np.uint32)
        self.begin = np.zeros(1, np.int64)
        self.used = np.empty(0, np.int64)

    def _keep_often_used(self) -> None:
        """Half as many chunks: those that most slices had."""
        often = np.sort(np.argsort(-self.used, kind="stable")[: KEPT_CHUNKS // 2])
        names = np.array(list(self.known), object)[often].tolist()
        ids = self.ids[ranges(self.begin[often], self.begin[often + 1])]
        lens, used = np.diff(self.begin)[often], self.used[often]
        self._forget()
        self.known.update(zip(names, range(len(names))))
        self._learn(ids, lens)
        self.used = used

    def _folded(self, chunks: pa.Array) -> pa.Array:
        if not self.folds:
            return chunks
        named = [pc.match_substring(chunks, t, ignore_case=True) for t in self.added]
        plain = functools.reduce(pc.and_not, named, pc.string_is_ascii(chunks))
        return pc.if_else(plain, pc.ascii_lower(chunks), chunks)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each with its end id, and their lengths."""
        texts = texts.fill_null("")
        if not self.by_chunk:
            each = [[*ids, end_id] for ids in self._library_ids(texts.to_pylist())]
            lens = np.array([len(e) for e in each], np.int64)
            return np.array([i for e in each for i in e], np.uint32), lens
        if len(self.known) > KEPT_CHUNKS:
            self._keep_often_used()
        split = pc.ascii_split_whitespace(texts)
        chunks = split.flatten().dictionary_encode()
        names = self._folded(chunks.dictionary).to_pylist()
        had = len(self.known)
        number = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        if len(self.known) > had:  # new chunks were numbered in the order they came
            new = list(islice(reversed(self.known), len(self.known) - had))[::-1]
            try:
                each = self._each(new)
                self._learn(np.fromiter(chain.from_iterable(each), np.uint32), np.fromiter(map(len, each), np.int64))
            except BaseException:
                self._forget()  # numbers without ids must not outlive a failed task
                raise
        self.used[number] += 1
        at = number[chunks.indices.to_numpy()]
        ends = split.offsets.to_numpy()[1:].astype(np.int64) - split.offsets[0].as_py()
        begin, lens = self.begin[at], self.begin[at + 1] - self.begin[at]
        upto = np.concatenate([[0], np.cumsum(lens)])[ends]  # ids of all documents so far
        flat = np.empty(int(lens.sum()) + len(ends), np.uint32)
        closed = upto + np.arange(len(ends))
        mine = np.ones(len(flat), bool)
        mine[closed] = False
        flat[closed] = end_id
        flat[mine] = self.ids[ranges(begin, begin + lens)]
        return flat, np.diff(closed, prepend=-1)

    def _learn(self, ids: np.ndarray, lens: np.ndarray) -> None:
        self.ids = np.concatenate([self.ids, ids])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(lens)])
        self.used = np.concatenate([self.used, np.zeros(len(lens), np.int64)])


def byte_slices(batches, text: str = TEXT, limit: int = SLICE_BYTES):
    """Each Arrow batch cut to slices of at most ``limit`` bytes of text, or one longer text."""
    for batch in batches:
        size = pc.binary_length(batch.column(batch.schema.get_field_index(text))).fill_null(0).to_numpy()
        upto = np.concatenate([[0], np.cumsum(size.astype(np.int64))])
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + limit, side="right")) - 1)
            yield batch.slice(a, b - a)
            a = b


@functools.lru_cache(maxsize=2)
def chunk_coder(path: str) -> ChunkCoder:
    return ChunkCoder(path)


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder (local path or any URI pyarrow knows) and the path in it."""
    if not urlparse(folder).scheme:
        return pafs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), urlparse(folder).path
    return pafs.FileSystem.from_uri(folder)


def write_token_files(
    docs: DataFrame,
    path: str,
    folder: str,
    end_id: int,
    width: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write all documents' ids under ``folder`` and return the manifest.

    The manifest has a row per part (part, name, n_docs, n_tokens, width, base)
    and is stored as ``folder/manifest``. Documents are sorted by id over all
    parts (nulls first, equal ids by a hash of the text). A part is written
    under a name of its own for each attempt; the manifest names the attempt
    that Spark committed, so lost executors and repeated tasks leave no trace
    in it. Null and empty texts are a document with only the end id. An empty
    table gives no parts. Texts are encoded whole; a task holds one slice of
    texts and its part's offsets. ``width`` is the bytes of an id (2 or 4).
    """
    code = {2: "<u2", 4: "<u4"}[width]

    def store(batches):
        coder = chunk_coder(path)
        store_fs, root = _opened(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}-{uuid.uuid4().hex}"
        lens, ids = [], []
        sink = None
        for batch in byte_slices(batches):
            if sink is None:
                store_fs.create_dir(f"{root}/tokens", recursive=True)
                sink = store_fs.open_output_stream(f"{root}/tokens/{name}.bin")
            flat, n = coder.encode(batch.column(batch.schema.get_field_index(TEXT)), end_id)
            if flat.size and int(flat.max()) >= 1 << (8 * width):
                raise ValueError(f"an id does not fit into {width} bytes")
            sink.write(flat.astype(code).tobytes())
            lens.append(n)
            ids.append(batch.column(batch.schema.get_field_index(ID)))
        if sink is None:
            return
        sink.close()
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lens))]).astype("<u8")
        with store_fs.open_output_stream(f"{root}/tokens/{name}.idx") as f:
            f.write(offsets.tobytes())
        with store_fs.open_output_stream(f"{root}/tokens/{name}.ids") as f:
            table = pa.table({ID: pa.chunked_array(ids)})
            with pa.ipc.new_file(f, table.schema) as w:
                w.write_table(table)
        row = [[part], [name], [len(offsets) - 1], [int(offsets[-1])], [width]]
        yield pa.record_batch(
            [pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32()))],
            names=["part", "name", "n_docs", "n_tokens", "width"],
        )

    ordered = (
        keyed(docs, id_col, text_col)
        .repartitionByRange(F.col(ID).asc_nulls_first(), F.col(ROW))
        .sortWithinPartitions(F.col(ID).asc_nulls_first(), ROW)
    )
    parts = ordered.select(ID, TEXT).mapInArrow(store, MANIFEST)
    spark = docs.sparkSession
    parts.write.parquet(f"{folder}/parts")
    # One row per part: a running sum over them is small however long the files are.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = spark.read.schema(MANIFEST).parquet(f"{folder}/parts").withColumn(
        "base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long")
    )
    based.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST + ", base long").parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str, kind: str = "long", id_col: str = "doc_id") -> DataFrame:
    """Documents of the files: ``id_col``, start, n_tokens, ids (binary, unsigned 32-bit LE).

    A local folder is memory-mapped, another one is read in ranges, a document
    at a time. ``start`` counts the tokens of all documents before.
    """
    manifest = spark.read.schema(MANIFEST + ", base long").parquet(f"{folder}/manifest")

    def load(batches):
        store_fs, root = _opened(folder)
        local = isinstance(store_fs, pafs.LocalFileSystem)
        for batch in batches:
            for m in batch.to_pylist():
                at = f"{root}/tokens/{m['name']}"
                with store_fs.open_input_file(f"{at}.idx") as f:
                    offsets = np.frombuffer(f.read(), "<u8").astype(np.int64)
                with store_fs.open_input_file(f"{at}.ids") as f:
                    ids = pa.ipc.open_file(f).read_all().column(ID).combine_chunks()
                code = {2: "<u2", 4: "<u4"}[m["width"]]
                if local:
                    flat = np.memmap(f"{at}.bin", code, "r") if m["n_tokens"] else np.empty(0, code)
                    take = lambda a, b: flat[a:b]
                else:
                    bin_file = store_fs.open_input_file(f"{at}.bin")
                    w = m["width"]
                    take = lambda a, b: np.frombuffer(bin_file.read_at((b - a) * w, a * w), code)
                a = 0
                while a < m["n_docs"]:  # slices of bounded size, or one document
                    limit = np.searchsorted(offsets, offsets[a] + 2_000_000, side="right") - 1
                    b = max(a + 1, int(limit))
                    near = np.asarray(take(int(offsets[a]), int(offsets[b]))).astype("<u4").tobytes()
                    cut = (offsets[a : b + 1] - offsets[a]) * 4
                    data = [near[x:y] for x, y in zip(cut[:-1], cut[1:])]
                    yield pa.record_batch(
                        [ids.slice(a, b - a), pa.array(m["base"] + offsets[a:b]),
                         pa.array(np.diff(offsets[a : b + 1])), pa.array(data, pa.binary())],
                        names=[ID, "start", "n_tokens", "ids"],
                    )
                    a = b

    spread = manifest.repartition(F.col("part"))
    found = spread.mapInArrow(load, f"{ID} {kind}, start long, n_tokens long, ids binary")
    return found.withColumnRenamed(ID, id_col)


def token_folder(spark: SparkSession) -> str:
    """A folder of its own for one set of files, under the cluster's shared one."""
    return fresh_dir(spark, "tokens")

"""Byte-pair encoding and decoding in batched numpy merge rounds."""

from __future__ import annotations

import functools
import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, TEXT, id_type, keyed, ranges, text_slices

# The split of GPT-2's byte-level tokenizer, with white space as Unicode has it.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
NONE = np.int64(2**62)
LONG_WORD = 512
KEPT_WORDS = 400_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Ids, merge ranks and special tokens of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*ids.values(), *special.values()]))
        for token, i in ids.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in special.items():
            self.bytes_of[i] = token.encode("utf-8")
        self.byte_ids = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_ids[b] = ids[letter]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made_by_rank = keys[order], order.astype(np.int64), made
        self.rank_of = dict(zip(keys.tolist(), range(len(keys))))
        self.special = special
        self.cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split = regex.compile(SPLIT)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE if it never merges: binary search over sorted keys."""
        want = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], NONE)

    def merge_batch(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array and the length of each word.

        All symbols lie in one flat array. A round finds each word's pair of
        lowest rank, joins all its occurrences from left to right, and looks up
        only the pairs next to a join; words without a pair drop out.
        """
        lens = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lens)
        rank = np.full(len(sym), NONE)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self.pair_ranks(sym[inner], sym[inner + 1])
        ready: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low = np.minimum.reduceat(rank, first)
            size = np.diff(np.concatenate([first, [len(sym)]]))
            live = np.repeat(low < NONE, size)
            if not live.all():
                ready.append((word[~live], sym[~live]))
                sym, word, rank = sym[live], word[live], rank[live]
                low, size = low[low < NONE], size[low < NONE]
                if not len(sym):
                    break
            hit = rank == np.repeat(low, size)
            at = np.flatnonzero(hit)
            # In a row of overlapping occurrences (aaa) every second one is joined.
            new_row = np.concatenate([[True], np.diff(at) > 1])
            begin = at[new_row][np.cumsum(new_row) - 1]
            at = at[(at - begin) % 2 == 0]
            sym[at] = self.made_by_rank[rank[at]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            touched = np.zeros(len(sym), bool)
            touched[at] = True
            sym, word, rank, touched = sym[stay], word[stay], rank[stay], touched[stay]
            again = touched.copy()
            again[:-1] |= touched[1:]
            again = np.flatnonzero(again)
            rank[again] = NONE
            again = again[again < len(sym) - 1]
            again = again[word[again] == word[again + 1]]
            rank[again] = self.pair_ranks(sym[again], sym[again + 1])
        if not ready:
            return np.empty(0, np.int64), lens * 0
        words_out = np.concatenate([w for w, _ in ready])
        order = np.argsort(words_out, kind="stable")
        return np.concatenate([s for _, s in ready])[order], np.bincount(words_out, minlength=len(words))

    def merge_long(self, word: bytes) -> list[int]:
        """The same for one very long word with a heap, so that its cost stays n log n."""
        sym = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after = list(range(1, len(sym))) + [-1]
        before = list(range(-1, len(sym) - 1))
        rank_of = self.rank_of.get
        heap = [(r, i) for i in range(len(sym) - 1) if (r := rank_of(sym[i] << 32 | sym[i + 1])) is not None]
        heapq.heapify(heap)
        gone = [False] * len(sym)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or rank_of(sym[i] << 32 | sym[j]) != r:
                continue
            sym[i], gone[j] = int(self.made_by_rank[r]), True
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank_of(sym[i] << 32 | sym[k])) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := rank_of(sym[h] << 32 | sym[i])) is not None:
                heapq.heappush(heap, (r, h))
        return [s for s, g in zip(sym, gone) if not g]


class Encoder:
    """Encodes batches of texts; remembers at most ``KEPT_WORDS`` words between batches."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.empty(0, np.int64)
        self.begin = np.zeros(1, np.int64)
        for token, i in self.vocabulary.special.items():
            self._add([token], np.array([i]), np.array([1]))

    def _add(self, words: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.ids = np.concatenate([self.ids, ids])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(lens)])

    def _learn(self, words: list[str]) -> None:
        v = self.vocabulary
        data = [w.encode("utf-8", "replace") for w in words]
        short = [i for i, d in enumerate(data) if len(d) <= LONG_WORD]
        ids, lens = v.merge_batch([data[i] for i in short])
        self._add([words[i] for i in short], ids, lens)
        for i, d in enumerate(data):
            if len(d) > LONG_WORD:
                long = v.merge_long(d)
                self._add([words[i]], np.array(long), np.array([len(long)]))

    def pieces(self, text: str) -> list[str]:
        """Special tokens and words in order; a special token never is a word of the split."""
        v = self.vocabulary
        if v.cut is None or not any(s in text for s in v.special):
            return v.split.findall(text)
        found: list[str] = []
        end = 0
        for m in v.cut.finditer(text):
            found += v.split.findall(text[end : m.start()])
            found.append(m[0])
            end = m.end()
        return found + v.split.findall(text[end:])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > KEPT_WORDS:
            self._forget()
        pieces = [self.pieces(t) for t in texts]
        new = {w: None for p in pieces for w in p if w not in self.known}
        if new:
            self._learn(list(new))
        result = []
        for p in pieces:
            at = np.fromiter(map(self.known.__getitem__, p), np.int64, len(p))
            result.append(self.ids[ranges(self.begin[at], self.begin[at + 1])])
        return result

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of each whole text and the text they decode to.

    Returns ``id_col``, ids array<int>, decoded string. ``path`` is a byte-level
    BPE file (vocabulary, merges, added tokens) that every executor can open.
    Added tokens in a text get their own id. Null and empty texts give no ids
    and an empty text; repeated rows are encoded one by one, alike; other
    columns are not read. Long texts are encoded whole, in a batch of their
    own. One pass, no shuffle; a worker remembers a bounded number of words.
    """

    def code(batches):
        coder = encoder(path)
        for part, texts in text_slices(batches):
            ids = coder.encode(texts)
            begin = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32)
            whole = flat.tolist()
            decoded = [coder.decode(whole[a:b]) for a, b in zip(begin[:-1], begin[1:])]
            yield pa.record_batch(
                [part.column(part.schema.get_field_index(ID)),
                 pa.ListArray.from_arrays(pa.array(begin), pa.array(flat)),
                 pa.array(decoded, pa.string())],
                names=[ID, "ids", "decoded"],
            )

    read = keyed(docs, id_col, text_col).select(ID, TEXT)
    coded = read.mapInArrow(code, f"{ID} {id_type(docs, id_col)}, ids array<int>, decoded string")
    return coded.select(F.col(ID).alias(id_col), "ids", "decoded")

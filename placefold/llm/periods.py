"""Periodic stretches of words inside one document, by seeds on lag diagonals.

A stretch with smallest period q and length L matches itself at lag q over
L - q words. With L >= max(24, 3q) that overlap is at least 16 words, and at
least 2q. Lags are therefore searched in bands: up to 16 with grams of 16
words, then (16, 32] with grams of 32, (32, 64] with grams of 64 and so on. A
gram is at least as long as any lag of its band and no longer than the overlap
that the band guarantees. By Fine and Wilf the next place of the gram at which
a stretch starts is then exactly one period on: only neighbouring places of a
gram need a look, and a lag that is found is the smallest period.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, ROW, TEXT, Numbered, keyed, ranges, text_slices

LEAST, TIMES = 24, 3  # a run has at least so many words, and so many periods
FIRST = 16  # the overlap any run has with itself: 24 - 8 = 2 * 8

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _named(doc: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers for pairs of names: equal numbers exactly for equal pairs of one document."""
    order = np.lexsort((right, left, doc))
    a, b, d = left[order], right[order], doc[order]
    new = np.empty(len(order), bool)
    new[:1] = True
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (d[1:] != d[:-1])
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new)
    return names


def _seeds(words: np.ndarray, starts: np.ndarray):
    """(positions, lags) of neighbouring places of a gram, band by band.

    Grams are named exactly, by doubling: a gram of 2k words is the pair of
    the names of its halves. A place whose gram stands nowhere else in its
    document can be in no longer gram that repeats, so it takes no further part.
    """
    total = len(words)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    ends = np.repeat(starts[1:], np.diff(starts))
    longest = int(np.diff(starts).max(initial=0))
    at, name, k = np.arange(total), words, 1
    while len(at) and longest >= LEAST and (k <= FIRST or TIMES * (k // 2 + 1) <= longest):
        if k >= FIRST:
            order = np.lexsort((at, name))
            p, same = at[order], name[order]
            lag = p[1:] - p[:-1]
            hit = (same[1:] == same[:-1]) & (lag > (0 if k == FIRST else k // 2)) & (lag <= k)
            yield p[:-1][hit], lag[hit]
        if k > 1:  # single words have one number in all documents
            _, which, count = np.unique(name, return_inverse=True, return_counts=True)
            at, name = at[count[which] > 1], name[count[which] > 1]
        half = np.full(total + 1, -1, np.int64)
        half[at] = name
        right = half[np.minimum(at + k, total)]
        whole = (at + 2 * k <= ends[at]) & (right >= 0)
        at, name, right = at[whole], name[whole], right[whole]
        name = _named(doc[at], name, right)
        k *= 2


def _agree(words: np.ndarray, x: int, lag: int, stop: int, step: int) -> int:
    """How far from ``x`` (towards ``stop``) words equal those a lag behind, by doubling looks."""
    look = 32
    while x != stop:
        n = min(look, abs(stop - x))
        if step > 0:
            same = words[x : x + n] == words[x - lag : x + n - lag]
        else:
            same = (words[x - n : x] == words[x - n + lag : x + lag])[::-1]
        if not same.all():
            return x + step * int(np.argmin(same))
        x += step * n
        look *= 2
    return x


def find_runs(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of all runs, by document, start and period.

    ``words`` are the word numbers of all documents, ``starts`` where each
    begins. Seeds are taken in order of position; ``covered`` keeps, per
    document and lag, how far matches have been extended, so that a stretch is
    extended once.
    """
    found = []
    for at, lag in _seeds(words, starts):
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        # A seed next to the one before it on its diagonal lies in the same match.
        fresh = np.ones(len(at), bool)
        fresh[1:] = (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)
        covered: dict[tuple[int, int], int] = {}
        doc = np.searchsorted(starts, at[fresh], side="right") - 1
        for d, x, q in zip(doc.tolist(), at[fresh].tolist(), lag[fresh].tolist()):
            if x < covered.get((d, q), -1):
                continue
            end = _agree(words, x + q, q, int(starts[d + 1]), 1)
            first = _agree(words, x, q, int(starts[d]), -1)
            covered[d, q] = end - q
            if end - first >= max(LEAST, TIMES * q):
                found.append((d, first - int(starts[d]), end - first, q))
    found.sort(key=lambda r: (r[0], r[1], r[3]))
    return tuple(np.array(c, np.int64) for c in zip(*found)) if found else tuple(np.empty((4, 0), np.int64))


def _marked(total: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    change = np.bincount(begin, minlength=total + 1) - np.bincount(end, minlength=total + 1)
    return np.cumsum(change[:total]) > 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id_col``, runs (start, length, period), kept.

    Words are what lies between ASCII white space, numbered from 0. A run is a
    stretch of at least 24 words and three periods that no word beside it
    carries on. ``runs`` are sorted by start, then period. ``kept`` is the text
    without those words that stand in a run behind its first period, joined by
    one space. Null, empty and blank texts have no runs and an empty ``kept``.
    Rows are handled alone, so repeated rows and ids give repeated results and
    an empty table gives none. Texts are read whole, a slice of texts or one
    longer text at a time.
    """

    def find(batches):
        for part, texts in text_slices(batches):
            known = Numbered()
            own = [t.encode("utf-8", "replace").split() for t in texts]
            starts = np.concatenate([[0], np.cumsum([len(w) for w in own])]).astype(np.int64)
            words = np.fromiter((known[w] for ws in own for w in ws), np.int64, starts[-1])
            doc, first, length, period = find_runs(words, starts)
            begin = starts[doc] + first
            gone = _marked(len(words), begin + period, begin + length)
            touched = set(doc.tolist())
            kept = [
                b" ".join(ws if i not in touched else [w for w, g in zip(ws, gone[a:b].tolist()) if not g]).decode()
                for i, (ws, a, b) in enumerate(zip(own, starts[:-1], starts[1:]))
            ]
            bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))]).astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array(first), pa.array(length), pa.array(period)], fields=list(RUN))
            yield pa.record_batch(
                [part.column(0), pa.ListArray.from_arrays(pa.array(bounds), rows), pa.array(kept, pa.string())],
                names=[ID, "runs", "kept"],
            )

    texts = keyed(docs, id_col, text_col).drop(ROW)
    kind = texts.schema[ID].dataType.simpleString()
    made = texts.mapInArrow(find, f"{ID} {kind}, runs array<struct<start:long,length:long,period:long>>, kept string")
    return made.withColumnRenamed(ID, id_col)


def greatest(runs: str = "runs"):
    """The run with the greatest exact length / period; ties go to the smaller start, then period."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    # Sorted by start and period, so only a truly greater exponent takes over.
    return F.aggregate(
        runs, none,
        lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best),
    )

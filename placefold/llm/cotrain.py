"""Quality by co-training: a text view and a metadata view teach each other.

All sums over documents (statistics, gradients, curvatures) are made by Spark
and added per entry in a shuffle; a few hundred numbers reach the driver, which
solves for the next coefficients. Every labelled and unlabelled document takes
part; nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, ROW, TEXT, only_rows, text_slices, written

CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".,;:!?'\"-()",
    "symbol": b"#*$%&|<>@^~=+_/\\{}[]`",
}
_HIGH = bytes(range(128, 256))
N_TEXT = 14


@dataclass(frozen=True)
class CoTraining:
    """``rounds`` exchanges of pseudo-labels whose log-odds exceed ``confident``.

    Pseudo-labelled documents together weigh ``pseudo_weight`` of the labelled
    ones. One labelled document in ``folds`` is kept for calibration.
    ``meta`` columns are hashed into ``buckets`` indicators each; ``size`` is a
    column with the length in characters.
    """

    rounds: int = 2
    confident: float = 4.0
    pseudo_weight: float = 0.5
    folds: int = 5
    steps: int = 8
    l2: float = 1e-3
    keep_at: float = 0.5
    meta: tuple[str, ...] = ("lang", "source")
    size: str = "n_chars"
    buckets: int = 12

    @property
    def n_meta(self) -> int:
        return 2 + self.buckets * len(self.meta)


def text_features(text: str, press: zstandard.ZstdCompressor) -> list[float]:
    """Counts and shares that tell prose from junk, over the whole text."""
    data = text.encode("utf-8", "replace")
    size = max(1, len(data))
    words = data.split()
    n = max(1, len(words))
    lengths = list(map(len, words))
    count: dict[bytes, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    shares = [(len(data) - len(data.translate(None, c))) / size for c in CLASSES.values()]
    return [
        np.log1p(len(words)),
        np.log1p(len(lines)),
        sum(lengths) / n,
        sum(x > 20 for x in lengths) / n,
        *shares,
        (len(data) - len(data.translate(None, _HIGH))) / size,
        len(count) / n,
        max(count.values(), default=0) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        len(press.compress(data)) / size,
        (data.count(b"!!") + data.count(b"##") + data.count(b"**")) / n,
    ]


def _features(docs: DataFrame, id_col: str, text_col: str, rule: CoTraining) -> DataFrame:
    """(_id, _row, n_words, xt, xm) of every document."""
    text = F.col(text_col).cast("string")
    have = [F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in rule.meta]
    size = F.col(rule.size).cast("double") if rule.size in docs.columns else F.lit(None).cast("double")
    read = docs.select(
        F.col(id_col).alias(ID), F.xxhash64(text, F.length(text)).alias(ROW), text.alias(TEXT),
        size.alias("_size"), F.array(*have).alias("_meta"),
    )

    def make(batches):
        press = zstandard.ZstdCompressor(level=3, write_content_size=False)
        for part, texts in text_slices(batches):
            xt = np.array([text_features(t, press) for t in texts], np.float32)
            xm = np.zeros((len(texts), rule.n_meta), np.float32)
            sizes = part.column(part.schema.get_field_index("_size")).to_pylist()
            xm[:, 0] = np.log1p([max(0.0, s) if s is not None and s == s else 0.0 for s in sizes])
            xm[:, 1] = [s is None for s in sizes]
            for i, values in enumerate(part.column(part.schema.get_field_index("_meta")).to_pylist()):
                for k, v in enumerate(values):
                    at = xxhash.xxh32_intdigest(f"{k}:{v}") % rule.buckets
                    xm[i, 2 + k * rule.buckets + at] = 1
            yield pa.record_batch(
                [*part.select([ID, ROW]).columns, pa.array([bool(t.split()) for t in texts]), _listed(xt), _listed(xm)],
                names=[ID, ROW, "some", "xt", "xm"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return read.mapInArrow(make, f"{ID} {kind}, {ROW} long, some boolean, xt array<float>, xm array<float>")


def _listed(x: np.ndarray) -> pa.ListArray:
    begin = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(begin), pa.array(np.ascontiguousarray(x).reshape(-1)))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.float64)


def _sums(rows: DataFrame, partial: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over all batches of a vector that ``partial`` makes of one."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                own = partial(batch)
                total = own if total is None else total + own
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["k", "v"])

    added = rows.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    return added.sort_values("k")["v"].to_numpy()


def _odds(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(rows: DataFrame, views: Callable, thetas: list[np.ndarray], steps: int, l2: float) -> list[np.ndarray]:
    """Newton steps of weighted logistic regressions, all views in one pass per step.

    ``views(batch)`` gives (X, y, weight) for each view; weights of a view add up to about 1.
    """
    thetas = [t.copy() for t in thetas]
    best: list[tuple] = [(np.inf, t) for t in thetas]  # least loss so far and where
    for _ in range(steps):
        now = [t.copy() for t in thetas]

        def partial(batch, now=now):
            found = []
            for (x, y, w), t in zip(views(batch), now):
                z = x @ t
                p = _odds(z)
                loss = (w * (np.logaddexp(0, z) - y * z)).sum()
                found += [[loss], x.T @ (w * (y - p)), ((x * (w * p * (1 - p))[:, None]).T @ x).reshape(-1)]
            return np.concatenate(found)

        total, at = _sums(rows, partial), 0
        if not len(total):
            break
        moved = 0.0
        for i, t in enumerate(now):
            d = len(t)
            keep = np.full(d, l2)
            keep[0] = 1e-6  # the constant is all but free
            loss = total[at] + 0.5 * (keep * t * t).sum()
            slope, bend = total[at + 1 : at + 1 + d], total[at + 1 + d : at + 1 + d + d * d].reshape(d, d)
            at += 1 + d + d * d
            if loss > best[i][0]:  # too far: back half the way
                thetas[i] = (t + best[i][1]) / 2
            else:
                best[i] = (loss, t)
                thetas[i] = t + np.linalg.solve(bend + np.diag(keep), slope - keep * t)
            moved = max(moved, float(np.abs(thetas[i] - t).max()))
        if moved < 1e-3:
            break
    return [t for _, t in best]


def _design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, squares: bool) -> np.ndarray:
    z = np.clip((x - mean) / scale, -4, 4)
    parts = [np.ones((len(z), 1)), z]
    if squares:
        parts.append(z * z)
    return np.hstack(parts)


@dataclass(frozen=True)
class Model:
    """Coefficients of both views and of their calibrated combination."""

    scales: tuple
    thetas: tuple
    calibrated: tuple

    def designs(self, batch):
        (mt, st), (mm, sm) = self.scales
        return _design(_matrix(batch, "xt"), mt, st, True), _design(_matrix(batch, "xm"), mm, sm, False)

    def logits(self, batch):
        return [x @ t for x, t in zip(self.designs(batch), self.thetas)]


def train(rows: DataFrame, rule: CoTraining) -> Model | None:
    """Co-train on (xt, xm, label, fold); None unless both classes are labelled in both parts."""
    dt, dm = N_TEXT, rule.n_meta

    def counts(batch):
        y, fold = _column(batch, "label"), _column(batch, "fold")
        xt, xm = _matrix(batch, "xt"), _matrix(batch, "xm")
        classes = [((y == c) & ((fold == 0) == cal)).sum() for cal in (False, True) for c in (0, 1)]
        return np.concatenate([[len(y), *classes], xt.sum(0), (xt**2).sum(0), xm.sum(0), (xm**2).sum(0)])

    total = _sums(rows, counts)
    if not len(total) or not (total[1:5] > 0).all():
        return None
    n, own, cal = total[0], total[1:3], total[3:5]
    moments, at = [], 5
    for d in (dt, dm):
        mean = total[at : at + d] / n
        moments.append((mean, np.sqrt(np.maximum(total[at + d : at + 2 * d] / n - mean**2, 1e-6))))
        at += 2 * d
    first = Model(tuple(moments), (np.zeros(1 + 2 * dt), np.zeros(1 + dm)), ())

    def labelled(batch):
        y, fold = _column(batch, "label"), _column(batch, "fold")
        use = ~np.isnan(y) & (fold != 0)
        return np.where(use, y, 0.0), np.where(use, np.where(y == 1, 0.5 / own[1], 0.5 / own[0]), 0.0)

    def plain(batch):
        y, w = labelled(batch)
        return [(x, y, w) for x in first.designs(batch)]

    thetas = tuple(_fit(rows, plain, list(first.thetas), rule.steps, rule.l2))
    for _ in range(rule.rounds):
        teacher = Model(first.scales, thetas, ())

        def sure(batch, teacher=teacher):
            """What each view takes over: the other's confident labels of unlabelled rows."""
            free = np.isnan(_column(batch, "label"))
            return [(z > 0, free & (np.abs(z) >= rule.confident)) for z in teacher.logits(batch)[::-1]]

        def tally(batch):
            return np.array([(use & (y == c)).sum() for y, use in sure(batch) for c in (False, True)], np.float64)

        many = np.maximum(_sums(rows, tally).reshape(2, 2), 1)

        def taught(batch, sure=sure, many=many):
            y0, w0 = labelled(batch)
            found = []
            for x, (y1, use), m in zip(first.designs(batch), sure(batch), many):
                w1 = np.where(use, rule.pseudo_weight * 0.5 / np.where(y1, m[1], m[0]), 0.0)
                found.append((x, np.where(use, y1, y0), w0 + w1))
            return found

        thetas = tuple(_fit(rows, taught, list(thetas), rule.steps, rule.l2))
    both = Model(first.scales, thetas, ())

    def held(batch):
        y, fold = _column(batch, "label"), _column(batch, "fold")
        w = np.where(~np.isnan(y) & (fold == 0), 1 / cal.sum(), 0.0)
        zt, zm = both.logits(batch)
        one, y = np.ones(len(y)), np.nan_to_num(y)
        return [(np.column_stack(c), y, w) for c in ((one, zt), (one, zm), (one, zt, zm))]

    start = [np.array([0.0, 1.0]), np.array([0.0, 0.0]), np.array([0.0, 1.0, 0.0])]
    return Model(first.scales, thetas, tuple(_fit(rows, held, start, rule.steps, rule.l2)))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    rule: CoTraining = CoTraining(),
) -> DataFrame:
    """Per document: ``id_col``, its row hash, p_text, p_meta, score, kept.

    p_text and p_meta are the calibrated probabilities of a label of 1 from
    each view alone, score is their calibrated combination; kept says that it
    reaches ``rule.keep_at``. Texts without words score 0 and are not kept.
    Several labels of one id count by their mean; null labels and labels of
    unknown ids are ignored; missing metadata is a value of its own. Without
    labels of both classes there is no model: scores are null and every text
    with words is kept. Repeated rows get the same scores.
    """
    known = (
        labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_i"))
        .agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("double").alias("label"))
    )
    made = _features(docs, id_col, text_col, rule)
    rows = written(
        made.join(known, made[ID] == F.col("_i"), "left")
        .withColumn("fold", F.pmod(F.xxhash64(ID), F.lit(rule.folds)).cast("int"))
        .select(ID, ROW, "some", "xt", "xm", "label", "fold"),
        "features",
    )
    model = train(rows.select("xt", "xm", "label", "fold"), rule)
    result = [F.col(ID).alias(id_col), ROW]
    if model is None:
        unknown = [F.lit(None).cast("double").alias(c) for c in ("p_text", "p_meta", "score")]
        return rows.select(*result, *unknown, F.col("some").alias("kept"))

    def score(batches):
        for batch in batches:
            zt, zm = model.logits(batch)
            a, b, c = model.calibrated
            ps = [_odds(a[0] + a[1] * zt), _odds(b[0] + b[1] * zm), _odds(c[0] + c[1] * zt + c[2] * zm)]
            some = _column(batch, "some") > 0
            ps = [np.where(some, p, 0.0) for p in ps]
            yield pa.record_batch(
                [*batch.select([ID, ROW]).columns, *map(pa.array, ps), pa.array(some & (ps[2] >= rule.keep_at))],
                names=[ID, ROW, "p_text", "p_meta", "score", "kept"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    scored = rows.mapInArrow(score, f"{ID} {kind}, {ROW} long, p_text double, p_meta double, score double, kept boolean")
    return scored.select(*result, "p_text", "p_meta", "score", "kept")


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without the rows that the classifier rejects, all columns as they were."""
    bad = quality_scores(docs, labels, id_col, text_col, **kw).where(~F.col("kept"))
    return only_rows(docs, bad.select(F.col(id_col).alias(ID), ROW), "left_anti", id_col, text_col)

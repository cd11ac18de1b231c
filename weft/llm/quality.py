"""Quality classifier by co-training: a text view and a page-metadata view teach each other.

The text view holds figures of a text's bytes, words and lines and a hashed profile of its letter triples, no length; the metadata view
holds language, source and length. Both are worked out once for every document and stored. Both views are logistic regressions fitted
on the driver: on at most LABELLED labelled documents (those with the smallest hash of their id, half of each class), and on what the
exchange adds. In every round each view labels all unlabelled documents on the executors; the ADDED documents a class of which it is
most confident, among all of them, join the other view's training set with that label, if it is sure by CONFIDENT at least. A view that
is never so sure, as metadata that says nothing of quality, teaches nothing. Each view is then calibrated on labelled rows kept apart, a
last regression on the two calibrated log-odds combines them, and executors score every document on its whole text.

Defined results: null text, language or source count as empty, a null n_chars as the text's length; without labels of both
classes every document scores 1 and is kept; several labels of one document count as one, the smallest; repeated rows score alike and
are one document in training (which of several texts of one id is taken is the one with the smallest hash of its figures); ties in
confidence go by the hash of the id; a row without an id is scored but never trains; a very long text is a row of figures like any
other; an empty table gives no rows; columns that are not used pass through untouched.
"""

from __future__ import annotations

import heapq
import operator
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.common import Scratch, bounded_batches, checked_broadcast, own_worker

LABELLED, ROUNDS, ADDED = 12_000, 4, 300
#: Labelled ids up to which they are broadcast (8 bytes each).
MOST_MARKS = 2_000_000
#: Probability from which a view is confident, and the combined probability from which a document is kept.
CONFIDENT, KEEP = 0.97, 0.5
_PUNCT = b"|%*#$&!.,;:?\"'()<>/_-="
_SOURCES, _TRIPLES = 32, 128


def text_view(raw: bytes) -> list[float]:
    """Figures of a whole text: what its bytes, words and lines are like, and how often letters follow each other."""
    n = max(1, len(raw))
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    words = raw.split()
    m = max(1, len(words))
    distinct = len(set(words))
    again = sum(map(operator.eq, words, words[1:])) / m
    lines = raw.split(b"\n")
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    ends = sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines)
    b = np.frombuffer(raw.lower(), np.uint8).astype(np.uint32)
    triples = ((b[:-2] * np.uint32(31) + b[1:-1]) * np.uint32(131) + b[2:]) % np.uint32(_TRIPLES) if len(b) > 2 else np.zeros(0, np.int64)
    profile = np.bincount(triples, minlength=_TRIPLES) / max(1, len(triples))
    return [
        *profile, *(h[c] for c in _PUNCT), h[97:123].sum(), h[65:91].sum(), h[48:58].sum(), h[128:].sum(), h[32], h[10], h[:10].sum(),
        again, float(again > 0.2), distinct / m, np.log1p(m / max(1, distinct)), float(lengths.mean()), float(lengths.std()), float((lengths <= 3).mean()), float((lengths >= 15).mean()),
        len(words) / len(lines) / 50, ends / len(lines), len(set(lines)) / len(lines), np.log1p(h[65:91].sum() / max(1e-4, h[97:123].sum())),
    ]


def meta_view(lang: str | None, source: str | None, n_chars: int | None, length: int) -> list[float]:
    """Figures of a document's metadata alone."""
    n = length if n_chars is None else max(0, n_chars)
    hot = [0.0] * (_SOURCES + 8)
    hot[zlib.crc32((source or "").encode()) % _SOURCES] = 1.0
    hot[_SOURCES + zlib.crc32((lang or "").encode()) % 8] = 1.0
    return [np.log1p(n), np.log1p(n) ** 2 / 10, float(n < 200), float(n > 20_000), *hot]


class Regression:
    """Logistic regression with a ridge penalty on standardised figures, by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0)
        self.scale[self.scale < 1e-9] = 1.0
        z = self._z(x)
        w = np.ones(len(y)) if weight is None else weight
        self.coef = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-3
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ self.coef, -30, 30)))
            grad = z.T @ (w * (p - y)) + penalty * self.coef
            step = np.linalg.solve((z * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty), grad)
            self.coef -= step
            if np.abs(step).max() < 1e-6:
                break

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        return np.clip(self._z(x) @ self.coef, -30, 30)


class Model:
    """Two calibrated views and what combines them.

    exchange(views, used): rows (view, label, doc_id, text, meta) of the unlabelled documents that each view is surest of.
    """

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, exchange: Callable[[list[Regression], set[int]], list]):
        apart = np.arange(len(y)) % 4 == 3
        if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
            apart = np.zeros(len(y), bool)
        fit = ~apart
        sets = {0: [text[fit], y[fit]], 1: [meta[fit], y[fit]]}
        used: set[int] = set()
        self.taught = [0, 0]
        for _ in range(ROUNDS):
            views = [Regression(*sets[v]) for v in (0, 1)]
            before = len(used)
            for r in exchange(views, used):
                if r.doc_id not in used:
                    used.add(r.doc_id)
                    self.taught[r.view] += 1
                    other = sets[1 - r.view]
                    other.append((np.frombuffer(r.meta if r.view == 0 else r.text, np.float32), float(r.label)))
            for v in (0, 1):
                if more := sets[v][2:]:
                    sets[v] = [np.vstack([sets[v][0], *(x for x, _ in more)]), np.append(sets[v][1], [label for _, label in more])]
            if len(used) == before:
                break
        self.text, self.meta = (Regression(*sets[v]) for v in (0, 1))
        check = apart if apart.any() else fit
        self.calibrated = [Regression(view.odds(x[check])[:, None], y[check]) for view, x in ((self.text, text), (self.meta, meta))]
        pair = self._pair(text[check], meta[check])
        # Together, no view may speak against itself: one that would is left out.
        self.used = [v for v in (0, 1) if Regression(pair, y[check]).coef[v] > 0] or [0, 1]
        self.both = Regression(pair[:, self.used], y[check])

    def _pair(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return np.stack([c.odds(v.odds(x)[:, None]) for c, v, x in zip(self.calibrated, (self.text, self.meta), (text, meta), strict=True)], axis=1)

    def scores(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Columns: text view, metadata view, combined; probabilities of good quality."""
        pair = self._pair(text, meta)
        return 1 / (1 + np.exp(-np.column_stack([pair, self.both.odds(pair[:, self.used])])))


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
    text = np.array([text_view(x) for x in raw], np.float32).reshape(len(raw), -1)
    rows = zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")), raw, strict=True)
    return text, np.array([meta_view(a, b, None if c is None else int(c), len(x)) for a, b, c, x in rows], np.float32).reshape(len(raw), -1)


_USED = ("doc_id", "text", "lang", "source", "n_chars")


def stored_views(docs: DataFrame) -> DataFrame:
    """doc_id and the two views' figures, as 32-bit floats in binary columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("quality")
        for batch in batches:
            views = (pa.array([row.tobytes() for row in v], pa.binary()) for v in _views(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *views], names=["doc_id", "text", "meta"])

    return docs.select(*_USED).mapInArrow(run, "doc_id long, text binary, meta binary")


def _figures(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1)


_CHOSEN = "view int, label int, sure double, place long, doc_id long, text binary, meta binary"


def _surest(free: DataFrame, views: list[Regression], used: set[int], added: int) -> list:
    """Of all unlabelled documents those that each view is surest of, at most added a class and view."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("quality")
        best: dict[tuple[int, int], list] = {(v, label): [] for v in (0, 1) for label in (0, 1)}
        for batch in batches:
            ids, places = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            for v in (0, 1):
                p = 1 / (1 + np.exp(-views[v].odds(_figures(batch.column(1 + v)))))
                for label, sure in ((1, p), (0, 1 - p)):
                    rows = [(-float(sure[i]), places[i], ids[i], batch, i) for i in np.flatnonzero(sure >= CONFIDENT).tolist() if ids[i] not in used]
                    # A task keeps what it may contribute: no more than could be chosen of it.
                    best[v, label] = heapq.nsmallest(added, best[v, label] + [(s, k, d, b.column(1)[j].as_py(), b.column(2)[j].as_py()) for s, k, d, b, j in heapq.nsmallest(added, rows, key=lambda r: r[:3])], key=lambda r: r[:3])
        rows = [(v, label, -s, k, d, t, m) for (v, label), found in best.items() for s, k, d, t, m in found]
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in _CHOSEN.split(", ")])

    order = [F.desc("sure"), "place", "doc_id"]
    nth = F.row_number().over(Window.partitionBy("view", "label").orderBy(*order))
    chosen = free.mapInArrow(run, _CHOSEN).withColumn("nth", nth).where(F.col("nth") <= added).collect()
    return sorted(chosen, key=lambda r: (r.view, r.label, r.nth))


def co_train(spark: SparkSession, docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, added: int = ADDED) -> tuple[Model | None, DataFrame]:
    """A model, or None where there aren't labels of both classes, and the stored views of all documents."""
    bounded_batches(spark)
    scratch = Scratch(spark, "quality")
    views = scratch.keep(stored_views(docs), "views")
    order = [F.xxhash64("doc_id"), "doc_id"]
    marks = scratch.keep(labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("y")), "marks")
    # Half of the sample from each class, so that the rarer one is well covered.
    ids = [marks.where(f"{cond}").orderBy(*order).limit(labelled // 2) for cond in ("y > 0.5", "y <= 0.5")]
    picked = views.join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")
    one = F.min(F.struct(F.xxhash64("text", "meta").alias("h"), "text", "meta", "y")).alias("r")
    rows = sorted(picked.groupBy("doc_id").agg(one).select("doc_id", "r.*").collect(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    y = np.array([float(r.y > 0.5) for r in rows])
    if len(set(y)) < 2:
        return None, views
    known = checked_broadcast(marks.select("doc_id"), marks.count(), MOST_MARKS)
    free = scratch.keep(views.where("doc_id is not null").join(known, "doc_id", "left_anti").withColumn("place", F.xxhash64("doc_id")), "free")
    text, meta = (np.array([np.frombuffer(r[v], np.float32) for r in rows], np.float64) for v in ("text", "meta"))
    model = Model(text, meta, y, lambda regressions, used: _surest(free, regressions, used, added))
    scratch.drop("free", "marks")
    return model, views


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model | None:
    return co_train(spark, docs, labels, labelled)[0]


SCHEMA = "doc_id long, text_score double, meta_score double, quality_score double, kept boolean"


def score_views(views: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """Scores of stored views: one row a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("quality")
        for batch in batches:
            s = model.scores(_figures(batch.column(1)), _figures(batch.column(2))) if model is not None and batch.num_rows else np.ones((batch.num_rows, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in s.T.copy()), pa.array(s[:, 2] >= keep)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return views.select("doc_id", "text", "meta").mapInArrow(run, SCHEMA)


def score_quality(docs: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    return score_views(stored_views(docs), model, keep)


def keep_good(docs: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """The rows of docs that the classifier keeps, all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("quality")
        for batch in batches:
            yield batch.filter(pa.array(model.scores(*_views(batch))[:, 2] >= keep)) if model is not None and batch.num_rows else batch

    return docs.mapInArrow(run, docs.schema)

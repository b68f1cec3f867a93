"""Quality classifier by co-training of two views of a document.

The content view sees the text alone (shape of words, repetition, characters), the metadata view sees language, source
and length alone. Both start from the labelled rows. In each round every unlabelled document of which a view is sure gets
its label for the other view: one pass of Spark over the features of all of them sums, for each view and class, the
gradient and the Gram matrix of the rows the other view is sure of, and a Newton step on the labelled rows with these
sums gives the next weights. The handed rows of both classes together weigh at most as much as the labelled rows times
the number of the round, in the proportion of the labelled classes, so many of them count a little each. Both views are
then calibrated on labelled rows that no training saw, and their log odds are added, less the prior that both hold.

Only the labelled rows are a bounded sample: at most ``LABELLED`` documents, the ones whose ids hash lowest, so the same
ones on every run. All other documents can hand on a label, and every document is scored. The features of each whole
text are worked out once and written; texts are never shuffled.

Defined results: a null text counts as empty, null metadata as a value of its own. A document with several labels has
their rounded mean. Repeated rows are scored one by one; of labelled rows that share an id the one whose features hash
lowest is learned from. Without labels, or with labels of one class only, a view's
probability is the smoothed share of good labels (one half without any). An empty table gives an empty result. Further
columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .shared import ascii_words, staged, takes_over

LABELLED = 8_000
ROUNDS = 5
#: Confidence at which a view hands a label on.
SURE = 0.95
#: Tasks that add up the sums of all tasks; one more adds up theirs, so the driver gets four sums a round.
ADDERS = 64
#: Share of the labelled sample that is kept for calibration, in 1000.
HELD = 250
RIDGE = 1.0
THRESHOLD = 0.5

SHAPES = 128
STATS = 16
SOURCES, LANGS, LENGTHS = 128, 32, 24
CONTENT, METADATA = STATS + SHAPES, SOURCES + LANGS + LENGTHS + 1

_SHAPE = bytes.maketrans(
    bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(48, 58)) + bytes(range(128, 256)),
    b"X" * 26 + b"x" * 26 + b"9" * 10 + b"x" * 128)


def _shape(word: bytes) -> bytes:
    """Letters as x or X and digits as 9, runs of the same as one."""
    shown = word.translate(_SHAPE)
    return bytes(c for i, c in enumerate(shown) if not i or c != shown[i - 1])


_shapes: dict[bytes, int] = {}


def _shape_bin(word: bytes) -> int:
    shape = _shape(word)
    known = _shapes.get(shape)
    if known is None:
        known = xxhash.xxh64_intdigest(shape) % SHAPES
        if len(_shapes) < 50_000:
            _shapes[shape] = known
    return known


def content_features(text: str | None) -> np.ndarray:
    data = (text or "").encode()
    words = ascii_words(data)
    n, size = max(1, len(words)), max(1, len(data))
    counts = Counter(words)
    out = np.zeros(CONTENT)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    share = lambda chars: (len(data) - len(data.translate(None, chars))) / size
    out[:STATS] = (
        math.log1p(len(words)) / 10, math.log1p(size) / 12, len(data) / n / 10, len(counts) / n, max(counts.values(), default=0) / n,
        pairs / n, share(bytes(range(65, 91))), share(bytes(range(48, 58))), share(b"#*$%&|<>"), share(b".,;:"), share(b"!?"),
        share(b"|"), math.log1p(len(lines)) / 8, 1 - len(set(lines)) / max(1, len(lines)), math.log1p(size / max(1, len(lines))) / 10,
        share(bytes(range(128, 256))))
    shapes: Counter = Counter()
    for word, c in counts.items():
        shapes[_shape_bin(word)] += c
    for b, c in shapes.items():
        out[STATS + b] = math.sqrt(c / n)
    return out


def metadata_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(METADATA)
    out[xxhash.xxh64_intdigest(f"s{source}") % SOURCES] = 1
    out[SOURCES + xxhash.xxh64_intdigest(f"l{lang}") % LANGS] = 1
    size = max(0, n_chars or 0)
    out[SOURCES + LANGS + min(LENGTHS - 1, size.bit_length())] = 1
    out[-1] = math.log1p(size) / 12
    return out


@dataclass
class View:
    """Logistic regression on standardised features, with a calibration of its log odds."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1], -30, 30)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.raw(x) + self.shift, -12, 12)


@dataclass
class Sums:
    """What the rows handed to one view as one class add to a Newton step at the view's weights."""

    n: float
    gradient: np.ndarray
    gram: np.ndarray

    @classmethod
    def none(cls, size: int) -> Sums:
        return cls(0.0, np.zeros(size), np.zeros((size, size)))

    def add(self, other: Sums) -> None:
        self.n += other.n
        self.gradient += other.gradient
        self.gram += other.gram

    def to_bytes(self) -> bytes:
        return np.concatenate([[self.n], self.gradient, self.gram.ravel()]).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Sums:
        flat = np.frombuffer(data)
        size = int(round((np.sqrt(4 * len(flat) - 3) - 1) / 2))
        return cls(float(flat[0]), flat[1 : size + 1].copy(), flat[size + 1 :].reshape(size, size).copy())


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, start: np.ndarray | None = None, handed: list[tuple[float, Sums]] = ()) -> np.ndarray:
    """Weights, intercept last, of ridge logistic regression. ``handed`` are weighted sums taken at ``start``."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gram = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        slope = x.T @ (p - y) + penalty * w
        for weight, sums in handed:
            gram += weight * sums.gram
            slope += weight * (sums.gradient + sums.gram @ (w - start))
        step = np.linalg.solve(gram, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> View:
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    return View(mean, scale, _newton((x - mean) / scale, y, ridge))


def calibrated(view: View, x: np.ndarray, y: np.ndarray) -> View:
    if 0 < y.sum() < len(y):
        w = _newton(view.raw(x)[:, None], y, 1e-2)
        if w[0] > 0:
            view.slope, view.shift = float(w[0]), float(w[1])
    return view


@dataclass
class Model:
    views: tuple[View, View] | None
    prior: float
    #: (from view, rows handed on) of every round.
    handed: list[tuple[int, int]]

    def logits(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log odds by content, by metadata, and of both."""
        if self.views is None:
            flat = np.full(len(content), self.prior)
            return flat, flat, flat
        a, b = (v.logit(x) for v, x in zip(self.views, (content, metadata), strict=True))
        return a, b, a + b - self.prior


def pool_sums(views: tuple[View, View], x: tuple[np.ndarray, np.ndarray], sure: float = SURE) -> list[Sums]:
    """For each view, first of the bad and then of the good rows the other view is sure of: what they add to its Newton step."""
    odds = np.log(sure / (1 - sure))
    out = []
    for v in (0, 1):
        view, said = views[v], views[1 - v].logit(x[1 - v])
        for label in (0, 1):
            rows = said >= odds if label else said <= -odds
            z = np.hstack([(x[v][rows] - view.mean) / view.scale, np.ones((int(rows.sum()), 1))])
            p = 1 / (1 + np.exp(-np.clip(z @ view.weights, -30, 30)))
            out.append(Sums(float(rows.sum()), z.T @ (p - label), (z * (p * (1 - p))[:, None]).T @ z))
    return out


def co_train(
    content: np.ndarray, metadata: np.ndarray, label: np.ndarray, held: np.ndarray, exchange: Callable[[tuple[View, View]], list[Sums]],
    rounds: int = ROUNDS,
) -> Model:
    """Labelled rows with ``label`` 0 or 1; ``held`` marks those for calibration alone. ``exchange`` gives :func:`pool_sums` of all others."""
    share = (label.sum() + 1) / (len(label) + 2)
    prior = float(np.log(share / (1 - share)))
    train, check = ~held, held
    if not 0 < label[train].sum() < train.sum():
        return Model(None, prior, [])
    if not 0 < label[check].sum() < check.sum():
        check = train
    x, y = (content, metadata), label[train].astype(float)

    def ready(v: int, view: View) -> View:
        view.slope, view.shift = 1.0, 0.0
        return calibrated(view, x[v][check], label[check].astype(float))

    views = (ready(0, fit(x[0][train], y)), ready(1, fit(x[1][train], y)))
    handed = []
    for turn in range(1, rounds + 1):
        sums = exchange(views)
        for v in (0, 1):
            bad, good = sums[2 * v], sums[2 * v + 1]
            handed.append((1 - v, int(bad.n + good.n)))
            if not (bad.n and good.n):
                continue
            total = min(good.n / share, bad.n / (1 - share), turn * len(y))
            weights = [(total * (1 - share) / bad.n, bad), (total * share / good.n, good)]
            view = views[v]
            view.weights = _newton((x[v][train] - view.mean) / view.scale, y, RIDGE, view.weights, weights)
            ready(v, view)
        if not any(n for _, n in handed[-2:]):
            break
    return Model(views, prior, handed)


def _parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[:, :CONTENT], x[:, CONTENT:]


def _rows(column: pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), "<f4").astype(np.float64).reshape(len(values), CONTENT + METADATA)


def _featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    takes_over("cotraining", _shapes.clear)
    for batch in batches:
        content = [content_features(t.as_py()) for t in batch.column("text")]
        metadata = [metadata_features(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)]
        both = [np.concatenate(r).astype("<f4").tobytes() for r in zip(content, metadata, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(both, pa.binary())], names=["doc_id", "x"])


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and x (features of both views) of every document, written once."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))
    return staged(rows.mapInArrow(_featured, "doc_id long, x binary"), "features")


def _added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, Sums] = {}
    for batch in batches:
        for slot, data in zip(batch.column("slot").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            part = Sums.from_bytes(data)
            if slot in total:
                total[slot].add(part)
            else:
                total[slot] = part
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([s.to_bytes() for s in total.values()], pa.binary())], names=["slot", "sums"])


def _exchange(pool: DataFrame, views: tuple[View, View], sure: float) -> list[Sums]:
    """:func:`pool_sums` over all rows of ``pool``; tasks add up their own rows, and few tasks add up all of these."""
    sizes = (CONTENT + 1, METADATA + 1)

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [Sums.none(sizes[v]) for v in (0, 1) for _ in (0, 1)]
        for batch in batches:
            if batch.num_rows:
                for mine, part in zip(total, pool_sums(views, _parts(_rows(batch.column("x"))), sure), strict=True):
                    mine.add(part)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(4), pa.int32()), pa.array([s.to_bytes() for s in total], pa.binary())], names=["slot", "sums"])

    shape = "slot int, sums binary"
    parts = pool.select("x").mapInArrow(summed, shape).repartition(ADDERS).mapInArrow(_added, shape)
    parts = parts.repartition(1).mapInArrow(_added, shape).collect()
    out = [Sums.none(sizes[v]) for v in (0, 1) for _ in (0, 1)]
    for slot, data in sorted((r[0], bytes(r[1])) for r in parts):
        out[slot].add(Sums.from_bytes(data))
    return out


def train_on(features: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = LABELLED, rounds: int = ROUNDS, sure: float = SURE) -> Model:
    """Model from :func:`featured` rows; ``labels`` has doc_id and ``label`` (0 or 1)."""
    marks = checkpointed(labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("__id")).agg(
        F.round(F.avg(label)).cast("int").alias("label")))
    known = features.join(marks, F.col("doc_id") == F.col("__id")).groupBy("doc_id", "label").agg(F.min_by("x", F.xxhash64("x")).alias("x"))
    got = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).collect()
    got.sort(key=lambda r: r[0])
    x = np.array([np.frombuffer(r[2], "<f4") for r in got], np.float64).reshape(-1, CONTENT + METADATA)
    y = np.array([r[1] for r in got], np.int64)
    held = np.array([xxhash.xxh64_intdigest(str(r[0]), 1) % 1000 < HELD for r in got], bool)
    pool = staged(features.join(marks.select("__id"), F.col("doc_id") == F.col("__id"), "left_anti").select("x"), "pool")
    return co_train(*_parts(x), y, held, lambda views: _exchange(pool, views, sure), rounds)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = LABELLED) -> Model:
    return train_on(featured(docs), labels, label, labelled)


def scored_features(features: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_content, p_metadata, score (probability of good by both views) and kept of every row of :func:`featured`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [1 / (1 + np.exp(-z)) for z in model.logits(*_parts(_rows(batch.column("x"))))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x) for x in p), pa.array(p[2] >= threshold)],
                names=["doc_id", "p_content", "p_metadata", "score", "kept"])

    return features.mapInArrow(run, "doc_id long, p_content double, p_metadata double, score double, kept boolean")


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    return scored_features(featured(docs), model, threshold)


def classified(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Train on the labels and all documents, and score all documents; their features are worked out once."""
    features = featured(docs)
    return scored_features(features, train_on(features, labels, label))

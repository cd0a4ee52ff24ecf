"""Classifiers of dot patterns: one logistic regression per dot.

``fit`` is Spark's own training. ``fit_best`` trains the six dots together, an
epoch a pass over all rows, with validation, a falling rate, an early stop and
the best state kept; it can be exported as ONNX. Images reach both as arrays of
features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dotframe.functions.encode import logits_to_bits, mirror_bits
from dotframe.operators.evalm import bce
from dotframe.operators.kernels import planar, resize
from dotframe.operators.photo import pixels_of

#: Sides of a crop as the classifier takes it.
SIZE = 64


@dataclass
class DotClassifier:
    models: list[LogisticRegressionModel]

    def logits(self, rows: DataFrame, features: str = "features") -> DataFrame:
        """Adds ``logits`` (six) and ``pred_bits``. The linear form is a column
        expression, so scoring needs no Python."""
        x = F.transform(features, lambda v: v.cast("double"))
        one = [_linear(x, m) for m in self.models]
        return rows.withColumn("logits", F.array(*one)).withColumn("pred_bits", logits_to_bits(F.col("logits")))

    def save(self, path: str) -> None:
        for i, m in enumerate(self.models, 1):
            m.write().overwrite().save(f"{path}/dot{i}")

    @staticmethod
    def load(path: str) -> DotClassifier:
        return DotClassifier([LogisticRegressionModel.load(f"{path}/dot{i}") for i in range(1, 7)])


def _linear(x: Column, model: LogisticRegressionModel) -> Column:
    weights = F.array(*[F.lit(float(v)) for v in model.coefficients])
    terms = F.zip_with(x, weights, lambda a, b: a * b)
    base = min(max(float(model.intercept), -30.0), 30.0)  # infinite for a constant dot
    return F.aggregate(terms, F.lit(base), lambda s, t: s + t)


def fit(rows: DataFrame, features: str = "features", bits: str = "bits6", epochs: int = 30, strength: float = 1e-3) -> DotClassifier:
    """Fits all six dots on rows with features (array) and bits6. A dot that is
    always or never raised gets a constant."""
    some = rows.where(F.col(bits).rlike("^[01]{6}$")).select(array_to_vector(F.transform(features, lambda v: v.cast("double"))).alias("x"), bits)
    models = []
    for i in range(1, 7):
        label = some.withColumn("label", F.substring(bits, i, 1).cast("double"))
        models.append(LogisticRegression(featuresCol="x", maxIter=epochs, regParam=strength, family="binomial").fit(label))
    return DotClassifier(models)


def log_rows(classifier: DotClassifier) -> list[dict]:
    """(dot, iteration, loss) of the training, as its log file has them."""
    return [
        {"dot": i, "epoch": k, "train_loss": loss}
        for i, m in enumerate(classifier.models, 1)
        if m.hasSummary
        for k, loss in enumerate(m.summary.objectiveHistory)
    ]


def evaluate(classifier: DotClassifier, rows: DataFrame, bits: str = "bits6") -> DataFrame:
    """One row: loss, dot and cell accuracy."""
    scored = classifier.logits(rows).withColumn("ok", (F.col("pred_bits") == F.col(bits)).cast("int"))
    dots = scored.select("ok", bits, F.posexplode("logits").alias("at", "x")).withColumn("y", F.expr(f"cast(substring({bits}, at + 1, 1) as int)"))
    hit = ((F.col("x") > 0) == (F.col("y") == 1)).cast("int")
    return dots.agg(F.avg(bce(F.col("x"), F.col("y"))).alias("loss"), F.avg(hit).alias("dot_acc"), F.avg("ok").alias("cell_acc"))




@dataclass
class LinearDots:
    """Six logits as a linear form of the features, and the training's log."""

    weights: np.ndarray  # features by dots
    bias: np.ndarray
    log: list[dict] = field(default_factory=list)

    def __call__(self, batch: np.ndarray) -> np.ndarray:
        return np.asarray(batch).reshape(len(batch), -1) @ self.weights + self.bias

    def save(self, path: str) -> None:
        np.savez(path, weights=self.weights, bias=self.bias)

    @staticmethod
    def load(path: str) -> LinearDots:
        with np.load(path) as f:
            return LinearDots(f["weights"], f["bias"])


def _pass_over(rows: DataFrame, model: LinearDots, features: str, bits: str) -> tuple[np.ndarray, np.ndarray, dict]:
    """(gradient of the weights, of the bias, measures) over all rows: a task
    sends one row of sums, whatever it reads."""
    w, b = model.weights, model.bias

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(w.size + b.size + 4)
        for pdf in it:
            if len(pdf):
                x = np.stack(pdf[features].to_numpy()).astype(float)
                y = np.array([[float(c) for c in s] for s in pdf[bits]])
                z = x @ w + b
                off = 1 / (1 + np.exp(-z)) - y
                loss = np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))
                hit = (z > 0) == (y == 1)
                sums += np.r_[(x.T @ off).ravel(), off.sum(axis=0), loss.mean(axis=1).sum(), hit.mean(axis=1).sum(), hit.all(axis=1).sum(), len(x)]
        yield pd.DataFrame({"sums": [sums.tolist()]})

    parts = rows.select(features, bits).mapInPandas(run, "sums array<double>")
    every = parts.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).toPandas()  # as many as weights
    total = np.zeros(w.size + b.size + 4)
    total[every["at"]] = every["v"]
    n = max(1.0, total[-1])
    measures = dict(zip(("loss", "dot_acc", "cell_acc"), total[-4:-1] / n))
    return total[: w.size].reshape(w.shape) / n, total[w.size : -4] / n, measures


def fit_best(
    training: DataFrame, validation: DataFrame, features: str = "features", bits: str = "bits6", epochs: int = 30, rate: float = 1e-3, patience: int = 5, stop: int = 10,
    checkpoint: str | None = None,
) -> LinearDots:
    """The state of the lowest validation loss of at most ``epochs`` epochs by
    Adam. The rate is halved where the loss hasn't fallen for ``patience``
    epochs, and training ends where it hasn't for ``stop``. Each best state is
    written to ``checkpoint``. The log has a row an epoch."""
    sound = lambda df: df.where(F.col(bits).rlike(r"\A[01]{6}\z") & F.col(features).isNotNull())
    training, validation = sound(training), sound(validation)
    first = training.select(F.size(features)).first()
    now = LinearDots(np.zeros((first[0] if first else 1, 6)), np.zeros(6))
    best, lowest, since, log = now, np.inf, 0, []
    moments = [np.zeros_like(v) for v in (now.weights, now.bias) for _ in range(2)]
    for epoch in range(1, epochs + 1):
        *slopes, seen = _pass_over(training, now, features, bits)
        state = []
        for k, (v, g) in enumerate(zip((now.weights, now.bias), slopes)):
            moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * g
            moments[2 * k + 1] = 0.999 * moments[2 * k + 1] + 0.001 * g * g
            mean, spread = moments[2 * k] / (1 - 0.9**epoch), moments[2 * k + 1] / (1 - 0.999**epoch)
            state.append(v - rate * mean / (np.sqrt(spread) + 1e-8))
        now = LinearDots(*state)
        *_, held = _pass_over(validation, now, features, bits)
        log.append({"epoch": epoch, "train_loss": seen["loss"], "val_loss": held["loss"], "val_dot_acc": held["dot_acc"], "val_cell_acc": held["cell_acc"], "rate": rate})
        since += 1
        if held["loss"] < lowest:
            best, lowest, since = now, held["loss"], 0
            if checkpoint:
                best.save(checkpoint)
        elif since % patience == 0:
            rate /= 2
        if since >= stop:
            break
    best.log = log
    return best


def write_log(log: list[dict], path: str) -> None:
    pd.DataFrame(log).to_csv(path, index=False)


# ONNX ----------------------------------------------------------------------


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes | str) -> bytes:
    """A field of a protocol buffer: whole numbers, or bytes with their length."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def onnx_bytes(model: LinearDots) -> bytes:
    """The model as an ONNX file: ``input`` of any batch size and any shape of a
    row, ``logits`` of six; operator set 17. Field numbers are the format's."""
    n = model.weights.shape[0]

    def tensor(name: str, value: np.ndarray, kind: int) -> bytes:
        return b"".join(_field(1, d) for d in value.shape) + _field(2, kind) + _field(8, name) + _field(9, value.tobytes())

    def value(name: str, *dims: int | str) -> bytes:
        shape = b"".join(_field(1, _field(2, d) if isinstance(d, str) else _field(1, d)) for d in dims)
        return _field(1, name) + _field(2, _field(1, _field(1, 1) + _field(2, shape)))

    def node(kind: str, inputs: tuple, output: str) -> bytes:
        return b"".join(_field(1, i) for i in inputs) + _field(2, output) + _field(4, kind)

    graph = _field(1, node("Reshape", ("input", "shape"), "flat")) + _field(1, node("Gemm", ("flat", "weights", "bias"), "logits")) + _field(2, "dots")
    graph += _field(5, tensor("weights", model.weights.astype("<f4"), 1)) + _field(5, tensor("bias", model.bias.astype("<f4"), 1))
    graph += _field(5, tensor("shape", np.array([-1, n], dtype="<i8"), 7))
    graph += _field(11, value("input", "batch", n)) + _field(12, value("logits", "batch", 6))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 17))


def export_onnx(model: LinearDots, path: str) -> None:
    Path(path).write_bytes(onnx_bytes(model))


# Augmentation --------------------------------------------------------------

JITTER, TURN, SHIFT = 0.3, 5.0, 0.05


def augmented(rgb: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The image with brightness and contrast changed by up to 30 %, turned by
    up to 5 degrees and moved by up to 5 %, black where nothing comes from."""
    bright, contrast = rng.uniform(1 - JITTER, 1 + JITTER, 2)
    v = np.clip(rgb.astype(float) * bright, 0, 255)
    v = np.clip((v - v.mean()) * contrast + v.mean(), 0, 255)
    h, w = v.shape[:2]
    angle, (dx, dy) = np.deg2rad(rng.uniform(-TURN, TURN)), rng.uniform(-SHIFT, SHIFT, 2) * (w, h)
    y, x = np.indices((h, w), dtype=float)
    y, x = y - (h - 1) / 2 - dy, x - (w - 1) / 2 - dx
    sx, sy = np.cos(angle) * x + np.sin(angle) * y + (w - 1) / 2, np.cos(angle) * y - np.sin(angle) * x + (h - 1) / 2
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = (sx - x0)[..., None], (sy - y0)[..., None]
    padded = np.pad(v, ((1, 1), (1, 1), (0, 0)))
    at = lambda yy, xx: padded[np.clip(yy + 1, 0, h + 1), np.clip(xx + 1, 0, w + 1)]
    return (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy


def crop_dataset(crops: DataFrame, training: bool, seed: int = 0) -> DataFrame:
    """Features of crops (path, pixels, img_w, img_h, bits6) as a classifier
    takes them: every crop and, for training, its mirror image with the mirrored
    pattern, each augmented by a random state of its own that depends on path
    and seed only. Columns: path, flip, bits6, features."""
    both = crops.withColumn("flip", F.lit(False))
    if training:
        both = both.unionByName(crops.withColumn("bits6", mirror_bits(F.col("bits6"))).withColumn("flip", F.lit(True)))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for r in pdf.itertuples():
                image = pixels_of(r)[:, ::-1] if r.flip else pixels_of(r)
                if training:
                    image = augmented(image, np.random.default_rng([r.key & 0x7FFFFFFFFFFFFFFF, seed, int(r.flip)]))
                out.append((r.path, r.flip, r.bits6, planar(resize(image.astype(float), SIZE, SIZE), standardise=True).ravel().tolist()))
            yield pd.DataFrame(out, columns=["path", "flip", "bits6", "features"])

    some = both.select("path", "pixels", "img_w", "img_h", "bits6", "flip", F.xxhash64("path").alias("key"))
    return some.mapInPandas(run, "path string, flip boolean, bits6 string, features array<double>")

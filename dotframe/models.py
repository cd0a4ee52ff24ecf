"""The boundary to neural models: where artefacts are, and how they are called."""

from __future__ import annotations

import os
import re
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dotframe.functions.encode import logits_to_bits

DETECTIONS = "page_id long, tile_no int, cx double, cy double, w double, h double, conf double, bits string"


class ModelNotFound(FileNotFoundError):
    """No copy of a model artefact could be found or fetched."""


def resolve(name: str, beside: Path | None = None, cache: Path | None = None, url: str | None = None, scratch: Path | None = None) -> Path:
    """Place of an artefact: in the folder beside, in a scratch training
    folder, in the cache, or fetched into the cache by way of a partial file
    that is renamed when whole."""
    cache = cache or Path(os.environ.get("XDG_CACHE_HOME", Path.home() / ".cache")) / "dotframe"
    for folder in (beside, scratch, cache):
        if folder and (folder / name).is_file():
            return folder / name
    if not url:
        raise ModelNotFound(name)
    cache.mkdir(parents=True, exist_ok=True)
    part = cache / f"{name}.part"
    try:
        with urllib.request.urlopen(url) as r, part.open("wb") as f:  # noqa: S310
            while block := r.read(1 << 20):
                f.write(block)
        part.replace(cache / name)
    except OSError as e:
        part.unlink(missing_ok=True)
        raise ModelNotFound(f"{name}: {e}") from e
    return cache / name


def pinned(file: Path, name: str, base_url: str | None = None, **places: Path | None) -> Path:
    """``resolve`` at the version that a text file pins: artefacts of another
    version are kept apart in the cache, and are fetched from
    ``base_url``/version/name."""
    version = file.read_text().strip()
    if not re.fullmatch(r"[A-Za-z0-9._-]+", version):
        raise ValueError(f"no version in {file}")
    cache = places.pop("cache", None) or Path(os.environ.get("XDG_CACHE_HOME", Path.home() / ".cache")) / "dotframe"
    return resolve(name, cache=cache / version, url=f"{base_url.rstrip('/')}/{version}/{name}" if base_url else None, **places)


class Detector(Protocol):
    """detect(image) -> rows of cx, cy, w, h, conf; opened once per worker."""

    def detect(self, image: np.ndarray, least: float) -> np.ndarray: ...


def detect(tiles: DataFrame, open_model: Callable[[], Detector], least: float = 0.05, max_det: int = 2000) -> DataFrame:
    """Detections of every tile (page_id, tile_no, x0, y0, image), in page
    pixels; the confidence floor goes into the model's call."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = open_model()
        for pdf in it:
            rows = []
            for r in pdf.itertuples():
                found = np.asarray(model.detect(np.array([np.asarray(x) for x in r.image]), least), dtype=float).reshape(-1, 5)
                found = found[np.argsort(-found[:, 4], kind="stable")][:max_det]
                rows += [(r.page_id, r.tile_no, x + r.x0, y + r.y0, w, h, c, "000000") for x, y, w, h, c in found if c >= least]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DETECTIONS.split(", ")])

    return tiles.select("page_id", "tile_no", "x0", "y0", "image").mapInPandas(run, DETECTIONS)


def classify(crops: DataFrame, open_model: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """Replaces bits by the classifier's six logits over each crop; all crops
    of a batch go through the model together."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = open_model()
        for pdf in it:
            batch = np.stack([np.array([[np.asarray(x) for x in r] for r in im], dtype=np.float32) for im in pdf["crop"]])
            yield pdf.drop(columns=["crop"]).assign(logits=list(np.asarray(model(batch), dtype=float)))

    rest = [c for c in crops.columns if c not in ("crop", "bits")]
    schema = crops.select(*rest, F.array(F.lit(0.0)).alias("logits")).schema
    return crops.select(*rest, "crop").mapInPandas(run, schema).withColumn("bits", logits_to_bits(F.col("logits")))


def onnx_session(path: str) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """Opens an ONNX classifier in the worker."""

    def open_model() -> Callable[[np.ndarray], np.ndarray]:
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        return lambda batch: session.run(None, {name: batch})[0]

    return open_model

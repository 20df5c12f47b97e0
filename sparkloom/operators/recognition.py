"""Models on batches of crops: width classes, padded tensors, one model for each worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import pixels

#: Fixed values of the recogniser: height of a line, least and largest width of a batch; a step covers so many columns.
LINE_HEIGHT, LEAST_WIDTH, MOST_WIDTH, STEP = 48, 320, 3200, 8
#: Bytes of scaled lines that wait in a task for others of their class, at most.
HELD = 64 << 20


@dataclass(frozen=True)
class Model:
    """A model by a name that tells it from all others (with its version).

    ``make`` gives a function from a tensor (items, planes, rows, columns) to
    an array with a row for each item. A worker process calls it once, runs
    the result on zeros of shape ``warm``, and keeps it for all later tasks.
    """

    name: str
    make: Callable[[], Callable[[np.ndarray], np.ndarray]]
    warm: tuple[int, ...]


#: Of this worker process; no more than so many.
_RUNNING: dict[str, Callable[[np.ndarray], np.ndarray]] = {}
MOST_MODELS = 4


def running(model: Model) -> Callable[[np.ndarray], np.ndarray]:
    if model.name not in _RUNNING:
        made = model.make()
        made(np.zeros(model.warm, np.float32))
        while len(_RUNNING) >= MOST_MODELS:
            _RUNNING.pop(next(iter(_RUNNING)))
        _RUNNING[model.name] = made
    return _RUNNING[model.name]


def scaled_width(width: Column, height: Column, line_height: int = LINE_HEIGHT) -> Column:
    """A line's width at the recogniser's height; multiplies before dividing."""
    return F.ceil(line_height * width / height)


def width_class(width: Column, height: Column, grain: int = 64) -> Column:
    """The width of the batch that a line goes to: its own, within limits, up to the next multiple of ``grain``."""
    own = F.least(F.lit(MOST_WIDTH), F.greatest(F.lit(LEAST_WIDTH), F.ceil(LINE_HEIGHT * width / height / STEP) * STEP))
    return F.least(F.lit(MOST_WIDTH), F.ceil(own / grain) * grain).cast("int")


def char_runs(scores: np.ndarray) -> list[dict]:
    """Runs of the best class (the lowest of equals) of steps by classes, without blanks (0): class, first and last step, the first step's score."""
    best = scores.argmax(axis=1)
    first = np.flatnonzero(np.diff(best, prepend=-1))
    last = np.append(first[1:], len(best)) - 1
    return [{"class": int(best[a]), "t0": int(a), "t1": int(b), "score": float(scores[a, best[a]])} for a, b in zip(first, last) if best[a]]


def recognised(crops: DataFrame, keys: list[str], model: Model, classes: int, grain: int = 64, batch: int = 16) -> DataFrame:
    """The ``keys`` of crops (width, height, data), their width class ``wide``, the columns that are ``filled``, ``steps`` and ``chars``.

    Each task keeps the lines of a width class until they fill a batch (or all
    that wait take ``HELD`` bytes), so no pixel crosses the network; each is
    scaled to the line height, and zeros fill the rest of the tensor. The class
    depends on the line alone, so which lines share a batch changes nothing.
    Scores must be steps of so many ``classes``.
    """
    width, height = F.col("width"), F.col("height")
    wide = width_class(width, height, grain)
    filled = F.greatest(F.lit(1), F.least(wide, scaled_width(width, height))).cast("int")
    sized = crops.select(*keys, "width", "height", wide.alias("wide"), filled.alias("filled"), "data")
    n, kinds = len(keys), {c: crops.schema[c].dataType.simpleString() for c in keys}

    def answers(held: list[tuple], wide_: int) -> pa.RecordBatch:
        tensor = np.zeros((len(held), 3, LINE_HEIGHT, wide_), np.float32)
        for k, (_, used, planes) in enumerate(held):
            tensor[k, :, :, :used] = pixels.recogniser_tensor(planes)
        scores = np.asarray(running(model)(tensor))
        if scores.ndim != 3 or len(scores) != len(held) or scores.shape[2] != classes:
            raise ValueError(f"scores of shape {scores.shape} are no steps of {classes} classes for {len(held)} lines")
        rows = [dict(zip(keys, key)) | {"wide": wide_, "filled": used, "steps": scores.shape[1], "chars": char_runs(s)} for (key, used, _), s in zip(held, scores)]
        return pa.RecordBatch.from_pylist(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple]] = {}
        size = 0
        for part in batches:
            columns = [c.to_pylist() for c in part.columns[: n + 4]]
            for k, data in enumerate(part.column(n + 4)):
                w, h, wide_, used = (c[k] for c in columns[n:])
                image = pixels.image_of(data.as_py(), w, h)[..., :3]
                line = np.ascontiguousarray(pixels.resized(image, used, LINE_HEIGHT))
                waiting.setdefault(wide_, []).append((tuple(c[k] for c in columns[:n]), used, line))
                size += line.nbytes
                if len(waiting[wide_]) == batch or size > HELD:
                    most = wide_ if len(waiting[wide_]) == batch else max(waiting, key=lambda c: c * len(waiting[c]))
                    held = waiting.pop(most)
                    size -= sum(x.nbytes for *_, x in held)
                    yield answers(held, most)
        for wide_, held in waiting.items():
            yield answers(held, wide_)

    from pyspark.sql.pandas.types import to_arrow_schema

    char = "array<struct<class:int,t0:int,t1:int,score:double>>"
    ddl = ", ".join(f"`{c}` {kind}" for c, kind in kinds.items()) + f", wide int, filled int, steps int, chars {char}"
    schema = to_arrow_schema(crops.sparkSession.createDataFrame([], ddl).schema)
    return sized.mapInArrow(run, ddl)


def detected(images: DataFrame, image: str, model: Model) -> DataFrame:
    """The model's ``map`` (row by row) of each image at the size ``size``, with its ``wide`` and ``high``."""
    kind = images.schema[image].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            key, width, height, wide, high = (c.to_pylist() for c in part.columns[:5])
            for k, data in enumerate(part.column(5)):  # one by one: a map is as large as its image
                picture = pixels.resized(pixels.image_of(data.as_py(), width[k], height[k]), wide[k], high[k])
                scores = np.asarray(running(model)(pixels.detector_tensor(picture)[None]), np.float32).reshape(-1)
                if len(scores) != wide[k] * high[k]:
                    raise ValueError(f"{len(scores)} scores for {wide[k]} by {high[k]} pixels")
                columns = [part.column(0).slice(k, 1), pa.array([wide[k]], pa.int32()), pa.array([high[k]], pa.int32()), pa.array([scores], pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(columns, [image, "wide", "high", "map"])

    asked = images.select(image, "width", "height", F.col("size.width").cast("int").alias("wide"), F.col("size.height").cast("int").alias("high"), "data")
    return asked.mapInArrow(run, f"`{image}` {kind}, wide int, high int, map array<float>")


def cropped(images: DataFrame, frames: DataFrame, image: str) -> DataFrame:
    """The upright crop of each frame (image, place, frame): ``width``, ``height`` and ``data``. Each image is read once, with all its frames."""
    kind = images.schema[image].dataType.simpleString()
    listed = frames.groupBy(image).agg(F.collect_list(F.struct("place", "frame")).alias("frames"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            width, height, all_frames = (c.to_pylist() for c in part.columns[1:4])
            for k, data in enumerate(part.column(4)):
                picture = pixels.image_of(data.as_py(), width[k], height[k])
                for f in all_frames[k]:
                    crop = pixels.warped(picture, f["frame"])
                    columns = [part.column(0).slice(k, 1), pa.array([f["place"]], pa.int32()), pa.array([crop.shape[1]], pa.int32()), pa.array([crop.shape[0]], pa.int32()), pa.array([crop.tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, [image, "place", "width", "height", "data"])

    joined = images.join(listed, image).select(image, "width", "height", "frames", "data")
    return joined.mapInArrow(run, f"`{image}` {kind}, place int, width int, height int, data binary")

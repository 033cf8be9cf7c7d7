"""Recognition engines behind one interface; a model is loaded once a worker and fed Arrow batches.

No image library and no model comes with the engine; a recogniser is anything with `recognise(image, field)`.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK_INK = 0.004
SCHEMA = "page string, row_index int, field string, text string, confidence double, engine string, error string"


@dataclass
class Reading:
    text: str = ""
    confidence: float = 0.0


class Engine(ABC):
    """name, and recognise() for one cell's image."""

    name = "engine"

    @abstractmethod
    def recognise(self, image: bytes, field: str) -> Reading: ...


ENGINES: dict[str, Callable[[], Engine]] = {}


def register(name: str, make: Callable[[], Engine]) -> None:
    ENGINES[name] = make


def build(name: str) -> Engine:
    """A registered engine by its name."""
    if name not in ENGINES:
        raise KeyError(f"unknown engine {name!r}; known: {', '.join(sorted(ENGINES))}")
    return ENGINES[name]()


class Transcript(Engine):
    """Reads a cell whose image is its text in UTF-8: for tests, and for cells that were typed in."""

    name = "transcript"

    def recognise(self, image: bytes, field: str) -> Reading:
        text = image.decode("utf-8")
        return Reading({"survey": "".join(c for c in text if c.isdigit()), "meter": "".join(c for c in text.upper() if c.isascii() and c.isalnum())}.get(field, " ".join(text.split())), 1.0)


register("transcript", Transcript)


def recognise_cells(cells: DataFrame, make: Callable[[], Engine], blank: float = BLANK_INK) -> DataFrame:
    """cells: page, row_index, field, image, ink. Blank cells never reach the engine; an engine's error rides on its row."""
    empty = cells.filter(F.col("ink") < blank).select(
        "page", "row_index", "field", F.lit("").alias("text"), F.lit(0.0).alias("confidence"), F.lit("blank").alias("engine"), F.lit(None).cast("string").alias("error")
    )

    def run(batches):
        engine = make()
        for batch in batches:
            texts, sure, errors = [], [], []
            for image, field in zip(batch.column("image").to_pylist(), batch.column("field").to_pylist(), strict=True):
                try:
                    got, error = engine.recognise(image, field), None
                except Exception as e:  # noqa: BLE001 a page's failure is a value, not the job's
                    got, error = Reading(), str(e)
                texts.append(got.text)
                sure.append(float(got.confidence))
                errors.append(error)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page"), batch.column("row_index"), batch.column("field"), pa.array(texts, pa.string()), pa.array(sure, pa.float64()), pa.array([engine.name] * len(texts)), pa.array(errors, pa.string())],
                ["page", "row_index", "field", "text", "confidence", "engine", "error"],
            )

    inked = cells.filter(F.col("ink") >= blank).select("page", "row_index", "field", "image")
    return inked.mapInArrow(run, SCHEMA).unionByName(empty)

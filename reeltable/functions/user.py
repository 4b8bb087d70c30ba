"""User code over batches of frames or of raw tensors."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from reeltable.operators.decode import BOXES


def apply_python(df: DataFrame, module: str, function: str = "process_frame", cls: str | None = None, args: list | None = None, kwargs: dict | None = None, schema: str | None = None) -> DataFrame:
    """A user's function, or the method of a class that is made once a task with JSON arguments, over each row as a dict.

    It may change the dict; a return of False drops the row."""
    made = json.dumps([args or [], kwargs or {}])
    names = [c.strip().split()[0] for c in schema.split(",")] if schema else df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where = importlib.import_module(module)
        a, k = json.loads(made)
        call = getattr(getattr(where, cls)(*a, **k), function) if cls else getattr(where, function)
        for pdf in batches:
            rows = [r for r in pdf.to_dict("records") if call(r) is not False]
            yield pd.DataFrame(rows, columns=names)

    return df.mapInPandas(run, schema or df.schema)


def custom_converter(tensors: DataFrame, convert: Callable[[dict], list[dict]]) -> DataFrame:
    """A user's conversion of each raw output to detections (x_min, y_min, x_max, y_max, confidence, label_id)."""
    names = [c.split()[0] for c in BOXES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"stream_id": r["stream_id"], "frame_id": r["frame_id"], "roi_id": i, **d} for r in pdf.to_dict("records") for i, d in enumerate(convert(r))]
            yield pd.DataFrame(rows, columns=names)

    return tensors.mapInPandas(run, BOXES)

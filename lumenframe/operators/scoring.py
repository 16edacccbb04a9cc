"""UD-02: interchangeable batch scorers on one operator."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def score_batches(df: DataFrame, make_predict: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], fields: list[T.StructField]) -> DataFrame:
    """df with the columns that a predictor gives for each Arrow batch.

    make_predict runs once per Python worker and task, so that a model is built there
    and never shipped; filter df to the rows that need scoring beforehand."""
    schema = T.StructType([*df.schema.fields, *fields])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = make_predict()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *predict(b)], names=[*b.schema.names, *names])

    return df.mapInArrow(run, schema)


def linear_scorer(column: str, weights: list[float], places: int = 12) -> Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]]:
    """A weighted sum of a vector column, rounded."""

    def make():
        w = np.array(weights)

        def predict(batch: pa.RecordBatch) -> list[pa.Array]:
            vectors = batch.column(batch.schema.get_field_index(column)).to_pylist()
            return [pa.array([None if v is None else round(float(np.dot(np.array(v, dtype=float), w[: len(v)])), places) for v in vectors], pa.float64())]

        return predict

    return make

"""Run a user's prediction function over a table."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from glossaflow import patterns as P

def _outcome(error: Exception) -> str:
    out_of_memory = isinstance(error, MemoryError) or (
        type(error).__name__ == "OutOfMemoryError"
    )
    text = str(error).encode("utf-8", "replace").decode()
    return P.STATUS_OOM if out_of_memory else f"{P.STATUS_ERROR}{text}"


def predict_column(
    record: Column, make_predictor: Callable[[], Callable], returns: str = "string"
) -> Column:
    """Struct ``(prediction, status, latency_s)`` of one function call per record.

    ``make_predictor`` runs once per task and returns the function, so a model
    loads once however many rows the task holds. An exception, no answer, or an
    answer that is not of type ``returns`` gives the row an empty prediction (null
    unless ``returns`` is a string) and a status; it never fails the task. Null records are not sent to the function and come back null.
    Only ``record`` travels to Python, and a filter on the result does not make
    Spark call the function again.
    """
    schema = f"struct<prediction:{returns},status:string,latency_s:double>"
    arrow_type = to_arrow_type(DataType.fromDDL(schema))
    failed = "" if returns == "string" else None

    def call(predictor: Callable, value) -> dict | None:
        if value is None:
            return None
        began = time.perf_counter()
        try:
            prediction, status = predictor(value), P.STATUS_OK
            if prediction is None:
                raise ValueError("no prediction")
        except Exception as error:  # noqa: BLE001 - recorded as the row's status
            prediction, status = failed, _outcome(error)
        spent = round(time.perf_counter() - began, 3)
        return {"prediction": prediction, "status": status, "latency_s": spent}

    def converted(rows: list[dict | None]) -> pa.Array:
        """Rows as Arrow; one by one where an answer does not fit the type."""
        try:
            return pa.array(rows, type=arrow_type)
        except (pa.ArrowException, UnicodeError, TypeError, ValueError, OverflowError):
            parts = []
            for row in rows:
                try:
                    parts.append(pa.array([row], type=arrow_type))
                except (pa.ArrowException, UnicodeError, TypeError, ValueError, OverflowError) as error:
                    parts.append(pa.array([row | {"prediction": failed, "status": _outcome(error)}], type=arrow_type))
            return pa.concat_arrays(parts)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predictor = make_predictor()
        for batch in batches:
            rows = [call(predictor, value) for value in batch.to_pylist()]
            yield converted(rows)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returnType=schema).asNondeterministic()(record)


def batch_predict(
    df: DataFrame,
    record: Column,
    make_predictor: Callable[[], Callable],
    returns: str = "string",
) -> DataFrame:
    """``df`` with ``prediction``, ``status`` and ``latency_s`` of each record."""
    return (
        df.withColumn("_out", predict_column(record, make_predictor, returns))
        .select(*df.columns, "_out.*")
    )

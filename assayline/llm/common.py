"""Shared by the corpus operators: batches of Arrow rows, texts as bytes, written tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from assayline.session import scratch_folder, ship_package

#: Rows handed to a step at once; bounds the Python objects alive in a task besides the longest text.
BATCH_ROWS = 256

Step = Callable[[pa.RecordBatch], Sequence]

_kept: dict = {}  # of a Python worker: the call of its last step, and what it made


def kept(make: Callable, *values):
    """``make(*values)``, kept by a worker for its next tasks of this step.

    A worker outlives its stage; what it keeps goes when it begins another step (:func:`map_batches`), so tables and remembered
    words of the stages of a pipeline do not add up.
    """
    if (make, values) not in _kept:
        _kept.clear()
        _kept[make, values] = make(*values)
    _kept[None] = True  # used by the step that begins
    return _kept[make, values]


def _begun(make: Callable[[], Step]) -> Step:
    """The step, after dropping what the worker kept for another one."""
    _kept.pop(None, None)
    step = make()
    if None not in _kept:
        _kept.clear()
    return step


def map_batches(df: DataFrame, schema: T.StructType | str, make: Callable[[], Step]) -> DataFrame:
    """Apply a step to every batch of rows of ``df``.

    ``make`` runs once per task and returns the step; a step turns a record batch into
    one array or list per column of ``schema``.  Rows are independent, so a task that is
    lost with its executor is simply run again.
    """
    ship_package(df.sparkSession)
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = _begun(make)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                columns = step(batch.slice(start, BATCH_ROWS))
                arrays = [
                    column.cast(field.type) if isinstance(column, pa.Array) else pa.array(column, field.type)
                    for column, field in zip(columns, arrow, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    """Strings of a column; null is empty."""
    return [value or "" for value in column.to_pylist()]


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read from there.

    Later steps start from the files, so a lost executor costs no recomputation of what lies before.
    """
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Rows of a few numbers that are broadcast at most.
MOST_SHIPPED = 1_000_000


def shipped(df: DataFrame, most: int = MOST_SHIPPED) -> DataFrame:
    """A written table, marked for broadcast if it has few rows; with more, a join with it shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns, whatever characters their names hold."""
    return df.select(*[F.col(f"`{c}`") for c in columns])

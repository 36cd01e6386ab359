"""Reading sample tables and writing results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.plans.ordered import row_positions


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes null, so that aggregates skip it."""
    return df.select(
        [
            F.when(~F.isnan(f"`{f.name}`"), F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def read_samples(
    spark: SparkSession, path: str, id_col: str = "id", schema: T.StructType | str | None = None
) -> DataFrame:
    """Headed CSV whose unnamed first column is the id; an empty field is null."""
    reader = spark.read.option("header", True).option("nullValue", "")
    df = (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)
    first = df.columns[0]
    return nan_to_null(df.withColumnRenamed(first, id_col) if first in ("", "_c0") else df)


def read_delimited(
    spark: SparkSession, path: str, sep: str = " ", positions: Sequence[int] | None = None, prefix: str = ""
) -> DataFrame:
    """Headerless text table; columns picked by position and named ``{prefix}{position}``."""
    df = spark.read.csv(path, sep=sep, header=False, inferSchema=True)
    chosen = range(len(df.columns)) if positions is None else positions
    return nan_to_null(df.select([F.col(df.columns[p]).alias(f"{prefix}{n}") for n, p in enumerate(chosen)]))


def read_labels(spark: SparkSession, path: str, sep: str = ",", id_col: str = "id", label_col: str = "label") -> DataFrame:
    """Headerless (id, label) file."""
    df = read_delimited(spark, path, sep, [0, 1])
    return df.toDF(id_col, label_col)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def attach_labels(features: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """Labelled rows only, joined on the id."""
    return features.join(labels, id_col)


def sample_ids(df: DataFrame, order: Sequence[str], id_col: str = "sample") -> DataFrame:
    """Add ``sample_1``, ``sample_2``, ... along ``order``."""
    placed = row_positions(df, order, pos="_pos")
    name = F.concat(F.lit("sample_"), (F.col("_pos") + 1).cast("string"))
    return placed.withColumn(id_col, name).drop("_pos")


def row_index(df: DataFrame, order: Sequence[str], offset: int = 0, out: str = "row") -> DataFrame:
    """Add a 0-based row number along ``order``, plus ``offset``."""
    return row_positions(df, order, pos=out).withColumn(out, F.col(out) + offset)


def write_result(df: DataFrame, path: str, partition_by: Sequence[str] = (), kind: str = "csv") -> None:
    """Headed CSV (no quotes needed: arrays are not allowed) or parquet, one folder per hyperparameter value."""
    if kind == "csv":
        nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
        if nested:
            raise ValueError(f"CSV cannot hold nested columns {nested}")
        df.write.mode("overwrite").option("header", True).option("quote", "").partitionBy(*partition_by).csv(path)
    else:
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def hyperparameter_table(spark: SparkSession, values: dict[str, float], digits: int = 0) -> DataFrame:
    """Names and rounded values of the chosen hyperparameters: (name, value)."""
    table = spark.createDataFrame([(k, float(v)) for k, v in values.items()], "name string, value double")
    return table.withColumn("value", F.round("value", digits))

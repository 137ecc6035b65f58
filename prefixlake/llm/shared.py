"""What the operators share on the Spark side: input tables and tables in the shared folder."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixlake.session import on_workers, shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return on_workers(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken: list[str], name: str) -> str:
    """``name``, with as many underscores before it as it takes to be no column of ``taken``; case does not tell columns apart."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    """A column's name as a reference to it, whatever it holds."""
    return f"`{name.replace('`', '``')}`"


def packed(df: DataFrame) -> DataFrame:
    """``df`` as one struct column ``row``, so that no name of its columns can meet another in a join."""
    return df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"))


def unpacked(rows: pa.StructArray, names: list[str]) -> pa.RecordBatch:
    """The columns of :func:`packed` again, inside a task."""
    return pa.RecordBatch.from_arrays(rows.flatten(), names=names)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: columnar, so it is smaller than a checkpoint."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.parquet(path)

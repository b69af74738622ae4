"""Tables, staged results and small Arrow helpers of the operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.plans.stage import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few longs each that a join side may have to be broadcast.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` for a broadcast join if its known number of rows is small, else for a shuffled one."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def text_only(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with nulls as empty texts; whatever else the table carries stays behind."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def signed(values: np.ndarray) -> pa.Array:
    """Unsigned hashes as the signed longs that Spark has."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def per_row(values: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Integer sums of ``values`` by row."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    at = np.searchsorted(rows, np.arange(n_rows + 1))
    return total[at[1:]] - total[at[:-1]]

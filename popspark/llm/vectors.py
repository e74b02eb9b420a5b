"""What the vector searches share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

INFINITE = float("inf")


def usable(embedding: Column) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INFINITE))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) > 0) & fine, F.lit(False))


def matrix(column: pa.ChunkedArray, dtype: type = np.float64) -> np.ndarray:
    """A column of lists of one length as rows."""
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else lists.chunk(0)
    return np.asarray(lists.flatten()).astype(dtype).reshape(len(lists), -1)


def best(found: DataFrame, k: int) -> DataFrame:
    """Of (query_id, vec_id, score), each query's k highest scores with ranks from 1; ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

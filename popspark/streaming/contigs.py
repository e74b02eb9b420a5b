"""Blocks of contigs as their files arrive: contigs are independent, so each batch is counted by itself and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from popspark.operators import blocks, sites


def count_arrivals(spark: SparkSession, source: str, schema: StructType, n_haps: int, loci: int, target: str, checkpoint: str) -> StreamingQuery:
    """Parquet files of genotypes (chunk, pos, hap, allele) in ``source``, each with whole contigs, to pair counts in ``target``.

    It takes what is there and stops; called again, it takes what has come since. A batch that is run again after a failure
    replaces what it wrote, as each writes a folder of its own number.
    """
    arrivals = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        counts = blocks.pair_counts(sites.site_table(batch, n_haps), loci)
        counts.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

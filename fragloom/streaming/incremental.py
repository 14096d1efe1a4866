"""New scans as a stream: each batch of pictures is paired with all that came before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fragloom.operators.pairs import side_of, stem

FILE = "path string, modificationTime timestamp, length long, content binary"


def pair_new(spark: SparkSession, folder: str, known: str, pairs: str, checkpoint: str) -> StreamingQuery:
    """Read the pictures that have come to ``folder`` and append (side, a, b) to the table ``pairs``: new with known ones, and new ones among themselves.

    Runs until no new file is left. A batch that is repeated after a failure writes into its own folder again, so no pair is written twice.
    """
    new = spark.readStream.schema(FILE).format("binaryFile").option("pathGlobFilter", "*.png").load(folder).select(stem(F.col("path")).alias("frag_id"), side_of(F.col("path")).alias("side"))

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        fresh = batch.distinct()
        fresh.write.mode("overwrite").parquet(f"{known}/batch={number}")
        fresh = session.read.parquet(f"{known}/batch={number}")
        every = session.read.schema("frag_id string, side string, batch long").parquet(known).where(F.col("batch") <= number)
        a = fresh.select("side", F.col("frag_id").alias("new"))
        b = every.select("side", F.col("frag_id").alias("old"), "batch")
        t = a.join(b, "side").where((F.col("batch") < number) & (F.col("new") != F.col("old")) | (F.col("new") < F.col("old")))
        t.select("side", F.least("new", "old").alias("a"), F.greatest("new", "old").alias("b")).distinct().write.mode("overwrite").parquet(f"{pairs}/batch={number}")

    return new.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()

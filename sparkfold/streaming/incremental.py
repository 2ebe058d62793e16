"""New proteins against known ones, as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.alignment import AlignOptions, align_pairs


def align_batch(new: DataFrame, known: DataFrame, options: AlignOptions) -> DataFrame:
    """query_id, target_id, raw_sw_score, aligned_pairs of each new protein with each known one and with each later new one.

    A pair of names is formed once; proteins meet by an equi-join on hashed blocks, each protein copied once a block of partners.
    """
    blocks = 16
    part = F.pmod(F.xxhash64("input_id"), F.lit(blocks)).cast("int")
    every = known.select("input_id", "length", "embedding").withColumn("fresh", F.lit(False)).unionByName(new.select("input_id", "length", "embedding").withColumn("fresh", F.lit(True)))
    q = new.select(F.col("input_id").alias("query_id"), part.alias("qb")).withColumn("tb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    t = every.select(F.col("input_id").alias("target_id"), "fresh", part.alias("tb")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = q.join(t, ["qb", "tb"]).where(~F.col("fresh") | (F.col("query_id") < F.col("target_id")))
    pairs = pairs.select(F.xxhash64("query_id", "target_id").alias("pair_index"), F.xxhash64("query_id").alias("query_index"), F.xxhash64("target_id").alias("target_index"), "query_id", "target_id")
    found = align_pairs(pairs, every.select(F.xxhash64("input_id").alias("idx"), "length", "embedding"), options)
    return found.join(pairs.select("pair_index", "query_id", "target_id"), "pair_index").select("query_id", "target_id", "raw_sw_score", F.col("path.aligned_pairs").alias("aligned_pairs"))


def start(stream: DataFrame, known_path: str, result_path: str, checkpoint: str, options: AlignOptions, available_now: bool = True) -> StreamingQuery:
    """Aligns each micro-batch of proteins (input_id, length, embedding) with all known ones, then adds it to them.

    Results and new known proteins are written under the batch's number, which a replayed batch
    overwrites: each pair is there once.
    """

    def one(batch: DataFrame, epoch: int) -> None:
        spark: SparkSession = batch.sparkSession
        schema = "input_id string, length int, embedding array<float>, batch long"
        known = spark.read.schema(schema).option("recursiveFileLookup", "false").parquet(known_path).where(F.col("batch") < epoch)
        fresh = batch.select("input_id", "length", "embedding").dropDuplicates(["input_id"]).join(known.select("input_id"), "input_id", "left_anti")
        align_batch(fresh, known, options).write.mode("overwrite").parquet(f"{result_path}/epoch={epoch}")
        fresh.write.mode("overwrite").parquet(f"{known_path}/batch={epoch}")

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

"""Session plumbing shared by the corpus operators: tables, lineage cuts, guarded broadcasts."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters outside these six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"

#: Rows of a narrow table (under about 100 bytes each) that may be broadcast.
BROADCAST_ROWS = 100_000
#: Rows of one key that one task may read.
HOT_ROWS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it names none, as in local tests, a folder of the warehouse, which executors share too."""
    sc = spark.sparkContext
    return sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and reads it back from the shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def swept(df: DataFrame) -> DataFrame:
    """df, after Spark was led to remove the shuffle files and checkpoints that nothing refers to any more.

    It does so when the driver's JVM collects garbage, which comes late where much is shuffled and the driver holds little.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def stored(df: DataFrame) -> DataFrame:
    """Like cut, by a written table: for loops, since a checkpoint keeps what Catalyst knows of partitions and columns, which multiplies from round to round."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows, so that long texts don't pile up in a worker. Spark reads this when a job is planned, so it stays set; a smaller number stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row; plain reuse would inline it at each mention."""
    return F.transform(F.array(value), body)[0]


def lookup_join(df: DataFrame, small: DataFrame, on: list[str], spread: Column, how: str = "left", salts: int = 16) -> DataFrame:
    """Joins df with a table that has one row for each key and is usually small.

    Up to BROADCAST_ROWS rows are broadcast, after counting them. A larger table is joined by a shuffle, but for the
    hot keys of df: see hot_join.
    """
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(small), on, how)
    return hot_join(df, small, on, spread, how, salts)


def hot_join(df: DataFrame, keyed: DataFrame, on: list[str], spread: Column, how: str = "left", salts: int = 16, hot: int = HOT_ROWS) -> DataFrame:
    """Joins df with a table that has one row for each key (columns `on`, no nulls), however often df has a key.

    Keys are counted with partial sums. Those of more than `hot` rows (df's rows / hot at most) are few, and their rows of the
    table are broadcast after counting them; all other rows meet by a shuffle. Should the hot keys be too many
    to broadcast, they are copied once for each salt and df is dealt by (key, hash of `spread`). Cut both
    inputs before if they are dear.
    """
    frequent = cut(df.groupBy(on).count().where(F.col("count") > hot).select(on))
    n = frequent.count()
    if not n:
        return df.join(keyed, on, how)
    if n > BROADCAST_ROWS:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
        return salted.join(keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*on, "_salt"], how).drop("_salt")
    few = F.broadcast(frequent)
    crowd = df.join(few, on, "left_semi").join(F.broadcast(keyed.join(few, on, "left_semi")), on, how)
    rest = df.join(few, on, "left_anti").join(keyed.join(few, on, "left_anti"), on, how)
    return crowd.unionByName(rest)

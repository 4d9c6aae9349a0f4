"""Shared folder, written tables and small expression helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.shipping import ship

#: `[^\x20\x09-\x0D]+`: what counts as a word where a contract speaks of words.
WORD = r"[^\x20\x09-\x0D]+"


#: A key is hot if it holds more than one in so many of all rows: there are at most so many hot keys.
HOT_KEYS = 10_000
#: Rows that a key may hold anyway.
HOT_LEAST = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master a temporary one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spindrift-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet in the shared folder and read it back.

    The table outlives any executor, so a lost one costs only the reading again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spindrift_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a table that `written` made and that nothing reads any more."""
    path = getattr(df, "_spindrift_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shipped(df: DataFrame) -> DataFrame:
    """The same table, after this package was sent to the executors: for whatever runs Python there."""
    ship(df.sparkSession)
    return df


def spread_join(rows: DataFrame, values: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to `values`, which has one row a key and in `count` the rows that the key has; inner or left.

    The values of keys with over 1 / `HOT_KEYS` of all `total` rows are broadcast, at most `HOT_KEYS` rows, so that their
    rows stay where they are; the others are joined by shuffle, where no key fills a task.
    """
    hot = F.col(count) > max(HOT_LEAST, total // HOT_KEYS)
    carried = values.select(*keys, F.struct(*[c for c in values.columns if c not in keys]).alias("_v"), hot.alias("_hot"))
    few = carried.where("_hot").select(*keys, F.col("_v").alias("_w"))
    # Rows that have their values by now, and those with a null key, which find none, must not meet in one task of the
    # next join: they are dealt anew there.
    done = F.col("_w").isNotNull()
    for key in keys:
        done = done | F.col(key).isNull()
    tagged = rows.join(F.broadcast(few), keys, "left").withColumn("_deal", F.when(done, F.shiftright(F.xxhash64(*rows.columns), 8) * 2 + 1).otherwise(F.lit(0).cast("long")))
    joined = tagged.join(carried.where("not _hot").select(*keys, F.lit(0).cast("long").alias("_deal"), "_v"), [*keys, "_deal"], "left")
    out = joined.select(*rows.columns, F.coalesce("_w", "_v").alias("_v"))
    return (out if how == "left" else out.where("_v is not null")).select(*rows.columns, "_v.*")


def pairs_of_parts(rows: DataFrame, key: str, item: str, most: int) -> DataFrame:
    """Each row once for every pair of parts of its group that its part is in: columns p, q (p <= q) and side."""
    sizes = written(rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most), "sizes")
    parts = F.ceil(F.coalesce("_n", F.lit(1)) / most).cast("int")
    placed = spread_join(rows, sizes, [key], "_n", rows.count(), "left").withColumn("_c", parts).withColumn("_own", F.pmod(F.xxhash64(item), F.col("_c")).cast("int"))
    each = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    return each.select(*rows.columns, F.least("_own", "_o").alias("p"), F.greatest("_own", "_o").alias("q"), F.when(F.col("_own") <= F.col("_o"), 0).otherwise(1).alias("side"))


def hex64(fp: Column) -> Column:
    """A long as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

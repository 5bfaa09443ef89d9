"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: At most so many keys can each hold more than 1/HOT_KEYS of all rows.
HOT_KEYS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, a new folder on a local master, else an error."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="campaignry-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """The folder goes when the driver ends; until then results may read it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back. This cuts the lineage, and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    delete_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table that materialize() wrote and nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def text_or_empty(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column], F.lit(""))


def numbered(df: DataFrame, keys: list[str], bucket: str, order: list[Column], name: str) -> DataFrame:
    """Number the rows of each key from 0 in the order (bucket, order), without gaps.

    One key may hold any share of all rows: rows are sorted within (key, bucket), and only one row for each
    bucket goes through the window over a whole key. bucket must be a column of few rows for each value.
    """
    sizes = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(k).alias(f"_{k}") for k in (*keys, bucket)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    on = [df[k].eqNullSafe(starts[f"_{k}"]) for k in (*keys, bucket)]
    within = Window.partitionBy(*keys, bucket).orderBy(*order)
    return df.withColumn("_at", F.row_number().over(within)).join(starts, on).withColumn(name, F.col("_before") + F.col("_at") - 1).drop("_at", "_before", *[f"_{k}" for k in (*keys, bucket)])


def numbered_by_range(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Number the rows of each key from 0 in the order, without gaps; nulls come first.

    Rows are dealt and sorted by ranges of (keys, order), so a key of any share of all rows is split where its rows
    differ. Only one row for each key and range goes through a window.
    """
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_pos", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ranged").withColumn("_range", F.shiftright("_pos", 33))
    sizes = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_of"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    on = [ranged[k].eqNullSafe(starts[f"_{k}"]) for k in keys] + [ranged["_range"] == starts["_of"]]
    return ranged.join(starts, on).withColumn(name, F.col("_pos") + F.col("_shift")).drop("_pos", "_range", "_of", "_shift", *[f"_{k}" for k in keys])


def join_by_key(rows: DataFrame, of: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined with of, which has one row for each key, and in count the rows of that key.

    A key may hold any share of rows: those of more than 1/HOT_KEYS of all, at most HOT_KEYS keys by that share, are
    broadcast, so their rows stay where they are; the others are joined by a shuffle.
    """
    most = (of.agg(F.sum(count)).first()[0] or 0) / HOT_KEYS
    hot = F.broadcast(of.where(F.col(count) > most))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(of.where(F.col(count) <= most), key))


def free_name(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

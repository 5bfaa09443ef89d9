"""The folder that all executors share, tables written there, and saves that readers see whole or not at all."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def hadoop(spark: SparkSession, path: str) -> tuple:
    """The file system of path, and the path as it takes it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a new folder on a local master, else an error."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="campaignry-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> str:
    """Write df into a new folder, which goes when the driver ends, and return the folder."""
    folder = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for folders in _PASSING:
        folders.append(folder)
    df.write.parquet(folder)
    fs, path = hadoop(df.sparkSession, folder)
    fs.deleteOnExit(path)
    return folder


_PASSING: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that are written meanwhile go at the end, but for the folders taken out of the list that this gives."""
    _PASSING.append(folders := [])
    try:
        yield folders
    finally:
        del _PASSING[next(i for i, x in enumerate(_PASSING) if x is folders)]
        for folder in folders:
            fs, path = hadoop(spark, folder)
            fs.delete(path, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written and read again: its lineage ends there, whatever executors are lost."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def numbered(df: DataFrame, start: int, name: str) -> tuple[DataFrame, int]:
    """df, written once, with its rows numbered from start without gaps, and how many there are. Only a count for each file part goes through one window."""
    rows = kept(df.withColumn(name, F.monotonically_increasing_id()), name)  # 33 bits of place after the part's number
    parts = rows.groupBy(F.shiftright(name, 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min(name).alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = kept(parts.select("_part", (before + start - F.col("_first")).alias("_shift"), "_n"), "parts")
    out = rows.withColumn("_part", F.shiftright(name, 33)).join(parts.drop("_n"), "_part").withColumn(name, F.col(name) + F.col("_shift"))
    return out.select(*rows.columns), parts.agg(F.sum("_n")).first()[0] or 0


def discard(df: DataFrame) -> None:
    """Delete the folder of a table that kept() wrote and nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        fs, path = hadoop(df.sparkSession, folder)
        fs.delete(path, True)


class Unsound(ValueError):
    """Rows that break a rule, or rows that were lost; nothing of them was published."""


def write_sound(df: DataFrame, folder: str, rules: dict[str, Column] | None = None, by: tuple[str, ...] = (), rows: int | None = None) -> None:
    """Write df into folder. Rows that break a rule (true is a breach) are counted by the writing itself; if there is one, or the rows are not so many, the folder goes again."""
    seen = Observation(f"sound-{uuid.uuid4().hex}")
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count(F.when(broken, 1)).alias(f"rule {name}") for name, broken in (rules or {}).items()])
    dealt = watched.hint("rebalance", *by).write.partitionBy(*by) if by else watched.write  # a folder is one file, or a few where it is large
    dealt.parquet(folder)
    bad = [f"{n} rows with {k.removeprefix('rule ')}" for k, n in sorted(seen.get.items()) if k.startswith("rule ") and n]
    bad += [f"{seen.get['rows']} rows instead of {rows}"] if rows is not None and seen.get["rows"] != rows else []
    if bad:
        fs, path = hadoop(df.sparkSession, folder)
        fs.delete(path, True)
        raise Unsound(", ".join(bad))


def load_store(spark: SparkSession, root: str) -> DataFrame | None:
    """The rows of the last save under root, or None."""
    fs, root_path = hadoop(spark, root)
    if not fs.exists(root_path):
        return None
    done = [s.getPath().getName() for s in fs.listStatus(root_path) if s.getPath().getName().startswith("v")]
    return spark.read.parquet(f"{root}/{max(done)}") if done else None


def save_store(df: DataFrame, root: str, keep: int = 2, rules: dict[str, Column] | None = None, rows: int | None = None) -> str:
    """Save df as the next version under root: written aside, then renamed in one step, so a failed save leaves the last one.

    A row that breaks a rule, or a number of rows other than given, stops the save (see write_sound).

    Versions beyond the keep newest go; df may read from the last one.
    """
    fs, root_path = hadoop(df.sparkSession, root)
    fs.mkdirs(root_path)
    names = sorted(s.getPath().getName() for s in fs.listStatus(root_path) if s.getPath().getName().startswith("v"))
    number = int(names[-1][1:]) + 1 if names else 1
    aside, final = f"{root}/.new-{uuid.uuid4().hex}", f"{root}/v{number:08}"
    write_sound(df, aside, rules, rows=rows)
    if not fs.rename(hadoop(df.sparkSession, aside)[1], hadoop(df.sparkSession, final)[1]):
        raise RuntimeError(f"{final} is there already: another save came first")
    for old in [*names, f"v{number:08}"][:-keep]:
        fs.delete(hadoop(df.sparkSession, f"{root}/{old}")[1], True)
    return final

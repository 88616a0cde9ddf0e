"""What several operators share: scratch tables in the cluster's shared folder and prefix sums over blocks."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is set, a temporary one if all runs in one process, as in tests; else an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="reelspark-"))
    return sc.getCheckpointDir()


class Scratch:
    """Intermediate tables, written to the shared folder so that any executor can be lost afterwards.

    A table that no later step reads can be dropped at once. The rest stays while the driver
    runs, as a returned DataFrame may still read it, and goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.top = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.top)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.top}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, *saved: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in saved:
            path = jvm.org.apache.hadoop.fs.Path(self._paths.pop(id(df)))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def typed(df: DataFrame, **types: str) -> DataFrame:
    """Only these columns, under these types; a missing column counts as null."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[c.lower()]}`") if c.lower() in have else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def column(df: DataFrame, name: str, kind: str) -> Column:
    """The column of this name in any case, as a type; null if there is none."""
    have = {c.lower(): c for c in df.columns}
    return (F.col(f"`{have[name.lower()]}`") if name.lower() in have else F.lit(None)).cast(kind)


def beside(df: DataFrame, **own: Column) -> DataFrame:
    """Each row as a struct ``row`` beside columns of one's own, so that no name can clash."""
    return df.select(F.struct(*[f"`{c}`" for c in df.columns]).alias("row"), *[v.alias(k) for k, v in own.items()])


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that beside() packed."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns])


def fingerprint(text: str | Column) -> list[Column]:
    """h1 and h2, two longs that together stand for a text; null differs from the empty text."""
    value = (F.col(text) if isinstance(text, str) else text).cast("string")
    return [F.xxhash64(value).alias("h1"), F.coalesce(F.crc32(value), F.lit(-1)).cast("long").alias("h2")]


def blocks_for(rows: int, per_block: int = 2000) -> int:
    """At most as many blocks as rows in each, beyond the first few: neither grows faster than the root of ``rows``."""
    return max(1, -(-rows // max(per_block, math.isqrt(rows))))


def gapless(scratch: Scratch, df: DataFrame, within: list[str], first: list[str], ties: list[str], rows: int, name: str, weight: str | None = None) -> DataFrame:
    """Adds a number from 0 without gaps inside each group of ``within``; with ``weight``, the sum of that column over the rows before.

    Rows with a smaller ``first`` come earlier; inside those, the order is that of a hash of ``ties``.
    A group of any size is dealt over blocks; only the blocks' sums meet in one place, and both
    grow with the root of ``rows``. ``df`` must be a saved table, so both reads see the same rows.
    """
    block = F.pmod(F.xxhash64(*[F.col(c) for c in ties]), F.lit(blocks_for(rows)))
    keys = [*within, *first, "_block"]
    df = df.withColumn("_block", block).withColumn("_weight", F.col(weight) if weight else F.lit(1).cast("long"))
    counts = df.groupBy(*keys).agg(F.sum("_weight").alias("_n"))
    order = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    bases = scratch.save(counts.withColumn("_base", F.coalesce(F.sum("_n").over(before(order.orderBy(*first, "_block"))), F.lit(0))).drop("_n"))
    inside = Window.partitionBy(*keys).orderBy(*ties)
    ranked = df.withColumn("_row", F.coalesce(F.sum("_weight").over(before(inside)), F.lit(0)))
    left, right = ranked.alias("l"), bases.alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return left.join(right, same).select(*[f"l.{c}" for c in df.columns if c not in ("_block", "_weight")], (F.col("_base") + F.col("_row")).cast("long").alias(name))


def long_schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def percent(num: Column, den: Column) -> Column:
    return F.when(den > 0, num * F.lit(100) / den)

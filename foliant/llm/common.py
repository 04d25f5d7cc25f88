"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import lower_batches
from ..shared import shared_dir

#: Input of one Arrow batch handed to Python: rows and bytes, whichever comes first.
BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession, most_bytes: int = BATCH_BYTES) -> None:
    """Bound the Arrow batches that Python workers get, since a row may hold a long text."""
    lower_batches(spark, BATCH_ROWS, most_bytes)


def _give_back() -> None:
    """Return freed memory to the system, which workers kept for later tasks would hold."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over the batches of a task that leaves its worker small."""

    def inner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return inner


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends
    there and the rows survive the loss of any executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Shelf:
    """Tables written on the way to a result; ``clear`` deletes those that nothing reads any more."""

    def __init__(self):
        self.paths: list[tuple[SparkSession, str]] = []
        self.tables: list[tuple[SparkSession, str]] = []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(df.sparkSession, name)
        df.write.parquet(path)
        self.paths.append((df.sparkSession, path))
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, by: str, name: str) -> DataFrame:
        """df as a table in buckets of ``by``, one for each shuffle partition: moved once, and not
        again for joins on that column."""
        spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
        many, table_name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"foliant_{uuid.uuid4().hex}"
        df.repartition(many, by).write.format("parquet").bucketBy(many, by).sortBy(by).option("path", path).saveAsTable(table_name)
        self.paths.append((spark, path))
        self.tables.append((spark, table_name))
        return spark.table(table_name)

    def clear(self) -> None:
        for spark, name in self.tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = []
        for spark, path in self.paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        self.paths = []


#: Keys whose facts are broadcast, at most.
HOT_KEYS = 1000


def join_facts(rows: DataFrame, facts: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """rows with the facts (a written table, a row for each key) of their key; ``count`` names the
    number of rows of a key, or a bound in proportion to it, and is dropped. Keys that hold more
    than one in HOT_KEYS of all rows, fewer than HOT_KEYS therefore, are joined by broadcast, all
    others by a shuffle, in which no key is large."""
    total = facts.agg(F.sum(count)).first()[0] or 0
    hot = (F.col(count) * HOT_KEYS > total) & F.col(key).isNotNull()
    large = F.broadcast(facts.where(hot).drop(count))
    known = rows.join(large, key)
    others = rows.join(F.broadcast(facts.where(hot).select(key)), key, "left_anti").join(facts.where(~hot).drop(count), key, how)
    return known.unionByName(others)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Snapshots in hash buckets: a job writes the buckets it changes and no other.

``data/v=<version>/bucket=<n>`` under a table's root holds a bucket as that
version left it; ``manifest/v=<version>`` lists the version of every bucket that has
rows. A version is there once its manifest is, which is written last, and
nothing that an earlier version wrote is touched: readers keep what they
read, and a version that is written again becomes the same.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "bucket int, version long, buckets int, key string, schema string"


def bucket_of(column: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, root: str, version: int) -> list:
    """At most one row for each bucket, and one without a bucket that has the table's settings."""
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest/v={version}").collect()


def _settings(rows: list) -> tuple[int, str, T.StructType]:
    own = next(r for r in rows if r.bucket is None)
    return own.buckets, own.key, T.StructType.fromJson(json.loads(own.schema))


def _write_manifest(spark: SparkSession, root: str, version: int, held: dict[int, int], buckets: int, key: str, schema: str) -> None:
    rows = [(None, version, buckets, key, schema), *((b, v, None, None, None) for b, v in sorted(held.items()))]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/v={version}")


def _write_data(df: DataFrame, root: str, version: int, buckets: int, key: str) -> set[int]:
    """Writes rows by bucket; the buckets that got any."""
    path = f"{root}/data/v={version}"
    df.withColumn("bucket", bucket_of(key, buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    return {r.bucket for r in df.sparkSession.read.schema("bucket int").parquet(path).select("bucket").distinct().collect()}


def create(df: DataFrame, root: str, key: str, buckets: int, version: int = 0) -> None:
    """A new table: all rows, by the hash of ``key``."""
    held = _write_data(df, root, version, buckets, key)
    _write_manifest(df.sparkSession, root, version, dict.fromkeys(held, version), buckets, key, df.schema.json())


def buckets_of(rows: DataFrame, column: str, buckets: int) -> list[int]:
    """The buckets that the values of a column belong to; one number for each bucket at most."""
    return sorted(r.b for r in rows.select(bucket_of(column, buckets).alias("b")).distinct().collect())


def _opened(spark: SparkSession, root: str, rows: list, only: Iterable[int] | None) -> DataFrame:
    wanted = None if only is None else set(only)
    paths = [f"{root}/data/v={r.version}/bucket={r.bucket}" for r in rows if r.bucket is not None and (wanted is None or r.bucket in wanted)]
    schema = _settings(rows)[2]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str, version: int, only: Iterable[int] | None = None) -> DataFrame:
    """A version's rows, of all buckets or of some."""
    return _opened(spark, root, _manifest(spark, root, version), only)


def part(rows: DataFrame, column: str, root: str, version: int) -> tuple[list[int], DataFrame]:
    """The buckets that some values belong to, and what they hold."""
    spark = rows.sparkSession
    listed = _manifest(spark, root, version)
    only = buckets_of(rows, column, _settings(listed)[0])
    return only, _opened(spark, root, listed, only)


def publish(df: DataFrame, root: str, version: int, only: Iterable[int]) -> None:
    """The next version: ``df`` has all rows of the buckets ``only``, the others stay as version - 1 has them."""
    spark = df.sparkSession
    before = _manifest(spark, root, version - 1)
    n, key, schema = _settings(before)
    only = set(only)
    held = {r.bucket: r.version for r in before if r.bucket is not None and r.bucket not in only}
    if only:
        held |= dict.fromkeys(_write_data(df.select(*[F.col(f.name).cast(f.dataType) for f in schema]), root, version, n, key), version)
    _write_manifest(spark, root, version, held, n, key, schema.json())


def carry(spark: SparkSession, root: str, version: int) -> None:
    """The next version of a table that stays as it is."""
    before = _manifest(spark, root, version - 1)
    n, key, schema = _settings(before)
    _write_manifest(spark, root, version, {r.bucket: r.version for r in before if r.bucket is not None}, n, key, schema.json())

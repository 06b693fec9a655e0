"""Helpers that several corpus operators share: tables, words, written tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters between words: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
#: Java pattern of the same characters.
WHITE_RUN = "[\\x20\\x09-\\x0D]+"


def shipped(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once for each context, as ``--py-files`` would."""
    if getattr(spark.sparkContext, "_rolesift_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp(prefix="rolesift-")) / "rolesift_package.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(at))
    spark.sparkContext._rolesift_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Named columns of one table; nothing else of it is read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local master may do without the setting: there one process holds
    driver and executors, and a temporary folder serves.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = tempfile.mkdtemp(prefix="rolesift-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder: lineage ends there.

    Lost executors cost nothing that was written, and later readers prune
    columns and push filters into the files.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in order; null has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE_RUN))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows: what a task makes of one is held at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def bitmap(keys: DataFrame, least_bits: int = 20, most_bits: int = 30):
    """A broadcast bit for each key: 32 bits a key, 2**most_bits bits at most. Keys that are not there hit one now and then."""
    bits = min(most_bits, max(least_bits, int(keys.count() * 32).bit_length()))
    small = min(bits, 19)
    mask = np.uint64((1 << bits) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & mask
            yield pa.RecordBatch.from_arrays([signed(at >> np.uint64(small)), signed(at & np.uint64((1 << small) - 1))], names=["part", "bit"])

    def gather(part: pa.Table) -> pa.Table:
        out = np.zeros(1 << small, np.uint8)
        out[part.column("bit").to_numpy()] = 1
        return pa.table({"part": part.column("part")[:1], "data": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    places = keys.mapInArrow(place, "part long, bit long").distinct()
    rows = places.groupBy("part").applyInArrow(gather, "part long, data binary").collect()
    full = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        full[r.part << (small - 3) : (r.part + 1) << (small - 3)] = np.frombuffer(r.data, np.uint8)
    return keys.sparkSession.sparkContext.broadcast((full, int(mask)))


def hit(bitmap_, keys: np.ndarray) -> np.ndarray:
    full, mask = bitmap_.value
    at = keys & np.uint64(mask)
    return (full[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

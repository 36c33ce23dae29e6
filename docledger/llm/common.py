"""What the operators of this subpackage share: tables, shared scratch space, word bytes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that end a word of white-space words, and A-Z in lower case.
SPACED = bytes(0x20 if b in (9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes that end a word of letters and digits (all of 0x80 and up counts), and A-Z in lower case.
ALNUM = bytes(
    b + 32
    if 65 <= b <= 90
    else b
    if 48 <= b <= 57 or 97 <= b <= 122 or b >= 0x80
    else 0x20
    for b in range(256)
)


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once per application, wherever the driver was started."""
    context = spark.sparkContext
    if not getattr(context, "_docledger_shipped", False):
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="docledger-code-")) / "docledger.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as held:
            for file in sorted(package.rglob("*.py")):
                held.write(file, Path(package.name) / file.relative_to(package))
        context.addPyFile(str(archive))
        context._docledger_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, one of our own (single machine)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='docledger-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables in the shared folder that cut lineage: lost executors do not lose them.

    `keep` writes a table and reads it back; `drop` deletes one that is no longer needed, and what is
    left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/docledger-llm/{name}-{uuid.uuid4().hex}"
        self.tables: list[str] = []
        atexit.register(self.close)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(target, True)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def keep_bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """A kept table whose files are dealt by `key`, so that joins on it don't move its rows."""
        table = f"docledger_{name}_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        writer = df.write.bucketBy(buckets, key).sortBy(key).option("path", f"{self.root}/{table}")
        writer.format("parquet").option("compression", "zstd").saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table)

    def drop(self, kept: DataFrame) -> None:
        self._delete(kept._scratch_path)

    def close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                for table in self.tables:
                    self.spark.sql(f"DROP TABLE IF EXISTS {table}")
                self._delete(self.root)
        except Exception:  # the session is gone already; its folder goes with the job
            pass


def bytes_of(column: str) -> Column:
    """UTF-8 bytes of a text, empty where it is null."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table does not use (names ignore case)."""
    used = {c.lower() for c in df.columns}
    while wanted.lower() in used:
        wanted = f"_{wanted}"
    return wanted


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to so many rows or, about, bytes, so that Python lists of long texts stay small."""
    for batch in batches:
        each = batch.nbytes // max(batch.num_rows, 1) + 1
        step = max(1, min(rows, size // each))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)

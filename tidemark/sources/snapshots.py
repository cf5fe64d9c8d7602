"""State as versioned snapshots, and page snapshots as tables and streams."""

from __future__ import annotations

import json
import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PAGES = "page_id long, url string, html string, adapter string, http_status int, source_id long, anchor_text string"


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the checkpoint folder: later steps neither repeat it nor carry its plan.

    The folder is ``spark.checkpoint.dir``; in local mode a temporary one stands in where none is
    named, on a cluster that is an error.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            path = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(path)
    return df.checkpoint()


def _hadoop(spark: SparkSession, path: str):
    """A path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    root, fs = _hadoop(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """The finished versions under ``path``, ascending: those whose writer has committed."""
    found = [int(n[2:]) for n in _names(spark, path) if n.startswith("v=") and n[2:].isdigit()]
    _, fs = _hadoop(spark, path)
    return sorted(v for v in found if fs.exists(_hadoop(spark, f"{path}/v={v}/_SUCCESS")[0]))


def drop_snapshots(spark: SparkSession, path: str, keep: int) -> list[int]:
    """Delete all finished versions but the latest ``keep`` (one at least); the versions that went."""
    gone = versions(spark, path)[: -max(keep, 1)]
    for v in gone:
        at, fs = _hadoop(spark, f"{path}/v={v}")
        fs.delete(at, True)
    return gone


def write_snapshot(df: DataFrame, path: str, version: int) -> None:
    """Write a whole version beside the others; readers see it once it is committed. Writing a version again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/v={version}")


def read_snapshot(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The latest finished version, or the latest below ``before``; None where there is none."""
    found = [v for v in versions(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/v={found[-1]}") if found else None


@dataclass(frozen=True)
class BucketedState:
    """A table in hash buckets of its key, of which a version writes only those that it touches.

    ``manifests/<version>.json`` names for each bucket the version whose files it has; it is written
    last, so a version is there once its manifest is. A version that is written again starts from
    the one below it and replaces its own files alone. What goes through the driver is one number a
    bucket.
    """

    path: str
    key: str = "id"
    buckets: int = 64

    def of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def versions(self, spark: SparkSession) -> list[int]:
        names = _names(spark, f"{self.path}/manifests")
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def manifest(self, spark: SparkSession, before: int | None = None) -> dict[int, int]:
        """The version of each bucket's files in the latest version (below ``before``); buckets without rows are left out."""
        found = [v for v in self.versions(spark) if before is None or v < before]
        if not found:
            return {}
        at, fs = _hadoop(spark, f"{self.path}/manifests/{found[-1]}.json")
        stream = fs.open(at)
        try:
            text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(b): v for b, v in json.loads(text).items()}

    def read(self, spark: SparkSession, schema: str | StructType, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of the latest version (below ``before``), of all buckets or some; none where there is no version."""
        files = [f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(self.manifest(spark, before).items()) if only is None or b in only]
        return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)

    def touched(self, keys: DataFrame, column: str) -> list[int]:
        """The buckets of the keys."""
        return sorted(r[0] for r in keys.select(self.of(F.col(column))).distinct().collect())

    def write(self, df: DataFrame, version: int, touched: list[int] | None = None) -> list[int]:
        """Make a version: ``df`` has all rows of the touched buckets (None: of all), the others stay as they are. The buckets that were written."""
        spark, data = df.sparkSession, f"{self.path}/data/v={version}"
        base = {} if touched is None else {b: v for b, v in self.manifest(spark, before=version).items() if b not in touched}
        # A bucket's rows go to one file, so files are no more than buckets.
        df.withColumn("bucket", self.of(F.col(self.key))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
        written = sorted(int(n.removeprefix("bucket=")) for n in _names(spark, data) if n.startswith("bucket="))
        text = json.dumps(base | dict.fromkeys(written, version), sort_keys=True)
        part, fs = _hadoop(spark, f"{self.path}/manifests/.{version}.part")
        stream = fs.create(part, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        done, _ = _hadoop(spark, f"{self.path}/manifests/{version}.json")
        fs.delete(done, False)
        fs.rename(part, done)
        return written

    def drop_old(self, spark: SparkSession, keep: int = 3) -> list[str]:
        """Delete all manifests but the latest ``keep`` (one at least), and the files that none of those names; the files' folders."""
        found = self.versions(spark)
        used = {(v, b) for at in found[-max(keep, 1) :] for b, v in self.manifest(spark, before=at + 1).items()}
        for v in found[: -max(keep, 1)]:
            at, fs = _hadoop(spark, f"{self.path}/manifests/{v}.json")
            fs.delete(at, False)
        gone = []
        for v in sorted(int(n[2:]) for n in _names(spark, f"{self.path}/data") if n.startswith("v=") and n[2:].isdigit()):
            if v > found[-1]:
                continue  # a version that is being written
            for name in _names(spark, f"{self.path}/data/v={v}"):
                if name.startswith("bucket=") and (v, int(name.removeprefix("bucket="))) not in used:
                    at, fs = _hadoop(spark, f"{self.path}/data/v={v}/{name}")
                    fs.delete(at, True)
                    gone.append(f"v={v}/{name}")
        return gone


def read_pages(spark: SparkSession, path: str, stream: bool = False, schema: str | StructType = PAGES, files_per_tick: int = 25) -> DataFrame:
    """Page snapshots by their schema, as a table or as a file stream that takes so many files a tick."""
    if stream:
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_tick).parquet(path)
    return spark.read.schema(schema).parquet(path)

"""Tables kept in the shared folder under a name made from what they were made of, and reports as files."""

from __future__ import annotations

import gc
import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(1)
def code_version() -> str:
    """A hash of this package's sources, part of every name: tables made by other code are not read."""
    root = Path(__file__).resolve().parent.parent
    found = hashlib.sha256()
    for path in sorted(p for part in ("functions", "operators", "plans", "sources") for p in (root / part).glob("*.py")):
        found.update(path.read_bytes())
    return found.hexdigest()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, a temporary one in local mode, else an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="linkloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage: gives its memory back, and Spark deletes shuffle files that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _files(spark, path)
    return bool(files.exists(place))


def fingerprint(spark: SparkSession, path: str) -> str:
    """A hash of the names, sizes and times of a table's files (or of those that a pattern names); no content is read."""
    folder, _, name = path.rpartition("/")
    found = spark.read.format("binaryFile").option("pathGlobFilter", name).load(folder) if "*" in name else spark.read.format("binaryFile").load(path)
    rows = found.select("path", "length", "modificationTime").collect()
    return hashlib.sha256(repr(sorted((r[0], r[1], str(r[2])) for r in rows)).encode()).hexdigest()


def ensure(spark: SparkSession, label: str, parts: tuple, build: Callable[[], DataFrame], partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The table of this label and these parts, built and written if it is not there yet.

    It is written under another name and renamed when whole, so a table that is there is complete; of two writers the
    first wins.
    """
    name = hashlib.sha256(repr((code_version(), *parts)).encode()).hexdigest()[:24]
    path = f"{shared_dir(spark)}/linkage-{label}-{name}"
    place, files = _files(spark, path)
    if not files.exists(place):
        fresh = fresh_path(spark, label)
        build().write.partitionBy(*partition_by).parquet(fresh)
        if not files.exists(place):
            files.rename(_files(spark, fresh)[0], place)
        release(spark)
    return spark.read.parquet(path)


def write_report(rows: DataFrame, path: str, title: str) -> None:
    """A text file: the title, then a line of name=value pairs per row, in the order of the lines. Meant for report tables, which are small."""
    cells = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in rows.columns]
    lines = rows.select(F.concat_ws("  ", *cells).alias("value"))
    head = rows.sparkSession.createDataFrame([(0, title)], "place int, value string")
    head.union(lines.select(F.lit(1), "value")).coalesce(1).sortWithinPartitions("place", "value").select("value").write.text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def write_decision(best: DataFrame, grid: DataFrame, path: str, most: int = 25) -> None:
    """The chosen decision and the grid's best rows as one JSON document."""
    row = best.first()
    top = grid.orderBy(F.col("macro_f05").desc(), F.col("precision").desc(), F.col("tau").asc(), F.col("gate").asc_nulls_first()).limit(most).collect()
    out = {"pair_threshold": row["tau"], "entity_gate": row["gate"], "macro_f05": row["macro_f05"], "grid_top": [r.asDict() for r in top]}
    best.sparkSession.createDataFrame([(json.dumps(out),)], "value string").coalesce(1).write.text(path)


def read_decision(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])

"""The folder that the driver and the executors share, small files in it, and this package on the executors."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session or the application; where both are unset, a local folder if Spark runs in one process
    (tests), else an error, as a folder of one machine loses tables."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        root = getattr(sc, "_millrace_work", None)
        if not root:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            sc._millrace_work = root = "file://" + tempfile.mkdtemp(prefix="millrace-work-")
    return root.rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_package", False):
        return
    path = f"{tempfile.mkdtemp(prefix='millrace-')}/{PACKAGE.name}.zip"  # addPyFile hands it out
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, f"{PACKAGE.name}/{p.relative_to(PACKAGE)}")
    sc.addPyFile(path)
    sc._millrace_package = True


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file whole: under another name first, then in place."""
    fs, p = _fs(spark, path)
    _, part = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(data))
    out.close()
    fs.delete(p, False)
    if not fs.rename(part, p):
        raise OSError(f"can't write {path}")


def get_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file."""
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    return bytes(rows[0]["content"])


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders in a folder, in order; none where it is missing."""
    fs, p = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)

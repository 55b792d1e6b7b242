"""Shared folders: where working data may live, and the few file operations
that the DataFrame API does not offer (does a file exist, delete it, a marker
file with a line of text). They go through the file system that Spark itself
uses, so any store Spark can write to works.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def _resolve(spark: SparkSession, path: str):
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _resolve(spark, path)
    return fs.exists(hadoop_path)


def delete(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = _resolve(spark, path)
    fs.delete(hadoop_path, True)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and authority of its store."""
    fs, hadoop_path = _resolve(spark, path)
    return fs.makeQualified(hadoop_path).toString()


def delete_uri(spark: SparkSession, uri: str) -> None:
    """As `delete`, for the encoded form that `_metadata.file_path` has."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(uri))
    delete(spark, hadoop_path.toString())


def write_marker(spark: SparkSession, path: str, text: str = "") -> None:
    """A small file that is either complete or absent."""
    fs, final = _resolve(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    stream = fs.create(part, True)
    stream.write(text.encode())
    stream.close()
    fs.delete(final, False)
    if not fs.rename(part, final):
        raise OSError(f"cannot write {path}")


def read_marker(spark: SparkSession, path: str) -> str | None:
    """The text of a marker file, None if there is no such file."""
    fs, hadoop_path = _resolve(spark, path)
    if not fs.exists(hadoop_path):
        return None
    stream = fs.open(hadoop_path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def modified_millis(spark: SparkSession, path: str) -> int:
    """When the store says the file was written."""
    fs, hadoop_path = _resolve(spark, path)
    return fs.getFileStatus(hadoop_path).getModificationTime()


def folder_bytes(spark: SparkSession, path: str) -> int:
    fs, hadoop_path = _resolve(spark, path)
    return fs.getContentSummary(hadoop_path).getLength()


def has_coarse_clock(spark: SparkSession, path: str) -> bool:
    """Object stores stamp files in whole seconds; local disks and HDFS in ms."""
    fs, _ = _resolve(spark, path)
    return fs.getUri().getScheme() not in ("file", "hdfs")


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly below a folder, none if there is no such folder."""
    fs, hadoop_path = _resolve(spark, path)
    return [status.getPath().getName() for status in fs.listStatus(hadoop_path)] if fs.exists(hadoop_path) else []


def working_folder(spark: SparkSession, label: str) -> str:
    """A fresh scratch folder that every executor can reach.

    It lies in the folder the cluster names in ``spark.checkpoint.dir``. Only a
    local session without that setting gets a temporary folder of its machine.
    On a mounted file system the folder goes when this process ends; elsewhere
    it is left to the retention rules of the store.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        folder = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    elif spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix=f"{label}-")
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    mounted = folder.removeprefix("file:")
    if "://" not in mounted:
        atexit.register(shutil.rmtree, mounted, ignore_errors=True)
    return folder

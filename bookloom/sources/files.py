"""Small files and folders in the store that Spark reads: pointers that commit a table, listings, removal of what no reader needs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file at once: readers see the old or the new one, never a part or none."""
    jvm, fresh = spark._jvm, f"{path}.new"
    p, fs = _path(spark, fresh)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    options = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    flags = spark.sparkContext._gateway.new_array(options, 1)
    flags[0] = options.OVERWRITE
    target = jvm.org.apache.hadoop.fs.Path(path)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(p).toUri(), spark._jsc.hadoopConfiguration()) \
        .rename(fs.makeQualified(p), fs.makeQualified(target), flags)


def get_text(spark: SparkSession, path: str) -> str | None:
    """What a small file holds; None where there is none."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders of a folder; none where it does not exist."""
    p, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def is_folder(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)

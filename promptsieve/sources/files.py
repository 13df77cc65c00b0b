"""The few file operations that Spark's readers and writers leave out."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _hadoop(spark, path)
    return files.exists(where)


def folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """What follows `prefix` in the names directly below `path`; none if it is absent."""
    where, files = _hadoop(spark, path)
    if not files.exists(where):
        return []
    names = [status.getPath().getName() for status in files.listStatus(where)]
    return sorted(name.removeprefix(prefix) for name in names if name.startswith(prefix))


def delete(spark: SparkSession, path: str) -> None:
    where, files = _hadoop(spark, path)
    files.delete(where, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole: it appears under its name only once it is complete."""
    part, files = _hadoop(spark, f"{path}.part")
    out = files.create(part, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    where, _ = _hadoop(spark, path)
    files.delete(where, False)
    if not files.rename(part, where):
        raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file as text; None if it is absent."""
    where, files = _hadoop(spark, path)
    if not files.exists(where):
        return None
    source = files.open(where)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()

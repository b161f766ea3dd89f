"""Writing chart datasets."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "csv", "json")


def slug(title: str) -> str:
    """Lower case, hyphens for spaces, no other special characters."""
    text = re.sub(r"\s+", "-", title.strip().lower())
    return re.sub(r"[^\w-]", "", text)


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write one dataset; every task writes its own part files.

    CSV cells keep their white space, and quotes inside them are doubled (RFC 4180).
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format '{fmt}'; supported: {', '.join(FORMATS)}")
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.options(
            header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        )
    writer.format(fmt).save(path)


def delete_table(spark: SparkSession, path: str) -> None:
    """Remove a table's folder from whatever file system holds it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder of whatever file system, sorted; none if there is no such folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    return sorted(entry.getPath().getName() for entry in system.listStatus(folder))


def file_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Put a small text file in place of an older one in a single rename, on any file system that has one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    draft = target.suffix(f".{uuid.uuid4().hex}.draft")
    stream = target.getFileSystem(conf).create(draft, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    options = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    options[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    qualified = target.getFileSystem(conf).makeQualified(target)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), conf).rename(draft, target, options)

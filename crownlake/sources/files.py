"""Whole files through Spark's own file systems."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def decoded(spark: SparkSession, path: str, pattern: str, decode: Callable[[bytes], pd.DataFrame], schema: str) -> DataFrame:
    """Rows of all files below ``path`` that match; ``file`` names the one they come from."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                yield decode(bytes(content)).assign(file=name)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, f"{schema}, file string")


def save(files: DataFrame, folder: str, overwrite: bool = True) -> int:
    """Writes rows (name, content) as files, one at a time; with ``overwrite`` the folder is emptied first."""
    spark = files.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(conf)
    if overwrite:
        fs.delete(top, True)
    fs.mkdirs(top)
    n = 0
    for row in files.select("name", "content").toLocalIterator():
        out = fs.create(jvm.org.apache.hadoop.fs.Path(top, row.name), True)
        try:
            out.write(bytes(row.content))
        finally:
            out.close()
        n += 1
    return n


def file_number(path: str) -> Column:
    """The first number in a file's name, as a column expression on the column ``path``."""
    return F.regexp_extract(F.element_at(F.split(F.col(path), "/"), -1), r"(\d+)", 1).cast("int")

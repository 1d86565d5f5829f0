"""PLY point clouds, text or binary, as tables and back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

POINTS = "x double, y double, z double, r double, g double, b double"
#: Names of number types in the format.
TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}


def decode(content: bytes) -> pd.DataFrame:
    """x, y, z and colours from 0 to 1 (null without colours) of the vertex element."""
    end = content.index(b"end_header") + len(b"end_header")
    head, start = content[:end].decode("ascii").split("\n"), content.index(b"\n", end) + 1
    if head[0].strip() != "ply":
        raise ValueError("no PLY file")
    kind, element, count, fields = "", "", 0, []
    for line in map(str.split, head):
        if line[:1] == ["format"]:
            kind = line[1]
        elif line[:1] == ["element"]:
            element = line[1]
            if element == "vertex":
                count = int(line[2])
            elif not fields:
                raise ValueError("vertices come first")
        elif line[:1] == ["property"] and element == "vertex":
            if line[1] == "list":
                raise ValueError("a vertex has no lists")
            fields.append((line[2], TYPES[line[1]]))
    names = [n for n, _ in fields]
    if kind == "ascii":
        rows = content[start:].decode("ascii").split("\n")[:count]
        x = np.array([r.split()[: len(names)] for r in rows], float).reshape(count, len(names))
        col = {n: x[:, k] for k, n in enumerate(names)}
    else:
        order = "<" if kind == "binary_little_endian" else ">"
        raw = np.frombuffer(content, np.dtype([(n, order + t) for n, t in fields]), count, start)
        col = {n: raw[n].astype(float) for n in names}
    top = {n: 255.0 if t == "u1" else 65535.0 if t == "u2" else 1.0 for n, t in fields}
    out = pd.DataFrame({a: col[a] for a in "xyz"})
    for a, n in zip("rgb", ("red", "green", "blue"), strict=True):
        out[a] = col[n] / top[n] if n in col else pd.Series(np.full(count, np.nan))
    return out.astype(object).where(out.notna(), None) if "red" not in col else out


def encode(points: pd.DataFrame) -> bytes:
    """Binary little-endian; colours as bytes, if no row lacks them."""
    coloured = bool(points[["r", "g", "b"]].notna().all().all()) and len(points) > 0
    kind = [(a, "<f8") for a in "xyz"] + ([(a, "u1") for a in "rgb"] if coloured else [])
    rows = np.zeros(len(points), np.dtype(kind))
    for a in "xyz":
        rows[a] = points[a]
    for a in "rgb" if coloured else "":
        rows[a] = np.clip(np.round(points[a].to_numpy(float) * 255), 0, 255)
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {len(points)}", *(f"property double {a}" for a in "xyz"), *(f"property uchar {n}" for n in ("red", "green", "blue") if coloured), "end_header"]
    return ("\n".join(head) + "\n").encode() + rows.tobytes()


def read(spark: SparkSession, path: str) -> DataFrame:
    """Points of all .ply files below ``path``; a file is one task's unit."""
    return files.decoded(spark, path, "*.ply", decode, POINTS)


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Points with ``cluster_id``, the number in their file's name."""
    return read(spark, path).withColumn("cluster_id", files.file_number("file"))


def cluster_files(points: DataFrame, name: Column | None = None, cluster: str = "cluster_id") -> DataFrame:
    """name, content: one file per cluster, by default ``cluster<id>.ply``."""
    names = F.format_string("cluster%d.ply", F.col(cluster)) if name is None else name
    src = points.select(names.alias("name"), *(F.col(a).cast("double").alias(a) for a in "xyzrgb"))
    return src.groupBy("name").applyInPandas(lambda pdf: pd.DataFrame({"name": pdf["name"].iloc[:1], "content": [encode(pdf)]}), "name string, content binary")


def save_clusters(points: DataFrame, folder: str, cluster: str = "cluster_id") -> int:
    """Writes each cluster to its file in the emptied folder; the number of files."""
    return files.save(cluster_files(points, cluster=cluster), folder)


def save_named(points: DataFrame, names: DataFrame, folder: str, cluster: str = "cluster_id") -> int:
    """Writes clusters under the names of a table (cluster, name), made safe for file systems.

    A cluster without a name raises; of clusters with one name all points go to one file.
    """
    if not points.select(cluster).distinct().join(names, cluster, "left_anti").isEmpty():
        raise ValueError("a cluster has no name")
    safe = F.concat(F.regexp_replace("_name", r'[<>:"/\\|?*]', "_"), F.lit(".ply"))
    return files.save(cluster_files(points.join(names.select(cluster, F.col("name").alias("_name")), cluster), safe), folder)


def save_multimatches(points: DataFrame, matches: DataFrame, folder: str, cluster: str = "cluster_id") -> int:
    """Writes each cluster near an ambiguous label to the path that ``multimatches`` gives it."""
    own = points.join(matches.select(F.col("file").alias(cluster), F.col("path").alias("_path")), cluster)
    return files.save(cluster_files(own, F.col("_path")), folder)

"""Media columns: payloads stored as progressive JPEG and read back as RGB tensors.

``encode_media`` turns texts into a binary column of progressive JPEG files whose quantised
coefficients hold the bytes (the format's lossless unit; samples after the inverse transform are
rounded). ``decode_media`` reads any binary column of progressive JPEG files: it accumulates the
scans, inverse-transforms, upsamples chroma and gives the full-resolution tensor. ``media_digest``
reads such a column back into payload digests and features without shipping the tensors.

All are row-wise, so they need no shuffle; a batch that is worked on holds some MB or a single row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, sliced
from .progressive_jpeg import JpegError, decode, encode_payload, payload_of

#: Payload bytes of a block of each of three components.
UNIT = 192


def padded(raw: bytes) -> bytes:
    """``raw`` with bytes 32 up to a positive multiple of UNIT."""
    return raw + b" " * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def encode_media(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (of the UTF-8 text), media: one progressive JPEG per row of ``docs``.

    Null text is empty (its payload is 192 spaces). Keys may be null or repeated: rows stay as they
    are; an empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    ship(docs.sparkSession)
    src = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "t"):
            raw = [v.as_buffer().to_pybytes() for v in batch.column(1).cast(pa.large_binary())]
            yield pa.record_batch([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array((encode_payload(padded(b)) for b in raw), pa.binary())], ["k", "n_bytes", "media"])

    return src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("k", key)


def decode_media(media: DataFrame, *, key: str = "doc_id", column: str = "media") -> DataFrame:
    """key, width, height, rgb (height * width * 3 bytes, rows first), error: one row per row.

    Null media and files that cannot be decoded give null sizes and tensor; ``error`` says why.
    """
    ship(media.sparkSession)
    src = media.select(F.col(key).alias("k"), F.col(column).alias("media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "media", 1 << 20):
            out = []
            for v in batch.column(1).to_pylist():
                try:
                    rgb = decode(v).rgb() if v is not None else None
                    out.append((rgb.shape[1], rgb.shape[0], rgb.tobytes(), None) if v is not None else (None, None, None, "null"))
                except (JpegError, KeyError, IndexError, ValueError) as e:
                    out.append((None, None, None, f"{type(e).__name__}: {e}"))
            w, h, t, e = zip(*out, strict=True)
            yield pa.record_batch([batch.column(0), pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(t, pa.binary()), pa.array(e, pa.string())], ["k", "width", "height", "rgb", "error"])

    return src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, width int, height int, rgb binary, error string").withColumnRenamed("k", key)


def media_digest(media: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Digests of the media column of ``encode_media``, from the stored bytes alone.

    key, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 16 payload bytes),
    media_bytes, media_sha256, feature (size, and the sums of the RGB tensor's channels).
    """
    ship(media.sparkSession)
    src = media.select(F.col(key).alias("k"), "n_bytes", "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "media"):
            size, sha, tail, total, own, feature = [], [], [], [], [], []
            for stored in batch.column(2).to_pylist():
                picture = decode(stored)
                payload, rgb = payload_of(picture), picture.rgb()
                size.append(len(payload)), sha.append(hashlib.sha256(payload).hexdigest()), tail.append(zlib.crc32(payload[-16:]))
                total.append(len(stored)), own.append(hashlib.sha256(stored).hexdigest())
                sums = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)
                feature.append(f"{picture.width}x{picture.height}:" + ",".join(map(str, sums)))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(sha), pa.array(tail, pa.int64()), pa.array(total, pa.int64()), pa.array(own), pa.array(feature)],
                ["k", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, {fields}").withColumnRenamed("k", key)

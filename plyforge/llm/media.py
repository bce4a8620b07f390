"""Media columns: progressive JPEG files in a binary column, decoded to RGB tensors and features."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plyforge.llm.common import fresh_path, table
from plyforge.llm.jpeg import BLOCK, decode_coefficients, encode_payload, stored_payload, to_rgb

#: Rows of one Arrow batch that Python holds in decoded form at once.
_ROWS = 64


def padded(text: str | None) -> tuple[int, bytes]:
    """The text's UTF-8 length, and its bytes with zeros up to a positive multiple of 64."""
    body = (text or "").encode("utf-8", "surrogatepass")
    return len(body), body + bytes(max(BLOCK, -(-len(body) // BLOCK) * BLOCK) - len(body))


def encode_texts(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, a progressive JPEG whose coefficients are the text's padded bytes.

    A null text is empty: one block of zeros. Repeated rows are encoded each.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, _ROWS):
                part = batch.slice(k, _ROWS)
                bodies = [padded(text) for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([n for n, _ in bodies], pa.int64()),
                        pa.array([encode_payload(body) for _, body in bodies], pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "media"],
                )

    return documents.select("doc_id", "text").mapInArrow(made, "doc_id long, n_bytes long, media binary")


def feature_of(rgb: np.ndarray) -> str:
    """Size, mean colour in thousandths, and a 64-bit hash of which of 8 x 8 areas are brighter than the mean."""
    high, wide, _ = rgb.shape
    n = high * wide
    means = [int(s) * 1000 // n for s in rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)]
    light = rgb.sum(axis=2, dtype=np.int64)
    rows, columns = np.arange(8) * high // 8, np.arange(8) * wide // 8
    areas = np.add.reduceat(np.add.reduceat(light, rows, axis=0), columns, axis=1) * n
    extent = np.diff(np.append(rows, high))[:, None] * np.diff(np.append(columns, wide))[None, :]
    bits = np.packbits((areas > extent * light.sum()).reshape(-1)).tobytes().hex()
    return f"{wide}x{high}:{means[0]},{means[1]},{means[2]}:{bits}"


def decode_media(media: DataFrame, tensors: bool = True) -> DataFrame:
    """The media's columns doc_id, n_bytes with the payload's and the file's digests and the picture.

    payload_bytes, payload_sha256 and tail_crc32 (of the last 64 bytes) are of the payload read
    back from the coefficients; media_bytes and media_sha256 of the file. feature is computed
    from the RGB tensor, which with tensors is returned too: height, width and rgb, the bytes
    of (height, width, 3). A null file gives nulls.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,"
        " media_sha256 string, feature string"
    )
    if tensors:
        names, kinds = [*names, "height", "width", "rgb"], [*kinds, pa.int32(), pa.int32(), pa.binary()]
        schema += ", height int, width int, rgb binary"

    def described(file: bytes | None) -> tuple:
        if file is None:
            return (None,) * (len(names) - 2)
        frame = decode_coefficients(file)
        payload, rgb = stored_payload(frame), to_rgb(frame)
        digest = hashlib.sha256(payload).hexdigest()
        out = (len(payload), digest, zlib.crc32(payload[-BLOCK:]), len(file), hashlib.sha256(file).hexdigest(), feature_of(rgb))
        return (*out, rgb.shape[0], rgb.shape[1], rgb.tobytes()) if tensors else out

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, _ROWS):
                part = batch.slice(k, _ROWS)
                rows = [described(file) for file in part.column("media").to_pylist()]
                made = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds[2:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *made], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(decoded, schema)


NAME = "op10_media"
ORACLE_SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "media")
    encode_texts(table(spark, sf_dir, "documents")).write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema("doc_id long, n_bytes long, media binary").parquet(path)
    return decode_media(stored)

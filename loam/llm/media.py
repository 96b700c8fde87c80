"""Media columns: JPEG bytes in, dimensions and DC-thumbnail hashes out; text payloads stored as JPEG and read back.

Row-wise work without any shuffle: every task handles a few MB of images at a time, whatever the table's size or skew.

Cases: a null or empty text is stored as 64 zero bytes; bytes that are not a baseline JPEG (null, empty, broken, progressive)
give nulls in all feature columns; equal bytes give equal features; other columns are ignored or kept as stated; an empty table
gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import jpeg
from .common import fresh, table, text_chunks

STEP = 2 << 20

STORED = "doc_id long, n_bytes long, media binary"
FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string, width int, height int"
)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_chunks(batches, STEP):
        lengths = np.diff(offsets)
        payloads = []
        for s, n in zip(offsets, lengths, strict=False):
            p = np.zeros(max(64, -(-int(n) // 64) * 64), np.uint8)
            p[:n] = data[s : s + n]
            payloads.append(p)
        media = pa.array(jpeg.store_payloads(payloads), pa.binary())
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(lengths, pa.int64()), media], ["doc_id", "n_bytes", "media"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_chunks(batches, STEP, "media"):
        files = [data[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
        images = [jpeg.parse(f) for f in files]
        jpeg.decode(images)
        out = []
        for doc_id, n, f, img in zip(rows.column("doc_id").to_pylist(), rows.column("n_bytes").to_pylist(), files, images, strict=True):
            payload = jpeg.read_payload(img)
            feature = f"{img.width}x{img.height}:{jpeg.difference_hash(jpeg.thumbnail(img))}"
            out.append((doc_id, n, len(payload), jpeg.sha256(payload), zlib.crc32(payload[-64:]), len(f), jpeg.sha256(f), feature, img.width, img.height))
        types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        names = [x.split()[0] for x in FEATURES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a lossless baseline JPEG."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_store, STORED)


def payload_features(stored: DataFrame) -> DataFrame:
    """Decodes what ``store_texts`` stored: the payload's digests, the medium's, dimensions and thumbnail hash."""
    return stored.mapInArrow(_features, FEATURES)


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_chunks(batches, STEP, "media"):
        out: list[tuple] = []
        for a, b in zip(offsets, offsets[1:], strict=False):
            try:
                img = jpeg.parse(data[a:b].tobytes())
                jpeg.decode([img])
                pixels = jpeg.thumbnail(img)
                out.append((img.width, img.height, pixels.tobytes(), jpeg.sha256(pixels.tobytes()), jpeg.difference_hash(pixels)))
            except jpeg.BROKEN:
                out.append((None,) * 5)
        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()], strict=True)]
        names = ["width", "height", "thumbnail", "thumbnail_sha256", "thumbnail_dhash"]
        yield pa.RecordBatch.from_arrays([*rows.columns, *cols], [*rows.schema.names, *names])


def image_features(images: DataFrame, column: str = "media") -> DataFrame:
    """Adds width, height, thumbnail (grey, row by row), thumbnail_sha256 and thumbnail_dhash to a table with a JPEG column.

    A column of the table that clashes with an added one, in whatever case, is renamed: <name>_in, with more underscores if that is
    there too.
    """
    types = {"width": "int", "height": "int", "thumbnail": "binary", "thumbnail_sha256": "string", "thumbnail_dhash": "string"}
    # Columns have numbers for names while the rows pass through Python, so none can clash with another.
    inside = images.toDF(*["media" if c == column else f"c{k}" for k, c in enumerate(images.columns)])
    schema = StructType([*inside.schema.fields, *[StructField(n, StructType.fromDDL(f"x {t}")[0].dataType) for n, t in types.items()]])
    names: list[str] = []
    for c in images.columns:
        names.append(fresh(f"{c}_in", [*images.columns, *names, *types]) if c.lower() in types else c)
    return inside.mapInArrow(_look, schema).toDF(*names, *types)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload_features(store_texts(table(spark, sf_dir, "documents")))

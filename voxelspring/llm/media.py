"""Media columns: Netpbm and BMP to numpy arrays, area resizing, NPY tiles, difference hashes.

`decode` reads the six Netpbm kinds and uncompressed 1-, 8-, 24- and 32-bit BMP. `area_resize` takes
every output cell's mean over its exact, fractional area from an integral image. `describe` runs
them over a column of encoded images and gives NPY tiles. `store_texts` writes texts as lossless
greyscale images and reads them back.

Defined results: a null text is the empty text; equal texts give equal values; a null or broken
image gives null size, tile and hash and its reason in `error`; an empty table gives no rows;
further columns of the input don't matter.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspring.llm.common import rows_of, table, text_bytes

WIDTH = 64
TILE = (32, 32)
#: Rows of an image summed at a time, so that the integral image of a tall one stays small.
BAND = 8192


def _netpbm_fields(data: bytes, at: int, count: int) -> tuple[list[int], int]:
    """Decimal header fields from `at` on, with comments skipped, and the place after them."""
    found = []
    while len(found) < count:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            if data[at : at + 1] == b"#":
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            else:
                at += 1
        begin = at
        while at < len(data) and data[at : at + 1].isdigit():
            at += 1
        if begin == at:
            raise ValueError("header field missing")
        found.append(int(data[begin:at]))
    return found, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """(height, width) or (height, width, 3), uint8 or uint16; bitmaps as 0 (black) and 255."""
    kind = data[1:2]
    bitmap, colour = kind in b"14", kind in b"36"
    (width, height), at = _netpbm_fields(data, 2, 2)
    most = 1
    if not bitmap:
        (most,), at = _netpbm_fields(data, at, 1)
    if not 0 < most < 65536 or width < 1 or height < 1:
        raise ValueError("bad size or range")
    shape = (height, width, 3) if colour else (height, width)
    count = int(np.prod(shape))
    if kind in b"123":
        body = b"\n".join(line.split(b"#")[0] for line in data[at:].split(b"\n"))
        if bitmap:
            body = b" ".join(bytes([c]) for c in body if c in b"01")
        values = np.array(body.split()[:count], dtype=np.int64)
    elif bitmap:
        row = -(-width // 8)
        packed = np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row)
        values = np.unpackbits(packed, axis=1)[:, :width].reshape(-1)
    else:
        values = np.frombuffer(data, np.uint8 if most < 256 else ">u2", count, at + 1)
    if len(values) != count:
        raise ValueError("samples missing")
    if bitmap:
        values = (1 - values) * 255
    return values.astype(np.uint8 if most < 256 else np.uint16).reshape(shape)


def decode_bmp(data: bytes) -> np.ndarray:
    """(height, width) for grey palettes, else (height, width, 3), top row first."""
    start, size, width, height, _, bits, packed = struct.unpack_from("<10xIIiiHHI", data)
    if size < 40 or packed not in (0, 3) or bits not in (1, 8, 24, 32) or width < 1 or height == 0:
        raise ValueError("kind of BMP not supported")
    rows, stride = abs(height), -(-width * bits // 32) * 4
    body = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if height > 0:
        body = body[::-1]
    if bits > 8:
        return body[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1].copy()
    index = np.unpackbits(body, axis=1)[:, :width] if bits == 1 else body[:, :width]
    (colours,) = struct.unpack_from("<I", data, 46)
    palette = np.frombuffer(data, np.uint8, 4 * (colours or 1 << bits), 14 + size).reshape(-1, 4)[:, 2::-1]
    if (palette == palette[:, :1]).all():
        return palette[:, 0][index]
    return palette[index]


def decode(data: bytes) -> np.ndarray:
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return decode_netpbm(data)
    if data[:2] == b"BM":
        return decode_bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def encode_pgm(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % image.shape[::-1] + image.tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """8-bit greyscale."""
    height, width = image.shape
    stride = -(-width // 4) * 4
    body = np.zeros((height, stride), np.uint8)
    body[:, :width] = image[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy()
    palette[:, 3] = 0
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 1078 + body.size, 0, 0, 1078, 40, width, height, 1, 8, 0, body.size, 2835, 2835, 256, 0)
    return head + palette.tobytes() + body.tobytes()


def _areas(image: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """Sums of the image over the bands between `rows` (fractional), by columns resized to `width`."""
    integral = np.zeros((image.shape[0] + 1, image.shape[1] + 1, *image.shape[2:]), dtype=np.float64)
    np.cumsum(image, axis=0, out=integral[1:, 1:])
    np.cumsum(integral[1:, 1:], axis=1, out=integral[1:, 1:])

    def at(table: np.ndarray, where: np.ndarray) -> np.ndarray:
        low = np.minimum(where.astype(np.int64), table.shape[0] - 2)
        part = (where - low).reshape(-1, *[1] * (table.ndim - 1))
        return table[low] * (1 - part) + table[low + 1] * part

    by_row = np.diff(at(integral, rows), axis=0)
    columns = np.linspace(0, image.shape[1], width + 1)
    return np.diff(at(np.moveaxis(by_row, 1, 0), columns), axis=0).swapaxes(0, 1)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each output cell's area, rounded half up, from integral images of bands of rows."""
    edges = np.linspace(0, image.shape[0], height + 1)
    total = np.zeros((height, width, *image.shape[2:]))
    for top in range(0, image.shape[0], BAND):
        band = image[top : top + BAND]
        total += _areas(band, np.clip(edges - top, 0, band.shape[0]), width)
    most = 65535 if image.dtype == np.uint16 else 255
    mean = total * (height * width / (image.shape[0] * image.shape[1]))
    return np.clip(np.floor(mean + 0.5 - 1e-9), 0, most).astype(image.dtype)


def grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    r, g, b = (image[..., i].astype(np.uint32) for i in range(3))
    return ((299 * r + 587 * g + 114 * b + 500) // 1000).astype(image.dtype)


def difference_hash(image: np.ndarray) -> str:
    """16 hex digits: whether each of 8 x 8 cells is darker than its right neighbour."""
    small = area_resize(grey(image), 8, 9).astype(np.int32)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(image: np.ndarray) -> bytes:
    to = io.BytesIO()
    np.lib.format.write_array(to, np.ascontiguousarray(image), version=(1, 0), allow_pickle=False)
    return to.getvalue()


def describe(images: DataFrame, column: str = "media", tile: tuple[int, int] = TILE) -> DataFrame:
    """doc_id with size, NPY tile and difference hash of each encoded image."""
    schema = pa.schema([("doc_id", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("tile_npy", pa.binary()), ("dhash", pa.string()), ("error", pa.string())])

    def one(doc_id, data):
        try:
            image = decode(data or b"")
            small = area_resize(image, *tile)
            return doc_id, *image.shape[:2], image.shape[2] if image.ndim == 3 else 1, npy(small), difference_hash(image), None
        except (ValueError, struct.error, IndexError) as e:
            return doc_id, None, None, None, None, None, str(e) or type(e).__name__

    def run(batches):
        for batch in batches:
            found = [one(*x) for x in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)] if found else [pa.array([], f.type) for f in schema], schema=schema)

    return images.select(F.col("doc_id").cast("long"), F.col(column).cast("binary").alias("media")).mapInArrow(run, "doc_id long, height int, width int, channels int, tile_npy binary, dhash string, error string")


def stored_form(text: str | None, form: str = "pgm") -> tuple[int, bytes]:
    """Bytes of the text, and its image: zeros up to a positive multiple of the width, one row each."""
    raw = text_bytes(text)
    padded = raw + bytes(-len(raw) % WIDTH if raw else WIDTH)
    image = np.frombuffer(padded, np.uint8).reshape(-1, WIDTH)
    return len(raw), (encode_bmp if form == "bmp" else encode_pgm)(image)


def images_of_texts(docs: DataFrame, form: str = "pgm") -> DataFrame:
    """doc_id, n_bytes and the image of each text."""

    def run(batches):
        for batch in batches:
            made = [stored_form(t, form) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.large_binary()).cast(pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def store_texts(docs: DataFrame, form: str = "pgm", tile: tuple[int, int] = TILE) -> DataFrame:
    """Each text stored as an image and read back: digests of both, the NPY tile and the hash."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("tile_npy", pa.binary())])

    def one(doc_id, text):
        n_bytes, media = stored_form(text, form)
        image = decode(media)
        payload = image.tobytes()
        return doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), npy(area_resize(image, *tile))

    def run(batches):
        found = []
        for row in rows_of(batches, "doc_id", "text"):
            found.append(one(*row))
            if len(found) >= 2_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_npy binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(table(spark, sf_dir, "documents"))


def payload_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the stored texts that SQL can express: sizes and the digest of what is read back."""
    return query(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


PAYLOAD_ORACLE = r"""
WITH raw AS (SELECT doc_id, encode(coalesce(text, '')) AS bytes FROM documents),
padded AS (
  SELECT doc_id, octet_length(bytes) AS n, CASE WHEN octet_length(bytes) = 0 THEN 64 ELSE (64 - octet_length(bytes) % 64) % 64 END AS more, bytes FROM raw
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n + more AS BIGINT) AS payload_bytes, sha256(bytes || repeat('\x00'::BLOB, more)) AS payload_sha256 FROM padded
"""

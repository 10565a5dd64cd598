"""Media columns: Netpbm and BMP images as numpy arrays, resized by area, tiled, hashed.

decode() reads PBM, PGM and PPM (plain and raw, 8 and 16 bits) and uncompressed BMP of 1, 4, 8,
24 and 32 bits. resize() averages exact areas by way of an integral image. difference_hash()
compares horizontal neighbours of a 9 x 8 reduction. npy_bytes() gives a tile's NPY form.

Null payloads give null columns from image_features(); texts (store_texts) take null as empty.
Broken or unknown images give a null in every feature and the reason in ``error``. Ties: equal neighbours in a difference hash are a 0 bit.
Repeated rows give equal rows each; extra columns, whatever their names, are ignored. An empty table gives no rows. Very long
payloads are reduced by strips, so that the integral image of a strip is all that is held beside the samples.
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

from .common import begin, documents, pieces

#: Samples in a row of the stored image of a text; its payload is padded to whole rows.
ROW = 64
#: Rows of an integral image that are held at once.
STRIP = 4096
SPACE = b" \t\n\r\v\f"


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """``count`` numbers after the magic, with # comments, and where the samples start."""
    found, at = [], 2
    while len(found) < count:
        while at < len(data) and data[at] in SPACE:
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at)
            if at < 0:
                raise ValueError("the header has no end")
            continue
        end = at
        while end < len(data) and 48 <= data[end] <= 57:
            end += 1
        if end == at or end - at > 9:
            raise ValueError("bad number in the header")
        found.append(int(data[at:end]))
        at = end
    return found, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """(height, width) or (height, width, 3) samples, uint8 or uint16; PBM ink is 1."""
    kind = data[1] - 48
    bits, colour, plain = kind in (1, 4), kind in (3, 6), kind < 4
    numbers, at = _header(data, 2 if bits else 3)
    width, height, top = numbers[0], numbers[1], 1 if bits else numbers[2]
    if not 0 < top < 65536:
        raise ValueError("bad maximum value")
    shape = (height, width, 3) if colour else (height, width)
    n = int(np.prod(shape))
    if plain:
        body = b"\n".join(line.split(b"#")[0] for line in data[at:].split(b"\n"))
        values = [c - 48 for c in body if c in b"01"] if bits else list(map(int, body.split()))
        out = np.array(values[:n], dtype="u1" if top < 256 else "u2")
    elif bits:
        row = (width + 7) // 8
        packed = np.frombuffer(data, "u1", row * height, at + 1).reshape(height, row)
        return np.unpackbits(packed, axis=1)[:, :width]
    else:
        out = np.frombuffer(data, "u1" if top < 256 else ">u2", n, at + 1)
    if out.size != n:
        raise ValueError("too few samples")
    return out.reshape(shape).astype("u1" if top < 256 else "u2", copy=False)


def decode_bmp(data: bytes) -> np.ndarray:
    """(height, width) for a grey palette, else (height, width, 3 or 4) as red, green, blue (, alpha)."""
    start, size, width, height, _, depth, packing = struct.unpack_from("<10xIIiiHHI", data)
    if size < 40 or packing or depth not in (1, 4, 8, 24, 32) or width <= 0 or not height:
        raise ValueError("unsupported BMP")
    rows, line = abs(height), (width * depth + 31) // 32 * 4
    raw = np.frombuffer(data, "u1", rows * line, start).reshape(rows, line)
    raw = raw[::-1] if height > 0 else raw
    if depth >= 24:
        out = raw[:, : width * depth // 8].reshape(rows, width, depth // 8)
        return out[..., [2, 1, 0, 3][: depth // 8]]
    if depth == 8:
        index = raw[:, :width]
    else:
        bits = np.unpackbits(raw, axis=1).reshape(rows, -1, depth)
        index = (bits * (1 << np.arange(depth)[::-1])).sum(2).astype("u1")[:, :width]
    used = struct.unpack_from("<I", data, 46)[0] or 1 << depth
    palette = np.frombuffer(data, "u1", 4 * used, 14 + size).reshape(used, 4)[:, 2::-1]
    if used == 256 and (palette == np.arange(256)[:, None]).all():
        return index
    colours = palette[index]
    return colours[..., 0] if (palette == palette[:, :1]).all() else colours


def decode(data: bytes) -> np.ndarray:
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return decode_netpbm(data)
    if data[:2] == b"BM":
        return decode_bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def grey(image: np.ndarray) -> np.ndarray:
    """One plane of 64-bit integers; colours by the usual 299 : 587 : 114 weights, rounded down."""
    if image.ndim == 2:
        return image.astype("i8")
    return image[..., :3].astype("i8") @ np.array([299, 587, 114]) // 1000


def resize(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the exact area that each target cell covers, by an integral image, of which STRIP rows are held at a time.

    Cells that divide a sample take their share of it: between integral points it is bilinear.
    """
    rows, cols = plane.shape
    y, x = np.linspace(0, rows, height + 1), np.linspace(0, cols, width + 1)
    top = np.minimum(y.astype("i8"), rows - 1)
    wanted = np.unique(np.concatenate((top, top + 1)))
    lines, above = np.zeros((len(wanted), cols + 1)), np.zeros(cols + 1)  # integral rows; that of the strips before
    for start in range(0, rows, STRIP):
        integral = np.zeros((min(STRIP, rows - start), cols + 1))
        np.cumsum(np.cumsum(plane[start : start + STRIP], 0, dtype="f8"), 1, out=integral[:, 1:])
        integral += above
        mine = (wanted > start) & (wanted <= start + len(integral))
        lines[mine] = integral[wanted[mine] - start - 1]
        above = integral[-1]

    def between(table: np.ndarray, low: np.ndarray, edges: np.ndarray, at: np.ndarray) -> np.ndarray:
        part = (edges - low)[:, None]
        return table[at] * (1 - part) + table[at + 1] * part

    across = between(lines, top, y, np.searchsorted(wanted, top))
    left = np.minimum(x.astype("i8"), cols - 1)
    corners = between(across.T, left, x, left).T
    return np.diff(np.diff(corners, axis=0), axis=1) * (height * width / (rows * cols))


def difference_hash(plane: np.ndarray) -> str:
    """64 bits, row by row, as 16 hex digits: whether a cell is darker than its right neighbour."""
    small = resize(plane, 8, 9).round(6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_bytes(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(tile), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def tiles(plane: np.ndarray, size: int, edge: int) -> list[tuple[int, int, np.ndarray]]:
    """(row, column, edge x edge uint8 tile) of the plane resized to ``size`` x ``size``."""
    whole = np.clip(np.rint(resize(plane, size, size)), 0, 255).astype("u1")
    return [(r // edge, c // edge, whole[r : r + edge, c : c + edge]) for r in range(0, size, edge) for c in range(0, size, edge)]


def image_features(images: DataFrame, key: str, data: str, size: int = 32, edge: int = 16) -> DataFrame:
    """``key``, height, width, dhash, the NPY tiles, and error for every image payload."""

    def run(batches):
        begin("media")
        for part in pieces(batches, 64):
            out = []
            for k, payload in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                row = {"key": k, "height": None, "width": None, "dhash": None, "tiles": None, "error": None}
                if payload is not None:
                    try:
                        plane = grey(decode(payload))
                        found = [{"row": r, "col": c, "npy": npy_bytes(t)} for r, c, t in tiles(plane, size, edge)]
                        row |= {"height": plane.shape[0], "width": plane.shape[1], "dhash": difference_hash(plane), "tiles": found}
                    except (ValueError, IndexError, struct.error) as bad:
                        row["error"] = str(bad) or "broken image"
                out.append(row)
            kind = pa.list_(pa.struct([("row", pa.int32()), ("col", pa.int32()), ("npy", pa.binary())]))
            schema = pa.schema([("key", part.schema.field(0).type), ("height", pa.int64()), ("width", pa.int64()), ("dhash", pa.string()), ("tiles", kind), ("error", pa.string())])
            yield pa.RecordBatch.from_pylist(out, schema)

    kind = images.schema[key].dataType.simpleString()
    shape = "height long, width long, dhash string, tiles array<struct<row int, col int, npy binary>>, error string"
    return images.select(key, data).mapInArrow(run, f"key {kind}, {shape}").withColumnRenamed("key", key)


def text_image(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the PGM that stores them in rows of 64 samples, padded by zeros."""
    raw = (text or "").encode()
    padded = raw + bytes(-len(raw) % ROW if raw else ROW)
    return len(raw), encode_pgm(np.frombuffer(padded, "u1").reshape(-1, ROW))


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
TILES = "tiles array<struct<row: int, col: int, npy: binary>>"


def store_texts(docs: DataFrame) -> DataFrame:
    """Every whole text as a stored image that is read back: one row a document, no exchange.

    ``feature``: the difference hash; ``tiles``: the NPY tiles of its reduction.
    """

    def run(batches):
        begin("media")
        for part in pieces(batches):
            out = []
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                n, media = text_image(text)
                plane = decode(media)
                payload = plane.tobytes()
                own = [{"row": r, "col": c, "npy": npy_bytes(t)} for r, c, t in tiles(plane, 16, 8)]
                out.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(plane), own))
            names = [*(c.split()[0] for c in SCHEMA.split(", ")), "tiles"]
            kinds = [*(pa.string() if c.endswith("string") else pa.int64() for c in SCHEMA.split(", ")), pa.list_(pa.struct([("row", pa.int32()), ("col", pa.int32()), ("npy", pa.binary())]))]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"{SCHEMA}, {TILES}")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(documents(spark, sf_dir))

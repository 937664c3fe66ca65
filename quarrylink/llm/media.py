"""Media columns: Netpbm and BMP to arrays, area resizing, NPY tiles and difference hashes.

Images are 8-bit samples. The stored form of a payload is a picture of 64 pixels of three
samples a row: PPM, or BMP where the payload's CRC is odd, so both readers see real rows.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarrylink.llm.common import read

ROW_BYTES = 192
TILE = 16
_BAND = 4096


def write_ppm(samples: np.ndarray) -> bytes:
    """Binary PPM of height x width x 3 samples."""
    h, w, _ = samples.shape
    return b"P6\n%d %d\n255\n" % (w, h) + samples.tobytes()


def write_pgm(samples: np.ndarray) -> bytes:
    """Binary PGM of height x width samples."""
    return b"P5\n%d %d\n255\n" % samples.shape[::-1] + samples.tobytes()


def write_bmp(samples: np.ndarray) -> bytes:
    """24-bit bottom-up BMP; rows are filled up to multiples of four bytes."""
    h, w, _ = samples.shape
    rows = np.zeros((h, -(-w * 3 // 4) * 4), np.uint8)
    rows[:, : w * 3] = samples[::-1, :, ::-1].reshape(h, w * 3)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    count = 3 if data[:2] in (b"P5", b"P6", b"P2", b"P3") else 2
    while len(fields) < count:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    w, h = fields[:2]
    kind = data[:2]
    if kind in (b"P5", b"P6"):
        depth = 3 if kind == b"P6" else 1
        wide = fields[2] > 255
        out = np.frombuffer(data, ">u2" if wide else np.uint8, h * w * depth, at + 1)
        if fields[2] != 255:
            out = (out.astype(np.uint32) * 255 // fields[2]).astype(np.uint8)
        return out.reshape(h, w, depth) if depth == 3 else out.reshape(h, w)
    if kind == b"P4":
        bits = np.frombuffer(data, np.uint8, h * (-(-w // 8)), at + 1).reshape(h, -1)
        return ((1 - np.unpackbits(bits, axis=1)[:, :w]) * 255).astype(np.uint8)
    values = np.array(data[at:].split(), np.int64)
    if kind == b"P1":
        digits = np.frombuffer(b"".join(data[at:].split()), np.uint8)[: h * w] - 48
        return ((1 - digits) * 255).astype(np.uint8).reshape(h, w)
    values = (values[: h * w * (3 if kind == b"P3" else 1)] * 255 // fields[2]).astype(np.uint8)
    return values.reshape((h, w, 3) if kind == b"P3" else (h, w))


def _bmp(data: bytes) -> np.ndarray:
    start, header, w, h, _, bits, packing = struct.unpack_from("<I", data, 10) + struct.unpack_from("<IiiHHI", data, 14)
    if packing or bits not in (8, 24, 32):
        raise ValueError(f"BMP of {bits} bits with compression {packing} is not supported")
    stride, rows = -(-w * bits // 32) * 4, abs(h)
    raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    raw = raw if h < 0 else raw[::-1]
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + header).reshape(used, 4)[:, 2::-1]
        return palette[raw[:, :w]]
    step = bits // 8
    return raw[:, : w * step].reshape(rows, w, step)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """Samples of a Netpbm (P1-P6) or BMP (8, 24 or 32 bits, uncompressed) file as uint8."""
    if data[:2] == b"BM":
        return _bmp(data)
    if data[:1] == b"P" and data[1:2] in b"123456":
        return _netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def area_resize(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each target cell's area, from an integral image; edges that cut pixels count in part.

    The integral runs over bands of rows, so its memory does not grow with the height.
    """
    h, w = gray.shape
    xs, ys = np.linspace(0, w, width + 1), np.linspace(0, h, height + 1)
    out = np.zeros((height, width))
    x0 = np.minimum(xs.astype(int), w - 1)
    for top in range(0, h, _BAND):
        band = gray[top : top + _BAND].astype(np.float64)
        n = len(band)
        integral = np.zeros((n + 1, w + 1))
        np.cumsum(np.cumsum(band, 0), 1, out=integral[1:, 1:])
        at = np.clip(ys - top, 0, n)
        y0 = np.minimum(at.astype(int), n - 1)
        rows = integral[y0] + (at - y0)[:, None] * (integral[y0 + 1] - integral[y0])
        cells = rows[:, x0] + (xs - x0) * (rows[:, x0 + 1] - rows[:, x0])
        out += np.diff(np.diff(cells, axis=0), axis=1)
    return out / ((h / height) * (w / width))


def gray(samples: np.ndarray) -> np.ndarray:
    """Luma of colour samples; gray samples as they are."""
    if samples.ndim == 2:
        return samples
    return ((samples[..., 0].astype(np.uint16) * 77 + samples[..., 1].astype(np.uint16) * 150 + samples[..., 2].astype(np.uint16) * 29) >> 8).astype(np.uint8)


def difference_hash(g: np.ndarray) -> str:
    """64 bits in hex: whether each of 8 x 9 resized cells is darker than its right neighbour."""
    small = np.round(area_resize(g, 8, 9), 6)
    return f"{int.from_bytes(np.packbits(small[:, :-1] < small[:, 1:]).tobytes(), 'big'):016x}"


def npy_tile(g: np.ndarray, size: int = TILE) -> bytes:
    """The image resized to size x size, as an NPY file of uint8."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(g, size, size)), 0, 255).astype(np.uint8))
    return out.getvalue()


def payload_of(raw: bytes) -> bytes:
    """``raw`` filled up with spaces to a positive multiple of one row."""
    return raw + b" " * (max(1, -(-len(raw) // ROW_BYTES)) * ROW_BYTES - len(raw))


def store_payload(payload: bytes) -> bytes:
    """The picture that holds a payload; equal payloads give equal pictures."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES // 3, 3)
    return write_bmp(samples) if zlib.crc32(payload) & 1 else write_ppm(samples)


def to_media(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, n_bytes, media``: each text as a stored picture. A null text is empty."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            raw = [b"" if x is None else x.encode() for x in batch.column(1).to_pylist()]
            media = [store_payload(payload_of(x)) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["key", "n_bytes", "media"])

    return df.select(df[key].alias("key"), df[text].cast("string").alias("t")).mapInArrow(run, f"key {kind}, n_bytes bigint, media binary").withColumnRenamed("key", key)


FEATURES = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, media_format string, feature string, tile binary"


def media_features(media: DataFrame, key: str) -> DataFrame:
    """Decode each stored picture and compute digests of its samples, a hash and an NPY tile."""
    kind = media.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column(2).to_pylist():
                samples = decode(data)
                payload = np.ascontiguousarray(samples).tobytes()
                g = gray(samples)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), "bmp" if data[:2] == b"BM" else "netpbm", difference_hash(g), npy_tile(g)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["key", "n_bytes", *(x.split()[0] for x in FEATURES.split(", "))])

    return media.select(media[key].alias("key"), "n_bytes", "media").mapInArrow(run, f"key {kind}, n_bytes bigint, {FEATURES}").withColumnRenamed("key", key)


def describe_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts stored as pictures and read back: one row per input row, in no order.

    Null and empty texts give a payload of one row of spaces. Null keys, repeated rows and
    texts of any length are kept; extra columns are ignored. An empty table gives no rows.
    """
    return media_features(to_media(df, key, text), key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pictures and back."""
    return describe_texts(read(spark, sf_dir, "documents"))

"""Binary columns that hold PNG images: writing, reading with checksum tests, and low-frequency cosine hashes.

Images are 8-bit greyscale. The writer gives each row the filter (none, left, above) with the least sum of absolute
differences; the reader takes all five filters of the format. Both work on whole rows or columns in numpy.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples in a row of an image that stores bytes.
WIDTH = 64
#: Side of the averaged image, and of its low frequencies, behind a hash.
SIDE, LOW = 32, 8
LEVEL = 1


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def write_png(samples: np.ndarray, level: int = LEVEL) -> bytes:
    """A PNG of a two-dimensional array of bytes."""
    height, width = samples.shape
    above = np.zeros_like(samples)
    above[1:] = samples[:-1]
    left = np.zeros_like(samples)
    left[:, 1:] = samples[:, :-1]
    tries = np.stack([samples, samples - left, samples - above])
    cost = np.minimum(tries, 0 - tries).sum(axis=2, dtype=np.int64)
    best = cost.argmin(axis=0)
    rows = np.empty((height, width + 1), dtype=np.uint8)
    rows[:, 0] = best
    rows[:, 1:] = tries[best, np.arange(height)]
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def chunks(data: bytes):
    """(kind, content) of each chunk; ValueError where a checksum or a length is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("a chunk is cut short")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        content = data[at + 8 : at + 8 + n]
        if at + 12 + n > len(data):
            raise ValueError("a chunk is cut short")
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(content, zlib.crc32(kind)):
            raise ValueError(f"wrong checksum in {kind!r}")
        yield kind, content
        if kind == b"IEND":
            return
        at += 12 + n
    raise ValueError("no end chunk")


def unfilter(filters: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Samples from filtered rows: runs of rows of one filter are summed at a time where the filter allows it."""
    out = np.empty_like(rows)
    height, width = rows.shape
    zero = np.zeros(width, dtype=np.uint8)
    cuts = [0, *(np.flatnonzero(np.diff(filters)) + 1).tolist(), height] if height else [0]
    for a, b in zip(cuts, cuts[1:]):
        kind, prev = int(filters[a]), out[a - 1] if a else zero
        if kind == 0:
            out[a:b] = rows[a:b]
        elif kind == 1:
            out[a:b] = np.cumsum(rows[a:b], axis=1, dtype=np.uint8)
        elif kind == 2:
            out[a:b] = np.cumsum(np.vstack([prev[None], rows[a:b]]), axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            # A sample needs those to its left, above, and above left: all samples of a diagonal come at once.
            h = b - a
            done = np.zeros((h + 1, width + 1), dtype=np.int64)
            done[0, 1:] = prev
            for d in range(h + width - 1):
                y = np.arange(max(0, d - width + 1), min(h, d + 1))
                x = d - y
                left, up, corner = done[y + 1, x], done[y, x + 1], done[y, x]
                if kind == 3:
                    guess = (left + up) >> 1
                else:
                    by_left, by_up, by_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                    guess = np.where((by_left <= by_up) & (by_left <= by_corner), left, np.where(by_up <= by_corner, up, corner))
                done[y + 1, x + 1] = (rows[a + y, x] + guess) & 255
            out[a:b] = done[1:, 1:]
        else:
            raise ValueError(f"unknown filter {kind}")
    return out


def read_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit greyscale PNG without interlace."""
    head, body = None, []
    for kind, content in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            body.append(content)
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit greyscale images without interlace")
    width, height = head[:2]
    rows = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8)
    if len(rows) != height * (width + 1):
        raise ValueError("image data of another size than its header says")
    rows = rows.reshape(height, width + 1)
    return unfilter(rows[:, 0], rows[:, 1:])


def _averaging(n: int, side: int) -> np.ndarray:
    """A side x n matrix that averages n cells into equal shares, fractions of a cell included."""
    edges = np.arange(side + 1) * (n / side)
    cells = np.arange(n)
    overlap = np.minimum(edges[1:, None], cells[None] + 1) - np.maximum(edges[:-1, None], cells[None])
    return np.maximum(overlap, 0) * (side / n)


_COSINE = np.cos(np.pi * (2 * np.arange(SIDE)[None] + 1) * np.arange(LOW)[:, None] / (2 * SIDE))
_ACROSS = _averaging(WIDTH, SIDE)


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits: which of the low frequencies of the averaged image are above their median."""
    height, width = samples.shape
    # Rows are averaged by sums over row spans, so tall images need no tall matrix.
    edges = np.linspace(0, height, SIDE + 1)
    total = np.vstack([np.zeros((1, width)), np.cumsum(samples, axis=0, dtype=np.float64)])
    whole = np.minimum(edges.astype(np.int64), height - 1)
    at = total[whole] + (edges - whole)[:, None] * samples[whole]
    down = np.diff(at, axis=0) / (height / SIDE)
    small = down @ (_ACROSS if width == WIDTH else _averaging(width, SIDE)).T
    low = np.round(_COSINE @ small @ _COSINE.T, 6).ravel()
    bits = low > np.median(low[1:])
    return f"{int(''.join('01'[b] for b in bits.tolist()), 2):016x}"


def store_bytes(data: bytes) -> tuple[bytes, np.ndarray]:
    """A PNG of the bytes, padded by zeros to a positive multiple of the row width."""
    data += bytes(-len(data) % WIDTH if data else WIDTH)
    samples = np.frombuffer(data, dtype=np.uint8).reshape(-1, WIDTH)
    return write_png(samples), samples


def _read_back(media: bytes) -> tuple:
    samples = read_png(media)
    payload = samples.tobytes()
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(samples))


FIELDS = (("payload_bytes", "long", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "long", pa.int64()), ("media_bytes", "long", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string()))


def text_images(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text's bytes as a PNG in a binary column: (id, n_bytes, media); a row for each row, no shuffle.

    A null or empty text is one row of zeros; null ids stay; repeated rows repeat; other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                raws = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) for r in raws], pa.int64()), pa.array([store_bytes(r)[0] for r in raws], pa.binary())], names=["id", "n_bytes", "media"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def payload_features(images: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """What stored texts hold: (id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature).

    Reads the PNGs of ``text_images``, checksums included; a damaged one is an error.
    """
    source = images.select(F.col(id_col).alias("id"), "n_bytes", F.col(media_col).alias("media"))

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                got = list(zip(*map(_read_back, part.column(2).to_pylist()), strict=True)) or [()] * len(FIELDS)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(v, type=t) for v, (_, _, t) in zip(got, FIELDS, strict=True))], names=["id", "n_bytes", *(f[0] for f in FIELDS)])

    out = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n_bytes long, " + ", ".join(f"{n} {t}" for n, t, _ in FIELDS))
    return out.withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the texts' images to the shared folder as a table with a binary column, and read their payloads back."""
    images = Scratch(docs.sparkSession, "media").save(text_images(docs, id_col, text_col), "images", compression="none")
    return payload_features(images, id_col)


def image_features(images: DataFrame, media_col: str = "media", id_col: str = "media_id") -> DataFrame:
    """Width, height and cosine hash of a binary column of PNGs; ``error`` says why one can't be read, null is an error too."""
    source = images.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))

    def one(data: bytes | None) -> tuple:
        try:
            if data is None:
                raise ValueError("null")
            samples = read_png(data)
            if not samples.size:
                raise ValueError("no samples")
            return samples.shape[1], samples.shape[0], cosine_hash(samples), None
        except (ValueError, zlib.error, struct.error) as e:
            return None, None, None, str(e)

    def run(batches):
        types = (pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            got = list(zip(*map(one, batch.column(1).to_pylist()), strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, type=t) for v, t in zip(got, types, strict=True))], names=["id", "width", "height", "feature", "error"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, width long, height long, feature string, error string").withColumnRenamed("id", id_col)

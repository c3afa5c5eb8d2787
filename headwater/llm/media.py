"""Media columns: lossless PNG samples in a binary column and low-frequency cosine hashes.

A payload becomes an 8-bit truecolour PNG: its bytes are the samples, `width`
pixels (3 bytes each) to a row. Rows are filtered by the cheapest of three
filters of the format, the image data deflated into chunks of bounded size, each
with its CRC. Reading back walks the chunks, tests signature, checksums, order
and header, inflates, and undoes all five row filters with numpy. The feature is
the sign pattern of the lowest 8 x 8 coefficients of a cosine transform over the
samples, averaged to a 32 x 32 grid.

Defined cases: a null or empty text gives one row of spaces; equal texts give
equal values whatever their id; a null id stays null; repeated rows give a row
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
STRIDE = 3 * WIDTH
CHUNK = 1 << 20
LEVEL = 4
GRID = 32


class BadImage(ValueError):
    """The bytes are no PNG that this module writes, or a checksum fails."""


def pad(raw: bytes) -> bytes:
    """Spaces up to a positive multiple of a row."""
    return raw + b" " * (max(STRIDE, -(-len(raw) // STRIDE) * STRIDE) - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, level: int = LEVEL) -> bytes:
    """A truecolour PNG of width WIDTH whose samples are the payload; its length must be a multiple of STRIDE."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, STRIDE)
    body = np.empty((len(rows), STRIDE + 1), np.uint8)
    body[:, 0], body[:, 1:] = 0, rows
    # the usual heuristic: the filter whose differences, as signed numbers, are smallest in sum
    cost = _cost(rows)
    for kind, data in ((1, _sub(rows)), (2, _up(rows))):
        own = _cost(data)
        better = own < cost
        body[better, 0], body[better, 1:], cost = kind, data[better], np.minimum(own, cost)
    data = zlib.compress(body.tobytes(), level)
    out = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0))]
    out += [_chunk(b"IDAT", data[i : i + CHUNK]) for i in range(0, len(data), CHUNK)]
    return b"".join([*out, _chunk(b"IEND", b"")])


def _cost(data: np.ndarray) -> np.ndarray:
    return np.minimum(data, -data).sum(axis=1, dtype=np.int64)


def _sub(rows: np.ndarray) -> np.ndarray:
    out = rows.copy()
    out[:, 3:] -= rows[:, :-3]
    return out


def _up(rows: np.ndarray) -> np.ndarray:
    out = rows.copy()
    out[1:] -= rows[:-1]
    return out


def decode_png(stored: bytes) -> bytes:
    """The samples of an 8-bit truecolour PNG without interlacing; BadImage if anything is amiss."""
    if not stored.startswith(SIGNATURE):
        raise BadImage("signature")
    at, head, data, ended = len(SIGNATURE), None, [], False
    while at < len(stored):
        if ended or at + 12 > len(stored):
            raise BadImage("length")
        (size,), kind = struct.unpack_from(">I", stored, at), stored[at + 4 : at + 8]
        body, crc = stored[at + 8 : at + 8 + size], stored[at + 8 + size : at + 12 + size]
        if len(crc) < 4 or zlib.crc32(kind + body) != struct.unpack(">I", crc)[0]:
            raise BadImage(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            ended = True
        at += 12 + size
    if head is None or not ended or head[2:] != (8, 2, 0, 0, 0):
        raise BadImage("header")
    width, height = head[:2]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    except zlib.error as e:
        raise BadImage(str(e)) from e
    if raw.size != height * (3 * width + 1):
        raise BadImage("size")
    raw = raw.reshape(height, 3 * width + 1)
    return unfilter(raw[:, 0], raw[:, 1:].copy(), 3).tobytes()


def unfilter(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """Undoes the row filters in place. Sub is a running sum along a row, a run of Up one down the rows."""
    if kinds.size and kinds.max() > 4:
        raise BadImage("filter")
    sub = np.flatnonzero(kinds == 1)
    if sub.size:
        rows[sub] = np.cumsum(rows[sub].reshape(len(sub), -1, step), axis=1, dtype=np.uint8).reshape(len(sub), -1)
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(kinds)], strict=True):
        if b == a or kinds[a] < 2:
            continue
        if kinds[a] == 2:
            if a:
                rows[a] += rows[a - 1]
            rows[a:b] = np.cumsum(rows[a:b], axis=0, dtype=np.uint8)
            continue
        for y in range(a, b):
            up = rows[y - 1] if y else np.zeros(rows.shape[1], np.uint8)
            _unfilter_by_pixel(kinds[y], rows[y], up, step)
    return rows


def _unfilter_by_pixel(kind: int, row: np.ndarray, up: np.ndarray, step: int) -> None:
    """Average and Paeth depend on the pixel before, which leaves no wider step than a pixel."""
    left = corner = np.zeros(step, np.int32)
    for x in range(0, len(row), step):
        above = up[x : x + step].astype(np.int32)
        if kind == 3:
            guess = (left + above) // 2
        else:
            base = left + above - corner
            a, b, c = abs(base - left), abs(base - above), abs(base - corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
        row[x : x + step] += guess.astype(np.uint8)
        left, corner = row[x : x + step].astype(np.int32), above


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n) + 0.5) * np.arange(k)[:, None])


_COS = _cosines(GRID, 8)


def cosine_hash(payload: bytes) -> str:
    """16 hex digits: signs of the lowest 8 x 8 cosine coefficients against their median."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, STRIDE)
    wide = rows.reshape(len(rows), GRID, -1).sum(axis=2, dtype=np.float64)
    edges = np.arange(GRID + 1) * len(rows) / GRID  # rows shared out by area, so any height fills the grid
    total = np.zeros((len(rows) + 1, GRID))
    np.cumsum(wide, axis=0, out=total[1:])
    whole = np.minimum(edges.astype(np.int64), len(rows) - 1)
    at = total[whole] + (edges - whole)[:, None] * wide[whole]
    small = np.diff(at, axis=0) * (GRID / len(rows))
    low = _COS @ small @ _COS.T
    low[0, 0] = 0.0  # brightness says nothing about the shape
    bits = low.ravel() > np.median(low)
    return np.packbits(bits).tobytes().hex()


def to_media(docs: DataFrame, level: int = LEVEL) -> DataFrame:
    """doc_id, n_bytes, media binary: the text's bytes as a PNG."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                raw = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array([encode_png(pad(x), level) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(write, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Reads every stored image back and describes it; the media column is dropped."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for stored in batch.column(2):
                stored = stored.as_py()
                payload = decode_png(stored)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), cosine_hash(payload)))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _parts(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for i in range(0, max(1, batch.num_rows), rows):
        yield batch.slice(i, rows)

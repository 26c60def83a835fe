"""Netpbm and BMP images as numpy arrays: lossless storage, area resizing by integral images, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 24  # samples on a side; a payload fills whole tiles
UNIT = TILE * TILE


def encode_pgm(pixels: np.ndarray) -> bytes:
    """Binary PGM (P5) of an 8-bit array of rows and columns, or binary PPM (P6) of one with 3 channels."""
    kind = b"P5" if pixels.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (kind, pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, dtype=np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """BMP of an 8-bit array: 8 bits with a grey palette, or 24 bits if it has 3 channels; rows from the bottom up."""
    height, width = pixels.shape[:2]
    rows = pixels if pixels.ndim == 2 else pixels[:, :, ::-1].reshape(height, 3 * width)
    stride = -(-rows.shape[1] // 4) * 4
    body = np.zeros((height, stride), dtype=np.uint8)
    body[:, : rows.shape[1]] = rows[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4) * np.array([1, 1, 1, 0], dtype=np.uint8) if pixels.ndim == 2 else np.zeros((0, 4), dtype=np.uint8)
    at = 54 + palette.size
    head = b"BM" + np.array([at + body.size, 0, at, 40, width, height], dtype="<u4").tobytes() + np.array([1, 8 if pixels.ndim == 2 else 24], dtype="<u2").tobytes()
    return head + np.array([0, body.size, 2835, 2835, 256 if pixels.ndim == 2 else 0, 0], dtype="<u4").tobytes() + palette.tobytes() + body.tobytes()


def _netpbm_header(data: bytes, fields: int) -> tuple[list[int], int]:
    """The header's numbers and where the samples begin; comments run from # to the line's end."""
    found: list[int] = []
    at = 2
    while len(found) < fields:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            at = (data.find(b"\n", at) if data[at : at + 1] == b"#" else at) + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("not a Netpbm header")
        found.append(int(data[at:end]))
        at = end
    return found, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """PBM, PGM and PPM, plain (P1 to P3) or binary (P4 to P6), with up to 16 bits; bits become 0 (black) and 255."""
    kind = data[1:2]
    bits = kind in b"14"
    numbers, at = _netpbm_header(data, 2 if bits else 3)
    width, height, most = *numbers[:2], 1 if bits else numbers[2]
    shape = (height, width, 3) if kind in b"36" else (height, width)
    n = int(np.prod(shape))
    if kind == b"1":
        flat = np.frombuffer(bytes(c for c in data[at - 1 :] if c in b"01"), dtype=np.uint8)[:n] - ord("0")
    elif kind in b"23":
        flat = np.array(data[at - 1 :].split()[:n], dtype=np.int64)
    elif kind == b"4":
        rows = np.frombuffer(data, dtype=np.uint8, offset=at, count=height * -(-width // 8)).reshape(height, -1)
        flat = np.unpackbits(rows, axis=1)[:, :width].reshape(-1)
    else:
        flat = np.frombuffer(data, dtype=np.uint8 if most < 256 else ">u2", offset=at, count=n)
    pixels = flat.reshape(shape)
    if bits:
        return ((1 - pixels) * 255).astype(np.uint8)
    return pixels.astype(np.uint8 if most < 256 else np.uint16)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 bits (grey palettes give two dimensions, others three), 24 or 32 bits."""
    at, _, width = np.frombuffer(data, dtype="<u4", offset=10, count=3).tolist()
    height = int(np.frombuffer(data, dtype="<i4", offset=22, count=1)[0])
    depth = int(np.frombuffer(data, dtype="<u2", offset=28, count=1)[0])
    if depth not in (8, 24, 32) or np.frombuffer(data, dtype="<u4", offset=30, count=1)[0] not in (0, 3):
        raise ValueError(f"BMP of {depth} bits or compressed")
    stride = -(-width * depth // 32) * 4
    rows = np.frombuffer(data, dtype=np.uint8, offset=at, count=stride * abs(height)).reshape(abs(height), stride)
    rows = rows[::-1] if height > 0 else rows
    if depth > 8:
        return rows[:, : width * depth // 8].reshape(abs(height), width, depth // 8)[:, :, 2::-1]
    head = int(np.frombuffer(data, dtype="<u4", offset=14, count=1)[0])
    colours = (at - 14 - head) // 4
    palette = np.frombuffer(data, dtype=np.uint8, offset=14 + head, count=4 * colours).reshape(colours, 4)[:, 2::-1]
    full = palette[rows[:, :width]]
    return full[:, :, 0] if (palette == palette[:, :1]).all() else full


def decode(data: bytes) -> np.ndarray:
    """An image of either format, known by its first two bytes."""
    if data[:2] == b"BM":
        return decode_bmp(data)
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def grey(pixels: np.ndarray) -> np.ndarray:
    """One channel: the mean of the colours, rounded down."""
    return pixels if pixels.ndim == 2 else pixels.sum(axis=2, dtype=np.int64) // 3


def _sums_to(integral: np.ndarray, edges: np.ndarray, parts: int) -> np.ndarray:
    """Integral values along the last axis at edges / parts, straight lines between samples; all times `parts`."""
    whole, rest = edges // parts, edges % parts
    following = np.minimum(whole + 1, integral.shape[-1] - 1)
    return integral[..., whole] * (parts - rest) + integral[..., following] * rest


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Exact area means (as doubles) of arrays whose last two axes are rows and columns, from their integral image."""
    rows, columns = pixels.shape[-2:]
    integral = np.zeros((*pixels.shape[:-2], rows + 1, columns + 1), dtype=np.int64)
    integral[..., 1:, 1:] = pixels.cumsum(axis=-2, dtype=np.int64).cumsum(axis=-1)
    across = _sums_to(integral, np.arange(width + 1) * columns, width)
    down = _sums_to(np.swapaxes(across, -1, -2), np.arange(height + 1) * rows, height)
    return np.swapaxes(np.diff(np.diff(down, axis=-1), axis=-2), -1, -2) / (rows * columns)


def difference_hash(pixels: np.ndarray) -> np.ndarray:
    """64 bits for each array: whether each of 8 x 8 area means is less than its right neighbour."""
    small = area_resize(pixels, 8, 9)
    bits = (small[..., :-1] < small[..., 1:]).reshape(*small.shape[:-2], 64)
    return np.packbits(bits, axis=-1)


def npy(pixels: np.ndarray) -> bytes:
    buffer = io.BytesIO()
    np.save(buffer, np.ascontiguousarray(pixels), allow_pickle=False)
    return buffer.getvalue()


def read_npy(data: bytes | pa.Buffer) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """The bytes of a text, and the same with bytes 255 up to a positive multiple of a tile."""
    data = (text or "").encode()
    size = max(1, -(-len(data) // UNIT)) * UNIT
    return len(data), data.ljust(size, b"\xff")


#: Tiles of one NPY array of a text's media: what a task holds beside the text itself.
TILES_AT_ONCE = 1024


def npy_tiles(pixels: np.ndarray) -> Iterator[bytes]:
    """A grey image of whole tiles, TILE wide, as NPY arrays (tiles, rows, columns) of TILES_AT_ONCE tiles at most."""
    tiles = pixels.reshape(-1, TILE, TILE)
    for at in range(0, len(tiles), TILES_AT_ONCE):
        yield npy(tiles[at : at + TILES_AT_ONCE])


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ("doc_id", "n_bytes", "media"), (pa.int64(), pa.int64(), pa.list_(pa.binary()))
    for batch in batches:
        rows, held = [], 0
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            n, payload = payload_of(text.as_py())
            image = decode(encode_pgm(np.frombuffer(payload, dtype=np.uint8).reshape(-1, TILE)))
            rows.append((i, n, list(npy_tiles(grey(image)))))
            held += len(payload)
            if held > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def text_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) of each row: the text's padded bytes as a PGM image, 24 samples to a row, decoded and written as NPY tiles.

    A null text is empty and so one tile of 255; repeated rows, null ids and texts of any length are treated alike; an
    empty table gives no rows; other columns are not carried.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(lambda b: _stored(b), "doc_id long, n_bytes long, media array<binary>")


class Bands:
    """The difference hash of an image that comes block by block: sums of its columns in eight bands of rows."""

    def __init__(self, rows: int, columns: int):
        self.rows, self.columns, self.seen = rows, columns, 0
        self.sums = np.zeros((8, columns), dtype=np.int64)

    def add(self, block: np.ndarray) -> None:
        """Rows must be a multiple of eight in all, so that bands have whole rows."""
        height = self.rows // 8
        for band in range(self.seen // height, min(7, (self.seen + len(block) - 1) // height) + 1):
            low, high = max(band * height - self.seen, 0), (band + 1) * height - self.seen
            self.sums[band] += block[low:high].sum(axis=0, dtype=np.int64)
        self.seen += len(block)

    def hash(self) -> bytes:
        integral = np.zeros((8, self.columns + 1), dtype=np.int64)
        integral[:, 1:] = self.sums.cumsum(axis=1)
        across = np.diff(_sums_to(integral, np.arange(10) * self.columns, 9), axis=1)
        return np.packbits((across[:, :-1] < across[:, 1:]).reshape(64)).tobytes()


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, n_bytes, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            payload, stored, tiles = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
            parts = [part.as_buffer() for part in media.values]
            # All arrays but the last have TILES_AT_ONCE tiles.
            last = read_npy(parts[-1])
            n_tiles = (len(parts) - 1) * TILES_AT_ONCE + len(last)
            bands, size = Bands(n_tiles * TILE, TILE), 0
            for k, part in enumerate(parts):
                block = last if k == len(parts) - 1 else read_npy(part)
                stored.update(part)
                data = block.tobytes()
                payload.update(data)
                tiles.update(difference_hash(block).tobytes())
                bands.add(block.reshape(-1, TILE))
                size += part.size
            feature = f"{bands.hash().hex()}-{tiles.hexdigest()[:16]}"
            out.append((doc_id, n_bytes, n_tiles * UNIT, payload.hexdigest(), zlib.crc32(data[-32:]), size, stored.hexdigest(), feature))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in FEATURES.split(", ")])


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of stored NPY tiles (doc_id, n_bytes, media), all from the stored bytes, a block at a time.

    feature: the difference hash of the whole image, then the first half of a SHA-256 over the hashes of its tiles.
    media_bytes and media_sha256 are of the NPY arrays one after the other. Repeated rows and null ids stay; an empty
    table gives no rows.
    """
    return media.mapInArrow(lambda b: _features(b), FEATURES)


def _tiles(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            try:
                pixels, why = decode(data.as_py() or b""), None
            except (ValueError, IndexError) as e:
                pixels, why = None, str(e)
            rows = [(key, None, None, None, None, why)] if pixels is None else []
            if pixels is not None:
                for y in range(0, pixels.shape[0], size):
                    for x in range(0, pixels.shape[1], size):
                        tile = pixels[y : y + size, x : x + size]
                        rows.append((key, y, x, npy(tile), difference_hash(grey(tile)).tobytes().hex(), None))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
            for at in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[at : at + 256]], k) for i, k in enumerate(kinds)], names=["key", "y", "x", "npy", "dhash", "error"])


def image_tiles(images: DataFrame, key: str, data: str, size: int = TILE) -> DataFrame:
    """One row for each tile of each image: key (as a string), y, x, the tile as NPY, its difference hash, error.

    Bytes that are null, empty or of another format give one row with an error and no tile.
    """
    return images.select(F.col(key).cast("string").alias("key"), F.col(data).cast("binary").alias("data")).mapInArrow(lambda b: _tiles(b, size), "key string, y int, x int, npy binary, dhash string, error string")

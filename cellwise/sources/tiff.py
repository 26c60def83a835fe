"""Tiled TIFF 6.0 files of grids and masks, one file for each block of the grid, so that no task holds more than a block.

A block's first cell stands in the page name. Rows of the image are x, columns y, so the orientation is left-top. Grids are
palette images with as few bits a sample as their regions need; masks have a directory for each algorithm and a depth for each region.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.functions.bits import minimum_bits
from cellwise.functions.rng import hash_u32_value
from cellwise.schema import RegionfieldMeta

# TIFF's numbers of tags, types and codecs, and the tags of region counts and algorithms.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, ORIENTATION, SAMPLES, PAGE_NAME, COLORMAP = 256, 257, 258, 259, 262, 274, 277, 285, 320
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT, DEPTH, TILE_DEPTH = 322, 323, 324, 325, 339, 32997, 32998
STRIP_OFFSETS, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 273, 278, 279, 284, 317
REGION_COUNT, ALGORITHM = 18007, 29716
ASCII, SHORT, LONG = 2, 3, 4
TYPES = {1: "B", ASCII: "c", SHORT: "H", LONG: "I"}
CODECS = {"none": 1, "lzw": 5, "deflate": 8, "zstd": 50000}
#: LZW's codes for an empty table and the end, and the first of strings.
CLEAR, END, FIRST = 256, 257, 258
LEFT_TOP, PALETTE, BLACK_IS_ZERO = 5, 3, 1


def lzw_compress(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, the highest bit first; a code gets longer one entry before its table needs it."""
    out, held, bits = bytearray(), 0, 0
    table = {bytes([i]): i for i in range(256)}
    width, following, prefix = 9, FIRST, b""

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(CLEAR)
    for i in range(len(data)):
        longer = prefix + data[i : i + 1]
        if longer in table:
            prefix = longer
            continue
        put(table[prefix])
        table[longer] = following
        following += 1
        width = max(width, following.bit_length())
        if following == 4094:
            put(CLEAR)
            table, width, following = {bytes([j]): j for j in range(256)}, 9, FIRST
        prefix = data[i : i + 1]
    if prefix:
        put(table[prefix])
        following += 1
        width = max(width, following.bit_length())
    put(END)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def lzw_expand(data: bytes) -> bytes:
    out, held, bits, at = bytearray(), 0, 0, 0
    table, width, last = [], 9, b""
    while True:
        while bits < width:
            if at >= len(data):
                return bytes(out)
            held, bits, at = held << 8 | data[at], bits + 8, at + 1
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == END:
            return bytes(out)
        if code == CLEAR:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code < len(table):
            string = table[code]
        elif last and code == len(table):
            string = last + last[:1]
        else:
            raise ValueError("LZW code out of order")
        out += string
        if last:
            table.append(last + string[:1])
        last = string
        width = max(9, min(12, (len(table) + 1).bit_length()))


def _compress(data: bytes, codec: int, level: int = 3) -> bytes:
    if codec == CODECS["lzw"]:
        return lzw_compress(data)
    if codec == CODECS["zstd"]:
        import zstandard

        return zstandard.ZstdCompressor(level=level).compress(data)
    return zlib.compress(data, level) if codec == CODECS["deflate"] else data


def _expand(data: bytes, codec: int) -> bytes:
    if codec == CODECS["zstd"]:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data)
    if codec in (CODECS["deflate"], 32946):  # its number now and before
        return zlib.decompress(data)
    if codec == CODECS["lzw"]:
        return lzw_expand(data)
    if codec != CODECS["none"]:
        raise ValueError(f"compression {codec}")
    return data


def _packed(tile: np.ndarray, bits: int) -> bytes:
    """Rows of samples, the first in the highest bits; each row begins at a byte."""
    if bits >= 8:
        return tile.astype("<u2" if bits == 16 else "u1").tobytes()
    spread = (tile[..., None] >> np.arange(bits - 1, -1, -1)) & 1
    return np.packbits(spread.reshape(*tile.shape[:-1], -1).astype(np.uint8), axis=-1).tobytes()


def _unpacked(data: bytes, rows: int, columns: int, bits: int, order: str = "<") -> np.ndarray:
    if bits >= 8:
        return np.frombuffer(data, dtype=f"{order}u2" if bits == 16 else "u1", count=rows * columns).reshape(rows, columns)
    one = np.unpackbits(np.frombuffer(data, dtype=np.uint8).reshape(rows, -1), axis=1)[:, : columns * bits]
    return one.reshape(rows, columns, bits) @ (1 << np.arange(bits - 1, -1, -1))


def palette(regions: int, bits: int, seed: int) -> list[int]:
    """16-bit red, green and blue of each code, drawn by seed and code; codes beyond the regions are black."""
    return [hash_u32_value(seed, f"palette:{c}", i) % 65536 if i < regions else 0 for c in "rgb" for i in range(1 << bits)]


def encode(directories: list[tuple[np.ndarray, dict[int, tuple[int, list]]]], bits: int, codec: str = "zstd", tile: int = 128) -> bytes:
    """A file with a directory for each (images, further tags); images are depth x rows x columns. Tiles repeat the edge."""
    number, out = CODECS[codec], bytearray(b"II*\0\0\0\0\0")
    link = 4
    for images, further in directories:
        depth, rows, columns = images.shape
        offsets, sizes = [], []
        for z in range(depth):
            for y in range(0, rows, tile):
                for x in range(0, columns, tile):
                    part = images[z, y : y + tile, x : x + tile]
                    whole = np.pad(part, ((0, tile - part.shape[0]), (0, tile - part.shape[1])), mode="edge")
                    data = _compress(_packed(whole, bits), number)
                    offsets.append(len(out))
                    sizes.append(len(data))
                    out += data
        tags = {
            WIDTH: (LONG, [columns]), LENGTH: (LONG, [rows]), BITS: (SHORT, [bits]), COMPRESSION: (SHORT, [number]), PHOTOMETRIC: (SHORT, [BLACK_IS_ZERO]), ORIENTATION: (SHORT, [LEFT_TOP]), SAMPLES: (SHORT, [1]),
            TILE_WIDTH: (LONG, [tile]), TILE_LENGTH: (LONG, [tile]), TILE_OFFSETS: (LONG, offsets), TILE_BYTES: (LONG, sizes), SAMPLE_FORMAT: (SHORT, [1]), DEPTH: (LONG, [depth]), TILE_DEPTH: (LONG, [1]),
        }
        tags |= further
        entries = b""
        for tag, (kind, values) in sorted(tags.items()):
            data = bytes(values) if kind == ASCII else struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
            if len(data) > 4:
                place = len(out) + len(out) % 2
                out += b"\0" * (len(out) % 2) + data
                data = struct.pack("<I", place)
            entries += struct.pack("<HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def decode(data: bytes) -> Iterator[tuple[np.ndarray, dict[int, list]]]:
    """(images, tags) of each directory; raises for what is no TIFF of tiles or strips with unsigned samples of up to 16 bits.

    Either byte order. images: depth x rows x columns, and a fourth axis where a pixel has several samples.
    """
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF")
    order = "<" if data[:1] == b"I" else ">"
    (at,) = struct.unpack_from(f"{order}I", data, 4)
    while at:
        (n,) = struct.unpack_from(f"{order}H", data, at)
        tags: dict[int, list] = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * i)
            if kind not in TYPES:
                continue
            form = f"{order}{count}{TYPES[kind]}"
            place = at + 10 + 12 * i
            if struct.calcsize(form) > 4:
                (place,) = struct.unpack_from(f"{order}I", data, place)
            tags[tag] = list(struct.unpack_from(form, data, place))
        samples = tags.get(SAMPLES, [1])[0]
        if not tags.keys() & {TILE_OFFSETS, STRIP_OFFSETS} or any(x != 1 for x in tags.get(SAMPLE_FORMAT, [1])) or len(set(tags.get(BITS, [1]))) > 1 or tags.get(BITS, [1])[0] > 16:
            raise ValueError("neither tiles nor strips, or not of unsigned samples of 16 bits at most")
        if samples > 1 and tags.get(PLANAR, [1])[0] != 1 or tags.get(PREDICTOR, [1])[0] != 1:
            raise ValueError("planes apart, or a predictor")
        rows, columns, bits, depth = tags[LENGTH][0], tags[WIDTH][0], tags.get(BITS, [1])[0], tags.get(DEPTH, [1])[0]
        tiled = TILE_OFFSETS in tags
        tall, wide = (tags[TILE_LENGTH][0], tags[TILE_WIDTH][0]) if tiled else (min(rows, tags.get(ROWS_PER_STRIP, [rows])[0]), columns)
        images = np.zeros((depth, rows, columns, samples), dtype=np.uint16)
        places = [(z, y, x) for z in range(depth) for y in range(0, rows, tall) for x in range(0, columns, wide)]
        offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
        for (z, y, x), offset, size in zip(places, offsets, sizes, strict=True):
            high = tall if tiled else min(tall, rows - y)
            tile = _unpacked(_expand(data[offset : offset + size], tags.get(COMPRESSION, [1])[0]), high, wide * samples, bits, order).reshape(high, wide, samples)
            images[z, y : y + tall, x : x + wide] = tile[: rows - y, : columns - x]
        yield images[..., 0] if samples == 1 else images, tags
        (at,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)


def _origin(tags: dict[int, list]) -> tuple[int, int]:
    name = b"".join(tags.get(PAGE_NAME, [b"0 0"])).rstrip(b"\0").split()
    return int(name[0]), int(name[1])


def _page_name(x0: int, y0: int) -> tuple[int, list]:
    return ASCII, list(f"{x0} {y0}\0".encode())


def _blocks(df: DataFrame, block: int) -> DataFrame:
    return df.withColumn("bx", F.floor(F.col("x") / F.lit(block)).cast("int")).withColumn("by", F.floor(F.col("y") / F.lit(block)).cast("int"))


def field_files(field: DataFrame, meta: RegionfieldMeta, block: int = 2048, codec: str = "zstd", seed: int = 0) -> DataFrame:
    """(name, content): a TIFF file for each block of a complete grid. Fails for fewer than two regions."""
    if meta.region_count < 2:
        raise ValueError("a palette image needs two regions at least")
    bits = minimum_bits(meta.region_count - 1)
    colours = palette(meta.region_count, bits, seed)

    def encoded(pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(pdf["x"].min()), int(pdf["y"].min())
        grid = np.zeros((int(pdf["x"].max()) - x0 + 1, int(pdf["y"].max()) - y0 + 1), dtype=np.uint8)
        grid[pdf["x"].to_numpy() - x0, pdf["y"].to_numpy() - y0] = pdf["region"].to_numpy()
        tags = {PHOTOMETRIC: (SHORT, [PALETTE]), COLORMAP: (SHORT, colours), REGION_COUNT: (SHORT, [meta.region_count]), PAGE_NAME: _page_name(x0, y0)}
        return pd.DataFrame({"name": [f"field-{x0}-{y0}.tif"], "content": [encode([(grid[None], tags)], bits, codec)]})

    return _blocks(field.select("x", "y", "region"), block).groupBy("bx", "by").applyInPandas(encoded, "name string, content binary")


def mask_files(masks: DataFrame, meta: RegionfieldMeta, block: int = 1024, codec: str = "zstd") -> DataFrame:
    """(name, content): a file for each block of masks (algorithm, region, x, y, code), where code has 16 bits."""

    def encoded(pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(pdf["x"].min()), int(pdf["y"].min())
        shape = (meta.region_count, int(pdf["x"].max()) - x0 + 1, int(pdf["y"].max()) - y0 + 1)
        directories = []
        for algorithm, part in pdf.groupby("algorithm"):
            images = np.zeros(shape, dtype=np.uint16)
            images[part["region"], part["x"] - x0, part["y"] - y0] = part["code"]
            directories.append((images, {ALGORITHM: (SHORT, [int(algorithm)]), PAGE_NAME: _page_name(x0, y0)}))
        return pd.DataFrame({"name": [f"mask-{x0}-{y0}.tif"], "content": [encode(directories, 16, codec)]})

    return _blocks(masks.select("algorithm", "region", "x", "y", "code"), block).groupBy("bx", "by").applyInPandas(encoded, "name string, content binary")


def write_files(files: DataFrame, folder: str) -> None:
    """Writes (name, content) to a folder, a file for each row; a task that runs again writes the same.

    folder: a path that all executors share, or an address of a file system that Arrow knows (file:, hdfs:, s3:, gs:).
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder) if re.match(r"[a-z][a-z0-9+]*:", folder) else (fs.LocalFileSystem(), folder)
        system.create_dir(path, recursive=True)
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                part = f"{path}/.{name}-{uuid.uuid4().hex}"  # attempts that run at once do not meet
                with system.open_output_stream(part) as out:
                    out.write(bytes(content))
                system.move(part, f"{path}/{name}")
            yield pdf[["name"]]

    files.mapInPandas(write, "name string").count()


def _decoded(files: DataFrame, rows, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                for images, tags in decode(bytes(content)):
                    yield rows(images, tags)

    return files.select("content").mapInPandas(run, schema)


def field_from_files(files: DataFrame) -> DataFrame:
    """The grid of TIFF files with a column `content`."""

    def rows(images: np.ndarray, tags: dict[int, list]) -> pd.DataFrame:
        x0, y0 = _origin(tags)
        x, y = np.indices(images.shape[1:]).reshape(2, -1)
        return pd.DataFrame({"x": (x + x0).astype("int32"), "y": (y + y0).astype("int32"), "region": images[0].reshape(-1).astype("int32")})

    return _decoded(files, rows, "x int, y int, region int")


def masks_from_files(files: DataFrame) -> DataFrame:
    """(algorithm, region, x, y, code) of TIFF files, codes of zero left out."""

    def rows(images: np.ndarray, tags: dict[int, list]) -> pd.DataFrame:
        x0, y0 = _origin(tags)
        region, x, y = np.nonzero(images)
        return pd.DataFrame({"algorithm": np.int32(tags[ALGORITHM][0]), "region": region.astype("int32"), "x": (x + x0).astype("int32"), "y": (y + y0).astype("int32"), "code": images[region, x, y].astype("int32")})

    return _decoded(files, rows, "algorithm int, region int, x int, y int, code int")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """The TIFF files of a folder, by any file system that Spark reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(folder).select("path", "content")

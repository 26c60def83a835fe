"""Images as features and results: PNG and binary Netpbm beside TIFF, features by region, one image for each layer, archives."""

from __future__ import annotations

import io
import struct
import tarfile
import zlib
from collections.abc import Iterator, Mapping
from pathlib import PurePath

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.functions.quantise import limits
from cellwise.sources import tiff

# Signatures, and the colour types of PNG by their samples.
PNG = b"\x89PNG\r\n\x1a\n"
PNG_SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}
#: Formats by the endings of files' names.
FORMATS = {".png": "png", ".pgm": "pgm", ".ppm": "pgm", ".tif": "tiff", ".tiff": "tiff"}


def format_of(name: str) -> str:
    """The format that a file's name ends in."""
    ending = PurePath(name).suffix.lower()
    if ending not in FORMATS:
        raise ValueError(f"{name!r} ends in none of {sorted(FORMATS)}")
    return FORMATS[ending]


def encode_png(pixels: np.ndarray) -> bytes:
    """PNG of rows x columns, or rows x columns x samples, of 8 or 16 bits."""
    pixels = pixels if pixels.ndim == 3 else pixels[..., None]
    rows, columns, samples = pixels.shape
    kind = {n: k for k, n in PNG_SAMPLES.items()}[samples]
    lines = np.ascontiguousarray(pixels.astype(">u2" if pixels.dtype == np.uint16 else "u1")).reshape(rows, -1).view(np.uint8)
    body = zlib.compress(np.concatenate((np.zeros((rows, 1), dtype=np.uint8), lines), axis=1).tobytes(), 6)
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", columns, rows, 16 if pixels.dtype == np.uint16 else 8, kind, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def _unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Lines of a PNG whose first byte names the filter; step: bytes of a pixel."""
    out = np.zeros((len(lines) + 1, lines.shape[1] - 1 + step), dtype=np.uint8)
    for y, line in enumerate(lines, 1):
        kind, data = int(line[0]), line[1:]
        now, above = out[y, step:], out[y - 1]
        if kind == 0:
            now[:] = data
        elif kind == 1:
            now[:] = data.reshape(-1, step).cumsum(axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            now[:] = data + above[step:]
        elif kind in (3, 4):
            row = out[y]
            for x in range(len(data)):
                a, b, c = int(row[x]), int(above[x + step]), int(above[x])
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                row[x + step] = (int(data[x]) + guess) & 255
        else:
            raise ValueError(f"PNG filter {kind}")
    return out[1:, step:]


def decode_png(data: bytes) -> np.ndarray:
    """Rows x columns x samples of a PNG of 8 or 16 bits without palette or interlacing."""
    if data[:8] != PNG:
        raise ValueError("not a PNG")
    at, body, head = 8, b"", None
    while at + 8 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif name == b"IDAT":
            body += part
        at += 12 + size
    if head is None or head[2] not in (8, 16) or head[3] not in PNG_SAMPLES or head[6]:
        raise ValueError("a PNG with palette, interlacing or other bits than 8 and 16")
    columns, rows, bits, kind = head[:4]
    step = PNG_SAMPLES[kind] * bits // 8
    lines = np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(rows, 1 + columns * step)
    pixels = np.ascontiguousarray(_unfiltered(lines, step))
    return pixels.view(">u2" if bits == 16 else "u1").reshape(rows, columns, PNG_SAMPLES[kind]).astype(np.uint16 if bits == 16 else np.uint8)


def encode_pgm(pixels: np.ndarray) -> bytes:
    """Binary Netpbm of rows x columns, or with three samples, of 8 or 16 bits."""
    kind, most = (b"P6" if pixels.ndim == 3 else b"P5"), 65535 if pixels.dtype == np.uint16 else 255
    return b"%s\n%d %d\n%d\n" % (kind, pixels.shape[1], pixels.shape[0], most) + pixels.astype(">u2" if most > 255 else "u1").tobytes()


def decode_pgm(data: bytes) -> np.ndarray:
    """Rows x columns x samples of a binary Netpbm without comments."""
    fields = data[:64].split(maxsplit=4)
    if len(fields) < 4 or fields[0] not in (b"P5", b"P6"):
        raise ValueError("not a binary Netpbm of greys or colours")
    columns, rows, most = map(int, fields[1:4])
    samples, kind = 3 if fields[0] == b"P6" else 1, ">u2" if most > 255 else "u1"
    start = len(data) - rows * columns * samples * np.dtype(kind).itemsize
    return np.frombuffer(data, dtype=kind, offset=start).reshape(rows, columns, samples).astype(np.uint16 if most > 255 else np.uint8)


def decode(data: bytes) -> list[np.ndarray]:
    """The layers of an image, each rows x columns x samples: one, or one for each directory and depth of a TIFF."""
    if data[:2] in (b"II", b"MM"):
        return [layer if layer.ndim == 3 else layer[..., None] for images, tags in tiff.decode(data) for layer in (images.astype(np.uint8) if tags.get(tiff.BITS, [1])[0] <= 8 else images)]
    return [decode_png(data) if data[:8] == PNG else decode_pgm(data)]


def encode(pixels: np.ndarray, form: str) -> bytes:
    if form == "tiff":
        return tiff.encode([(pixels[None], {})], 16 if pixels.dtype == np.uint16 else 8)
    if form not in ("png", "pgm"):
        raise ValueError(f"format {form!r}")
    return encode_png(pixels) if form == "png" else encode_pgm(pixels)


FEATURES = "region int, x int, y int, channel int, value double"


def features_from_files(files: DataFrame, rows_at_once: int = 256) -> DataFrame:
    """(region, x, y, channel, value) of images (region, content): samples as shares of their type's range.

    A file with several layers has those of the regions from its own number on. x is the image's row, y its column, as
    grids are stored. Some rows of an image are made at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for region, content in zip(pdf["region"], pdf["content"], strict=True):
                for k, layer in enumerate(decode(bytes(content))):
                    most = float(np.iinfo(layer.dtype).max)
                    for at in range(0, len(layer), rows_at_once):
                        part = layer[at : at + rows_at_once]
                        x, y, channel = (i.reshape(-1).astype("int32") for i in np.indices(part.shape))
                        yield pd.DataFrame({"region": np.int32(region + k), "x": x + np.int32(at), "y": y, "channel": channel, "value": part.reshape(-1) / most})

    return files.select(F.col("region").cast("int").alias("region"), "content").mapInPandas(run, FEATURES)


def read_features(spark: SparkSession, paths: Mapping[int, str]) -> DataFrame:
    """The features of each region from the image at its path, by any file system that Spark reads."""
    parts = []
    for region, path in sorted(paths.items()):
        format_of(path)
        parts.append(spark.read.format("binaryFile").load(path).select(F.lit(region).alias("region"), "content"))
    files = parts[0]
    for other in parts[1:]:
        files = files.unionByName(other)
    return features_from_files(files)


def layer_images(masks: DataFrame, block: int = 1024, form: str = "png", kind: str = "u16") -> DataFrame:
    """(algorithm, region, name, content): an image for each algorithm, region and block of masks (algorithm, region, x, y, code).

    code has 16 bits; kind u8 or u16 is what the images have. Cells without a row are zero; a block's size is that of its cells.
    """
    if kind not in ("u8", "u16"):
        raise ValueError(f"images of {kind!r}")
    most = limits(kind)[1]
    blocks = masks.withColumn("bx", F.floor(F.col("x") / F.lit(block)).cast("int")).withColumn("by", F.floor(F.col("y") / F.lit(block)).cast("int"))
    spans = blocks.groupBy("bx", "by").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    dealt = blocks.join(spans, ["bx", "by"])

    def encoded(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        image = np.zeros((int(row["x1"] - row["x0"]) + 1, int(row["y1"] - row["y0"]) + 1), dtype=np.uint16)
        image[pdf["x"].to_numpy() - int(row["x0"]), pdf["y"].to_numpy() - int(row["y0"])] = pdf["code"].to_numpy()
        if kind == "u8":
            image = np.round(image / 65535.0 * most).astype(np.uint8)
        ending = next(e for e, f in FORMATS.items() if f == form)
        name = f"Directory-{int(row['algorithm'])}_Depth-{int(row['region'])}_{int(row['x0'])}-{int(row['y0'])}{ending}"
        return pd.DataFrame({"algorithm": [np.int32(row["algorithm"])], "region": [np.int32(row["region"])], "name": [name], "content": [encode(image, form)]})

    return dealt.groupBy("algorithm", "region", "bx", "by").applyInPandas(encoded, "algorithm int, region int, name string, content binary")


def archives(files: DataFrame, by: str) -> DataFrame:
    """(name, content): a tar archive of the files (name, content) of each value of `by`, in order of their names."""

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        buffer, stem = io.BytesIO(), str(pdf[by].iloc[0])
        with tarfile.open(fileobj=buffer, mode="w") as tar:
            for name, content in sorted(zip(pdf["name"], pdf["content"], strict=True)):
                info = tarfile.TarInfo(f"{stem}/{name}")
                info.size = len(content)
                tar.addfile(info, io.BytesIO(bytes(content)))
        return pd.DataFrame({"name": [f"{stem}.tar"], "content": [buffer.getvalue()]})

    return files.select(by, "name", "content").groupBy(by).applyInPandas(packed, "name string, content binary")

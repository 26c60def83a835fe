"""Images, archives, configurations and the command line."""

import io
import tarfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellwise.__main__ import parser, run
from cellwise.functions.quantise import promoted
from cellwise.operators.blend import blend
from cellwise.plans.sweeps import Config, Span, config_from_yaml, parse_yaml
from cellwise.sources import images, tables, tiff

from grid_rows import rows


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=9000) | st.lists(st.sampled_from([b"a", b"ab", b"\0" * 50, b"xyz" * 9]), max_size=600).map(b"".join))
def test_lzw(data):
    assert tiff.lzw_expand(tiff.lzw_compress(data)) == data


def test_lzw_of_long_data():
    data = np.random.default_rng(1).integers(0, 7, 200_000).astype(np.uint8).tobytes()
    assert tiff.lzw_expand(tiff.lzw_compress(data)) == data


def big_endian(pixels):
    """A TIFF of one strip of 16-bit samples, the highest byte first, put together by hand."""
    rows_, columns = pixels.shape
    body = pixels.astype(">u2").tobytes()
    entries = [(256, 4, columns), (257, 4, rows_), (258, 3, 16), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, rows_), (279, 4, len(body))]
    directory = len(entries).to_bytes(2, "big")
    for tag, kind, value in entries:
        directory += tag.to_bytes(2, "big") + kind.to_bytes(2, "big") + (1).to_bytes(4, "big") + (value.to_bytes(4, "big") if kind == 4 else value.to_bytes(2, "big") + b"\0\0")
    return b"MM\0*" + (8 + len(body)).to_bytes(4, "big") + body + directory + b"\0" * 4


def test_big_endian_strips():
    pixels = np.arange(35, dtype=np.uint16).reshape(5, 7) * 1111
    ((back, _),) = tiff.decode(big_endian(pixels))
    assert (back[0] == pixels).all()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([1, 3]), st.sampled_from([np.uint8, np.uint16]), st.randoms(use_true_random=False))
def test_codecs(height, width, samples, kind, random):
    pixels = np.array([random.randrange(np.iinfo(kind).max + 1) for _ in range(height * width * samples)], dtype=kind).reshape(height, width, samples)
    for data in (images.encode_png(pixels), images.encode_pgm(pixels if samples == 3 else pixels[..., 0])):
        (back,) = images.decode(data)
        assert back.dtype == kind and (back == pixels).all()


def test_png_filters():
    pixels = np.random.default_rng(2).integers(0, 256, (6, 8, 3)).astype(np.int64)
    lines = []
    for y in range(6):
        kind, line = y % 5, []
        for x in range(8):
            for c in range(3):
                a, b, d = (pixels[y, x - 1, c] if x else 0), (pixels[y - 1, x, c] if y else 0), (pixels[y - 1, x - 1, c] if x and y else 0)
                near = min((abs(a + b - d - v), i) for i, v in enumerate((a, b, d)))[1]
                line.append((pixels[y, x, c] - (0, a, b, (a + b) // 2, (a, b, d)[near])[kind]) % 256)
        lines.append([kind, *line])
    assert (images._unfiltered(np.array(lines, dtype=np.uint8), 3).reshape(6, 8, 3) == pixels).all()


def test_features_from_images(spark, tmp_path):
    r = np.random.default_rng(3)
    layers = [r.integers(0, 256, (4, 5)).astype(np.uint8) for _ in range(3)]
    (tmp_path / "a.png").write_bytes(images.encode_png(layers[0]))
    (tmp_path / "b.tif").write_bytes(tiff.encode([(np.stack(layers[1:]).astype(np.uint16), {})], 8, "lzw", 16))
    features = images.read_features(spark, {0: str(tmp_path / "a.png"), 1: str(tmp_path / "b.tif")})
    got = {(f["region"], f["x"], f["y"]): f["value"] for f in features.collect()}
    assert got == {(k, x, y): layer[x, y] / 255 for k, layer in enumerate(layers) for x in range(4) for y in range(5)}
    masks = spark.createDataFrame([(0, x, y, k, k + 1, 6) for k in range(3) for x in range(4) for y in range(5)], "algorithm int, x int, y int, region int, importance long, norm int")
    blended = {(b["x"], b["y"]): b["value"] for b in blend(masks, features).collect()}
    assert all(abs(blended[x, y] - sum((k + 1) * int(layers[k][x, y]) / 255 for k in range(3)) / 6) < 1e-12 for x in range(4) for y in range(5))
    with pytest.raises(ValueError):
        images.read_features(spark, {0: "a.jpg"})


def test_layers_and_archives(spark):
    codes = np.random.default_rng(4).integers(0, 65536, (2, 3, 6, 5))
    masks = spark.createDataFrame([(a, k, x, y, int(codes[a, k, x, y])) for a in range(2) for k in range(3) for x in range(6) for y in range(5)], "algorithm int, region int, x int, y int, code int")
    for kind, scale in (("u16", 1), ("u8", 257)):
        files = images.layer_images(masks, block=4, kind=kind).withColumn("stem", F.concat(F.lit("m"), "algorithm"))
        for tar in images.archives(files, "stem").collect():
            with tarfile.open(fileobj=io.BytesIO(bytes(tar["content"]))) as t:
                a, seen = int(tar["name"][1]), 0
                for member in t.getmembers():
                    depth, at = member.name.split("Depth-")[1].split("_")
                    x0, y0 = map(int, at.split(".")[0].split("-"))
                    (pixels,) = images.decode(t.extractfile(member).read())
                    expected = codes[a, int(depth), x0 : x0 + 4, y0 : y0 + 4]
                    assert (pixels[..., 0] == np.round(expected / scale)).all()
                    seen += pixels.size
                assert seen == 90


def test_configuration():
    text = """---
# a comment
seed: 42
thread affinity mask:
    profiler: 0x2AAA
parameter set:
    default:
        fixed:
            extent: [96, 64]  # here too
            radius: 8
            region count: 3
            centroid count: 4
        variable:
            radius:
                from: 2
                to: 8
                step: 3
            region count:
                from: 2
                to: 4
                step: 2
            centroid count:
                from: 1
                to: 9
                step: 2
    stress:
        fixed:
            extent: [128, 128]
            region count: 6
        variable:
            radius:
                from: 8
                to: 16
                step: 2
"""
    assert parse_yaml(text)["thread affinity mask"] == {"profiler": 0x2AAA}
    assert config_from_yaml(text) == Config(42, (96, 64), 8, 3, 4, Span(2, 8, 3), Span(2, 4, 2), Span(1, 9, 2), (128, 128), 6, Span(8, 16, 2))
    with pytest.raises(ValueError):
        parse_yaml("no mapping")


def test_index_at_rest(spark, tmp_path):
    from cellwise.plans import profile

    index = profile.job_index(spark, ["Radius"], ["Uniform"], ["F+", "F-"], ["DD"])
    tables.write_index(index, f"{tmp_path}/Content.csv")
    assert rows(tables.read_index(spark, f"{tmp_path}/Content.csv")) == rows(index)
    results = spark.createDataFrame([(1, 2, 3.14159, 7)], profile.RESULTS)
    tables.write_results(results, f"{tmp_path}/r")
    assert rows(tables.read_results(spark, f"{tmp_path}/r").select("variable", "t_median", "memory", "job_id")) == [(2, 3.14, 7, 1)]
    with pytest.raises(ValueError, match="lzw"):
        tables.write_field(spark.createDataFrame([(0, 0, 0)], "x int, y int, region int"), f"{tmp_path}/x", compression="lzw")


def test_types_are_promoted():
    assert (promoted("u8"), promoted("u8", "u16"), promoted("i8", "i16"), promoted("u8", "i8"), promoted("u16", "i8")) == ("u8", "u16", "i16", "i16", "i32")
    with pytest.raises(ValueError):
        promoted("f8")


def test_command_line(spark, tmp_path):
    call = lambda *a: run(spark, parser().parse_args([str(x) for x in a]))
    call("regionfield", "voronoi", tmp_path / "f", "--resolution", "40,32", "--regions", 3, "--centroids", 5, "--seed", 7)
    assert tables.read_field(spark, str(tmp_path / "f")).count() == 40 * 32
    call("splat", "stochastic", tmp_path / "f", tmp_path / "m", "--resolution", "40,32", "--regions", 3, "--radius", 2, "--samples", 8, "--extent", "10,12", "--centre", "--seed", 1)
    masks = spark.read.parquet(str(tmp_path / "m"))
    assert masks.select("x", "y").distinct().count() == 120 and masks.agg(F.min("x")).first()[0] == 15
    for k in range(3):
        (tmp_path / f"{k}.png").write_bytes(images.encode_png(np.full((40, 32), 100 * k, dtype=np.uint8)))
    call("blend", tmp_path / "m", tmp_path / "b", "-F", *(tmp_path / f"{k}.png" for k in range(3)))
    mixed = {(b["x"], b["y"]): b["value"] for b in spark.read.parquet(str(tmp_path / "b")).collect()}
    counts = {(m["x"], m["y"]): m["s"] for m in masks.groupBy("x", "y").agg(F.sum(F.col("importance") * F.col("region") * 100).alias("s")).collect()}
    assert len(mixed) == 120 and all(abs(mixed[c] - counts[c] / 8) <= 0.5 + 1e-9 for c in mixed)
    call("split", tmp_path / "m", tmp_path / "t")
    assert [p.name for p in (tmp_path / "t").glob("*.tar")] == ["m-1.tar"]
    call("regionfield", "uniform", tmp_path / "tif", "--resolution", "40,32", "--regions", 3, "--tiff", "--compression", "lzw")
    assert tiff.field_from_files(tiff.read_files(spark, str(tmp_path / "tif"))).count() == 40 * 32

"""Properties of generators, blending, storage, profiles and streams."""

import pytest
from pyspark.sql import functions as F

from cellwise.operators import generators
from cellwise.operators.blend import blend, quantised
from cellwise.operators.raster import equal, transpose
from cellwise.plans import profile
from cellwise.plans.api import DiamondSquare, Full, Uniform, Voronoi, generate, splat
from cellwise.schema import RegionfieldMeta, check_complete
from cellwise.sources.tables import read_field, read_results, write_field, write_masks, write_results
from cellwise.streaming.kernels import compact, read_kernels, start_kernels

from grid_rows import rows

META = RegionfieldMeta(17, 17, 4)


@pytest.mark.parametrize("generator", [Uniform(), Voronoi(5), DiamondSquare((5, 5), (0, 2)), DiamondSquare((3, 4), (1, 1))])
def test_grids_are_complete_and_repeatable(spark, generator):
    field = generate(spark, META, generator, 3)
    check_complete(field, META)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert rows(generate(spark, META, generator, 3)) == rows(field)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_one_centroid_is_one_region(spark):
    assert generate(spark, META, Voronoi(1), 3).select("region").distinct().count() == 1


def test_nearest_prefers_the_lower_id(spark):
    points = [(0, 0, 0, 1), (1, 4, 0, 2), (2, 4, 0, 3)]
    cell = spark.createDataFrame([(2, 0), (3, 0)], "x int, y int").select("x", generators.nearest(points)["id"].alias("id"))
    assert rows(cell) == [(2, 0), (3, 1)]


def test_centroids_in_python_and_spark(spark):
    assert rows(generators.centroids(spark, META, 9, 11)) == sorted(generators.centroid_rows(META, 9, 11), key=repr)


def test_upscale(spark):
    start = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (1, 0, 2), (1, 1, 3)], "x int, y int, region int")
    got = {(r["x"], r["y"]): r["region"] for r in generators.upscale(spark, start, (2, 2), 5).collect()}
    assert len(got) == 9 and [got[c] for c in ((0, 0), (0, 2), (2, 0), (2, 2))] == [0, 1, 2, 3]
    assert got[0, 1] in (0, 1) and got[1, 0] in (0, 2) and got[1, 2] in (1, 3) and got[2, 1] in (2, 3)
    chained = generators.upscale(spark, generators.upscale(spark, start, (2, 2), 5, 0), (3, 3), 5, 1)
    assert rows(chained) == rows(generators.upscale(spark, start, (2, 2), 5, 0, 2))


@pytest.mark.parametrize(("n", "e", "s", "w", "centre", "allowed"), [(1, 1, 1, 1, 0, {1}), (1, 2, 3, 2, 0, {2}), (1, 2, 1, 3, 0, {1}), (1, 2, 3, 4, 0, {0}), (1, 2, 1, 2, 0, {1, 2})])
def test_smooth(spark, n, e, s, w, centre, allowed):
    cells = [(0, 0, 9), (0, 1, n), (0, 2, 9), (1, 0, w), (1, 1, centre), (1, 2, e), (2, 0, 9), (2, 1, s), (2, 2, 9)]
    got = {(r["x"], r["y"]): r["region"] for r in generators.smooth(spark.createDataFrame(cells, "x int, y int, region int"), (3, 3), 1, "t").collect()}
    assert got.pop((1, 1)) in allowed
    assert got == {(x, y): r for x, y, r in cells if (x, y) != (1, 1)}


def test_sizes():
    assert generators.grown(5, 6) == 257
    with pytest.raises(ValueError):
        generators.centroid_rows(META, 0, 1)


def test_resize_to_itself_and_to_a_line(spark):
    field = generate(spark, META, Uniform(), 1)
    assert equal(generators.resize(spark, field, (17, 17), (17, 17)), field).first()["equal"]
    assert {r["region"] for r in generators.resize(spark, field, (17, 17), (1, 1)).collect()} == {r["region"] for r in field.where("x = 0 AND y = 0").collect()}


def test_strategies_agree(spark):
    field = generate(spark, RegionfieldMeta(40, 33, 6), Voronoi(9), 2).cache()
    each = [rows(splat(field, RegionfieldMeta(40, 33, 6), Full(5, s)).select("x", "y", "region", "importance")) for s in ("scatter", "prefix", "tile")]
    assert each[0] == each[1] == each[2]
    assert not equal(transpose(field), field).first()["equal"]


def test_blend(spark):
    masks = spark.createDataFrame([(0, 0, 0, r, n, 4) for r, n in ((0, 1), (1, 3))], "algorithm int, x int, y int, region int, importance long, norm int")
    features = spark.createDataFrame([(r, 0, 0, c, 10 * r + c) for r in range(2) for c in range(2)], "region int, x int, y int, channel int, value long")
    blended = blend(masks, features)
    assert rows(blended.select("channel", "value")) == [(0, 7.5), (1, 8.5)]
    assert rows(quantised(blended).select("channel", "value")) == [(0, 0), (1, 255)]


def test_storage(spark, tmp_path):
    field = generate(spark, META, Uniform(), 1)
    write_field(field, f"{tmp_path}/f", (8, 8))
    assert rows(read_field(spark, f"{tmp_path}/f")) == rows(field)
    assert read_field(spark, f"{tmp_path}/f", (8, 8), (3, 9, 8, 16)).count() == 7 * 9
    write_masks({"full": splat(field, META, Full(1))}, f"{tmp_path}/m")
    assert spark.read.parquet(f"{tmp_path}/m").where("algorithm = 0").count() > 0


def test_profiles(spark, tmp_path):
    index = profile.job_index(spark, ["Radius"], ["Uniform"], ["F+"], ["DD", "DS", "SS"])
    results = profile.sweep(spark, profile.FIRST_JOB, [1, 2], lambda r: splat(generate(spark, META, Uniform(), 1), META, Full(r)), runs=1)
    write_results(results, f"{tmp_path}/r")
    found = profile.lookup(index, read_results(spark, f"{tmp_path}/r"), title="Radius")
    assert found.count() == 2 and found.where(F.col("DD").isNull()).count() == 0


def test_stream(spark, tmp_path):
    deltas = spark.createDataFrame([(0, 1, "inc", 5), (0, 1, "dec", 2), (0, 2, "dec", 1)], "k int, region int, op string, amount long")
    deltas.write.parquet(f"{tmp_path}/d")
    stream = spark.readStream.schema(deltas.schema).parquet(f"{tmp_path}/d")
    query = start_kernels(stream, ["k"], f"{tmp_path}/kernels", f"{tmp_path}/c")
    query.awaitTermination(60)
    assert rows(read_kernels(spark, f"{tmp_path}/kernels", ["k"])) == [(0, 1, 3)]
    compact(spark, f"{tmp_path}/kernels", ["k"], f"{tmp_path}/compact")
    assert rows(read_kernels(spark, f"{tmp_path}/compact", ["k"])) == [(0, 1, 3)]

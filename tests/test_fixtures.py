"""Golden values of the core operator, the kernels, shapes, bits and tiles."""

import pytest
from pyspark.sql import functions as F

from cellwise.functions.arrays import linspace_values, pad_clamp, to_dense, to_sparse
from cellwise.functions.bits import BitsPerSample, bit_pack, bit_unpack, minimum_bits, minimum_bits_of
from cellwise.operators import coefficients, raster
from cellwise.plans.api import Full, Stochastic, Stratified, Systematic, parse_iterations, splat
from cellwise.schema import RegionfieldMeta, check_complete, resolve_window

from grid_rows import rows

# A field of regions and the counts in neighbourhoods that must come out.
FIELD = [
    [0, 2, 1, 2, 1, 2, 3, 2],
    [0, 3, 0, 2, 2, 3, 3, 0],
    [0, 3, 2, 3, 0, 3, 0, 1],
    [0, 3, 1, 0, 3, 2, 0, 2],
    [0, 2, 3, 3, 1, 1, 1, 3],
    [0, 2, 3, 1, 1, 2, 3, 2],
]
META = RegionfieldMeta(6, 8, 4)
EXPECTED = {(2, 3): [3, 5, 8, 9], (2, 4): [5, 6, 6, 8], (2, 5): [5, 5, 7, 8], (3, 3): [3, 5, 7, 10], (3, 4): [5, 6, 5, 9], (3, 5): [5, 6, 6, 8]}
LATTICE = {(2, 3): [0, 1, 4, 4], (2, 4): [2, 4, 1, 2], (2, 5): [0, 2, 3, 4], (3, 3): [1, 1, 4, 3], (3, 4): [2, 2, 1, 4], (3, 5): [2, 1, 5, 1]}
OFFSET_LATTICE = {(2, 3): [0, 0, 1, 3], (2, 4): [1, 1, 1, 1], (2, 5): [2, 0, 1, 1], (3, 3): [1, 1, 1, 1], (3, 4): [0, 1, 1, 2], (3, 5): [1, 1, 0, 2]}


@pytest.fixture(scope="module")
def field(spark):
    return spark.createDataFrame([(x, y, c) for x, line in enumerate(FIELD) for y, c in enumerate(line)], "x int, y int, region int").cache()


def as_rows(expected, norm):
    return sorted(((x, y, r, n, n / norm) for (x, y), counts in expected.items() for r, n in enumerate(counts) if n), key=repr)


@pytest.mark.parametrize("strategy", ["scatter", "prefix", "tile", "auto"])
def test_full(field, strategy):
    got = splat(field, META, Full(2, strategy), (2, 3), (2, 3))
    assert rows(got.select("x", "y", "region", "importance", "mask")) == as_rows(EXPECTED, 25)


@pytest.mark.parametrize(("first", "interval", "expected", "norm"), [((0, 0), (2, 2), LATTICE, 9), ((1, 0), (2, 3), OFFSET_LATTICE, 4)])
def test_systematic(field, first, interval, expected, norm):
    got = splat(field, META, Systematic(2, first, interval), (2, 3), (2, 3))
    assert rows(got.select("x", "y", "region", "importance", "mask")) == as_rows(expected, norm)


def test_systematic_of_every_cell_is_full(field):
    assert rows(splat(field, META, Systematic(2), (2, 3), (2, 3))) == rows(splat(field, META, Full(2), (2, 3), (2, 3)))


@pytest.mark.parametrize("spec", [Stratified(2, 3, 7), Stratified(2, 8, 7), Stochastic(2, 16, 7)])
def test_samples_add_up_and_ignore_partitions(field, spec):
    got = splat(field, META, spec, (2, 3), (2, 3))
    assert {r["s"] for r in got.groupBy("x", "y").agg(F.sum("importance").alias("s")).collect()} == {spec.strata**2 if isinstance(spec, Stratified) else spec.samples}
    assert rows(got) == rows(splat(field.repartition(7), META, spec, (2, 3), (2, 3)))


def test_transposition_commutes(field):
    got = splat(raster.transpose(field), META.transposed, Full(2, "tile"), (3, 2), (3, 2))
    assert rows(got.select(F.col("y").alias("x"), F.col("x").alias("y"), "region", "importance", "mask")) == as_rows(EXPECTED, 25)


def test_shapes(field):
    dense = splat(field, META, Full(2), (2, 3), (2, 3), shape="array", relative=True)
    assert {(r["x"], r["y"]): r["dense"] for r in dense.collect()} == {(x - 2, y - 3): [n / 25 for n in v] for (x, y), v in EXPECTED.items()}
    offsets = coefficients.row_offsets(splat(field, META, Full(2), (2, 3), (2, 3))).orderBy("x", "y").collect()
    assert [(r["begin"], r["end"]) for r in offsets] == [(4 * i, 4 * i + 4) for i in range(6)]


@pytest.mark.parametrize(("meta", "offset", "extent"), [(RegionfieldMeta(5, 8, 4), (2, 3), (2, 3)), (META, (1, 3), (2, 3)), (META, (2, 3), (3, 3)), (META, (2, 3), (0, 3))])
def test_windows_outside_the_grid(meta, offset, extent):
    with pytest.raises(ValueError):
        resolve_window(meta, 2, offset, extent)


def test_running_sums_take_no_holes(field):
    holed = field.where("x <> 3 OR y <> 3")
    with pytest.raises(ValueError, match="holes"):
        splat(holed, META, Full(2, "prefix"), (2, 3), (2, 3))
    assert rows(splat(holed, META, Full(2, "tile"), (2, 3), (2, 3))) == rows(splat(holed, META, Full(2, "scatter"), (2, 3), (2, 3)))


@pytest.mark.parametrize("cores", [1, 4, 64])
def test_tiles_leave_no_core_idle(cores):
    from cellwise.operators.occupancy import tile_size
    from cellwise.schema import Window

    size = tile_size(Window((136, 136), (512, 512)), 136, cores)
    assert 272 <= size <= 1088 and (cores == 1 or (-(-512 // size)) ** 2 >= 4)
    assert tile_size(Window((2, 2), (20_000, 20_000)), 2, 64) == 128


def test_incomplete_grids(field):
    check_complete(field, META)
    with pytest.raises(ValueError):
        check_complete(field.where("x <> 3 OR y <> 3"), META)
    with pytest.raises(ValueError):
        RegionfieldMeta(0, 4, 2)


def test_kernels(spark):
    inc0, dec0, inc1 = [99, 33, 0, 86, 0, 66, 12, 91, 60, 85], [57, 0, 0, 86, 0, 66, 0, 28, 0, 85], [0, 98, 0, 48, 10, 0, 70, 0, 74, 50]
    deltas = [(0, i, op, v) for op, values in (("inc", inc0), ("dec", dec0), ("inc", inc1)) for i, v in enumerate(values) if v]
    got = coefficients.apply_deltas(spark.createDataFrame(deltas, "k int, region int, op string, amount long"), ["k"], "op", "amount")
    assert rows(got.select("region", "importance")) == sorted([(0, 42), (1, 131), (6, 82), (7, 63), (8, 134), (3, 48), (4, 10), (9, 50)], key=repr)


def test_sparse_and_dense(spark):
    dense = [91, 1, 27, 91, 33, 24, 43, 2, 91, 91]
    df = spark.createDataFrame([(1, dense)], "k int, dense array<int>")
    sparse = to_sparse(df, "dense", 91)
    assert rows(sparse.select("region", "value")) == sorted([(1, 1), (2, 27), (4, 33), (5, 24), (6, 43), (7, 2)], key=repr)
    assert to_dense(sparse, ["k"], "value", 10, 91).first()["dense"] == dense


def test_bits(spark):
    df = spark.createDataFrame([([2, 1, 3, 2, 0, 1],)], "v array<int>")
    words = df.select(bit_pack(F.col("v"), 2, 8).alias("w"))
    assert words.first()["w"] == [0b1001111000010101]
    assert words.select(bit_unpack(F.col("w"), F.lit(6), 2, 8).alias("v")).first()["v"] == [2, 1, 3, 2, 0, 1]
    for bits in (1, 2, 4, 8):
        assert (BitsPerSample(bits).factor, BitsPerSample(bits).log2, BitsPerSample(bits).mask) == (8 // bits, bits.bit_length() - 1, 2**bits - 1)
    with pytest.raises(ValueError):
        BitsPerSample(3)
    got = spark.range(256).select("id", minimum_bits_of(F.col("id")).alias("b")).collect()
    assert all(r["b"] == minimum_bits(r["id"]) for r in got)


def test_tiles(spark):
    values = ["4268777", "8304978", "5928684", "2633374", "3305923"]
    df = spark.createDataFrame([(x, y, int(c)) for x, line in enumerate(values) for y, c in enumerate(line)], "x int, y int, region int")
    meta, tile = RegionfieldMeta(5, 7, 10), (4, 3)
    tiles = raster.to_tiles(df, meta, tile)
    assert tiles.count() == 2 * 3 * 12
    last = {(r["i"], r["j"]): r["region"] for r in tiles.where("tile_x = 1 AND tile_y = 2").collect()}
    assert last == {(i, j): 3 for i in range(4) for j in range(3)}
    assert rows(raster.from_tiles(tiles, meta, tile)) == rows(df)
    assert [tuple(r) for r in raster.tile_spine(spark, meta, tile).orderBy("tile_x", "tile_y").collect()] == [(a, b, 4 * a, 3 * b) for a in range(2) for b in range(3)]


def test_lines(spark):
    assert linspace_values(2, 64, 15, True) == [2, 6, 10, 15, 19, 24, 28, 33, 37, 41, 46, 50, 55, 59, 64]
    assert linspace_values(8, 256, 30, True)[-1] == 255
    assert linspace_values(3, 9, 0) == [] and linspace_values(3, 9, 1) == [3.0]
    df = spark.createDataFrame([([1, 2],), ([1, 2, 3, 4],), ([],)], "v array<int>")
    assert [r["p"] for r in df.select(pad_clamp(F.col("v"), 3).alias("p")).collect()] == [[1, 2, 2], [1, 2, 3, 4], []]


def test_iterations():
    assert parse_iterations("3x0-3x2") == (0, 0, 0, 2, 2, 2)
    with pytest.raises(ValueError):
        parse_iterations("3y0")

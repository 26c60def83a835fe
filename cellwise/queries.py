"""Queries of the occupancy engine over the driver's tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.functions.arrays import linspace, normalise, pad_clamp, to_dense, to_sparse
from cellwise.functions.bits import bit_pack, bit_unpack, minimum_bits_of
from cellwise.functions.quantise import INTEGERS, dequantise_u16, limits, normalise_from, promoted, quantise_u8, quantise_u16, rescale, unnormalise_to
from cellwise.functions.rng import hash_u32, hash_u32_sql, uniform_int
from cellwise.operators import blend as blending
from cellwise.operators import coefficients, generators, occupancy, raster
from cellwise.plans import profile
from cellwise.plans.api import Full, Stochastic, Stratified, Systematic, splat
from cellwise.schema import RegionfieldMeta, Window, centred_window, maximum_extent, measure, minimum_dimension, minimum_offset
from cellwise.sources.tables import field_from

H, REGIONS, SEED = 50, 5, 42
TYPES = ("click", "error", "purchase", "signup", "view")
TILE = (16, 16)
GRID = RegionfieldMeta(64, 48, REGIONS)
CENTROIDS = 12
DS = generators.DiamondSquare((5, 5), (0, 0, 1))

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Grids from the events: 50 columns, the region by the type of event or by its user.


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _type_index():
    case = F.lit(None).cast("int")
    for i, name in enumerate(TYPES):
        case = F.when(F.col("event_type") == name, i).otherwise(case)
    return case


def rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_from(_events(spark, sf_dir), F.col("event_id"), H, _type_index())


def rf_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_from(_events(spark, sf_dir), F.col("event_id"), H, F.pmod("user_id", F.lit(32)))


def meta_of(field: DataFrame, regions: int = REGIONS) -> RegionfieldMeta:
    return measure(field, regions)


TYPE_SQL = "CASE event_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TYPES)) + " END"
RF_SQL = f"rf AS (SELECT CAST(event_id // {H} AS INTEGER) AS x, CAST(event_id % {H} AS INTEGER) AS y, CAST({TYPE_SQL} AS INTEGER) AS region FROM events)"
USERS_SQL = f"rf AS (SELECT CAST(event_id // {H} AS INTEGER) AS x, CAST(event_id % {H} AS INTEGER) AS y, CAST(user_id % 32 AS INTEGER) AS region FROM events)"
META_SQL = "m AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM rf)"


def counted_sql(xs: list[int], ys: list[int], radius: int, base: str = RF_SQL, where: str | None = None) -> str:
    """CTEs up to `counted` (x, y, region, importance): cells at the given steps from each centre."""
    where = where or f"x BETWEEN {radius} AND w - 1 - {radius} AND y BETWEEN {radius} AND h - 1 - {radius}"
    return f"""{base}, {META_SQL},
        seen AS (SELECT x - dx AS x, y - dy AS y, region FROM rf, (SELECT unnest({xs}) AS dx), (SELECT unnest({ys}) AS dy)),
        counted AS (SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, region, count(*) AS importance FROM seen, m WHERE {where} GROUP BY ALL)"""


def full_sql(radius: int, **options) -> str:
    steps = list(range(-radius, radius + 1))
    return counted_sql(steps, steps, radius, **options)


def mask_sql(ctes: str, norm: int) -> str:
    return f"WITH {ctes} SELECT x, y, region, importance, CAST(importance AS DOUBLE) / CAST({norm} AS DOUBLE) AS mask FROM counted"


def _splat(spec, base=rf, regions: int = REGIONS, **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        field = base(spark, sf_dir)
        return splat(field, meta_of(field, regions), spec, **options)

    return run


def _register(name: str, run: Query, sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


_register("oc_full_vanilla", _splat(Full(2, "scatter")), mask_sql(full_sql(2), 25))
_register("oc_full_fast", _splat(Full(2, "tile")), mask_sql(full_sql(2), 25))
_register("oc_full_prefix", _splat(Full(4, "prefix")), mask_sql(full_sql(4), 81))
_register("oc_full_r8", _splat(Full(8)), mask_sql(full_sql(8), 289))
_register("oc_radius0", _splat(Full(0)), mask_sql(full_sql(0), 1))
_register("oc_full_window", _splat(Full(2), offset=(3, 5), extent=(10, 20)), mask_sql(full_sql(2, where="x BETWEEN 3 AND 12 AND y BETWEEN 5 AND 24"), 25))
_register("oc_full_many_regions", _splat(Full(3), rf_users, 32), mask_sql(full_sql(3, base=USERS_SQL), 49))
_register("oc_systematic", _splat(Systematic(4, (1, 0), (2, 3))), mask_sql(counted_sql([-3, -1, 1, 3], [-4, -1, 2], 4), 12))

CENTRES_SQL = f"{RF_SQL}, {META_SQL}, centres AS (SELECT x, y FROM rf, m WHERE x BETWEEN 4 AND w - 5 AND y BETWEEN 4 AND h - 5)"
_STRATUM = lambda axis: f"CAST(least(i{axis} * 9 // 3 + (({hash_u32_sql(SEED, 'splat:stratified', 'x - 4', 'y - 4', 'i0', 'i1', axis)} * ((i{axis} + 1) * 9 // 3 - i{axis} * 9 // 3)) >> 32), 8) AS INTEGER)"
_register(
    "oc_stratified",
    _splat(Stratified(4, 3, SEED)),
    mask_sql(
        f"""{CENTRES_SQL}, samples AS (SELECT x, y, x - 4 + {_STRATUM(0)} AS sx, y - 4 + {_STRATUM(1)} AS sy FROM centres, (SELECT unnest(range(3)) AS i0), (SELECT unnest(range(3)) AS i1)),
        counted AS (SELECT s.x, s.y, rf.region, count(*) AS importance FROM samples s JOIN rf ON rf.x = sx AND rf.y = sy GROUP BY ALL)""",
        9,
    ),
)
_DRAW = lambda axis: f"CAST({hash_u32_sql(SEED, 'splat:stochastic', 'x - 4', 'y - 4', 'k', axis)} % 9 AS INTEGER)"
_register(
    "oc_stochastic",
    _splat(Stochastic(4, 16, SEED)),
    mask_sql(
        f"""{CENTRES_SQL}, samples AS (SELECT x, y, x - 4 + {_DRAW(0)} AS sx, y - 4 + {_DRAW(1)} AS sy FROM centres, (SELECT unnest(range(16)) AS k)),
        counted AS (SELECT s.x, s.y, rf.region, count(*) AS importance FROM samples s JOIN rf ON rf.x = sx AND rf.y = sy GROUP BY ALL)""",
        16,
    ),
)


def _box(along: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        field = rf(spark, sf_dir)
        meta = meta_of(field)
        size = meta.height if along == "y" else meta.width
        return occupancy.box_1d(occupancy.one_hot(field, REGIONS), along, 3, 3, size - 4).where("n > 0")

    return run


_register("box1d_rows", _box("y"), f"WITH {counted_sql([0], list(range(-3, 4)), 0, where='y BETWEEN 3 AND h - 4')} SELECT x, y, region, importance AS n FROM counted")
_register("box1d_cols", _box("x"), f"WITH {counted_sql(list(range(-3, 4)), [0], 0, where='x BETWEEN 3 AND w - 4')} SELECT x, y, region, importance AS n FROM counted")


@query(f"WITH {full_sql(2, where='x BETWEEN (w - 8) // 2 AND (w - 8) // 2 + 7 AND y BETWEEN (h - 8) // 2 AND (h - 8) // 2 + 7')} SELECT x, y, region, importance, CAST(importance AS DOUBLE) / CAST(25 AS DOUBLE) AS mask FROM counted")
def splat_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = rf(spark, sf_dir)
    meta = meta_of(field)
    window = centred_window(meta, 2, (8, 8))
    return splat(field, meta, Full(2), window.offset, window.extent)


@query(f"WITH {RF_SQL}, {META_SQL} SELECT CAST(4 AS INTEGER) AS min_offset_x, CAST(4 AS INTEGER) AS min_offset_y, CAST(w - 8 AS INTEGER) AS max_extent_x, CAST(h - 8 AS INTEGER) AS max_extent_y, CAST(w AS INTEGER) AS min_dim_x, CAST(h AS INTEGER) AS min_dim_y FROM m")
def valid_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = meta_of(rf(spark, sf_dir))
    offset = minimum_offset(4)
    extent = maximum_extent(meta, offset, 4)
    row = (*offset, *extent, *minimum_dimension(Window(offset, extent), 4))
    return spark.createDataFrame([row], "min_offset_x int, min_offset_y int, max_extent_x int, max_extent_y int, min_dim_x int, min_dim_y int")


# Generators.

GRID_SQL = f"SELECT i AS idx, CAST(i // {GRID.height} AS INTEGER) AS x, CAST(i % {GRID.height} AS INTEGER) AS y FROM range({GRID.width * GRID.height}) t(i)"
_CX, _CY = (f"CAST({hash_u32_sql(SEED, f'gen:centroid:{a}', 'i')} % {n} AS INTEGER)" for a, n in (("x", GRID.width), ("y", GRID.height)))
CENTROIDS_SQL = f"""placed AS (SELECT CAST(i AS INTEGER) AS id, {_CX} AS cx, {_CY} AS cy FROM range({CENTROIDS}) t(i)),
    centroids AS (SELECT id, cx, cy, CAST({hash_u32_sql(SEED, "gen:centroid:region", "cx", "cy")} % {REGIONS} AS INTEGER) AS region FROM placed)"""


@query(f"SELECT x, y, CAST({hash_u32_sql(SEED, 'gen:uniform', 'idx')} % {REGIONS} AS INTEGER) AS region FROM ({GRID_SQL})")
def gen_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.Uniform()(spark, GRID, SEED)


@query(f"WITH {CENTROIDS_SQL} SELECT id, cx, cy, region FROM centroids")
def gen_voronoi_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.centroids(spark, GRID, CENTROIDS, SEED)


@query(f"WITH {CENTROIDS_SQL}, g AS ({GRID_SQL}) SELECT x, y, arg_min(region, ((x - cx) * (x - cx) + (y - cy) * (y - cy)) * 1000 + id) AS region FROM g, centroids GROUP BY x, y")
def gen_voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.Voronoi(CENTROIDS)(spark, GRID, SEED)


@query(f"WITH {CENTROIDS_SQL}, {RF_SQL} SELECT x, y, CAST(min(((x - cx) * (x - cx) + (y - cy) * (y - cy)) * 1000 + id) // 1000 AS BIGINT) AS d2, arg_min(id, ((x - cx) * (x - cx) + (y - cy) * (y - cy)) * 1000 + id) AS id FROM rf, centroids GROUP BY x, y")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = generators.nearest(generators.centroid_rows(GRID, CENTROIDS, SEED))
    return rf(spark, sf_dir).select("x", "y", found.alias("c")).select("x", "y", "c.d2", "c.id")


def _grid_sql(w: int, h: int) -> str:
    return f"SELECT CAST(i // {h} AS INTEGER) AS x, CAST(i % {h} AS INTEGER) AS y FROM range({w * h}) t(i)"


def _up_sql(x: str, y: str, level: int, axis: int) -> str:
    v = (x, y)[axis]
    return f"CAST(({v} >> 1) + ({v} & 1) * ({hash_u32_sql(SEED, f'gen:up:{level}', x, y, axis)} & 1) AS INTEGER)"


DS_START_SQL = f"start AS (SELECT x, y, CAST({hash_u32_sql(SEED, 'gen:uniform', 'x * 5 + y')} % {REGIONS} AS INTEGER) AS region FROM ({_grid_sql(5, 5)}))"


@query(f"WITH {DS_START_SQL}, g AS (SELECT x, y, {_up_sql('x', 'y', 0, 0)} AS px, {_up_sql('x', 'y', 0, 1)} AS py FROM ({_grid_sql(9, 9)})) SELECT g.x, g.y, s.region FROM g JOIN start s ON s.x = px AND s.y = py")
def ds_upscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = generators.Uniform()(spark, RegionfieldMeta(5, 5, REGIONS), SEED)
    return generators.upscale(spark, start, (5, 5), SEED)


def _smooth_sql(source: str, w: str, h: str, tag: str) -> str:
    return f"""near AS (SELECT x, y, region, lag(region) OVER (PARTITION BY x ORDER BY y) AS w_, lead(region) OVER (PARTITION BY x ORDER BY y) AS e_,
            lag(region) OVER (PARTITION BY y ORDER BY x) AS n_, lead(region) OVER (PARTITION BY y ORDER BY x) AS s_ FROM {source})
        SELECT x, y, CASE WHEN x = 0 OR y = 0 OR x = {w} - 1 OR y = {h} - 1 THEN region
            WHEN e_ = w_ AND n_ = s_ THEN CASE WHEN ({hash_u32_sql(SEED, f"gen:smooth:{tag}", "x", "y")} & 1) = 0 THEN n_ ELSE e_ END
            WHEN e_ = w_ THEN e_ WHEN n_ = s_ THEN n_ ELSE region END AS region FROM near"""


@query(f"WITH {RF_SQL}, {_smooth_sql('rf', '(SELECT max(x) + 1 FROM rf)', '(SELECT max(y) + 1 FROM rf)', 'rf')}")
def ds_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = rf(spark, sf_dir)
    meta = meta_of(field)
    return generators.smooth(field, (meta.width, meta.height), SEED, "rf")


@query(
    f"""WITH {DS_START_SQL}, t2 AS (SELECT x, y, {_up_sql("x", "y", 2, 0)} AS x2, {_up_sql("x", "y", 2, 1)} AS y2 FROM ({_grid_sql(33, 33)})),
    t1 AS (SELECT x, y, {_up_sql("x2", "y2", 1, 0)} AS x1, {_up_sql("x2", "y2", 1, 1)} AS y1 FROM t2),
    t0 AS (SELECT x, y, {_up_sql("x1", "y1", 0, 0)} AS x0, {_up_sql("x1", "y1", 0, 1)} AS y0 FROM t1),
    up AS (SELECT t0.x, t0.y, s.region FROM t0 JOIN start s ON s.x = x0 AND s.y = y0), {_smooth_sql("up", "33", "33", "2:0")}"""
)
def gen_diamond_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DS(spark, RegionfieldMeta(*DS.size, REGIONS), SEED)


@query(
    f"""WITH {RF_SQL}, {META_SQL}, g AS (SELECT x, y, CAST((2 * (w - 1) * x + 29) // 58 AS INTEGER) AS px, CAST((2 * (h - 1) * y + 19) // 38 AS INTEGER) AS py FROM ({_grid_sql(30, 20)}), m)
    SELECT g.x, g.y, rf.region FROM g JOIN rf ON rf.x = px AND rf.y = py"""
)
def resize_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = rf(spark, sf_dir)
    meta = meta_of(field)
    return generators.resize(spark, field, (meta.width, meta.height), (30, 20))


# Grids as tables.


@query(f"WITH {RF_SQL} SELECT y AS x, x AS y, region FROM rf")
def transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.transpose(rf(spark, sf_dir))


@query(f"WITH {RF_SQL} SELECT * FROM rf WHERE x BETWEEN 4 AND 12 AND y BETWEEN 40 AND 59")
def slice2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.slice2d(rf(spark, sf_dir), (4, 40), (9, 20))


@query(f"WITH {RF_SQL} SELECT x, string_agg(CAST(region AS VARCHAR), ',' ORDER BY y) AS regions FROM rf GROUP BY x")
def rows_as_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.lines(rf(spark, sf_dir), "x").withColumn("regions", F.concat_ws(",", F.col("regions").cast("array<string>")))


@query(f"WITH {RF_SQL} SELECT y, string_agg(CAST(region AS VARCHAR), ',' ORDER BY x) AS regions FROM rf GROUP BY y")
def cols_as_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.lines(rf(spark, sf_dir), "y").withColumn("regions", F.concat_ws(",", F.col("regions").cast("array<string>")))


@query(f"WITH {RF_SQL} SELECT CAST(max(x) + 1 AS INTEGER) AS width, CAST(max(y) + 1 AS INTEGER) AS height, count(*) AS cells FROM rf")
def extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.extent(rf(spark, sf_dir))


_EQUAL_SQL = "(SELECT count(*) = 0 FROM ((SELECT x, y, region, count(*) FROM rf GROUP BY ALL EXCEPT SELECT x, y, region, count(*) FROM {other} GROUP BY ALL) UNION ALL (SELECT x, y, region, count(*) FROM {other} GROUP BY ALL EXCEPT SELECT x, y, region, count(*) FROM rf GROUP BY ALL))) AND {regions}"


@query(
    f"""WITH {RF_SQL}, one AS (SELECT x, y, CAST(CASE WHEN x = 3 AND y = 7 THEN (region + 1) % {REGIONS} ELSE region END AS INTEGER) AS region FROM rf), twice AS (SELECT * FROM rf UNION ALL SELECT * FROM rf WHERE x = 0 AND y = 0),
    less AS (SELECT * FROM rf WHERE NOT (x = 0 AND y = 0)), turned AS (SELECT y AS x, x AS y, region FROM rf)
    SELECT 'same' AS pair, {_EQUAL_SQL.format(other="rf", regions="true")} AS equal UNION ALL SELECT 'one cell', {_EQUAL_SQL.format(other="one", regions="true")} UNION ALL SELECT 'a row twice', {_EQUAL_SQL.format(other="twice", regions="true")}
    UNION ALL SELECT 'a row less', {_EQUAL_SQL.format(other="less", regions="true")} UNION ALL SELECT 'transposed', {_EQUAL_SQL.format(other="turned", regions="true")} UNION ALL SELECT 'region count', {_EQUAL_SQL.format(other="rf", regions="5 = 6")}"""
)
def regionfield_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that are equal, and that differ in one cell, a repeated or missing row, the axes or the number of regions."""
    field = rf(spark, sf_dir)
    first = (F.col("x") == 0) & (F.col("y") == 0)
    pairs = {
        "same": (raster.transpose(raster.transpose(field)), REGIONS),
        "one cell": (field.withColumn("region", F.when((F.col("x") == 3) & (F.col("y") == 7), (F.col("region") + 1) % REGIONS).otherwise(F.col("region"))), REGIONS),
        "a row twice": (field.unionByName(field.where(first)), REGIONS),
        "a row less": (field.where(~first), REGIONS),
        "transposed": (raster.transpose(field), REGIONS),
        "region count": (field, REGIONS + 1),
    }
    found = [raster.equal(field, other, (REGIONS, n)).select(F.lit(name).alias("pair"), "equal") for name, (other, n) in pairs.items()]
    return reduce(DataFrame.unionByName, found)


# Kernels and shapes.

DELTAS_SQL = f"deltas AS (SELECT CAST(event_id // {H} AS INTEGER) AS x, CAST({TYPE_SQL} AS INTEGER) AS region, 1 + event_id % 7 AS amount, CASE WHEN event_id % 3 = 0 THEN 'dec' ELSE 'inc' END AS op FROM events)"


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return _events(spark, sf_dir).select(F.floor(n / H).cast("int").alias("x"), _type_index().alias("region"), (F.pmod(n, F.lit(7)) + 1).alias("amount"), F.when(F.pmod(n, F.lit(3)) == 0, "dec").otherwise("inc").alias("op"))


@query(f"WITH {DELTAS_SQL} SELECT x, region, CAST(sum(amount) AS BIGINT) AS importance FROM deltas GROUP BY ALL")
def kernel_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coefficients.increments(deltas(spark, sf_dir), ["x"], "amount")


@query(f"WITH {DELTAS_SQL} SELECT x, region, CAST(sum(CASE op WHEN 'inc' THEN amount ELSE -amount END) AS BIGINT) AS importance FROM deltas GROUP BY ALL HAVING sum(CASE op WHEN 'inc' THEN amount ELSE -amount END) > 0")
def kernel_inc_dec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coefficients.apply_deltas(deltas(spark, sf_dir), ["x"], "op", "amount")


@query(f"WITH {RF_SQL} SELECT min(region) AS lowest, max(region) AS highest, CAST(min(CASE WHEN region = 0 THEN x * {H} + y END) AS BIGINT) AS first_lowest FROM rf")
def field_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.extremes(rf(spark, sf_dir), H)


ROW_COUNTS_SQL = f"{RF_SQL}, n AS (SELECT x, region, count(*) AS n FROM rf GROUP BY ALL), spine AS (SELECT x, r AS region FROM (SELECT DISTINCT x FROM rf), range(8) t(r)), dense AS (SELECT s.x, s.region, coalesce(n, 0) AS n FROM spine s LEFT JOIN n USING (x, region))"


def _row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rf(spark, sf_dir).groupBy("x", "region").agg(F.count("*").alias("n"))


@query(f"WITH {ROW_COUNTS_SQL} SELECT x, string_agg(CAST(n AS VARCHAR), ',' ORDER BY region) AS dense FROM dense GROUP BY x")
def to_dense_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_dense(_row_counts(spark, sf_dir), ["x"], "n", 8).withColumn("dense", F.concat_ws(",", F.col("dense").cast("array<string>")))


@query(f"WITH {ROW_COUNTS_SQL} SELECT x, CAST(region AS INTEGER) AS region, n AS value FROM dense WHERE n <> 0")
def to_sparse_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_sparse(to_dense(_row_counts(spark, sf_dir), ["x"], "n", 8), "dense")


for _old, _new in (("to_dense_rows", "to_dense"), ("to_sparse_rows", "to_sparse")):
    QUERIES[_new], ORACLE_SQL[_new] = QUERIES.pop(_old), ORACLE_SQL.pop(_old)


def _weights(spark: SparkSession, sf_dir: str, spec=Full(2)) -> DataFrame:
    field = rf(spark, sf_dir)
    return splat(field, meta_of(field), spec)


@query(f"WITH {full_sql(2)}, spine AS (SELECT x, y, CAST(r AS INTEGER) AS region FROM (SELECT DISTINCT x, y FROM counted), range({REGIONS}) t(r)) SELECT x, y, string_agg(CAST(coalesce(importance, 0) AS VARCHAR), ',' ORDER BY region) AS dense FROM spine LEFT JOIN counted USING (x, y, region) GROUP BY x, y")
def scm_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coefficients.dense(_weights(spark, sf_dir), REGIONS).withColumn("dense", F.concat_ws(",", F.col("dense").cast("array<string>")))


@query(f"WITH {full_sql(2)} SELECT x, y, region, importance FROM counted")
def scm_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_sparse(coefficients.dense(_weights(spark, sf_dir), REGIONS), "dense").withColumnRenamed("value", "importance")


@query(f"WITH {full_sql(2)} SELECT x, y, string_agg(region || ':' || importance, ',' ORDER BY region) AS elements FROM counted GROUP BY x, y")
def scm_sparse_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = coefficients.sparse_arrays(_weights(spark, sf_dir))
    return found.withColumn("elements", F.concat_ws(",", F.transform("elements", lambda e: F.concat_ws(":", e["region"].cast("string"), e["value"].cast("string")))))


@query(f'WITH {full_sql(2)}, c AS (SELECT x, y, count(*) AS n FROM counted GROUP BY x, y), o AS (SELECT x, y, n, sum(n) OVER (ORDER BY x, y ROWS UNBOUNDED PRECEDING) AS e FROM c) SELECT x, y, CAST(e - n AS BIGINT) AS "begin", CAST(e AS BIGINT) AS "end" FROM o')
def csr_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coefficients.row_offsets(_weights(spark, sf_dir))


@query(f"WITH {full_sql(2)}, c AS (SELECT count(DISTINCT (x, y)) AS cells, count(*) AS elements FROM counted) SELECT cells, elements, CAST(cells * {REGIONS} * 8 AS BIGINT) AS dense_bytes, CAST(elements * 16 + (cells + 1) * 4 AS BIGINT) AS sparse_bytes FROM c")
def scm_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coefficients.sizes(_weights(spark, sf_dir), REGIONS)


@query(f"WITH {full_sql(2)} SELECT x, y, count(*) AS regions FROM counted GROUP BY x, y")
def local_region_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coefficients.region_counts(_weights(spark, sf_dir))


# Numbers.


@query(f"WITH {RF_SQL}, n AS (SELECT x, region, count(*) AS n FROM rf GROUP BY ALL) SELECT x, region, n, CAST(n AS DOUBLE) / CAST({H} AS DOUBLE) AS share FROM n")
def normalise_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row_counts(spark, sf_dir).withColumn("share", normalise(F.col("n"), H))


QUERIES["normalise"], ORACLE_SQL["normalise"] = QUERIES.pop("normalise_rows"), ORACLE_SQL.pop("normalise_rows")


@query("SELECT CAST(i AS INTEGER) AS i, CAST(2 AS DOUBLE) + (CAST(62 AS DOUBLE) / CAST(14 AS DOUBLE)) * i AS value, CAST(trunc(CAST(2 AS DOUBLE) + (CAST(62 AS DOUBLE) / CAST(14 AS DOUBLE)) * i) AS INTEGER) AS truncated FROM range(15) t(i)")
def linspace_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linspace(spark, 2, 64, 15)


QUERIES["linspace"], ORACLE_SQL["linspace"] = QUERIES.pop("linspace_radius"), ORACLE_SQL.pop("linspace_radius")


@query(f"WITH {RF_SQL}, p AS (SELECT x, i, region FROM rf JOIN range(8) t(i) ON y = least(i, 4)) SELECT x, string_agg(CAST(region AS VARCHAR), ',' ORDER BY i) AS padded FROM p GROUP BY x")
def pad_clamp_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = raster.lines(rf(spark, sf_dir).where("y < 5"), "x")
    return first.select("x", F.concat_ws(",", pad_clamp(F.col("regions"), 8).cast("array<string>")).alias("padded"))


QUERIES["pad_clamp"], ORACLE_SQL["pad_clamp"] = QUERIES.pop("pad_clamp_rows"), ORACLE_SQL.pop("pad_clamp_rows")


@query("SELECT p_size AS largest, CAST(CASE WHEN p_size < 2 THEN 1 WHEN p_size < 4 THEN 2 WHEN p_size < 16 THEN 4 ELSE 8 END AS INTEGER) AS bits, CAST(8 // CASE WHEN p_size < 2 THEN 1 WHEN p_size < 4 THEN 2 WHEN p_size < 16 THEN 4 ELSE 8 END AS INTEGER) AS factor FROM (SELECT DISTINCT p_size FROM part)")
def bits_per_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").alias("largest")).distinct()
    bits = sizes.withColumn("bits", minimum_bits_of(F.col("largest")))
    return bits.withColumn("factor", (F.lit(8) / F.col("bits")).cast("int"))


@query(f"WITH {RF_SQL}, p AS (SELECT x, i // 8 AS word, i % 8 AS place, region FROM rf JOIN range({-(-H // 8) * 8}) t(i) ON y = least(i, {H - 1})) SELECT x, CAST(word AS INTEGER) AS word, CAST(sum(CAST(region AS BIGINT) << (4 * (7 - place))) AS BIGINT) AS packed FROM p GROUP BY x, word")
def bit_pack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = raster.lines(rf(spark, sf_dir), "x").select("x", bit_pack(F.col("regions"), 4, 8).alias("words"))
    return packed.select("x", F.posexplode("words").alias("word", "packed"))


@query(f"WITH {RF_SQL} SELECT x, y, region FROM rf")
def bit_unpack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = raster.lines(rf(spark, sf_dir), "x").select("x", bit_pack(F.col("regions"), 4, 8).alias("words"), F.size("regions").alias("n"))
    return packed.select("x", F.posexplode(bit_unpack(F.col("words"), F.col("n"), 4, 8)).alias("y", "region"))


for _old, _new in (("bit_pack_rows", "bit_pack"), ("bit_unpack_rows", "bit_unpack")):
    QUERIES[_new], ORACLE_SQL[_new] = QUERIES.pop(_old), ORACLE_SQL.pop(_old)


@query(f"WITH {full_sql(2)} SELECT x, y, region, CAST(round_even(CAST(importance AS DOUBLE) / CAST(25 AS DOUBLE) * CAST(255 AS DOUBLE), 0) AS INTEGER) AS code FROM counted")
def unnormalise_u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir).select("x", "y", "region", quantise_u8(F.col("mask")).alias("code"))


@query("WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT event_id, (value - lo) / (hi - lo) AS scaled FROM events, e")
def rescale_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).select("event_id", "value")
    ends = events.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return events.join(F.broadcast(ends)).select("event_id", rescale(F.col("value"), F.col("lo"), F.col("hi")).alias("scaled"))


QUERIES["rescale"], ORACLE_SQL["rescale"] = QUERIES.pop("rescale_values"), ORACLE_SQL.pop("rescale_values")


@query(f"WITH {full_sql(2)} SELECT x, y, region, CAST((2 * importance * 65535 + 25) // 50 AS INTEGER) AS code FROM counted")
def mask_quantise_u16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir).select("x", "y", "region", quantise_u16(F.col("importance"), 25).alias("code"))


@query(f"WITH {full_sql(2)} SELECT x, y, region, CAST((2 * importance * 65535 + 25) // 50 AS DOUBLE) / CAST(65535 AS DOUBLE) AS mask FROM counted")
def mask_dequantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir).select("x", "y", "region", dequantise_u16(quantise_u16(F.col("importance"), 25)).alias("mask"))


# Blending.

FEATURE_SQL = f"feature AS (SELECT CAST(event_id // {H} AS INTEGER) AS x, CAST(event_id % {H} AS INTEGER) AS y, CAST(r AS INTEGER) AS region, CAST(c AS INTEGER) AS channel, CAST(round(value * 100) AS BIGINT) * (r + 1) + c AS value FROM events, range({REGIONS}) t(r), range(3) u(c))"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _events(spark, sf_dir).select(F.floor(F.col("event_id") / H).cast("int").alias("x"), F.pmod("event_id", F.lit(H)).cast("int").alias("y"), F.round(F.col("value") * 100).cast("long").alias("v"))
    each = cells.select("x", "y", "v", F.explode(F.sequence(F.lit(0), F.lit(REGIONS - 1))).alias("region")).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("channel"))
    return each.select("x", "y", "region", "channel", (F.col("v") * (F.col("region") + 1) + F.col("channel")).alias("value"))


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lattice = Systematic(2, (0, 0), (2, 2))
    return blending.union_of({"full": _weights(spark, sf_dir).withColumn("norm", F.lit(25)), "systematic": _weights(spark, sf_dir, lattice).withColumn("norm", F.lit(9))})


MASKS_SQL = (
    full_sql(2)
    + f""", lattice AS (SELECT CAST(x - dx AS INTEGER) AS x, CAST(y - dy AS INTEGER) AS y, region FROM rf, (SELECT unnest([-2, 0, 2]) AS dx), (SELECT unnest([-2, 0, 2]) AS dy)),
    sampled AS (SELECT x, y, region, count(*) AS importance FROM lattice, m WHERE x BETWEEN 2 AND w - 3 AND y BETWEEN 2 AND h - 3 GROUP BY ALL),
    masks AS (SELECT CAST(0 AS INTEGER) AS algorithm, x, y, region, importance, 25 AS norm FROM counted UNION ALL SELECT CAST(3 AS INTEGER), x, y, region, importance, 9 FROM sampled)"""
)
BLEND_SQL = f"{MASKS_SQL}, {FEATURE_SQL}, blended AS (SELECT algorithm, x, y, channel, CAST(CAST(sum(importance * value) AS BIGINT) AS DOUBLE) / CAST(norm AS DOUBLE) AS value FROM masks JOIN feature USING (x, y, region) GROUP BY algorithm, x, y, channel, norm)"


@query(f"WITH {MASKS_SQL} SELECT algorithm, x, y, region, importance, CAST(importance AS DOUBLE) / CAST(norm AS DOUBLE) AS mask FROM masks")
def multi_algorithm_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masks(spark, sf_dir).select("algorithm", "x", "y", "region", "importance", "mask")


@query(f"WITH {BLEND_SQL} SELECT * FROM blended")
def masked_splat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blending.blend(_masks(spark, sf_dir), features(spark, sf_dir))


#: Features in 0 .. 1, of 1024 steps: sums of such doubles are exact, whatever their order.
SHARES_SQL = f"shares AS (SELECT CAST(event_id // {H} AS INTEGER) AS x, CAST(event_id % {H} AS INTEGER) AS y, CAST(r AS INTEGER) AS region, CAST(c AS INTEGER) AS channel, CAST((event_id * 37 + r * 101 + c * 11) % 1025 AS DOUBLE) / 1024 AS value FROM events, range({REGIONS}) t(r), range(3) u(c))"


def share_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _events(spark, sf_dir).select("event_id", F.explode(F.sequence(F.lit(0), F.lit(REGIONS - 1))).alias("region")).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("channel"))
    n = F.col("event_id")
    return cells.select(F.floor(n / H).cast("int").alias("x"), F.pmod(n, F.lit(H)).cast("int").alias("y"), "region", "channel", (F.pmod(n * 37 + F.col("region") * 101 + F.col("channel") * 11, F.lit(1025)).cast("double") / 1024).alias("value"))


SHARED_SQL = f"{MASKS_SQL}, {SHARES_SQL}, blended AS (SELECT algorithm, x, y, channel, sum(importance * value) / CAST(norm AS DOUBLE) AS value FROM masks JOIN shares USING (x, y, region) GROUP BY algorithm, x, y, channel, norm)"


@query(f"WITH {SHARED_SQL} SELECT * FROM blended")
def masked_splat_fractional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blending.blend(_masks(spark, sf_dir), share_features(spark, sf_dir))


@query(f"WITH {SHARED_SQL} SELECT algorithm, x, y, channel, CAST(round_even(value * CAST(65535 AS DOUBLE) + CAST(-32768 AS DOUBLE), 0) AS INTEGER) AS value FROM blended")
def masked_quantise_i16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features in 0 .. 1 need no stretching; the type of the result is that of 8-bit signed and 16-bit features."""
    return blending.quantised(masked_splat_fractional(spark, sf_dir), promoted("i8", "i16"), stretch=False)


_KINDS = " UNION ALL ".join(f"SELECT x, y, region, '{k}' AS kind, CAST(round_even(CAST(importance AS DOUBLE) / CAST(25 AS DOUBLE) * CAST({limits(k)[1] - limits(k)[0]} AS DOUBLE) + CAST({limits(k)[0]} AS DOUBLE), 0) AS BIGINT) AS code FROM counted" for k in INTEGERS)
_BACK = " ".join(f"WHEN '{k}' THEN (CAST(code AS DOUBLE) - CAST({limits(k)[0]} AS DOUBLE)) / CAST({limits(k)[1] - limits(k)[0]} AS DOUBLE)" for k in INTEGERS)


@query(f"WITH {full_sql(2)}, coded AS ({_KINDS}) SELECT x, y, region, kind, code, CASE kind {_BACK} END AS value FROM coded")
def integer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights as numbers of each integer type, and back."""
    weights = _weights(spark, sf_dir)
    coded = [weights.select("x", "y", "region", F.lit(k).alias("kind"), unnormalise_to(F.col("mask"), k).alias("code")).withColumn("value", normalise_from(F.col("code"), k)) for k in INTEGERS]
    return reduce(DataFrame.unionByName, coded)


STRETCH_SQL = f"{BLEND_SQL}, ends AS (SELECT min(value) AS lo, max(value) AS hi FROM blended)"


@query(f"WITH {STRETCH_SQL} SELECT algorithm, x, y, channel, (value - lo) / (hi - lo) AS value FROM blended, ends")
def masked_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blending.stretched(masked_splat(spark, sf_dir))


@query(f"WITH {STRETCH_SQL} SELECT algorithm, x, y, channel, CAST(round_even((value - lo) / (hi - lo) * CAST(255 AS DOUBLE), 0) AS INTEGER) AS value FROM blended, ends")
def masked_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blending.quantised(masked_splat(spark, sf_dir))


@query(f"WITH {MASKS_SQL} SELECT algorithm, region, x, y, CAST((2 * importance * 65535 + norm) // (2 * norm) AS INTEGER) AS code FROM masks")
def split_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = _masks(spark, sf_dir)
    code = F.when(F.col("norm") == 25, quantise_u16(F.col("importance"), 25)).otherwise(quantise_u16(F.col("importance"), 9))
    return masks.select("algorithm", "region", "x", "y", code.alias("code"))


# Tiles and palettes.


@query(f"WITH {RF_SQL}, {META_SQL} SELECT CAST(tx AS INTEGER) AS tile_x, CAST(ty AS INTEGER) AS tile_y, CAST(tx * 16 AS INTEGER) AS x0, CAST(ty * 16 AS INTEGER) AS y0 FROM m, LATERAL (SELECT unnest(range((w + 15) // 16)) AS tx), LATERAL (SELECT unnest(range((h + 15) // 16)) AS ty)")
def foreach_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.tile_spine(spark, meta_of(rf(spark, sf_dir)), TILE)


@query(f"WITH {RF_SQL} SELECT x, y, region, CAST(x // 16 AS INTEGER) AS tile_x, CAST(y // 16 AS INTEGER) AS tile_y FROM rf")
def tile_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.with_tiles(rf(spark, sf_dir), TILE)


@query(f"""WITH {RF_SQL}, {META_SQL}, s AS (SELECT tx, ty, i, j, least(tx * 16 + i, w - 1) AS x, least(ty * 16 + j, h - 1) AS y FROM m, LATERAL (SELECT unnest(range((w + 15) // 16)) AS tx), LATERAL (SELECT unnest(range((h + 15) // 16)) AS ty), range(16) a(i), range(16) b(j))
    SELECT CAST(tx AS INTEGER) AS tile_x, CAST(ty AS INTEGER) AS tile_y, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, region FROM s JOIN rf USING (x, y)""")
def tile_pad_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = rf(spark, sf_dir)
    return raster.to_tiles(field, meta_of(field), TILE)


@query(f"WITH {RF_SQL} SELECT x, y, region FROM rf")
def tile_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = rf(spark, sf_dir)
    meta = meta_of(field)
    return raster.from_tiles(raster.to_tiles(field, meta, TILE), meta, TILE)


_COLOUR = lambda c: f"CAST({hash_u32_sql(SEED, f'palette:{c}', 'i')} % 65536 AS INTEGER) AS {c}"


@query(f"SELECT CAST(i AS INTEGER) AS region, {_COLOUR('r')}, {_COLOUR('g')}, {_COLOUR('b')} FROM range({REGIONS}) t(i)")
def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(REGIONS).select(F.col("id").cast("int").alias("region"), *(uniform_int(hash_u32(SEED, f"palette:{c}", F.col("id")), 65536).alias(c) for c in "rgb"))


# Profiles: results of the Radius sweep with times made up from job and value, looked up by job.

_JOBS = ", ".join(f"({profile.FIRST_JOB + i}, '{g}', '{s}', '{c}')" for i, (g, s, c) in enumerate((g, s, c) for g in ("Uniform", "Voronoi") for s in ("F+", "F-") for c in ("DD", "DS", "SS")))
_VALUES = ", ".join(f"({v})" for v in profile.SWEEPS["Radius"])


@query(
    f"""WITH jobs AS (SELECT * FROM (VALUES {_JOBS}) t(job_id, generator, splatting, container)), v AS (SELECT * FROM (VALUES {_VALUES}) t(variable)),
    r AS (SELECT container, variable, CAST((job_id - {profile.FIRST_JOB} + 1) * variable AS DOUBLE) AS t FROM jobs, v WHERE generator = 'Voronoi' AND splatting = 'F+')
    SELECT variable, max(CASE container WHEN 'DD' THEN t END) AS "DD", max(CASE container WHEN 'DS' THEN t END) AS "DS", max(CASE container WHEN 'SS' THEN t END) AS "SS" FROM r GROUP BY variable"""
)
def profile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = profile.job_index(spark, ["Radius"], ["Uniform", "Voronoi"], ["F+", "F-"], ["DD", "DS", "SS"])
    values = spark.createDataFrame([(v,) for v in profile.SWEEPS["Radius"]], "variable int")
    results = index.select("job_id").join(F.broadcast(values)).withColumn("t_median", ((F.col("job_id") - profile.FIRST_JOB + 1) * F.col("variable")).cast("double"))
    return profile.lookup(index, results, title="Radius", generator="Voronoi", splatting="F+", tag="Default")

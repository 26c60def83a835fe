"""The command line: python -m cellwise regionfield | splat | blend | split | profile."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cellwise.functions.quantise import promoted, quantise_u16
from cellwise.functions.rng import default_seed
from cellwise.operators.blend import ALGORITHMS, blend, quantised
from cellwise.plans import api, sweeps
from cellwise.schema import RegionfieldMeta, centred_window
from cellwise.sources import images, tables, tiff


def _pair(text: str) -> tuple[int, int]:
    return sweeps.pair(text.replace("x", ",").split(","))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cellwise", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    field = commands.add_parser("regionfield", help="generate a grid of regions")
    field.add_argument("generator", choices=sorted(api.GENERATORS))
    field.add_argument("output")
    field.add_argument("--resolution", type=_pair, required=True, help="width,height")
    field.add_argument("--regions", type=int, required=True)
    field.add_argument("--centroids", type=int, default=2)
    field.add_argument("--initial-extent", type=_pair, default=(2, 2))
    field.add_argument("--iterations", type=api.parse_iterations, default=(0,), help="such as 3x0-3x2")

    splat = commands.add_parser("splat", help="weights of regions around each cell")
    splat.add_argument("method", choices=sorted(api.SPLATTERS))
    splat.add_argument("input")
    splat.add_argument("output")
    splat.add_argument("--regions", type=int, required=True)
    splat.add_argument("--resolution", type=_pair, required=True)
    splat.add_argument("--radius", type=int, default=0)
    splat.add_argument("--offset", type=_pair)
    splat.add_argument("--extent", type=_pair)
    splat.add_argument("--centre", action="store_true", help="put the extent in the middle")
    splat.add_argument("--strata", type=int, default=1)
    splat.add_argument("--samples", type=int, default=1)
    splat.add_argument("--first", type=_pair, default=(0, 0))
    splat.add_argument("--interval", type=_pair, default=(1, 1))

    mix = commands.add_parser("blend", help="features by region, blended by weights")
    mix.add_argument("masks")
    mix.add_argument("output")
    mix.add_argument("-F", "--features", nargs="+", required=True, help="an image for each region, or one with a layer for each")
    mix.add_argument("--rescale", action="store_true", help="stretch over the whole type")
    mix.add_argument("--type", default="u8", choices=["u8", "u16"])

    split = commands.add_parser("split", help="an image for each algorithm and region, in archives")
    split.add_argument("masks")
    split.add_argument("output")
    split.add_argument("--format", default="png", choices=sorted(set(images.FORMATS.values())))
    split.add_argument("--type", default="u16", choices=["u8", "u16"])

    profile = commands.add_parser("profile", help="time the sweeps of a configuration")
    profile.add_argument("configuration", help="a YAML file")
    profile.add_argument("output")
    for command in (field, splat):
        command.add_argument("--seed", type=int, default=None)
    for command in (field, splat, split):
        command.add_argument("--compression", default="zstd")
    for command in (field, splat):
        command.add_argument("--tiff", action="store_true", help="write TIFF blocks instead of tables")
    return top


def _spec(given: argparse.Namespace) -> api.Splatter:
    options = {"full": {}, "systematic": {"first": given.first, "interval": given.interval}, "stratified": {"strata": given.strata, "seed": given.seed}, "stochastic": {"samples": given.samples, "seed": given.seed}}
    return api.SPLATTERS[given.method](radius=given.radius, **options[given.method])


def run(spark: SparkSession, given: argparse.Namespace) -> None:
    """Runs one command; a seed that is not given is taken from the clock."""
    if getattr(given, "seed", 0) is None:
        given.seed = default_seed()
    if given.command == "regionfield":
        meta = RegionfieldMeta(*given.resolution, given.regions)
        generator = {"uniform": lambda: api.Uniform(), "voronoi": lambda: api.Voronoi(given.centroids), "diamond_square": lambda: api.DiamondSquare(given.initial_extent, given.iterations)}[given.generator]()
        grid = api.generate(spark, meta, generator, given.seed)
        if given.tiff:
            tiff.write_files(tiff.field_files(grid, meta, codec=given.compression, seed=given.seed), given.output)
        else:
            tables.write_field(grid, given.output, compression=given.compression)
    elif given.command == "splat":
        meta = RegionfieldMeta(*given.resolution, given.regions)
        spec = _spec(given)
        window = centred_window(meta, given.radius, given.extent) if given.centre else None
        weights = api.splat(tables.read_field(spark, given.input), meta, spec, window.offset if window else given.offset, window.extent if window else given.extent)
        norm = weights.agg(F.round(F.max(F.col("importance") / F.col("mask")))).first()[0]
        masks = weights.withColumn("norm", F.lit(int(norm or 1)))
        if given.tiff:
            coded = masks.select(F.lit(ALGORITHMS[given.method]).alias("algorithm"), "region", "x", "y", quantise_u16(F.col("importance"), int(norm or 1)).alias("code"))
            tiff.write_files(tiff.mask_files(coded, meta, codec=given.compression), given.output)
        else:
            tables.write_masks({given.method: masks}, given.output, given.compression)
    elif given.command == "blend":
        features = images.read_features(spark, dict(enumerate(given.features)))
        blended = blend(spark.read.parquet(given.masks), features)
        quantised(blended, promoted(given.type), given.rescale).write.mode("overwrite").parquet(given.output)
    elif given.command == "split":
        masks = spark.read.parquet(given.masks)
        coded = masks.withColumn("code", F.bround(F.col("mask") * 65535, 0).cast("int")).select("algorithm", "region", "x", "y", "code")
        files = images.layer_images(coded, form=given.format, kind=given.type).withColumn("stem", F.concat(F.lit(f"{Path(given.masks).name}-"), "algorithm"))
        tiff.write_files(images.archives(files, "stem"), given.output)
    else:
        with open(given.configuration, encoding="utf-8") as f:
            config = sweeps.config_from_yaml(f.read())
        index, results = sweeps.run_profile(spark, config)
        tables.write_index(index, f"{given.output}/Content.csv")
        tables.write_results(results, f"{given.output}/results")


def main(arguments: list[str] | None = None) -> None:
    given = parser().parse_args(arguments)
    run(SparkSession.builder.appName("cellwise").getOrCreate(), given)


if __name__ == "__main__":
    main()

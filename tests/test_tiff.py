"""TIFF files come back as they went."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellwise.functions.quantise import quantise_u16
from cellwise.plans.api import Full, Uniform, generate, splat
from cellwise.schema import RegionfieldMeta
from cellwise.sources import tiff
from pyspark.sql import functions as F

from grid_rows import rows


@settings(max_examples=30, deadline=None)
@given(st.sampled_from([1, 2, 4, 8, 16]), st.sampled_from(sorted(tiff.CODECS)), st.integers(1, 40), st.integers(1, 40), st.integers(1, 3))
def test_codec(bits, codec, height, width, depth):
    images = np.random.default_rng(height * width).integers(0, 1 << bits, (depth, height, width)).astype(np.uint16)
    ((back, tags),) = tiff.decode(tiff.encode([(images, {tiff.REGION_COUNT: (tiff.SHORT, [7])})], bits, codec, 16))
    assert (back == images).all() and tags[tiff.REGION_COUNT] == [7] and tags[tiff.ORIENTATION] == [5]


def test_other_bytes():
    for data in (b"", b"MM*\0", b"II*\0\x08\0\0\0\0\0\0\0\0\0"):
        with pytest.raises(ValueError):
            list(tiff.decode(data))


def test_files(spark, tmp_path):
    meta = RegionfieldMeta(37, 29, 5)
    field = generate(spark, meta, Uniform(), 3).cache()
    tiff.write_files(tiff.field_files(field, meta, 16), f"{tmp_path}/f")
    tiff.write_files(tiff.field_files(field, meta, 16), f"file://{tmp_path}/f")  # again, by an address
    assert rows(tiff.field_from_files(tiff.read_files(spark, f"{tmp_path}/f"))) == rows(field)
    masks = splat(field, meta, Full(1)).select(F.lit(0).alias("algorithm"), "region", "x", "y", quantise_u16(F.col("importance"), 9).alias("code"))
    assert rows(tiff.masks_from_files(tiff.mask_files(masks, meta, 16))) == rows(masks)
    with pytest.raises(ValueError):
        tiff.field_files(field, RegionfieldMeta(37, 29, 1))

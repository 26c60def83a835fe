"""The profile's configuration and a small run of all sweeps."""

import pytest

from cellwise.plans.profile import lookup
from cellwise.plans.sweeps import Config, Span, run_profile


def test_config():
    config = Config.of({"extent": [8, 9], "radii": {"from": 1, "to": 3, "count": 3}, "runs": 1})
    assert config.extent == (8, 9) and config.radii.values == [1, 2, 3] and config.region_counts == Span(2, 30, 15)
    for bad in ({"extent": [8]}, {"radii": {"from": 1, "to": 2}}, {"radius_": 1}):
        with pytest.raises(ValueError):
            Config.of(bad)


def test_run(spark, monkeypatch):
    from cellwise.plans import sweeps

    monkeypatch.setattr(sweeps.sweep_radius, "__defaults__", (("SS",), None, None, None, "Default"))
    for f in (sweeps.sweep_region_count, sweeps.sweep_centroid_count):
        monkeypatch.setattr(f, "__defaults__", (("SS",),))
    monkeypatch.setattr(sweeps, "SHAPES", {"SS": "long"})
    config = Config(extent=(6, 6), radius=1, radii=Span(1, 2, 2), region_counts=Span(2, 3, 2), centroid_counts=Span(1, 2, 2), stress_extent=(8, 8), stress_radii=Span(1, 1, 1), runs=1)
    index, results = run_profile(spark, config)
    assert index.count() == 9 and results.count() == 17
    assert lookup(index, results, title="Radius", generator="Uniform", splatting="F+", tag="Stress").count() == 1

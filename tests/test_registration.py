"""Calibration, waves and propagation on planted data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.functions import geometry as geo
from skylattice.operators import raster, robust
from skylattice.plans import registration as reg
from skylattice.sources import files


def test_calibrate(spark):
    rng = np.random.default_rng(0)
    h = np.array([[1.01, 0.02, 3], [-0.01, 0.99, -2], [1e-5, 0, 1]])
    rows = []
    for idx in range(30):
        p = rng.uniform(0, [640, 480], (12, 2))
        q = robust.project(h, p) + rng.normal(0, 0.05, p.shape)
        conf = rng.choice([0.9, 0.3, 0.1], 12)
        q[conf == 0.1] += 99
        rows += [(f"{idx:04d}", *map(float, (*b, *a)), float(c)) for a, b, c in zip(p, q, conf)]
    df = spark.createDataFrame(rows, "idx string, x0 double, y0 double, x1 double, y1 double, conf double")
    got = reg.calibrate(df)
    assert np.allclose(np.array(got.m).reshape(3, 3), h, atol=0.2) and got.rmse < 0.2 and got.n_inliers > 150
    with pytest.raises(reg.TooFewMatches):
        reg.calibrate(df.filter("conf < 0.5"))


def test_field_uses_all_inliers(spark):
    """A distortion that six of 20,000 inliers see."""
    rng = np.random.default_rng(3)
    p = rng.uniform(0, [640, 480], (20_000, 2))
    p = p[(np.abs(p - [320, 240]) > 40).any(axis=1)]
    p = np.concatenate([p, [320, 240] + rng.uniform(-8, 8, (6, 2))])
    q = p.copy()
    q[-6:, 0] += 2
    rows = [(f"{i % 25:04d}", *map(float, (*b, *a)), 0.9) for i, (a, b) in enumerate(zip(p, q))]
    df = spark.createDataFrame(rows, "idx string, x0 double, y0 double, x1 double, y1 double, conf double")
    got = reg.calibrate(df, reg.CalibrationConfig(model="affine"))
    gx, gy, field = got.field
    assert got.n_inliers == len(p)
    assert field[list(gy).index(240), list(gx).index(320), 0] < -1.5  # the warped image is two pixels to the left there
    # cells against the exact spline
    some = rng.choice(len(p), 1500, replace=False)
    wave = np.column_stack([np.sin(p[some, 0] / 90), np.cos(p[some, 1] / 90)])
    exact, cells = (robust.residual_field(p[some], wave, 640, 480, dense=d)[2] for d in (3000, 100))
    assert np.sqrt(((exact - cells) ** 2).mean()) < 0.05


def test_waves_and_propagation(spark):
    order = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 9)], "step long, image long")
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 2)], "a long, b long")
    waves = reg.fill_waves(order, edges)
    assert sorted(map(tuple, waves.collect())) == [(1, 0), (2, 1), (3, 2), (9, 0)]
    pixels = spark.createDataFrame([(1, 0, 0, 5.0), (1, 0, 1, 6.0), (2, 0, 0, 7.0), (3, 5, 5, 1.0)], "image long, y int, x int, value double")
    shift = [1.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    moves = spark.createDataFrame([(2, 1, 1, shift), (3, 2, 1, shift)], "target long, source long, rank int, m array<double>")
    got = {(r.image, r.y, r.x): r.value for r in reg.propagate(pixels, moves, waves, 8, 8).collect()}
    assert got == {(1, 0, 0): 5.0, (1, 0, 1): 6.0, (2, 0, 0): 7.0, (2, 0, 1): 5.0, (2, 0, 2): 6.0, (3, 5, 5): 1.0, (3, 0, 1): 7.0, (3, 0, 2): 5.0, (3, 0, 3): 6.0}


def test_choose_method(spark):
    pairs = spark.createDataFrame([("a", "b"), ("c", "d")], "v string, t string")
    poses = spark.createDataFrame([("a",), ("b",), ("c",)], "image string")
    assert {r.v: r.method for r in reg.choose_method(pairs, poses, "v", "t").collect()} == {"a": "3d", "c": "2d"}


def test_utm(spark):
    one = spark.range(1)
    zone = geo.utm_zone(F.lit(52.52), F.lit(13.405))
    e, n = geo.lat_lon_to_utm(F.lit(52.52), F.lit(13.405), zone)
    r = one.select(zone.alias("z"), e.alias("e"), n.alias("n")).first()
    assert r.z == 32633 and abs(r.e - 391_779) < 2 and abs(r.n - 5_820_072) < 2  # known to the metre


def test_images():
    image = np.add.outer(np.arange(64), np.arange(96)).astype(np.uint8)
    assert abs(raster.resize_area(image, 48, 32).mean() - image.mean()) < 0.6
    dim = (100 + image // 8).astype(np.uint8)
    assert raster.equalize(dim).std() > dim.std()
    x, y = raster.division_map(9, 7, 0.0, (4, 3), 5)
    assert (raster.remap(image[:7, :9], x, y)[0] == image[:7, :9]).all()


def test_features_and_guards(spark, tmp_path):
    images = spark.createDataFrame([("0001",), ("0002",)], "idx string")
    mapping = spark.createDataFrame([("0001", "d/a.JPG"), ("0002", "d/b.JPG")], "index string, original_visible string")
    shots = spark.createDataFrame([("a.JPG", 400, 300)], "shot string, width int, height int")
    features = spark.createDataFrame([("a.JPG", 0, 0.0, 0.5), ("b.JPG", 0, 0.0, 0.0)], "name string, kp int, x double, y double")
    assert [tuple(r) for r in files.image_features(images, mapping, shots, features).collect()] == [("0001", 0, 200.0, 350.0)]
    assert files.read_origin(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(ValueError):
        files.reset_outputs([str(tmp_path)], "move")

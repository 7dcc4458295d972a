"""The entry points on a small planted survey."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.operators import organize, raster, robust
from skylattice.operators.rays import Grid, Ground
from skylattice.plans import densify, survey
from skylattice.plans import registration as reg

W, H = 60, 48
CONFIG = reg.CalibrationConfig(model="affine", width=W, height=H)
SHIFT = np.array([[1, 0, 4], [0, 1, 3], [0, 0, 1.0]])  # thermal to visible, in work frames


@pytest.fixture(scope="module")
def ground():
    rng = np.random.default_rng(0)
    return rng.integers(20, 236, (120, 160, 3), dtype=np.uint8)


@pytest.fixture(scope="module")
def raw(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(1, 4):
        p = rng.uniform(0, [W, H], (60, 2))
        q = robust.project(SHIFT, p)
        rows += [(f"{i:04d}", *map(float, (*b, *a)), 0.9) for a, b in zip(p, q)]
    return spark.createDataFrame(rows, "idx string, x0 double, y0 double, x1 double, y1 double, conf double")


def test_organise(spark, tmp_path):
    names = {"A_0003_V.png": (8, 6), "B_3_T.png": (4, 3), "IMG_xyzab_V.png": (8, 6), "IMG_xyzcd_T.png": (4, 3), "C_9_V.png": (8, 6), "D_8_T.png": (4, 3)}
    for n, (w, h) in names.items():
        (tmp_path / n).write_bytes(raster.encode_png(np.full((h, w), len(n), np.uint8)))
    (tmp_path / "bad.png").write_bytes(b"no image")
    dry = survey.organise(spark, str(tmp_path))
    plan = {tuple(r[c].rsplit("/", 1)[-1] for c in ("visible", "thermal")): r.idx for r in dry.plan.collect()}
    assert plan == {("A_0003_V.png", "B_3_T.png"): "0001", ("IMG_xyzab_V.png", "IMG_xyzcd_T.png"): "0002"} and dry.copied is None
    assert organize.dry_run(dry.plan, n=1).count() == 1
    assert sorted((r.side, r.path.rsplit("/", 1)[1]) for r in dry.unmatched.collect()) == [("thermal", "D_8_T.png"), ("visible", "C_9_V.png")]
    done = survey.organise(spark, str(tmp_path), str(tmp_path / "out"))
    assert [r.error for r in done.copied.collect()] == [None] * 4
    assert sorted(r.idx for r in survey.load_pairs(spark, str(tmp_path / "out")).collect()) == ["0001", "0002"]
    assert survey.mapping(done.plan).columns[0] == "index"


def test_register_is_restartable(spark, raw, ground, tmp_path):
    visible = raster.encode_png(ground[:H, :W])
    thermal = raster.encode_png(ground[3 : H + 3, 4 : W + 4])  # its pixel (x, y) is the visible (x + 4, y + 3)
    pairs = spark.createDataFrame([("0001", visible, thermal), ("0002", visible, b"broken"), ("0003", visible, thermal)], "idx string, visible binary, thermal binary")
    found = survey.register(pairs, raw, str(tmp_path), CONFIG, limit=2)
    assert np.allclose(np.array(found.m).reshape(3, 3), SHIFT, atol=1e-6) and found.n_pairs == 3
    survey.register(pairs, raw, str(tmp_path), CONFIG, limit=2)
    survey.register(pairs, raw, str(tmp_path), CONFIG)
    got = spark.read.parquet(f"{tmp_path}/warped").collect()
    assert sorted(r.idx for r in got) == ["0001", "0003"]
    image = raster.decode_png(bytes(got[0].warped), alpha=True)
    assert (image[3:, 4:, :3] == ground[3:H, 4:W]).all() and (image[3:, 4:, 3] == 255).all()
    assert got[0].coverage == pytest.approx((W - 4) * (H - 3) / (W * H))
    # a saved calibration wins over the configuration, and says so
    again = reg.calibrate_once(raw, f"{tmp_path}/calibration", reg.CalibrationConfig(model="homography", width=W, height=H))
    assert again.model == "affine" and "homography" in again.warnings[-1]
    assert reg.calibrate_once(raw, f"{tmp_path}/calibration", reg.CalibrationConfig(model="homography", width=W, height=H), again=True).model == "homography"


def test_calibration_round_trip_and_defaults(spark, tmp_path):
    field = (np.array([0, 20, 59]), np.array([0, 47]), np.arange(12.0).reshape(2, 3, 2))
    one = reg.Calibration(list(SHIFT.ravel()), "homography", 9, 8, 0.5, 0.1, (30.0, 24.0), 38.0, field, W, H, 3, ("note",))
    reg.save_calibration(spark, one, f"{tmp_path}/c")
    back = reg.load_calibration(spark, f"{tmp_path}/c")
    assert (back.field[2] == field[2]).all() and back.warnings == ("note",) and back.k == 0.1 and back.width == W
    spark.createDataFrame([([1.0] * 9,)], "m array<double>").write.parquet(f"{tmp_path}/old")
    old = reg.load_calibration(spark, f"{tmp_path}/old")
    assert (old.model, old.k, old.field, old.n_pairs) == ("affine", 0.0, None, 0)
    gx, gy = np.meshgrid(np.arange(W), np.arange(H))
    np.savez(tmp_path / "c.npz", M_work=SHIFT[:2], work_size=np.array([W, H]), has_tps=True, map_x=gx + 1.0, map_y=gy - 2.0)
    bundle = reg.read_calibration_bundle(spark, f"{tmp_path}/c.npz")
    assert bundle.model == "affine" and np.allclose(bundle.m, SHIFT.ravel()) and np.allclose(bundle.field[2], [1.0, -2.0])
    # the field is read beside each pixel
    image = np.tile(np.arange(W, dtype=np.uint8)[None, :, None], (H, 1, 3))
    moved, _ = reg.warp_thermal(image, (W, H), reg.Calibration(list(np.eye(3).ravel()), "affine", 0, 0, 0, 0.0, (30, 24), 38.0, bundle.field, W, H))
    assert moved[10, 10, 0] == 11


def test_warnings(raw):
    mirror = np.array([[-1, 0, 0], [0, 1, 0], [0, 0, 1.0]])
    assert any("reflection" in x for x in reg.check_transform(mirror, CONFIG))
    assert reg.check_transform(np.eye(3), CONFIG) == []
    assert reg.check_transform(np.array([[1, 0, 0], [0, 1, 0], [0.1, 0, 1]]), reg.CalibrationConfig()) == ["strong perspective"]


def test_import_is_idempotent(spark, tmp_path):
    rows = [("2", i, "1", 10 + i) for i in range(3)] + [("3", 1, "3", 1)]
    df = spark.createDataFrame(rows, "image_a string, kp_a int, image_b string, kp_b int")
    assert survey.import_matches(df, str(tmp_path)) == 1 and survey.import_matches(df, str(tmp_path)) == 0
    more = df.unionByName(spark.createDataFrame([("1", 0, "4", 0)], df.schema))
    assert survey.import_matches(more, str(tmp_path)) == 1
    tracks = survey.build_tracks(spark, str(tmp_path))
    assert tracks.count() == 8
    assert spark.read.csv(f"{tmp_path}/tracks.csv", header=True).columns == ["track_id", "image", "feature_id"]


def png(image, mask):
    return raster.encode_png(np.dstack([image, mask.astype(np.uint8) * 255]))


def test_densify_propagates(spark, ground, tmp_path):
    """Three images in a row, 20 pixels apart: the third gets pixels of the first through the second."""
    visible, own, points, matches = [], [], [], []
    for i in range(3):
        part = ground[:H, 20 * i : 20 * i + W]
        mask = np.zeros((H, W), bool)
        mask[:, :30] = i == 0
        visible.append((str(i + 1), raster.encode_png(np.zeros_like(part))))
        own.append((str(i + 1), png(part, mask)))
        points += [(str(i + 1), k, float(x - 20 * i), float(y)) for k, (x, y) in enumerate((x, y) for x in range(0, 160, 9) for y in range(0, H, 7)) if 0 <= x - 20 * i < W]
    have = {(p[0], p[1]) for p in points}
    for a, b in (("1", "2"), ("2", "3")):
        matches += [(a, k, b, k) for k in range(400) if (a, k) in have and (b, k) in have]
    results = str(tmp_path)
    spark.createDataFrame(own, "idx string, warped binary").write.parquet(f"{results}/warped")
    survey.import_matches(spark.createDataFrame(matches, "image_a string, kp_a int, image_b string, kp_b int"), results)
    df = spark.createDataFrame(points, "image string, kp int, x double, y double")
    out = {r.idx: r for r in survey.densify_survey(spark.createDataFrame(visible, "idx string, visible binary"), df, results).collect()}
    assert set(out) == {"1", "2", "3"} and all(not r.errors for r in out.values())
    assert out["1"].after == pytest.approx(0.5) and out["2"].after > 0.1
    side = raster.decode_png(bytes(out["2"].sidecar), alpha=True)
    assert (side[5:40, 1:9, 3] == 255).all() and (side[5:40, 1:9, :3] == ground[5:40, 21:29]).all() and not side[..., 3][:, 20:].any()
    assert survey.densify_survey(spark.createDataFrame(visible, "idx string, visible binary"), df, results).count() == 0


def test_fill_rules(ground):
    visible = np.zeros((H, W, 3), np.uint8)
    part, mask = ground[:H, :W], np.zeros((H, W), bool)
    mask[:, :20] = True
    own = np.dstack([part, mask.astype(np.uint8) * 255])
    full = np.dstack([part, np.full((H, W), 255, np.uint8)])
    bad = densify.Layer("bad", full, m=np.zeros((3, 3)))
    good = densify.Layer("good", full, m=np.eye(3), points=np.array([[10.0, 10], [30, 20]]))
    got = densify.fill_image(visible, own, [bad, good], densify.FULL)
    assert got["sources"] == 2 and got["after"] == 1.0 and len(got["errors"]) == 1 and got["errors"][0].startswith("bad")
    boxed = densify.fill_image(visible, own, [good], densify.BOXED)
    assert boxed["real"].mean() < 1 and boxed["real"][15, 32] and not boxed["real"][40, 50]
    with pytest.warns(UserWarning):
        rest = densify.fill_image(visible, own, [], densify.BLENDED)
    assert rest["dense"][:, 40:].any() and not rest["real"][:, 40:].any()  # guesses are no true content
    assert densify.fill_image(visible, None, [], densify.FULL)["after"] == 0


def test_fill_by_poses(spark, ground):
    """Two cameras over a plane, ten pixels apart on the ground."""
    k, down = np.array([[50.0, 0, W / 2], [0, 50, H / 2], [0, 0, 1]]), np.diag([1.0, -1, -1])
    rows, targets = [], []
    for i, c in enumerate((np.array([0.0, 0, 50]), np.array([10.0, 0, 50]))):
        rows.append((str(i + 1), W, H, *(x.ravel().tolist() for x in (k, down, -down @ c, c))))
        image = ground[:H, 10 * i : 10 * i + W]
        targets.append((str(i + 1), raster.encode_png(np.zeros_like(image)), png(image, np.full((H, W), i == 1))))
    poses = spark.createDataFrame(rows, "idx string, width int, height int, K array<double>, R array<double>, t array<double>, C array<double>")
    df = spark.createDataFrame(targets, "idx string, visible binary, own binary")
    p = np.random.default_rng(0).uniform([15, 5], [50, 40], (20, 2))
    matches = spark.createDataFrame([("1", "2", *map(float, (x, y, x - 10, y))) for x, y in p], "a string, b string, x0 double, y0 double, x1 double, y1 double")
    plane = Ground(0.0)
    out, why = densify.fill_by_poses(df, poses, matches, plane, 20.0)
    got = {r.idx: r for r in out.collect()}
    side = raster.decode_png(bytes(got["1"].sidecar), alpha=True)
    assert why == "poses" and (side[5:40, 12:58, :3] == ground[5:40, 12:58]).all() and not side[:, :9, 3].any()
    wrong = matches.withColumn("x1", F.col("x1") + 200)
    assert densify.fill_by_poses(df, poses, wrong, plane, 20.0)[0] is None
    assert densify.fill_by_poses(df, poses, matches.limit(0), plane, 20.0)[0] is None  # no evidence

    def broken():
        raise OSError("no file")

    ground_, what = densify.plane_or_surface(poses, broken, 20.0)
    assert what.startswith("plane: OSError") and ground_.grid is None
    assert densify.plane_or_surface(poses, lambda: (Grid(np.zeros((3, 3)), 0, 0, 1.0), None))[1] == "surface"

"""File sources: image scans and headers, camera text, feature arrays, match maps, documents, tables."""

from __future__ import annotations

import gzip
import io
import pickle
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.functions.geometry import compose_pose

#: Extensions of images, and folders that hold results, not inputs.
EXTENSIONS = ("jpg", "jpeg", "tif", "tiff", "png")
SKIP = ("visible", "thermal", "register_results", "sfm_rig")
#: Camera parameters sit in the first bytes of a file.
HEADER_BYTES = 131072

MAPPING = T.StructType([T.StructField(n, T.StringType()) for n in ("index", "original_visible", "original_thermal", "new_visible", "new_thermal")])
PAIR_STATUS = T.StructType([T.StructField("image_a", T.StringType()), T.StructField("image_b", T.StringType()), T.StructField("verified", T.IntegerType()), T.StructField("inliers", T.IntegerType())])
INLIERS = T.StructType([T.StructField("image_a", T.StringType()), T.StructField("image_b", T.StringType()), T.StructField("kp_a", T.IntegerType()), T.StructField("kp_b", T.IntegerType())])


def scan_images(spark: SparkSession, folder: str, skip: tuple[str, ...] = SKIP) -> DataFrame:
    """path, length of all images below a folder, without those in result folders.  Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    inner = F.split(F.regexp_replace("path", r"/[^/]*$", ""), "/")
    return files.filter(ext.isin(*EXTENSIONS) & ~F.arrays_overlap(inner, F.array(*map(F.lit, skip))))


def image_size(data: bytes) -> tuple[int, int]:
    """Width and height from a PNG, JPEG or TIFF header."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", data[16:24])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            marker = data[at + 1]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            at += 2 if marker in (0x01, 0xFF) or 0xD0 <= marker <= 0xD9 else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
        raise ValueError("JPEG without a frame header")
    if data[:4] in (b"II*\0", b"MM\0*"):
        tags = tiff_tags(data, 0)
        return int(tags[256]), int(tags[257])
    raise ValueError("unknown image format")


def tiff_tags(data: bytes, base: int, at: int | None = None) -> dict[int, float]:
    """Numbers of a TIFF directory by tag; of several values the first."""
    order = "<" if data[base : base + 2] == b"II" else ">"
    at = struct.unpack_from(order + "I", data, base + 4)[0] if at is None else at
    out = {}
    for i in range(struct.unpack_from(order + "H", data, base + at)[0]):
        entry = base + at + 2 + 12 * i
        tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
        code, size = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 9: ("i", 4), 10: ("ii", 8)}.get(kind, ("", 0))
        if not code:
            continue
        where = entry + 8 if size * count <= 4 else base + struct.unpack_from(order + "I", data, entry + 8)[0]
        values = struct.unpack_from(order + code, data, where)
        out[tag] = values[0] / values[1] if len(values) == 2 and values[1] else float(values[0])
    return out


def exif_tags(data: bytes, sub: bool = True) -> dict[int, float]:
    """EXIF numbers of a JPEG or TIFF: of the sub-directory, or of the base one."""
    base = 0 if data[:4] in (b"II*\0", b"MM\0*") else data.find(b"Exif\0\0") + 6
    if base == 5:
        return {}
    tags = tiff_tags(data, base)
    return tiff_tags(data, base, int(tags[0x8769])) if sub and 0x8769 in tags else tags


def focal_pixels(data: bytes, width: int, height: int, sub: bool = True) -> float | None:
    """Focal length in pixels from EXIF: the 35 mm equivalent, else the focal-plane resolution, else None."""
    tags = exif_tags(data, sub)
    if tags.get(0xA405):
        return tags[0xA405] * max(width, height) / 36.0
    unit = {2: 25.4, 3: 10.0}.get(int(tags.get(0xA210, 2)))
    if unit and tags.get(0x920A) and tags.get(0xA20E):
        return tags[0x920A] * tags[0xA20E] / unit
    return None


def read_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """path, width, height, focal, error: header fields; a file that cannot be read reports why and the others go on."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    heads = files.filter(ext.isin(*EXTENSIONS)).select("path", F.substring("content", 1, HEADER_BYTES).alias("head"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, head in zip(pdf.path, pdf["head"], strict=True):
                try:
                    w, h = image_size(bytes(head))
                    rows.append((path, w, h, focal_pixels(bytes(head), w, h), None))
                except (ValueError, KeyError, struct.error) as e:
                    rows.append((path, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "focal", "error"]).astype({"width": "Int32", "height": "Int32"})

    return heads.mapInPandas(parse, "path string, width int, height int, focal double, error string")


def dewarp(content: Column) -> Column:
    """Nine lens parameters from the text ``DewarpData`` of a header (after the last ``;``); null if there are not nine."""
    head = F.decode(F.substring(content, 1, HEADER_BYTES), "ISO-8859-1")
    text = F.regexp_extract(head, r'DewarpData\s*=\s*"([^"]*)"', 1)
    numbers = F.transform(F.split(F.element_at(F.split(text, ";"), -1), ","), lambda x: F.trim(x).try_cast("double"))
    fine = (F.size(numbers) == 9) & ~F.exists(numbers, lambda x: x.isNull())
    return F.when(fine, numbers)


def index_folder(files: DataFrame, tag: str) -> DataFrame:
    """idx, path by names ``_<digits>_<tag>.<ext>``; of several the last by name."""
    idx = F.regexp_extract("path", rf"(?i)_(\d+)_{re.escape(tag)}\.(?:{'|'.join(EXTENSIONS)})$", 1)
    return files.select(idx.alias("idx"), "path").filter("idx <> ''").groupBy("idx").agg(F.max("path").alias("path"))


def feature_points(data: bytes) -> np.ndarray:
    """N x 2 points of an array bundle under ``points``, ``keypoints`` or ``features``; other keys are an error."""
    with np.load(io.BytesIO(data), allow_pickle=False) as bundle:
        for key in ("points", "keypoints", "features"):
            if key in bundle.files:
                return np.asarray(bundle[key])[:, :2].astype(np.float32)
        raise ValueError(f"no known array among {bundle.files}")


def read_features(spark: SparkSession, folder: str) -> DataFrame:
    """path, kp, x, y, error from ``.npz`` files; kp is the row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content, strict=True):
                try:
                    p = feature_points(bytes(content))
                    yield pd.DataFrame({"path": path, "kp": np.arange(len(p), dtype=np.int32), "x": p[:, 0], "y": p[:, 1], "error": None})
                except (ValueError, KeyError, IndexError, OSError, EOFError, zipfile.BadZipFile, zlib.error) as e:
                    yield pd.DataFrame({"path": [path], "kp": pd.array([None], "Int32"), "x": [np.nan], "y": [np.nan], "error": [str(e)]})

    return files.mapInPandas(parse, "path string, kp int, x float, y float, error string")


class _ArraysOnly(pickle.Unpickler):
    """Loads plain containers and numpy arrays, and nothing that could run code."""

    def find_class(self, module: str, name: str):
        if module in ("numpy", "numpy.core.multiarray", "numpy._core.multiarray") and name in ("ndarray", "dtype", "_reconstruct", "scalar"):
            return super().find_class(module, name)
        if (module, name) == ("numpy._core.numeric", "_frombuffer") or (module, name) == ("numpy.core.numeric", "_frombuffer"):
            return super().find_class(module, name)
        if (module, name) == ("_codecs", "encode"):
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed")


def match_map(data: bytes) -> dict[str, np.ndarray]:
    """Neighbour name to N x 2 key point numbers, from a gzipped pickle."""
    found = _ArraysOnly(gzip.GzipFile(fileobj=io.BytesIO(data))).load()
    return {str(k): np.asarray(v, np.int64).reshape(-1, 2) for k, v in found.items()}


def read_matches(spark: SparkSession, folder: str) -> DataFrame:
    """path, neighbour, n, kp_this, kp_other, error: a row a match, and one row with n = 0 and nulls for an empty list.

    A file that cannot be read gives one row with its error, and the others go on.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pkl.gz").option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content, strict=True):
                try:
                    found = match_map(bytes(content))
                except (ValueError, TypeError, KeyError, IndexError, AttributeError, OSError, EOFError, zlib.error, pickle.UnpicklingError) as e:
                    yield pd.DataFrame({"path": [path], "neighbour": [None], "n": [0], "kp_this": pd.array([None], "Int64"), "kp_other": pd.array([None], "Int64"), "error": [f"{type(e).__name__}: {e}"]})
                    continue
                for name, m in found.items():
                    some = m if len(m) else np.array([[np.nan, np.nan]])
                    yield pd.DataFrame({"path": path, "neighbour": name, "n": len(m), "kp_this": some[:, 0], "kp_other": some[:, 1], "error": None}).astype({"kp_this": "Int64", "kp_other": "Int64"})

    return files.mapInPandas(parse, "path string, neighbour string, n int, kp_this long, kp_other long, error string")


def read_raw_matches(spark: SparkSession, folder: str) -> DataFrame:
    """idx, x0, y0, x1, y1, conf, error from bundles ``<idx>.npz`` with mkpts0, mkpts1 and conf.

    A bundle that cannot be read gives one row with its error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(folder)
    files = files.select(F.regexp_extract("path", r"([^/\\]*)\.npz$", 1).alias("idx"), "content")
    names = ["x0", "y0", "x1", "y1", "conf"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for idx, content in zip(pdf.idx, pdf.content, strict=True):
                try:
                    with np.load(io.BytesIO(bytes(content)), allow_pickle=False) as bundle:
                        rows = np.column_stack([bundle["mkpts0"].reshape(-1, 2), bundle["mkpts1"].reshape(-1, 2), bundle["conf"].reshape(-1, 1)]).astype(float)
                    yield pd.DataFrame(rows, columns=names).assign(idx=idx, error=None)[["idx", *names, "error"]]
                except (ValueError, KeyError, OSError, EOFError, zipfile.BadZipFile, zlib.error) as e:
                    yield pd.DataFrame([(idx, *[np.nan] * 5, f"{type(e).__name__}: {e}")], columns=["idx", *names, "error"])

    return files.mapInPandas(parse, "idx string, x0 double, y0 double, x1 double, y1 double, conf double, error string")


def pose_matches(raw: DataFrame, poses: DataFrame, least: float = 0.5) -> DataFrame:
    """``poses`` with the confident raw matches of their images, by the number in names ``DJI_<idx>_V.<ext>``; images without either are left out."""
    idx = F.regexp_extract("image", r"(?i)DJI_(\d+)_V\.[^./\\]+$", 1)
    return raw.filter(F.col("conf") >= least).join(poses.withColumn("idx", idx).filter("idx <> ''"), "idx")


_CAMERA = "width int, height int, focal double, focal_x double, focal_y double, c_x double, c_y double, k1 double, k2 double, k3 double, p1 double, p2 double"
_SHOT = "camera string, rotation array<double>, translation array<double>"


def read_reconstruction(spark: SparkSession, path: str, merge: bool = False) -> DataFrame:
    """shot, camera name, camera fields, rotation, translation of the reconstruction with most shots (the first of equals), or of all, later ones winning."""
    schema = f"cameras map<string, struct<{re.sub(r'(\w+) (\w+)', r'\1:\2', _CAMERA)}>>, shots map<string, struct<camera:string, rotation:array<double>, translation:array<double>>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{schema.replace('cameras map', 'cameras:map').replace('shots map', 'shots:map')}>>").alias("all"))
    each = whole.select(F.posexplode("all").alias("pos", "r"))
    if not merge:
        each = each.agg(F.max_by(F.struct("pos", "r"), F.struct(F.size("r.shots"), -F.col("pos"))).alias("b")).select("b.*")
    cameras = each.select("pos", F.explode("r.cameras").alias("camera", "c"))
    shots = each.select("pos", F.explode("r.shots").alias("shot", "s"))
    if merge:
        cameras = cameras.groupBy("camera").agg(F.max_by("c", "pos").alias("c"))
        shots = shots.groupBy("shot").agg(F.max_by("s", "pos").alias("s"))
        return shots.select("shot", "s.*").join(cameras.select("camera", "c.*"), "camera")
    return shots.select("shot", "s.*").join(cameras.select("camera", "c.*"), "camera")


def read_camera_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sensors, cameras with a pose, chunk) of a camera document; an error if the chunk has no transform."""
    numbers = lambda c: F.transform(F.split(F.trim(c), r"\s+"), lambda x: x.cast("double"))
    cameras = spark.read.format("xml").option("rowTag", "camera").schema("_id string, _label string, _sensor_id string, transform string").load(path)
    cameras = cameras.filter("transform is not null").select(F.col("_id").alias("camera"), F.col("_label").alias("label"), F.col("_sensor_id").alias("sensor"), numbers(F.col("transform")).alias("transform"))
    if cameras.filter(F.size("transform") != 16).limit(1).count():
        raise ValueError("a camera transform needs 16 numbers")
    calibration = ", ".join(f"{n} double" for n in ("f", "fx", "fy", "cx", "cy", "k1", "k2", "k3", "p1", "p2")).replace(" ", ":").replace(",:", ", ")
    sensors = spark.read.format("xml").option("rowTag", "sensor").schema(f"_id string, resolution struct<_width:int, _height:int>, calibration struct<{calibration}>").load(path)
    value = lambda n: F.coalesce(F.col(f"calibration.{n}"), F.lit(0.0))
    fx = F.coalesce("calibration.fx", "calibration.f")
    sensors = sensors.select(F.col("_id").alias("sensor"), F.col("resolution._width").alias("width"), F.col("resolution._height").alias("height"), fx.alias("fx"), F.coalesce("calibration.fy", fx).alias("fy"), *(value(n).alias(n) for n in ("cx", "cy", "k1", "k2", "k3", "p1", "p2")))
    chunk = spark.read.format("xml").option("rowTag", "chunk").schema("transform struct<rotation:string, translation:string, scale:string>").load(path)
    text = lambda c: F.coalesce(F.col(f"transform.{c}"), F.lit(""))
    chunk = chunk.filter("transform is not null").select(numbers(text("rotation")).alias("rotation"), numbers(text("translation")).alias("translation"), F.col("transform.scale").cast("double").alias("scale"))
    if not chunk.filter((F.size("rotation") == 9) & (F.size("translation") == 3)).limit(1).count():
        raise ValueError("the chunk has no transform")
    return sensors, cameras, chunk


def read_table(spark: SparkSession, path: str, schema: T.StructType, required: bool = False) -> DataFrame:
    """A headed CSV table with ids as text; a missing file is an empty table, or an error if required."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not required and not jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, header=True, schema=schema)


def write_table(df: DataFrame, path: str, append: bool = False) -> None:
    """A headed CSV table; appended to or replaced."""
    df.write.mode("append" if append else "overwrite").csv(path, header=True)


def append_rows(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Append rows with the columns of ``schema`` to a headed CSV table."""
    write_table(df.select([F.col(f.name).cast(f.dataType) for f in schema]), path, append=True)


def export_tracks(tracks: DataFrame, path: str) -> None:
    """track_id, image, feature_id as a headed CSV table, written anew each time."""
    write_table(tracks.select("track_id", "image", "feature_id"), path)


def agisoft_poses(sensors: DataFrame, cameras: DataFrame, chunk: DataFrame) -> DataFrame:
    """label, width, height, K, R, t, C: world poses of the cameras whose sensor is known, of :func:`read_camera_xml`.

    A camera transform is 4 x 4, from the camera to the chunk; the chunk's
    scale is 1 if it names none.
    """
    m = F.col("transform")
    local = F.array(*(m[4 * i + j] for i in range(3) for j in range(3)))
    center = F.array(*(m[4 * i + 3] for i in range(3)))
    place = chunk.select(F.col("rotation").alias("cr"), F.col("translation").alias("ct"), F.coalesce("scale", F.lit(1.0)).alias("cs"))
    rows = cameras.join(sensors, "sensor").join(F.broadcast(place.limit(1)))  # one chunk
    pose = compose_pose(local, center, F.col("cr"), F.col("ct"), F.col("cs"))
    zero, one = F.lit(0.0), F.lit(1.0)
    k = F.array(F.col("fx"), zero, F.col("width") / 2 + F.col("cx"), zero, F.col("fy"), F.col("height") / 2 + F.col("cy"), zero, zero, one)
    return rows.select("label", "width", "height", k.alias("K"), pose["R"].alias("R"), pose["t"].alias("t"), pose["C"].alias("C"))


def organised_poses(poses: DataFrame, names: DataFrame) -> DataFrame:
    """``poses`` by organised image name: label to original name (with or without its extension) to new name; others are left out."""
    bare = lambda c: F.regexp_replace(c, r"(?<=.)\.[^.]*$", "")
    keyed = names.select(bare(F.col("original")).alias("k"), F.col("new").alias("image"), "idx")
    return poses.withColumn("k", bare(F.col("label"))).join(keyed, "k").drop("k", "label")


def read_origin(spark: SparkSession, path: str) -> DataFrame:
    """latitude, longitude, altitude (0 if missing) of a survey's origin; no row without a file."""
    try:
        found = spark.read.schema("latitude double, longitude double, altitude double").option("multiLine", "true").json(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "latitude double, longitude double, altitude double")
    return found.fillna(0.0, ["altitude"])


def image_features(images: DataFrame, mapping: DataFrame, shots: DataFrame, features: DataFrame) -> DataFrame:
    """idx, kp, x, y in native pixels: image to original name to shot and camera to features; any miss leaves an image out.

    ``features`` has name (of the shot), kp, x, y in units of the longer side
    from the centre; ``shots`` the camera's width and height.
    """
    from skylattice.functions.geometry import normalized_to_pixel

    original = mapping.select(F.col("index").alias("idx"), F.regexp_extract("original_visible", r"([^/\\]*)$", 1).alias("name"))
    found = images.select("idx").join(original, "idx").join(shots.select(F.col("shot").alias("name"), "width", "height"), "name").join(features, "name")
    x, y = normalized_to_pixel(F.col("x"), F.col("y"), F.col("width"), F.col("height"))
    return found.select("idx", "kp", x.cast("float").alias("x"), y.cast("float").alias("y"))


def copy_planned(plan: DataFrame, target: str, move: bool = False) -> DataFrame:
    """Copy (or move) the files of a naming plan into ``visible`` and ``thermal`` below ``target``; source, target, error.

    The executors copy, from store to store by Arrow's file systems (local,
    HDFS, S3, GCS).  A file that cannot be copied reports why, and the others
    go on.  Copying happens once, before this returns.
    """
    from skylattice.storage import materialize

    sides = [plan.select(F.col(s).alias("source"), F.concat(F.lit(f"{target.rstrip('/')}/{s}/"), F.col(f"new_{s}")).alias("target")) for s in ("visible", "thermal")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        def place(path: str) -> tuple:
            path = re.sub(r"^file:/+", "/", path)
            return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

        for pdf in batches:
            errors = []
            for source, to in zip(pdf.source, pdf.target, strict=True):
                try:
                    (a, from_path), (b, to_path) = place(source), place(to)
                    b.create_dir(to_path.rpartition("/")[0], recursive=True)
                    if move and a.equals(b):
                        a.move(from_path, to_path)
                    else:
                        fs.copy_files(from_path, to_path, source_filesystem=a, destination_filesystem=b)
                        if move:
                            a.delete_file(from_path)
                    errors.append(None)
                except (OSError, ValueError) as e:
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(error=errors)

    both = sides[0].unionByName(sides[1])
    spread = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(both.repartition(spread).mapInPandas(run, "source string, target string, error string"), "copied")


def reset_outputs(paths: list[str], mode: str) -> None:
    """Delete result folders; refused where originals were moved into them."""
    import shutil

    if mode == "move":
        raise ValueError("originals were moved here: resetting would lose them")
    for path in paths:
        shutil.rmtree(path, ignore_errors=True)

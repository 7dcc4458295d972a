"""LAS point clouds as a Spark data source: ``spark.read.format("las").load(path)``."""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "x double, y double, z double, intensity int, classification int, red int, green int, blue int"
#: Offset of the colours by point format.
_COLOR = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}


class Header:
    """Layout of a file's point records."""

    def __init__(self, data: bytes):
        if data[:4] != b"LASF":
            raise ValueError("not a LAS file")
        self.version = (data[24], data[25])
        self.offset = struct.unpack_from("<I", data, 96)[0]
        self.format, self.length = data[104] & 0x3F, struct.unpack_from("<H", data, 105)[0]
        self.count = struct.unpack_from("<I", data, 107)[0]
        if self.version >= (1, 4) and not self.count:
            self.count = struct.unpack_from("<Q", data, 247)[0]
        self.scale, self.shift = np.array(struct.unpack_from("<3d", data, 131)), np.array(struct.unpack_from("<3d", data, 155))


def points(data: bytes, header: Header) -> pa.RecordBatch:
    """Records as columns; colours are null where the format has none."""
    raw = np.frombuffer(data, np.uint8).reshape(-1, header.length)
    at = lambda o, n, t: np.ascontiguousarray(raw[:, o : o + n]).view(t)
    xyz = at(0, 12, "<i4").astype(float) * header.scale + header.shift
    kind = raw[:, 16] if header.format >= 6 else raw[:, 15] & 0x1F
    color = _COLOR.get(header.format)
    rgb = [pa.nulls(len(raw), pa.int32())] * 3 if color is None else [pa.array(c.astype(np.int32)) for c in at(color, 6, "<u2").T]
    cols = [*map(pa.array, xyz.T), pa.array(at(12, 2, "<u2").ravel().astype(np.int32)), pa.array(kind.astype(np.int32)), *rgb]
    return pa.RecordBatch.from_arrays(cols, ["x", "y", "z", "intensity", "classification", "red", "green", "blue"])


class Slice(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        super().__init__((path, first, count))
        self.path, self.first, self.count = path, first, count


class LasReader(DataSourceReader):
    """One partition per ``rows`` records of each file."""

    def __init__(self, options: dict):
        self.path, self.rows = options["path"].removeprefix("file://").removeprefix("file:"), int(options.get("rows", 1_000_000))

    def partitions(self) -> list[Slice]:
        files = sorted(glob.glob(os.path.join(self.path, "**", "*.las"), recursive=True)) if os.path.isdir(self.path) else [self.path]
        out = []
        for path in files:
            with open(path, "rb") as f:
                count = Header(f.read(375)).count
            out += [Slice(path, at, min(self.rows, count - at)) for at in range(0, count, self.rows)]
        return out

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        with open(part.path, "rb") as f:
            header = Header(f.read(375))
            f.seek(header.offset + part.first * header.length)
            left = part.count
            while left:
                n = min(left, 100_000)
                yield points(f.read(n * header.length), header)
                left -= n


class LasSource(DataSource):
    """Files on a path that executors can open (a mounted store); see :mod:`skylattice.sources.files` for others."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LasReader:
        return LasReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(LasSource)

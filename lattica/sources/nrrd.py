"""NRRD volumes as tables of voxels.

read_nrrd takes whole files, a task each, wherever Spark can read. The data source "nrrd" cuts the raw data of files, attached or
detached, into byte ranges by what their headers say, so one large volume is many tasks'; it opens files itself, so their folder must
be one that all executors see.
"""

from __future__ import annotations

import glob
import gzip
import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Type names of the format, and how they are stored.
TYPES = {
    "signed char": "i1", "int8": "i1", "uchar": "u1", "unsigned char": "u1", "uint8": "u1", "short": "i2", "int16": "i2",
    "ushort": "u2", "unsigned short": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "unsigned int": "u4",
    "uint32": "u4", "longlong": "i8", "int64": "i8", "ulonglong": "u8", "uint64": "u8", "float": "f4", "double": "f8",
}


def parse(content: bytes) -> tuple[dict[str, str], np.ndarray]:
    """Header and data of a file with attached data, raw, gzip or ascii; the first axis is the fastest."""
    head, _, body = content.partition(b"\n\n")
    lines = head.decode("ascii", "replace").splitlines()
    if not lines or not lines[0].startswith("NRRD"):
        raise ValueError("not an NRRD file")
    header = dict(x.split(": ", 1) for x in lines[1:] if not x.startswith("#") and ": " in x)
    kind = np.dtype(("<" if header.get("endian", "little") == "little" else ">") + TYPES[header["type"]])
    encoding, shape = header.get("encoding", "raw"), [int(n) for n in header["sizes"].split()]
    if encoding in ("gzip", "gz"):
        body = gzip.decompress(body)
    elif encoding not in ("raw", "ascii", "text", "txt"):
        raise ValueError(f"encoding {encoding} is not supported")
    data = np.array(body.split(), kind) if encoding in ("ascii", "text", "txt") else np.frombuffer(body, kind, int(np.prod(shape)))
    return header, data.reshape(shape, order="F")


def read_nrrd(spark: SparkSession, path: str) -> DataFrame:
    """path, ix, iy, iz and value of every voxel of 3-D files; 4-D files have a number `component` of the first axis."""
    def run(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in files:
            for name, content in zip(part["path"], part["content"], strict=True):
                data = parse(content)[1]
                data = data[None] if data.ndim == 3 else data
                for component, volume in enumerate(data):
                    for ix, plane in enumerate(volume):
                        iy, iz = np.indices(plane.shape)
                        yield pd.DataFrame({"path": name, "component": component, "ix": ix, "iy": iy.ravel(), "iz": iz.ravel(), "value": plane.ravel().astype(float)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, component int, ix long, iy long, iz long, value double")


SPLIT_SCHEMA = "path string, component int, ix long, iy long, iz long, value double"
#: Values of a range that a task turns into rows at once.
ROWS = 1 << 16


class Range(InputPartition):
    """Values `start` to `stop` of one file's raw data."""

    def __init__(self, path: str, data: str, kind: str, shape: list[int], offset: int, start: int, stop: int):
        self.path, self.data, self.kind, self.shape, self.offset, self.start, self.stop = path, data, kind, shape, offset, start, stop


def header_of(path: str) -> tuple[dict[str, str], int]:
    """A file's header, read without its data, and where attached data begin; detached ones begin at 0, or behind `byte skip` bytes."""
    with open(path, "rb") as f:
        lines = []
        for raw in f:
            line = raw.decode("ascii", "replace").rstrip("\r\n")
            if not line:
                break
            lines.append(line)
        at = f.tell()
    if not lines or not lines[0].startswith("NRRD"):
        raise ValueError(f"{path} is not an NRRD file")
    header = dict(x.split(": ", 1) for x in lines[1:] if not x.startswith("#") and ": " in x)
    return header, int(header.get("byte skip", header.get("byteskip", 0))) if "data file" in header or "datafile" in header else at


class NrrdReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.bytes = options["path"].removeprefix("file://"), int(options.get("splitBytes", 1 << 26))

    def partitions(self) -> list[Range]:
        found = sorted(glob.glob(f"{self.path}/*.n[hr][dr][rd]")) if os.path.isdir(self.path) else [self.path]
        out = []
        for path in found:
            header, offset = header_of(path)
            if header.get("encoding", "raw") != "raw":
                raise ValueError(f"{path} is not raw: read_nrrd reads it, in one task")
            kind = np.dtype(("<" if header.get("endian", "little") == "little" else ">") + TYPES[header["type"]])
            shape = [int(n) for n in header["sizes"].split()]
            data = header.get("data file", header.get("datafile"))
            data = path if data is None else os.path.join(os.path.dirname(path), data)
            n = math.prod(shape)
            if os.path.getsize(data) < offset + n * kind.itemsize:
                raise ValueError(f"{data} is shorter than its header says")
            step = max(1, self.bytes // kind.itemsize)
            out += [Range(path, data, kind.str, shape, offset, a, min(n, a + step)) for a in range(0, n, step)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(part.kind)
        shape = [1] * (4 - len(part.shape)) + part.shape
        with open(part.data, "rb") as f:
            f.seek(part.offset + part.start * kind.itemsize)
            for a in range(part.start, part.stop, ROWS):
                n = min(ROWS, part.stop - a)
                values = np.frombuffer(f.read(n * kind.itemsize), kind, n).astype(float)
                c, x, y, z = np.unravel_index(np.arange(a, a + n), shape, order="F")
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array(c.astype(np.int32)), *(pa.array(i.astype(np.int64)) for i in (x, y, z)), pa.array(values)], names=["path", "component", "ix", "iy", "iz", "value"])


class NrrdSource(DataSource):
    """spark.read.format("nrrd").load(path), a file or a folder of .nrrd and .nhdr files; option splitBytes. Rows are those of read_nrrd."""

    @classmethod
    def name(cls) -> str:
        return "nrrd"

    def schema(self) -> str:
        return SPLIT_SCHEMA

    def reader(self, schema: object) -> NrrdReader:
        return NrrdReader(self.options)


def read_nrrd_split(spark: SparkSession, path: str, split_bytes: int = 1 << 26) -> DataFrame:
    """Raw volumes as read_nrrd gives them, by ranges of split_bytes."""
    spark.dataSource.register(NrrdSource)
    return spark.read.format("nrrd").option("splitBytes", split_bytes).load(path)

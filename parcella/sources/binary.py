"""Sparse-model binaries and vertex PLY files: Python data sources for reading, and writers that concatenate parts in order.

Readers plan partitions without decoding: the driver walks record lengths only. Inputs and outputs are opened through
pyarrow's file systems, so that hdfs, s3 and the like work as local paths do.
"""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from parcella.functions.geometry import PARAMETERS
from parcella.operators.checks import same_layout

#: Schemas of the three binaries' tables.
SCHEMAS = {
    "cameras": "ordinal long, camera_id int, model_id int, width long, height long, params array<double>",
    "images": "ordinal long, image_id int, qvec array<double>, tvec array<double>, camera_id int, name string, points2d array<struct<x: double, y: double, point3d_id: long>>",
    "points": "ordinal long, point3d_id long, xyz array<double>, rgb array<short>, error double, track array<struct<image_id: int, point2d_idx: int>>",
}
KEYS = {"cameras": "camera_id", "images": "image_id", "points": "point3d_id"}
#: Records of a partition.
RECORDS = 1 << 16
BATCH = 1 << 12


def opened(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system, at


class Bytes:
    """A stream of fixed and variable fields that reports where it ends early."""

    def __init__(self, path: str, offset: int = 0) -> None:
        system, at = opened(path)
        self.path, self.f = path, io.BufferedReader(system.open_input_file(at), 1 << 20)
        self.f.seek(offset)

    def take(self, n: int) -> bytes:
        data = self.f.read(n)
        if len(data) != n:
            raise ValueError(f"{self.path}: ends within a record, at byte {self.f.tell()}")
        return data

    def values(self, form: str) -> tuple:
        return struct.unpack("<" + form, self.take(struct.calcsize("<" + form)))

    def text(self) -> str:
        out = bytearray()
        while (c := self.take(1)) != b"\0":
            out += c
        return out.decode("utf-8")

    def skip(self, n: int) -> None:
        self.f.seek(n, io.SEEK_CUR)


def count_records(path: str) -> int:
    """The number of records, from the header alone."""
    return Bytes(path).values("Q")[0]


def _parameters(model: int, path: str) -> int:
    if model not in PARAMETERS:
        raise ValueError(f"{path}: unknown camera model {model}")
    return PARAMETERS[model]


def read_record(kind: str, b: Bytes) -> tuple:
    if kind == "cameras":
        camera, model, width, height = b.values("iiQQ")
        if max(width, height) >= 1 << 63:
            raise ValueError(f"{b.path}: a size is out of range")
        return camera, model, width, height, list(b.values(f"{_parameters(model, b.path)}d"))
    if kind == "images":
        image, *q = b.values("i4d")
        t, camera, name = b.values("3d"), b.values("i")[0], b.text()
        n = b.values("Q")[0]
        marks = np.frombuffer(b.take(24 * n), np.dtype([("x", "<f8"), ("y", "<f8"), ("point3d_id", "<i8")]))
        return image, q, list(t), camera, name, [dict(zip(marks.dtype.names, m)) for m in marks.tolist()]
    point, *rest = b.values("Q3d3Bd")
    n = b.values("Q")[0]
    track = np.frombuffer(b.take(8 * n), np.dtype([("image_id", "<i4"), ("point2d_idx", "<i4")]))
    if point >= 1 << 63:
        raise ValueError(f"{b.path}: a point's id is out of range")
    return point, rest[:3], rest[3:6], rest[6], [dict(zip(track.dtype.names, m)) for m in track.tolist()]


def skip_record(kind: str, b: Bytes) -> None:
    if kind == "cameras":
        b.skip(8 * _parameters(b.values("iiQQ")[1], b.path))
    elif kind == "images":
        b.skip(4 + 56 + 4)
        b.text()
        b.skip(24 * b.values("Q")[0])
    else:
        b.skip(8 + 24 + 3 + 8)
        b.skip(8 * b.values("Q")[0])


@dataclass
class Span(InputPartition):
    """Records of a file: from a byte, so many, the first of which has this number."""

    offset: int
    first: int
    count: int
    path: str = ""


class SparseReader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:
        self.path, self.kind = options["path"], options["kind"]
        self.records, self.schema = int(options.get("records", RECORDS)), schema

    def partitions(self) -> list[Span]:
        b = Bytes(self.path)
        n = b.values("Q")[0]
        spans = []
        for first in range(0, n, self.records):
            spans.append(Span(b.f.tell(), first, min(self.records, n - first)))
            if first + self.records < n:
                for _ in range(self.records):
                    skip_record(self.kind, b)
        return spans or [Span(8, 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        b = Bytes(self.path, span.offset)
        for a in range(0, span.count, BATCH):
            rows = [(span.first + k, *read_record(self.kind, b)) for k in range(a, min(a + BATCH, span.count))]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)


class SparseSource(DataSource):
    """Format "sparse_model". Options: path of one binary; kind: cameras, images or points; records of a partition."""

    @classmethod
    def name(cls) -> str:
        return "sparse_model"

    def schema(self) -> str:
        return SCHEMAS[self.options["kind"]]

    def reader(self, schema) -> DataSourceReader:
        return SparseReader(dict(self.options), schema)


def read_sparse(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """One of the three tables; of records that share an id the last one counts."""
    spark.dataSource.register(SparseSource)
    rows = spark.read.format("sparse_model").options(path=path, kind=kind, **options).load()
    key, others = KEYS[kind], [c for c in rows.columns if c not in ("ordinal", KEYS[kind])]
    last = F.max_by(F.struct(*others), "ordinal").alias("r")
    return rows.groupBy(key).agg(last).select(key, *(f"r.{c}" for c in others))


def _packed(kind: str, r) -> bytes:
    if kind == "cameras":
        if len(r["params"]) != _parameters(r["model_id"], kind):
            raise ValueError(f"camera {r['camera_id']} has {len(r['params'])} parameters")
        return struct.pack(f"<iiQQ{len(r['params'])}d", r["camera_id"], r["model_id"], r["width"], r["height"], *r["params"])
    if kind == "images":
        if len(r["qvec"]) != 4 or len(r["tvec"]) != 3:
            raise ValueError(f"image {r['image_id']} has a malformed pose")
        marks = np.array([(m["x"], m["y"], m["point3d_id"]) for m in r["points2d"]], np.dtype("<f8,<f8,<i8")).tobytes()
        return struct.pack("<i7di", r["image_id"], *r["qvec"], *r["tvec"], r["camera_id"]) + r["name"].encode() + b"\0" + struct.pack("<Q", len(r["points2d"])) + marks
    track = np.array([(m["image_id"], m["point2d_idx"]) for m in r["track"]], "<i4").tobytes()
    return struct.pack("<Q3d3BdQ", r["point3d_id"], *r["xyz"], *r["rgb"], r["error"], len(r["track"])) + track


def _pieces(df: DataFrame, *order: str) -> DataFrame:
    """df, sorted over all, with the number of its part, as the order in which parts are joined."""
    return df.orderBy(*order).withColumn("__part", F.spark_partition_id())


def _joined(path: str, header: bytes, pieces: DataFrame) -> None:
    """Writes a file from (part, bytes) in the order of parts, one at a time, beside its name and then under it."""
    system, at = opened(path)
    with system.open_output_stream(at + ".tmp") as out:
        out.write(header)
        for r in pieces.orderBy("part").toLocalIterator():
            out.write(r["data"])
    system.move(at + ".tmp", at)


def write_sparse(df: DataFrame, path: str, kind: str) -> None:
    """One binary with records by ascending id. Records are packed by tasks; the file is put together part by part."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = 0, []
        for b in batches:
            for r in b.to_pylist():
                part = r["__part"]
                out.append(_packed(kind, r))
        if out:
            yield pa.RecordBatch.from_pydict({"part": [part], "n": [len(out)], "data": [b"".join(out)]})

    pieces = _pieces(df, KEYS[kind]).mapInArrow(pack, "part long, n long, data binary").persist()
    try:
        n = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        _joined(path, struct.pack("<Q", n), pieces)
    finally:
        pieces.unpersist()


#: Scalar types of a PLY header: fixed values of the format, with the types that hold them in Spark.
PLY_TYPES = {
    "char": ("<i1", "byte"),
    "int8": ("<i1", "byte"),
    "uchar": ("<u1", "short"),
    "uint8": ("<u1", "short"),
    "short": ("<i2", "short"),
    "int16": ("<i2", "short"),
    "ushort": ("<u2", "int"),
    "uint16": ("<u2", "int"),
    "int": ("<i4", "int"),
    "int32": ("<i4", "int"),
    "uint": ("<u4", "long"),
    "uint32": ("<u4", "long"),
    "float": ("<f4", "float"),
    "float32": ("<f4", "float"),
    "double": ("<f8", "double"),
    "float64": ("<f8", "double"),
}
SPARK_TO_PLY = {"tinyint": "char", "smallint": "short", "int": "int", "float": "float", "double": "double"}


@dataclass
class PlyHeader:
    properties: list[tuple[str, str]]
    vertices: int
    size: int

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(n, PLY_TYPES[t][0]) for n, t in self.properties])


def ply_header(path: str) -> PlyHeader:
    """The header of a binary little-endian file with one vertex element of scalars, whose payload has the right size."""
    system, at = opened(path)
    with system.open_input_file(at) as f:
        whole = f.size()
        head = f.read(1 << 16)
    end = head.find(b"end_header\n")
    if not head.startswith(b"ply\n") or end < 0:
        raise ValueError(f"{path}: no PLY header")
    properties, vertices, form = [], None, ""
    for line in head[:end].decode("ascii").splitlines()[1:]:
        words = line.split()
        if not words or words[0] in ("comment", "obj_info"):
            continue
        if words[0] == "format":
            form = " ".join(words[1:])
        elif words[0] == "element":
            if words[1] != "vertex" or vertices is not None:
                raise ValueError(f"{path}: only one vertex element is supported")
            vertices = int(words[2])
        elif words[0] == "property" and len(words) == 3 and words[1] in PLY_TYPES and vertices is not None:
            properties.append((words[2], words[1]))
        else:
            raise ValueError(f"{path}: unsupported header line {line!r}")
    if form != "binary_little_endian 1.0" or vertices is None or not properties:
        raise ValueError(f"{path}: not a binary little-endian vertex file")
    header = PlyHeader(properties, vertices, end + len(b"end_header\n"))
    if whole - header.size != vertices * header.dtype.itemsize:
        raise ValueError(f"{path}: the payload has {whole - header.size} bytes, not {vertices * header.dtype.itemsize}")
    return header


def _ply_paths(options: dict) -> list[str]:
    return json.loads(options["parts"]) if "parts" in options else [options["path"]]


def ply_headers(paths: list[str]) -> list[PlyHeader]:
    """The headers of files whose vertices have equal properties, in name, type and order; comments and numbers may differ."""
    if not paths:
        raise ValueError("no PLY files are given")
    headers = [ply_header(p) for p in paths]
    same_layout([h.properties for h in headers])
    return headers


class PlyReader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:
        self.paths, self.rows, self.schema = _ply_paths(options), int(options.get("rows", 1 << 20)), schema

    def partitions(self) -> list[Span]:
        spans, before = [], 0
        for path, h in zip(self.paths, ply_headers(self.paths)):
            spans += [Span(h.size + a * h.dtype.itemsize, before + a, min(self.rows, h.vertices - a), path) for a in range(0, h.vertices, self.rows)]
            before += h.vertices
        return spans or [Span(0, 0, 0, self.paths[0])]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, dtype = to_arrow_schema(self.schema), ply_header(span.path).dtype
        system, at = opened(span.path)
        with system.open_input_file(at) as f:
            f.seek(span.offset)
            for a in range(0, span.count, 1 << 16):
                n = min(1 << 16, span.count - a)
                rows = np.frombuffer(f.read(n * dtype.itemsize), dtype)
                cols = [pa.array(np.arange(span.first + a, span.first + a + n))] + [pa.array(np.ascontiguousarray(rows[c])).cast(schema.field(c).type) for c in dtype.names]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)


class PlySource(DataSource):
    """Format "vertex_ply": the vertices with row_no; the schema follows the header. Options: path, or parts (a JSON list of paths
    whose vertices are numbered on from file to file); rows of a partition."""

    @classmethod
    def name(cls) -> str:
        return "vertex_ply"

    def schema(self) -> str:
        h = ply_headers(_ply_paths(self.options))[0]
        return ", ".join(["row_no long", *(f"`{n}` {PLY_TYPES[t][1]}" for n, t in h.properties)])

    def reader(self, schema) -> DataSourceReader:
        return PlyReader(dict(self.options), schema)


def read_ply(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(PlySource)
    return spark.read.format("vertex_ply").options(path=path, **options).load()


def merge_ply(spark: SparkSession, paths: list[str], path: str, **options) -> None:
    """One file of the vertices of all files, in their order, with the types that their headers name. Files of other properties
    are errors, before anything is written. One scan reads all of them."""
    types = dict(ply_headers(paths)[0].properties)
    spark.dataSource.register(PlySource)
    write_ply(spark.read.format("vertex_ply").options(parts=json.dumps(paths), **options).load(), path, "row_no", types=types)


def write_ply(df: DataFrame, path: str, *order: str, comments: list[str] | None = None, types: dict[str, str] | None = None) -> None:
    """Vertices of df in the given order; row_no and block_id are no properties and stay out. types names the file's types of
    properties, where they are not those of the columns."""
    names = [c for c in df.columns if c not in ("row_no", "block_id")]
    types = types or {n: SPARK_TO_PLY[t] for n, t in df.select(*names).dtypes}
    dtype = np.dtype([(n, PLY_TYPES[types[n]][0]) for n in names])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = 0
        for b in batches:
            if b.num_rows:
                rows = np.empty(b.num_rows, dtype)
                for n in names:
                    rows[n] = b.column(n).to_numpy(zero_copy_only=False)
                part = (b.column("__part")[0].as_py() << 32) + piece
                piece += 1
                yield pa.RecordBatch.from_pydict({"part": [part], "n": [b.num_rows], "data": [rows.tobytes()]})

    pieces = _pieces(df, *order).mapInArrow(pack, "part long, n long, data binary").persist()
    try:
        n = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        lines = ["ply", "format binary_little_endian 1.0", *(f"comment {c}" for c in comments or []), f"element vertex {n}", *(f"property {types[c]} {c}" for c in names), "end_header"]
        _joined(path, ("\n".join(lines) + "\n").encode("ascii"), pieces)
    finally:
        pieces.unpersist()

"""Reading a snapshot of an Iceberg table by its metadata document (format versions 1 and 2, position deletes)."""

from __future__ import annotations

import io
import json
import struct
import zlib

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.sources.parquet_blocks import _open

# Primitive types of the table format and what they are in Spark.
TYPES = {"boolean": "boolean", "int": "int", "long": "bigint", "float": "float", "double": "double", "date": "date", "time": "bigint", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "string": "string", "uuid": "string", "binary": "binary"}


def spark_type(t: object) -> str:
    """The Spark type of a schema's type."""
    if isinstance(t, dict):
        if t["type"] == "struct":
            return "struct<" + ",".join(f"`{f['name']}`:{spark_type(f['type'])}" for f in t["fields"]) + ">"
        if t["type"] == "list":
            return f"array<{spark_type(t['element'])}>"
        return f"map<{spark_type(t['key'])},{spark_type(t['value'])}>"
    return "binary" if t.startswith("fixed") else t.replace(" ", "") if t.startswith("decimal") else TYPES[t]


class _Avro:
    """A reader of Avro container files, enough for manifests."""

    def __init__(self, data: bytes) -> None:
        self.f = io.BytesIO(data)
        if self.f.read(4) != b"Obj\x01":
            raise ValueError("not an Avro file")
        meta = self.value({"type": "map", "values": "bytes"})
        self.schema, self.codec, self.sync = json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), self.f.read(16)
        self.names: dict[str, object] = {}

    def long(self) -> int:
        out = shift = 0
        while True:
            b = self.f.read(1)[0]
            out |= (b & 127) << shift
            if b < 128:
                return (out >> 1) ^ -(out & 1)
            shift += 7

    def value(self, t: object):
        if isinstance(t, list):
            return self.value(t[self.long()])
        if isinstance(t, str) and t in getattr(self, "names", {}):
            return self.value(self.names[t])
        kind = t["type"] if isinstance(t, dict) else t
        if isinstance(kind, (dict, list)):
            return self.value(kind)
        if isinstance(t, dict) and "name" in t and kind in ("record", "fixed", "enum"):
            self.names[t["name"]] = t
        if kind == "null":
            return None
        if kind == "boolean":
            return self.f.read(1) == b"\x01"
        if kind in ("int", "long"):
            return self.long()
        if kind in ("float", "double"):
            return struct.unpack("<f" if kind == "float" else "<d", self.f.read(4 if kind == "float" else 8))[0]
        if kind in ("bytes", "string"):
            raw = self.f.read(self.long())
            return raw if kind == "bytes" else raw.decode()
        if kind == "fixed":
            return self.f.read(t["size"])
        if kind == "enum":
            return t["symbols"][self.long()]
        if kind == "record":
            return {x["name"]: self.value(x["type"]) for x in t["fields"]}
        out: list = []
        while n := self.long():
            if n < 0:
                self.long()
            for _ in range(abs(n)):
                out.append((self.value("string"), self.value(t["values"])) if kind == "map" else self.value(t["items"]))
        return dict(out) if kind == "map" else out

    def rows(self):
        whole = self.f
        while head := whole.read(1):
            whole.seek(-len(head), 1)
            self.f = whole
            n, size = self.long(), self.long()
            raw = whole.read(size)
            self.f = io.BytesIO(zlib.decompress(raw, -15) if self.codec == "deflate" else raw)
            if self.codec not in ("null", "deflate"):
                raise ValueError(f"Avro codec {self.codec}")
            for _ in range(n):
                yield self.value(self.schema)
            whole.read(16)
            self.f = whole


def _bytes(path: str) -> bytes:
    fs, p = _open(path)
    with fs.open_input_stream(p) as f:
        return f.read()


def manifest_files(metadata: str, snapshot_id: int | None = None) -> tuple[dict, list[dict]]:
    """(metadata document, live data and delete files) of a snapshot, by default the current one."""
    doc = json.loads(_bytes(metadata))
    wanted = snapshot_id or doc.get("current-snapshot-id")
    snap = next((s for s in doc.get("snapshots", []) if s["snapshot-id"] == wanted), None)
    if snap is None:
        return doc, []
    lists = [m["manifest_path"] for m in _Avro(_bytes(snap["manifest-list"])).rows()] if "manifest-list" in snap else snap["manifests"]
    out = []
    for m in lists:
        for e in _Avro(_bytes(m)).rows():
            if e["status"] != 2:
                out.append(e["data_file"] | {"content": e["data_file"].get("content", 0)})
    return doc, out


def read_snapshot(spark: SparkSession, metadata: str, snapshot_id: int | None = None) -> DataFrame:
    """Rows of a snapshot: columns by field id where files carry ids, with position deletes taken out."""
    doc, files = manifest_files(metadata, snapshot_id)
    schema = next((s for s in doc.get("schemas", []) if s["schema-id"] == doc.get("current-schema-id")), doc.get("schema"))
    fields = [T.StructField(f["name"], T._parse_datatype_string(f"x {spark_type(f['type'])}")[0].dataType, True, {"parquet.field.id": f["id"]}) for f in schema["fields"]]
    kind = T.StructType(fields)
    data, deletes = [f["file_path"] for f in files if f["content"] == 0], [f["file_path"] for f in files if f["content"] == 1]
    if any(f["content"] == 2 for f in files):
        raise NotImplementedError("equality deletes")
    if not data:
        return spark.createDataFrame([], kind)
    spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")
    spark.conf.set("spark.sql.parquet.fieldId.read.ignoreMissing", "true")
    df = spark.read.schema(kind).parquet(*data)
    if deletes:
        gone = spark.read.parquet(*deletes).select(F.regexp_replace("file_path", r"^[a-z0-9]+:/*", "").alias("_f"), F.col("pos").alias("_p"))
        df = df.select("*", F.regexp_replace(F.col("_metadata.file_path"), r"^[a-z0-9]+:/*", "").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        df = df.join(gone, (F.col("_file") == F.col("_f")) & (F.col("_row") == F.col("_p")), "left_anti").drop("_file", "_row")
    return df


def exists(path: str) -> bool:
    fs, p = _open(path)
    return fs.get_file_info(p).type != pafs.FileType.NotFound

"""Snapshot tables on Parquet: a small transactional table layer.

A table is a folder. ``meta/v000001.json``, ... are its versions. A version is written
aside and published under its name in one atomic step that fails if the name is taken, so
of two writers only one makes the next version and none is ever seen half written. It
names the schema (columns with ids), the partition specs, how far each stream got, and all
snapshots. A snapshot names a list of manifests, Parquet tables with one row per file:
content (0 data, 1 position deletes), partition values, row count, size and column bounds.
A commit adds a manifest of its own files; only manifests that name removed files are
written anew, and short ones are merged once there are many. Data columns carry physical
names made of their ids (``c7``), so renaming, dropping and adding touch no file.

Position deletes name a data file by its path below ``data/``, which is unique whatever
the partition folders are called.

While a writer is at work, ``open/`` holds a mark with the name that all its files begin
with; orphan removal leaves such files alone.

Manifests stay DataFrames: pruning, statistics and orphan search are queries over them,
and only the paths that a scan reads come to the driver.
"""

from __future__ import annotations

import contextlib
import datetime
import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.shared import delete_path, materialize
from lakeloom.sources.parquet_blocks import _open
from lakeloom.table import pruning, transforms
from lakeloom.table.bounds import footer_rows

MANIFEST = "path string, content int, spec_id int, schema_id int, partition map<string,string>, row_count bigint, file_size bigint, lower map<int,string>, upper map<int,string>, nulls map<int,bigint>, first_row_id bigint"
DELETES = "_file string, _pos bigint"
#: Rewrite a file instead of writing position deletes if more than this percentage of its rows go.
COPY_ON_WRITE_PERCENT = 20
TARGET_BYTES = 536_870_912
#: More manifests than this in a snapshot are merged into one by the commit; the table property ``merge_manifests`` overrides it.
MERGE_MANIFESTS = 40
#: Footers of up to so many files are read by one task; those of more, by one task for each so many.
FOOTERS_A_TASK = 64
#: Positions up to this number are broadcast when deleted rows are taken out; beyond it the join is a shuffle.
BROADCAST_POSITIONS = 1_000_000
#: A writer's mark older than this is that of a writer that died.
OPEN_MS = 24 * 3600 * 1000

#: Type changes that keep every value.
WIDENING = {("int", "bigint"), ("smallint", "int"), ("smallint", "bigint"), ("float", "double"), ("date", "timestamp_ntz")}


class ConcurrentWrite(RuntimeError):
    """Another writer made the next version first."""


class Table:
    """A snapshot table in the folder ``location`` (a URL or path that all executors reach)."""

    def __init__(self, spark: SparkSession, location: str) -> None:
        self.spark, self.location = spark, location.rstrip("/")

    # Files --------------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _read(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, path: str, body: str) -> None:
        fs, p = self._fs(path)
        out = fs.create(p, True)
        out.write(bytearray(body.encode()))
        out.close()

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.location}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def version(self) -> int:
        return max((int(n[1:-5]) for n in self._names("meta") if n.startswith("v") and n.endswith(".json")), default=0)

    def exists(self) -> bool:
        return self.version() > 0

    def state(self, version: int | None = None) -> dict:
        """The metadata document of a version, by default the last."""
        v = version or self.version()
        if not v:
            raise FileNotFoundError(f"no table in {self.location}")
        return json.loads(self._read(f"{self.location}/meta/v{v:06d}.json")) | {"version": v}

    def _publish_file(self, path: str, body: str) -> bool:
        """Make a file with this content in one step, unless there is one of its name; says whether it did.

        Local folders: a hard link, which is exclusive, to a file written aside. Object
        stores: a file shows only once it is closed, and is created on the condition that
        there is none. Other file systems: written aside and renamed, which fails if the
        name is taken.
        """
        scheme = path.partition(":")[0] if ":" in path else self._fs(path)[0].getScheme()
        aside = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}.tmp"
        fs, p = self._fs(path)
        if scheme == "file":
            local, there = _open(aside)[1], _open(path)[1]
            os.makedirs(os.path.dirname(local), exist_ok=True)
            with open(local, "w", encoding="utf-8") as f:
                f.write(body)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(local, there)
            except FileExistsError:
                return False
            finally:
                os.unlink(local)
            return True
        if scheme in ("s3", "s3a", "s3n", "gs", "az", "abfs", "abfss", "wasb"):
            try:
                out = fs.createFile(p).overwrite(False).opt("fs.option.create.conditional.overwrite", True).recursive().build()
                out.write(bytearray(body.encode()))
                out.close()
            except Py4JJavaError:
                if fs.exists(p):
                    return False
                raise
            return True
        self._write(aside, body)
        done = not fs.exists(p) and fs.rename(self._fs(aside)[1], p)
        if not done:
            delete_path(self.spark, aside)
        return done

    def _commit(self, state: dict) -> dict:
        """Publish the next version; raises :class:`ConcurrentWrite` if it is there already."""
        v = state["version"] + 1
        if not self._publish_file(f"{self.location}/meta/v{v:06d}.json", json.dumps({k: x for k, x in state.items() if k != "version"})):
            raise ConcurrentWrite(f"version {v} of {self.location} exists")
        return state | {"version": v}

    @contextlib.contextmanager
    def _writing(self) -> Iterator[str]:
        """The name that all files of one writer begin with, marked as in use until it is done."""
        op = uuid.uuid4().hex[:16]
        mark = f"{self.location}/open/{op}"
        self._write(mark, str(int(time.time() * 1000)))
        yield op
        delete_path(self.spark, mark)  # after a failure the mark stays, and loses its force with age

    # Schema -------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, location: str, schema: T.StructType | str, partition_by: str | None = None, properties: dict | None = None) -> Table:
        t = cls(spark, location)
        schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        columns = [{"id": i, "name": f.name, "type": f.dataType.simpleString(), "required": not f.nullable, "default": None, "fill": None, "since": 0} for i, f in enumerate(schema, 1)]
        specs = [transforms.parse(partition_by, [f.name for f in schema])] if partition_by else [[]]
        for s in specs[0]:
            name = s.pop("column")
            s["id"] = next(c["id"] for c in columns if c["name"] == name)
        state = {"uuid": uuid.uuid4().hex, "columns": columns, "last_id": len(columns), "schema_id": 0, "specs": specs, "spec": 0, "snapshots": [], "current": None, "next_row_id": 0, "streams": {}, "properties": properties or {}, "version": 0}
        t._commit(state)
        return t

    @classmethod
    def create_as(cls, df: DataFrame, location: str, partition_by: str | None = None) -> Table:
        """CREATE TABLE AS."""
        t = cls.create(df.sparkSession, location, df.schema, partition_by)
        t.append(df)
        return t

    @classmethod
    def from_files(cls, spark: SparkSession, location: str, path: str, *, load: bool = True, partition_by: str | None = None, **options: object) -> Table:
        """CREATE TABLE with the definition of files (``load=False``), or with their rows as well."""
        from lakeloom.sources.io import read

        df = read(spark, path, **options)
        t = cls.create(spark, location, df.schema, partition_by)
        if load:
            t.append(df)
        return t

    def schema(self, state: dict | None = None) -> T.StructType:
        return T._parse_datatype_string(", ".join(f"`{c['name']}` {c['type']}" for c in (state or self.state())["columns"]))

    def _alter(self, change) -> None:
        for _ in range(5):
            state = self.state()
            change(state)
            state["schema_id"] += 1
            try:
                self._commit(state)
                return
            except ConcurrentWrite:
                time.sleep(0.05)
        raise ConcurrentWrite(self.location)

    @staticmethod
    def _column(state: dict, name: str) -> dict:
        found = next((c for c in state["columns"] if c["name"] == name), None)
        if found is None:
            raise ValueError(f'column "{name}" does not exist')
        return found

    def add_column(self, name: str, kind: str, default: object = None) -> None:
        """Add a column; rows written before have ``default``."""

        def change(s: dict) -> None:
            if any(c["name"] == name for c in s["columns"]):
                raise ValueError(f'column "{name}" already exists')
            s["last_id"] += 1
            s["columns"].append({"id": s["last_id"], "name": name, "type": T._parse_datatype_string(f"x {kind}")[0].dataType.simpleString(), "required": False, "default": default, "fill": default, "since": s["schema_id"] + 1})

        self._alter(change)

    def set_default(self, name: str, default: object) -> None:
        """ALTER COLUMN SET DEFAULT (null drops it): what later inserts without the column get; rows that are there stay as they are."""
        self._alter(lambda s: self._column(s, name).__setitem__("fill", default))

    def drop_column(self, name: str) -> None:
        def change(s: dict) -> None:
            gone = self._column(s, name)
            if any(p["id"] == gone["id"] for p in s["specs"][s["spec"]]):
                raise ValueError(f'column "{name}" is used for partitioning')
            s["columns"] = [c for c in s["columns"] if c is not gone]

        self._alter(change)

    def rename_column(self, name: str, new: str) -> None:
        def change(s: dict) -> None:
            if any(c["name"] == new for c in s["columns"]):
                raise ValueError(f'column "{new}" already exists')
            self._column(s, name)["name"] = new

        self._alter(change)

    def widen_column(self, name: str, kind: str) -> None:
        def change(s: dict) -> None:
            c = self._column(s, name)
            to = T._parse_datatype_string(f"x {kind}")[0].dataType.simpleString()
            if c["type"] != to and (c["type"], to) not in WIDENING:
                raise ValueError(f"cannot change {c['type']} to {to}")
            c["type"] = to

        self._alter(change)

    def drop_not_null(self, name: str) -> None:
        self._alter(lambda s: self._column(s, name).__setitem__("required", False))

    def set_partitioning(self, partition_by: str | None) -> None:
        """Partition evolution: files written from now on follow the new spec, older ones keep theirs."""

        def change(s: dict) -> None:
            spec = transforms.parse(partition_by, [c["name"] for c in s["columns"]]) if partition_by else []
            for p in spec:
                p["id"] = self._column(s, p.pop("column"))["id"]
            s["specs"].append(spec)
            s["spec"] = len(s["specs"]) - 1

        self._alter(change)

    # Reading ------------------------------------------------------------------------

    def _snapshot(self, state: dict, snapshot_id: int | None = None, as_of: datetime.datetime | None = None) -> dict | None:
        if snapshot_id is not None:
            found = next((s for s in state["snapshots"] if s["id"] == snapshot_id), None)
            if found is None:
                raise ValueError(f"no snapshot {snapshot_id}")
            return found
        if as_of is not None:
            ms = as_of.replace(tzinfo=as_of.tzinfo or datetime.UTC).timestamp() * 1000
            return next((s for s in reversed(state["snapshots"]) if s["at"] <= ms), None)
        return next((s for s in state["snapshots"] if s["id"] == state["current"]), None)

    def manifest(self, state: dict | None = None, snapshot: dict | None = None) -> DataFrame:
        """One row per file of a snapshot."""
        return self._entries(state, snapshot).drop("_m")

    def _entries(self, state: dict | None = None, snapshot: dict | None = None, only: list[dict] | None = None) -> DataFrame:
        """The manifests' rows, with the manifest's name in ``_m``; row ids are counted from that of the manifest."""
        state = state or self.state()
        snapshot = snapshot or self._snapshot(state)
        held = only if only is not None else snapshot["manifests"] if snapshot else []
        if not held:
            return self.spark.createDataFrame([], MANIFEST + ", _m string")
        m = self.spark.read.schema(MANIFEST).parquet(*[f"{self.location}/manifests/{x['name']}" for x in held])
        m = m.withColumn("_m", F.element_at(F.split("_metadata.file_path", "/"), -2))
        base = F.create_map(*[F.lit(y) for x in held for y in (x["name"], x["first_row_id"])])
        return m.withColumn("first_row_id", F.col("first_row_id") + base[F.col("_m")])

    def plan_files(self, where: Column | str | list[tuple[str, str, object]] | None = None, state: dict | None = None, snapshot: dict | None = None) -> DataFrame:
        """The manifest rows that may hold rows meeting ``where``: a condition, SQL text, or triples (column, operator, value) with = <> < <= > >= in isnull notnull.

        Bounds of columns and values of hidden partition transforms are both used.
        """
        return self._planned(state or self.state(), snapshot, where).drop("_m")

    def _planned(self, state: dict, snapshot: dict | None, where: Column | str | list | None) -> DataFrame:
        return pruning.pruned(self._entries(state, snapshot), self.schema(state), state, pruning.as_condition(where))

    def _listed(self, files: DataFrame) -> list[Row]:
        return files.select("path", "content", "schema_id", "row_count", "file_size", "_m").collect()  # one row per file that is read

    def _physical(self, state: dict) -> T.StructType:
        return T._parse_datatype_string(", ".join(f"c{c['id']} {c['type']}" for c in state["columns"])) if state["columns"] else T.StructType([])

    @staticmethod
    def _key(path: str) -> str:
        """How position deletes name a data file: its path below ``data/``."""
        return path.partition("/")[2]

    def _data(self, state: dict, files: list[Row], *, positions: bool = False) -> DataFrame | None:
        """Rows of data files under the current schema, as they are stored. Files older than a column with a default are read apart."""
        if not files:
            return None
        groups: dict[tuple[int, ...], list[str]] = {}
        for f in files:
            missing = tuple(c["id"] for c in state["columns"] if c["default"] is not None and c["since"] > f["schema_id"])
            groups.setdefault(missing, []).append(f["path"])
        url = F.col("_metadata.file_path")  # names are percent-encoded once in it
        whole = F.when(F.contains(url, F.lit("%")), F.url_decode(F.replace(url, F.lit("+"), F.lit("%2B")))).otherwise(url)
        parts = []
        for missing, paths in groups.items():
            df = self.spark.read.schema(self._physical(state)).parquet(*[f"{self.location}/{p}" for p in paths])
            keep = [F.lit(c["default"]).cast(c["type"]).alias(c["name"]) if c["id"] in missing else F.col(f"c{c['id']}").alias(c["name"]) for c in state["columns"]]
            place = [F.substring_index(whole, "/data/", -1).alias("_file"), F.col("_metadata.row_index").alias("_pos")] if positions else []
            parts.append(df.select(*keep, *place))
        return reduce(DataFrame.unionAll, parts)

    def _deleted(self, files: list[Row]) -> DataFrame:
        return self.spark.read.schema(DELETES).parquet(*[f"{self.location}/{f['path']}" for f in files])

    def _rows(self, state: dict, listed: list[Row], *, positions: bool = False) -> DataFrame:
        """The live rows of listed data files; listed position deletes are taken out."""
        data, deletes = [f for f in listed if f["content"] == 0], [f for f in listed if f["content"] == 1]
        df = self._data(state, data, positions=positions or bool(deletes))
        if df is None:
            empty = self.spark.createDataFrame([], self.schema(state))
            return empty.withColumns({"_file": F.lit(""), "_pos": F.lit(0).cast("bigint")}) if positions else empty
        if deletes:
            d = self._deleted(deletes)
            small = sum(f["row_count"] or 0 for f in deletes) <= BROADCAST_POSITIONS
            df = df.join(F.broadcast(d) if small else d, ["_file", "_pos"], "left_anti")
        names = [F.col(f"`{c['name']}`") for c in state["columns"]]
        return df.select(*names, "_file", "_pos") if positions else df.select(*names)

    def read(self, where: Column | str | list[tuple[str, str, object]] | None = None, *, snapshot_id: int | None = None, as_of: datetime.datetime | None = None) -> DataFrame:
        """The table's rows, now or as of a snapshot or time; ``where`` (see :meth:`plan_files`) prunes files and filters rows."""
        state = self.state()
        snap = self._snapshot(state, snapshot_id, as_of)
        if snap is None and (snapshot_id is not None or as_of is not None):
            return self.spark.createDataFrame([], self.schema(state))
        df = self._rows(state, self._listed(self._planned(state, snap, where)))
        condition = pruning.as_condition(where)
        return df if condition is None else df.filter(condition)

    def snapshots(self) -> DataFrame:
        rows = [(s["id"], s["parent"], datetime.datetime.fromtimestamp(s["at"] / 1000, datetime.UTC).replace(tzinfo=None), s["operation"], s["added_files"], s["removed_files"], s["rows"]) for s in self.state()["snapshots"]]
        return self.spark.createDataFrame(rows, "snapshot_id bigint, parent_id bigint, committed_at timestamp_ntz, operation string, added_files bigint, removed_files bigint, total_rows bigint")

    def files(self) -> DataFrame:
        return self.manifest()

    def size(self) -> int:
        """Bytes of all live files."""
        return self.manifest().agg(F.coalesce(F.sum("file_size"), F.lit(0))).first()[0]

    def column_stats(self) -> DataFrame:
        """path, column, lower, upper, nulls of every data file."""
        names = self.spark.createDataFrame([(c["id"], c["name"]) for c in self.state()["columns"]], "id int, column string")
        m = self.manifest().filter("content = 0").select("path", "upper", "nulls", F.explode_outer("lower").alias("id", "lower"))
        return m.join(F.broadcast(names), "id").select("path", "column", "lower", F.try_element_at("upper", F.col("id")).alias("upper"), F.try_element_at("nulls", F.col("id")).alias("nulls"))

    def row_ids(self) -> DataFrame:
        """The rows with a stable ``_row_id``: the file's first id plus the row's place in it."""
        state = self.state()
        entries = self._entries(state)
        first = entries.filter("content = 0").select(F.expr("substring(path, 6)").alias("_file"), "first_row_id")
        df = self._rows(state, self._listed(entries), positions=True)
        return df.join(first, "_file").withColumn("_row_id", F.col("first_row_id") + F.col("_pos")).drop("_file", "_pos", "first_row_id")

    def changes(self, after: int, to: int | None = None) -> DataFrame:
        """Rows inserted and deleted between two snapshots, with ``_change``; only files that differ are read."""
        state = self.state()
        a, b = (self._snapshot(state, s) if s is not None else self._snapshot(state) for s in (after, to))
        old, new = ({f["path"]: f for f in self._listed(self._entries(state, s))} for s in (a, b))
        if {p for p, f in old.items() if f["content"]} == {p for p, f in new.items() if f["content"]}:
            # position deletes are the same on both sides: only changed data files can differ
            both = {p for p in old.keys() & new.keys() if not old[p]["content"]}
            old, new = ({p: f for p, f in x.items() if p not in both} for x in (old, new))
        before, now = self._rows(state, [*old.values()]), self._rows(state, [*new.values()])
        return now.exceptAll(before).withColumn("_change", F.lit("insert")).unionAll(before.exceptAll(now).withColumn("_change", F.lit("delete")))

    # Writing ------------------------------------------------------------------------

    def _write_data(self, state: dict, df: DataFrame, op: str, records_per_file: int | None = None) -> dict | None:
        """Write rows as data files under the current spec; returns their manifest, if there are any."""
        spec = state["specs"][state["spec"]]
        for c in state["columns"]:
            if c["required"]:
                df = df.withColumn(c["name"], F.coalesce(F.col(f"`{c['name']}`"), F.raise_error(F.lit(f"null value in column \"{c['name']}\"")).cast(c["type"])))
        out = df.select(*[F.col(f"`{c['name']}`").cast(c["type"]).alias(f"c{c['id']}") for c in state["columns"]])
        folder = f"data/{op}-{uuid.uuid4().hex[:6]}"
        parts = [f"p{i}" for i in range(len(spec))]
        if spec:
            types = {c["id"]: c["type"] for c in state["columns"]}
            out = out.withColumns({p: F.concat(F.lit("="), transforms.value(s, F.col(f"c{s['id']}"), types[s["id"]]).cast("string")) for p, s in zip(parts, spec)})  # the sign tells an empty text from null
            # One file per partition value where it is small; AQE splits a hot one over tasks and joins small ones in one.
            out = out.hint("rebalance", *[F.col(p) for p in parts])
        w = out.write.option("maxRecordsPerFile", records_per_file or 0)
        if spec:
            w = w.partitionBy(*parts)
        w.parquet(f"{self.location}/{folder}")
        return self._write_manifest(state, folder, op, parts, [s["name"] for s in spec], {c["id"]: f"c{c['id']}" for c in state["columns"]}, 0)

    def _write_manifest(self, state: dict, folder: str, op: str, parts: list[str], names: list[str], columns: dict[int, str], content: int) -> dict | None:
        """A manifest of the files below a folder, from their footers, which tasks read; None if there are no rows.

        Data files are numbered in the order of their paths by the rows before them: a
        prefix sum over one row per file of this commit.
        """
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(f"{self.location}/{folder}").select("path", "length")
        many = len(found.inputFiles())
        found = found.coalesce(-(-many // FOOTERS_A_TASK) or 1)
        spec_id, schema_id = state["spec"], state["schema_id"]

        def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield footer_rows(b, folder, columns, parts, names, content, spec_id, schema_id)

        def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at = 0
            for b in batches:
                before = at + b["row_count"].cumsum() - b["row_count"]
                at += int(b["row_count"].sum())
                yield b.assign(first_row_id=before.astype("Int64"))

        rows = found.mapInPandas(footers, MANIFEST)
        rows = rows if many <= FOOTERS_A_TASK else rows.coalesce(1)
        if content == 0:
            rows = rows.sortWithinPartitions("path").mapInPandas(numbered, MANIFEST)
        return self._save_manifest(rows, op, state["next_row_id"])

    def _save_manifest(self, rows: DataFrame, op: str, first_row_id: int) -> dict | None:
        name, seen = f"{op}-{uuid.uuid4().hex[:6]}", Observation()
        rows = rows.observe(seen, F.count("*").alias("files"), F.coalesce(F.sum("content"), F.lit(0)).alias("deletes"), F.coalesce(F.sum(F.when(F.col("content") == 0, F.col("row_count"))), F.lit(0)).alias("rows"))
        rows.write.parquet(f"{self.location}/manifests/{name}")
        return {"name": name, "first_row_id": first_row_id} | seen.get if seen.get["files"] else None

    def _publish(self, state: dict, operation: str, op: str, added: list[dict], rows: int, removed: list[Row] | None = None, *, stream: tuple[str, int] | None = None) -> int:
        """Commit a snapshot: manifests ``added``, files ``removed`` (all if None), ``rows`` more or fewer."""
        before = self._snapshot(state)
        held = before["manifests"] if before else []
        gone = sum(m["files"] for m in held) if removed is None else len(removed)
        if removed is None:
            held = []
        elif removed:
            per: dict[str, int] = {}
            for f in removed:
                per[f["_m"]] = per.get(f["_m"], 0) + 1
            touched = [m for m in held if m["name"] in per]
            held = [m for m in held if m["name"] not in per]
            left = [m for m in touched if per[m["name"]] < m["files"]]  # of the others nothing is left
            if left:
                out = self.spark.createDataFrame([(f["path"],) for f in removed], "path string")
                rest = self._entries(state, only=left).join(F.broadcast(out) if len(removed) <= 100_000 else out, "path", "left_anti")
                held = [*held, *filter(None, [self._save_manifest(self._plain(rest), op, 0)])]
        added = [m for m in added if m is not None]
        next_id = state["next_row_id"]
        for m in added:
            m["first_row_id"] = next_id
            next_id += m["rows"]
        kept = [*held, *added]
        if len(kept) > state["properties"].get("merge_manifests", MERGE_MANIFESTS):
            kept = [m for m in [self._save_manifest(self._plain(self._entries(state, only=kept)), op, 0)] if m]
        snap = {
            "id": max((s["id"] for s in state["snapshots"]), default=0) + 1, "parent": state["current"], "at": int(time.time() * 1000), "operation": operation, "manifests": kept,
            "rows": rows + (before["rows"] if before and removed is not None else 0), "added_files": sum(m["files"] for m in added), "removed_files": gone,
        }
        streams = state["streams"] | ({stream[0]: stream[1]} if stream else {})
        self._commit(state | {"snapshots": [*state["snapshots"], snap], "current": snap["id"], "next_row_id": next_id, "streams": streams})
        return snap["id"]

    @staticmethod
    def _plain(entries: DataFrame) -> DataFrame:
        return entries.select(*[c.split()[0] for c in MANIFEST.split(", ")]).coalesce(1)

    def append(self, df: DataFrame, *, records_per_file: int | None = None, stream: tuple[str, int] | None = None) -> int:
        """INSERT: add rows; columns are matched by name, missing ones get their default. Returns the snapshot id. A lost race is retried.

        ``stream`` is (name of a stream, number of its batch): a batch that is not above
        the last one committed is skipped. The number stands in the same document as the
        snapshot, so there is no moment at which one is there without the other.
        """
        state = self.state()
        unknown = [c for c in df.columns if c not in {x["name"] for x in state["columns"]}]
        if unknown:
            raise ValueError(f"no such columns: {unknown}")
        if stream and stream[1] <= state["streams"].get(stream[0], -1):
            return state["current"]
        df = df.withColumns({c["name"]: F.lit(c["fill"]).cast(c["type"]) for c in state["columns"] if c["name"] not in df.columns})
        with self._writing() as op:
            added = self._write_data(state, df, op, records_per_file)
            for _ in range(20):
                try:
                    return self._publish(state, "append", op, [added], added["rows"] if added else 0, [], stream=stream)
                except ConcurrentWrite:
                    time.sleep(0.05)
                    state = self.state()
                    if stream and stream[1] <= state["streams"].get(stream[0], -1):
                        return state["current"]
        raise ConcurrentWrite(self.location)

    def overwrite(self, df: DataFrame) -> int:
        state = self.state()
        with self._writing() as op:
            added = self._write_data(state, df, op)
            return self._publish(state, "overwrite", op, [added], added["rows"] if added else 0)

    def truncate(self) -> int:
        return self._publish(self.state(), "truncate", "", [], 0)

    def delete(self, condition: Column | str, *, where: Column | str | list | None = None, mode: str = "auto", returning: bool = False) -> DataFrame | int:
        """DELETE. Files are pruned by the condition itself; ``where`` may add what follows from it but cannot be seen in it.

        Files of which every row goes are dropped by metadata alone. Of the others, mode
        ``cow`` rewrites, ``mor`` writes position deletes, and ``auto`` rewrites where more
        than 20 percent of the rows of the touched files go. Returns the snapshot id (the
        current one if no row is hit), or with ``returning`` the deleted rows.
        """
        c = pruning.as_condition(condition)
        return self._change("delete", lambda rows: rows.filter(c), self._narrow(c, where), None, mode, returning)

    def update(self, assignments: dict[str, Column], condition: Column | str, *, where: Column | str | list | None = None, mode: str = "auto", returning: bool = False) -> DataFrame | int:
        """UPDATE: the hit rows are deleted and written anew. Expressions see the old values."""
        c = pruning.as_condition(condition)
        return self._change("update", lambda rows: rows.filter(c), self._narrow(c, where), assignments, mode, returning)

    def delete_using(self, source: DataFrame, on: Column | str, *, where: Column | str | list | None = None, mode: str = "auto", returning: bool = False) -> DataFrame | int:
        """DELETE USING: rows that ``on`` joins with at least one row of ``source``; it names columns as ``t.column`` and ``s.column``."""
        on = pruning.as_condition(on)
        return self._change("delete", lambda rows: rows.alias("t").join(source.alias("s"), on, "left_semi"), where, None, mode, returning)

    def update_from(self, source: DataFrame, assignments: dict[str, Column], on: Column | str, *, where: Column | str | list | None = None, mode: str = "auto", returning: bool = False) -> DataFrame | int:
        """UPDATE ... FROM: rows that ``on`` joins with ``source`` take the assigned values; both name columns as ``t.column`` and ``s.column``.

        Of several source rows that join with one row, one is used; which one is not said.
        """
        on, names = pruning.as_condition(on), self.schema().names
        unknown = [n for n in assignments if n not in names]
        if unknown:
            raise ValueError(f"no such columns: {unknown}")

        def pick(rows: DataFrame) -> DataFrame:
            joined = rows.alias("t").join(source.alias("s"), on)
            new = [(assignments[n] if n in assignments else F.col(f"t.`{n}`")).alias(n) for n in names]
            return joined.select(*new, F.col("t._file").alias("_file"), F.col("t._pos").alias("_pos")).dropDuplicates(["_file", "_pos"])

        return self._change("update", pick, where, {}, mode, returning)

    @staticmethod
    def _narrow(condition: Column, where: Column | str | list | None) -> Column:
        more = pruning.as_condition(where)
        return condition if more is None else condition & more

    def _change(self, operation: str, pick: Callable[[DataFrame], DataFrame], where: Column | str | list | None, assignments: dict[str, Column] | None, mode: str, returning: bool) -> DataFrame | int:
        state = self.state()
        for n in assignments or {}:
            self._column(state, n)
        names = [c["name"] for c in state["columns"]]
        listed = self._listed(self._planned(state, None, where))
        deletes = [f for f in listed if f["content"] == 1]
        found = pick(self._rows(state, listed, positions=True))
        if assignments:
            found = found.select(*[(assignments[n] if n in assignments else F.col(f"`{n}`")).alias(n) for n in names], "_file", "_pos")
        whole_rows = returning or assignments is not None
        hit = materialize(found if whole_rows else found.select("_file", "_pos"), "hit")
        count = {r["_file"]: r["count"] for r in hit.groupBy("_file").count().collect()}  # one row per file that is hit
        if not count:
            return hit.drop("_file", "_pos") if returning else state["current"]
        touched = [f for f in listed if f["content"] == 0 and self._key(f["path"]) in count]
        n = lambda f: count[self._key(f["path"])]
        before = sum(f["row_count"] for f in deletes)  # all of them may lie in one file
        dead = self._dead(deletes, touched) if any(n(f) >= f["row_count"] - before for f in touched) else {}
        partial = [f for f in touched if n(f) < f["row_count"] - dead.get(self._key(f["path"]), 0)]
        gone = [f for f in touched if f not in partial]
        total = sum(count.values())
        rewrite = mode == "cow" or (mode == "auto" and sum(map(n, partial)) * 100 > COPY_ON_WRITE_PERCENT * sum(f["row_count"] for f in partial))
        with self._writing() as op:
            new, added = [], []
            if assignments is not None:
                new.append(hit.select(*[F.col(f"`{x}`") for x in names]))
            places = hit.select("_file", "_pos")
            if partial and rewrite:
                rows = self._rows(state, [*partial, *deletes], positions=True)
                left = rows.join(F.broadcast(places) if total <= BROADCAST_POSITIONS else places, ["_file", "_pos"], "left_anti")
                new.append(left.select(*[F.col(f"`{x}`") for x in names]))
                gone = touched
            elif partial:
                if gone:
                    some = self.spark.createDataFrame([(self._key(f["path"]),) for f in partial], "_file string")
                    places = places.join(F.broadcast(some) if len(partial) <= 100_000 else some, "_file", "left_semi")
                folder = f"deletes/{op}"
                placed = places.coalesce(1) if total <= BROADCAST_POSITIONS else places.repartition(F.col("_file"))
                placed.sortWithinPartitions("_file", "_pos").write.parquet(f"{self.location}/{folder}")
                added.append(self._write_manifest(state, folder, op, [], [], {0: "_file"}, 1))
            if new:
                added.append(self._write_data(state, reduce(DataFrame.unionAll, new), op))
            snap = self._publish(state, operation, op, added, 0 if assignments is not None else -total, gone)
        return hit.drop("_file", "_pos") if returning else snap

    def _dead(self, deletes: list[Row], touched: list[Row]) -> dict[str, int]:
        """How many rows of the touched files position deletes have taken already."""
        if not deletes:
            return {}
        of = self.spark.createDataFrame([(self._key(f["path"]),) for f in touched], "_file string")
        d = self._deleted(deletes).join(F.broadcast(of) if len(touched) <= 100_000 else of, "_file", "left_semi")  # no position is ever deleted twice
        return {r["_file"]: r["count"] for r in d.groupBy("_file").count().collect()}  # one row per file that is hit

    def merge(self, *_: object, **__: object) -> None:
        raise NotImplementedError("MERGE is not supported on lake tables")

    # Maintenance --------------------------------------------------------------------

    def compact(self, *, target: int = TARGET_BYTES, min_files: int = 2) -> int | None:
        """VACUUM: per partition, rewrite small files into files of about ``target`` bytes, and files that position deletes name without their dead rows.

        Other files stay as they are. Position deletes are gone afterwards, as every file
        that they name is written anew. A group of small files that would not become fewer
        is left alone. Returns the snapshot id, or None if there was nothing to do.
        """
        state = self.state()
        entries = self._entries(state)
        deletes = self._listed(entries.filter("content = 1"))
        data = entries.filter("content = 0").withColumn("_k", F.to_json("partition")).withColumn("_file", F.expr("substring(path, 6)"))
        if deletes:
            named = self._deleted(deletes).select("_file").distinct().withColumn("_dirty", F.lit(True))
            data = data.join(named, "_file", "left").withColumn("_dirty", F.coalesce("_dirty", F.lit(False)))
        else:
            data = data.withColumn("_dirty", F.lit(False))
        small = data.filter(F.col("_dirty") | (F.col("file_size") < target * 3 // 4))
        groups = small.groupBy(F.col("spec_id").alias("_s"), F.col("_k").alias("_g")).agg(F.count("*").alias("_n"), F.sum("file_size").alias("_b"))
        groups = groups.withColumn("_merge", (F.col("_n") >= min_files) & (F.ceil(F.col("_b") / target) < F.col("_n")))
        j = small.join(groups, (F.col("spec_id") == F.col("_s")) & (F.col("_k") == F.col("_g"))).filter(F.col("_dirty") | F.col("_merge"))
        chosen = self._listed(j)
        if not chosen and not deletes:
            return None
        with self._writing() as op:
            added = None
            if chosen:
                size, rows = sum(f["file_size"] for f in chosen), sum(f["row_count"] for f in chosen)
                # Rebalanced pieces should be as large as the outputs; the setting is that of a session of its own.
                t = Table(self._session({"spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target)}), self.location)
                df = t._rows(state, [*chosen, *deletes])
                if not state["specs"][state["spec"]]:
                    df = df.coalesce(max(1, -(-size // target)))
                added = t._write_data(state, df, op, max(1, rows * target // max(size, 1)))
            return self._publish(state, "compact", op, [added], 0, [*chosen, *deletes])

    def _session(self, settings: dict[str, str]) -> SparkSession:
        """A session like this one with other settings."""
        s = self.spark.newSession()
        for k, v in (self.spark.conf.getAll | settings).items():
            if k.startswith("spark.sql.") and s.conf.isModifiable(k):
                s.conf.set(k, v)
        return s

    def rewrite_manifest(self) -> int:
        """One manifest file, in the order of partitions."""
        state = self.state()
        before = self._snapshot(state)
        with self._writing() as op:
            m = self._save_manifest(self._plain(self._entries(state)).sortWithinPartitions(F.to_json("partition"), "path"), op, 0) if before else None
            held = [m] if m else []
            snap = {"id": max((s["id"] for s in state["snapshots"]), default=0) + 1, "parent": state["current"], "at": int(time.time() * 1000), "operation": "manifest", "manifests": held, "rows": before["rows"] if before else 0, "added_files": 0, "removed_files": 0}
            self._commit(state | {"snapshots": [*state["snapshots"], snap], "current": snap["id"]})
        return snap["id"]

    def expire_snapshots(self, keep_last: int = 1, older_than_ms: int | None = None) -> int:
        """Forget old snapshots (never the current one); returns how many went. Files are removed by :meth:`remove_orphans`."""
        state = self.state()
        last = {s["id"] for s in state["snapshots"][-keep_last:]} | {state["current"]}
        kept = [s for s in state["snapshots"] if s["id"] in last or (older_than_ms is not None and s["at"] >= older_than_ms)]
        gone = len(state["snapshots"]) - len(kept)
        if gone:
            self._commit(state | {"snapshots": kept})
        return gone

    def _manifests_in_use(self) -> list[dict]:
        """Manifests of all kept snapshots, and of versions beyond this one, which a transaction under way may have made."""
        states = [self.state(), *[self.state(v) for v in range(self.version() + 1, Table.version(self) + 1)]]
        return [*{m["name"]: m for st in states for s in st["snapshots"] for m in s["manifests"]}.values()]

    def referenced_files(self) -> DataFrame:
        """Paths that any kept snapshot names."""
        return self._entries(only=self._manifests_in_use()).select("path").distinct()

    def _open_writers(self, age_ms: int) -> list[str]:
        now, out = time.time() * 1000, []
        for name in self._names("open"):
            try:
                if now - int(self._read(f"{self.location}/open/{name}")) < age_ms:
                    out.append(name)
            except (Py4JJavaError, ValueError):  # gone meanwhile, or just being made
                out.append(name)
        return out

    def remove_orphans(self, older_than_ms: int | None = None, *, open_ms: int = OPEN_MS) -> int:
        """Delete files that no kept snapshot names; returns how many.

        Files of writers at work stay: those whose mark is younger than ``open_ms``. Files
        newer than ``older_than_ms`` (milliseconds since 1970) stay too if that is given. The
        order of looking (files, marks, snapshots) leaves no gap: a writer not yet seen among
        the marks has no listed file, one no longer seen has its snapshot.
        """
        have = []
        for folder in ("data", "deletes", "manifests"):
            if self._names(folder):
                have.append(self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(f"{self.location}/{folder}").select("path", "modificationTime", F.concat(F.lit(f"{folder}/"), F.substring_index("path", f"/{folder}/", -1)).alias("rel")))
        if not have:
            return 0
        files = reduce(DataFrame.unionAll, have)
        busy = self._open_writers(open_ms)
        used = self._manifests_in_use()
        if busy:
            files = files.filter(~F.substring(F.split("rel", "/")[1], 1, 16).isin(busy))
        if older_than_ms is not None:
            files = files.filter(F.unix_millis("modificationTime") < older_than_ms)
        known = self._entries(only=used).select(F.col("path").alias("_known")).distinct()
        orphans = files.join(known, F.col("rel") == F.col("_known"), "left_anti").filter(~F.col("rel").startswith("manifests/") | ~F.split("rel", "/")[1].isin([m["name"] for m in used]))

        def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for path in b["path"]:
                    fs, p = _open(path)
                    for one in (p, "/.".join(p.rsplit("/", 1)) + ".crc"):  # the second is the checksum that local folders hold
                        with contextlib.suppress(FileNotFoundError, OSError):
                            fs.delete_file(one)
                yield pd.DataFrame({"n": [len(b)]})

        return orphans.select("path").mapInPandas(remove, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def vacuum(self, *, keep_snapshots: int = 1, orphans_older_than_ms: int | None = None) -> dict[str, int]:
        """Compaction, snapshot expiry and orphan removal in one call."""
        compacted = self.compact()
        return {"compacted": int(compacted is not None), "expired": self.expire_snapshots(keep_snapshots), "removed": self.remove_orphans(orphans_older_than_ms)}

    def drop(self) -> None:
        delete_path(self.spark, self.location)

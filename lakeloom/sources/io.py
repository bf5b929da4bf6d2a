"""Readers and writers by format, with format and compression inferred from names."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.functions import geo

#: File name endings and what they say; longer ones first.
ENDINGS = {
    ".metadata.json": ("iceberg", "none"), ".csv.gz": ("csv", "gzip"), ".csv.zst": ("csv", "zstd"), ".json.gz": ("json", "gzip"), ".json.zst": ("json", "zstd"), ".geojson.gz": ("geojson", "gzip"),
    ".parquet": ("parquet", "snappy"), ".csv": ("csv", "none"), ".tsv": ("csv", "none"), ".geojson": ("geojson", "none"), ".json": ("json", "none"), ".ndjson": ("json", "none"), ".jsonl": ("json", "none"),
}
FORMATS = ("parquet", "csv", "json", "geojson", "log", "iceberg", "delta", "text")
COMPRESSIONS = ("none", "gzip", "zstd", "snappy")
#: Schemes of places that can be read; a bare path is local or of the default file system.
SCHEMES = ("file", "s3", "s3a", "s3n", "gs", "az", "abfs", "abfss", "wasb", "hdfs", "http", "https", "hf")


def infer(path: str, format: str | None = None, compression: str | None = None) -> tuple[str, str]:  # noqa: A002
    """(format, compression) from the options, else from the end of the path before any ``?``."""
    base = path.split("?", 1)[0].lower().rstrip("/")
    known = next((v for k, v in ENDINGS.items() if base.endswith(k)), (None, None))
    f = (format or known[0] or "").lower()
    if not f:
        raise ValueError("unrecognized file format")
    if f not in FORMATS:
        raise ValueError(f'format "{format}" not recognized')
    c = (compression or known[1] or ("snappy" if f == "parquet" else "none")).lower()
    if c not in COMPRESSIONS:
        raise ValueError(f'compression "{compression}" not recognized')
    if f in ("csv", "json") and c == "snappy":
        raise ValueError(f"snappy compression is not supported for {f}")
    return f, c


def check_url(path: str) -> str:
    """The path, if its scheme is one that can be read."""
    m = re.match(r"^([A-Za-z][A-Za-z0-9+.-]*)://", path)
    if m and m[1].lower() not in SCHEMES:
        raise ValueError(f"unsupported scheme {m[1]}")
    return path


def _quoted_breaks(spark: SparkSession, paths: list[str], quote: str) -> bool:
    """Whether a quoted field of the files goes over several lines: a line then has an odd number of quotes. One scan, which ends at the first such line of each task."""
    lines = spark.read.text(paths)
    odd = (F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))) % 2 == 1
    return not lines.filter(odd).limit(1).isEmpty()


def sniff_csv(spark: SparkSession, path: str, sample_lines: int = 200) -> dict[str, str]:
    """Delimiter, quote and header of CSV files, from their first lines."""
    lines = [r[0] for r in spark.read.text(path).limit(sample_lines).collect() if r[0]]
    if not lines:
        return {"sep": ",", "quote": '"', "header": "false"}
    quote = '"' if sum(x.count('"') for x in lines) >= sum(len(re.findall(r"(?:^|[,;|\t])'", x)) for x in lines) else "'"
    bare = [re.sub(f"{quote}[^{quote}]*{quote}", "", x) for x in lines]

    def score(d: str) -> tuple[int, int]:
        n = [x.count(d) for x in bare]
        return (n.count(n[0]) * (n[0] > 0), n[0])

    sep = max(",;|\t", key=score)
    sep = sep if score(sep)[0] else ","
    cells = [x.split(sep) for x in bare]
    number = re.compile(r"\s*-?\d+(\.\d+)?([eE][+-]?\d+)?\s*|\d{4}-\d\d-\d\d.*|true|false")
    head, rest = cells[0], [c for c in cells[1:] if len(c) == len(cells[0])]
    typed = [i for i in range(len(head)) if rest and all(not c[i] or number.fullmatch(c[i]) for c in rest) and any(c[i] for c in rest)]
    header = bool(typed) and not any(number.fullmatch(head[i]) for i in typed) or (not typed and len(set(head)) == len(head) and all(re.fullmatch(r"[A-Za-z_]\w*", h.strip(f' {quote}')) or not h for h in head) and bool(rest) and any(head))
    return {"sep": sep, "quote": quote, "header": str(header).lower()}


def read(spark: SparkSession, path: str | list[str], format: str | None = None, *, schema: T.StructType | str | None = None, filename: bool = False, compression: str | None = None, **options: object) -> DataFrame:  # noqa: A002
    """Read files of one format (a path, a glob or a list). ``filename`` adds ``_filename``, on which filters prune files.

    Options: header, delimiter, quote, escape, null and multiline for CSV; files are split
    among tasks unless a quoted field holds a line break, which is looked for where
    ``multiline`` does not say so; array for JSON files that hold
    one array; log_format for logs. Without a schema, types are inferred.
    """
    paths = [check_url(p) for p in ([path] if isinstance(path, str) else path)]
    f, _ = infer(paths[0], format, compression)
    if f == "iceberg":
        from lakeloom.sources.iceberg import read_snapshot

        return read_snapshot(spark, paths[0])
    if f == "delta":
        from lakeloom.sources.delta import read_delta

        return read_delta(spark, paths[0])
    if f == "log":
        df = read_log(spark, paths, str(options.get("log_format", "")))
    elif f == "geojson":
        df = read_geojson(spark, paths)
    else:
        r = spark.read
        if schema is not None:
            r = r.schema(schema)
        if f == "csv":
            said = {"sep": options.get("delimiter"), "quote": options.get("quote"), "header": options.get("header"), "escape": options.get("escape"), "nullValue": options.get("null")}
            found = sniff_csv(spark, paths[0]) if any(said[k] is None for k in ("sep", "quote", "header")) else {}
            quote = str(said["quote"] if said["quote"] is not None else found.get("quote", '"'))
            breaks = options["multiline"] if options.get("multiline") is not None else bool(quote) and _quoted_breaks(spark, paths, quote)
            opts = {"escape": '"', "multiLine": str(bool(breaks)).lower(), "inferSchema": str(schema is None).lower(), "preferDate": "true"} | found | {k: str(v).lower() if isinstance(v, bool) else v for k, v in said.items() if v is not None}
            df = r.options(**opts).csv(paths)
        elif f == "json":
            df = r.option("multiLine", str(bool(options.get("array"))).lower()).json(paths)
        elif f == "text":
            df = r.text(paths)
        else:
            df = r.parquet(*paths)
    return df.withColumn("_filename", F.col("_metadata.file_path")) if filename else df


def write(df: DataFrame, path: str, format: str | None = None, *, compression: str | None = None, mode: str = "error", records_per_file: int | None = None, files: int | None = None, partition_by: list[str] | None = None, **options: object) -> None:  # noqa: A002
    """COPY TO: write a query's rows. CSV has no header unless asked for, as in PostgreSQL."""
    f, c = infer(path, format, compression)
    if f not in ("parquet", "csv", "json", "text"):
        raise ValueError(f"cannot write {f}")
    w = (df.repartition(files) if files else df).write.mode(mode).option("compression", c)
    if records_per_file:
        w = w.option("maxRecordsPerFile", records_per_file)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if f == "csv":
        w = w.options(header=str(options.get("header", False)).lower(), sep=str(options.get("delimiter", ",")), quote=str(options.get("quote", '"')), escape=str(options.get("escape", '"')), nullValue=str(options.get("null", "")), emptyValue='""', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
        w.csv(path)
    elif f == "json":
        w.option("ignoreNullFields", "false").json(path)
    elif f == "text":
        w.text(path)
    else:
        w.parquet(path)


def copy_from(spark: SparkSession, path: str, *, columns: list[str] | None = None, where: Column | str | None = None, **options: object) -> DataFrame:
    """COPY FROM: rows of files, with a column list and a filter, both pushed into the scan."""
    df = read(spark, path, **options)
    if where is not None:
        df = df.filter(where)
    return df.select(*columns) if columns else df


# Logs ------------------------------------------------------------------------------

# The fields of an S3 server access log line, in order, with their kinds.
S3_LOG = (
    ("bucket_owner", "word"), ("bucket", "word"), ("request_time", "time"), ("remote_ip", "word"), ("requester", "word"), ("request_id", "word"), ("operation", "word"),
    ("s3_key", "word"), ("request_uri", "quoted"), ("http_status", "word"), ("s3_errorcode", "word"), ("bytes_sent", "number"), ("object_size", "number"), ("total_time", "number"),
    ("turn_around_time", "number"), ("referer", "quoted"), ("user_agent", "quoted"), ("version_id", "word"), ("host_id", "word"), ("sigver", "word"), ("cypersuite", "word"),
    ("auth_type", "word"), ("host_header", "word"), ("tls_version", "word"), ("access_point_arn", "word"), ("acl_required", "word"),
)
_KINDS = {"word": r"(\S+)", "time": r"\[([^\]]+)\]", "quoted": r'(?:"([^"]*)"|(?=-)([^" ]+))', "number": r"(\d+|-)"}


def read_log(spark: SparkSession, paths: list[str] | str, log_format: str = "s3") -> DataFrame:
    """Access logs as the 27-column table; a line that does not match gives a row of nulls with the whole line in ``extra``."""
    if log_format != "s3":
        raise ValueError(f"unrecognized log_format value: {log_format}")
    return parse_log_lines(spark.read.text(paths), "value")


def parse_log_lines(lines: DataFrame, column: str) -> DataFrame:
    pattern = "^" + " ".join(_KINDS[k].replace("([^\" ]+)", "[^\" ]+") if k == "quoted" else _KINDS[k] for _, k in S3_LOG) + "(.*)$"
    line = F.col(column)
    ok = F.rlike(line, F.lit(pattern))
    out = []
    for n, (name, kind) in enumerate(S3_LOG, 1):
        x = F.when(ok, F.regexp_extract(line, pattern, n))
        if kind == "time":
            x = F.try_to_timestamp(x, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
        elif kind == "number":
            x = F.when(x != "-", x.cast("bigint"))
        elif kind == "quoted":
            x = F.when(ok & (x == ""), F.lit("-")).otherwise(x)
        out.append(x.alias(name))
    extra = F.when(ok, F.regexp_extract(line, pattern, len(S3_LOG) + 1)).otherwise(line)
    return lines.select(*out, extra.alias("extra"))


# Spatial files -----------------------------------------------------------------------


def read_geojson(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Features of GeoJSON files: their properties as columns and ``geom`` as WKB."""
    raw = spark.read.option("multiLine", "true").json(paths)
    if "features" not in raw.columns:
        raise ValueError("not a GeoJSON feature collection")
    one = raw.select(F.explode("features").alias("f"))
    names = [x.name for x in one.schema["f"].dataType["properties"].dataType] if isinstance(one.schema["f"].dataType["properties"].dataType, T.StructType) else []
    return one.select(*[F.col(f"f.properties.`{n}`").alias(n) for n in names], geo.st_geomfromgeojson(F.to_json("f.geometry")).alias("geom"))


def geometry_columns(path: str) -> dict[str, dict]:
    """Geometry columns of a GeoParquet file, from its footer."""
    import pyarrow.parquet as pq

    from lakeloom.sources.parquet_blocks import _open

    fs, p = _open(path)
    with fs.open_input_file(p) as f:
        meta = pq.ParquetFile(f).metadata.metadata or {}
    return json.loads(meta.get(b"geo", b"{}")).get("columns", {})


# Files -------------------------------------------------------------------------------


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """path, size and modification time of files; their contents are not read."""
    return spark.read.format("binaryFile").load(check_url(pattern)).select("path", F.col("length").alias("file_size"), F.col("modificationTime").alias("last_modified"))


def _status(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(check_url(path))
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def file_size(spark: SparkSession, path: str) -> int:
    fs, p = _status(spark, path)
    return fs.getFileStatus(p).getLen()


def file_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _status(spark, path)
    return fs.exists(p)


def file_delete(spark: SparkSession, path: str) -> bool:
    fs, p = _status(spark, path)
    return fs.delete(p, False)


def preview(spark: SparkSession, path: str, format: str | None = None, **options: object) -> DataFrame:  # noqa: A002
    """column_name and column_type of files."""
    s = read(spark, path, format, **options).schema
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in s], "column_name string, column_type string")


class FileCache:
    """Tables of files kept in memory, the least recently used leaving first when the sum of file sizes passes a limit."""

    def __init__(self, spark: SparkSession, limit_bytes: int) -> None:
        self.spark, self.limit, self.held = spark, limit_bytes, {}

    def add(self, path: str, **options: object) -> DataFrame:
        if path in self.held:
            self.held[path] = self.held.pop(path)
            return self.held[path][0]
        size = list_files(self.spark, path).agg(F.coalesce(F.sum("file_size"), F.lit(0))).first()[0]
        df = read(self.spark, path, **options).persist()
        self.held[path] = (df, size)
        self.manage()
        return df

    def remove(self, path: str) -> bool:
        held = self.held.pop(path, None)
        if held:
            held[0].unpersist()
        return held is not None

    def manage(self) -> None:
        while len(self.held) > 1 and sum(s for _, s in self.held.values()) > self.limit:
            self.remove(next(iter(self.held)))

    def list(self) -> DataFrame:
        return self.spark.createDataFrame([(p, s) for p, (_, s) in self.held.items()], "path string, file_size bigint")

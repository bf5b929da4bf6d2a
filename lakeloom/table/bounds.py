"""File statistics from Parquet footers."""

from __future__ import annotations

import datetime
import decimal
from urllib.parse import unquote

import pandas as pd
import pyarrow.parquet as pq

from lakeloom.sources.parquet_blocks import _open

NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
COLUMNS = ["path", "content", "spec_id", "schema_id", "partition", "row_count", "file_size", "lower", "upper", "nulls", "first_row_id"]


def as_text(v: object) -> str | None:
    """A bound as text that casts back to its type."""
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, (int, float, str, datetime.date, decimal.Decimal)):
        return None if v != v else str(v)
    return None


def footer_rows(files: pd.DataFrame, folder: str, columns: dict[int, str], parts: list[str], names: list[str], content: int, spec_id: int, schema_id: int) -> pd.DataFrame:
    """Manifest rows of files given by path and length; ``columns`` gives the stored name of each column id. Files without rows are left out."""
    rows = []
    for path, length in zip(files["path"], files["length"]):
        fs, p = _open(path)
        with fs.open_input_file(p) as f:
            meta = pq.ParquetFile(f).metadata
        if not meta.num_rows:
            continue
        rel = folder + path.rpartition(folder)[2]
        values = dict(x.split("=", 1) for x in rel.split("/")[:-1] if "=" in x)
        partition = {n: (None if (v := unquote(values.get(p, NULL_PARTITION))) == NULL_PARTITION else v[1:]) for p, n in zip(parts, names)}
        lower, upper, nulls = {}, {}, {}
        order = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
        for i, stored in columns.items():
            at = order.get(stored)
            stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)] if at is not None else []
            if not stats or any(s is None for s in stats):
                continue
            if all(s.has_null_count for s in stats):
                nulls[i] = sum(s.null_count for s in stats)
            held = [s for s in stats if s.has_min_max]
            if held and len(held) == sum(1 for s in stats if s.num_values):
                lo, hi = as_text(min(s.min for s in held)), as_text(max(s.max for s in held))
                if lo is not None and hi is not None:
                    lower[i], upper[i] = lo, hi
        rows.append((rel, content, spec_id, schema_id, partition, meta.num_rows, length, lower, upper, nulls, None))
    return pd.DataFrame(rows, columns=COLUMNS).astype({"row_count": "int64", "file_size": "int64", "first_row_id": "Int64"})

"""Copying encoded column blocks between Parquet files.

A Parquet footer is a Thrift struct in the compact protocol. It is read here into plain
(field id, wire type, value) tuples, so fields that this module does not know are kept,
then offsets are shifted and the struct is written back. Field numbers are those of the
public Parquet format definition.
"""

from __future__ import annotations

import struct
import uuid

import pyarrow.fs as pafs

# Wire types of the Thrift compact protocol.
TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT, UUID = range(1, 14)
# Field ids in the Parquet format definition.
FILE_SCHEMA, FILE_ROWS, FILE_GROUPS = 2, 3, 4
FILE_ENCRYPTION, FILE_SIGNING_KEY = 8, 9
GROUP_COLUMNS, GROUP_ROWS, GROUP_OFFSET, GROUP_ORDINAL = 1, 3, 5, 7
CHUNK_PATH, CHUNK_OFFSET, CHUNK_META = 1, 2, 3
CHUNK_INDEXES = (4, 5, 6, 7)
META_SIZE, META_DATA, META_INDEX, META_DICTIONARY = 7, 9, 10, 11
META_BLOOM = (14, 15)
MAGIC = b"PAR1"
COPY_BYTES = 8 << 20


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.d, self.at = data, 0

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.d[self.at]
            self.at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    def zigzag(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def value(self, kind: int):
        if kind in (TRUE, FALSE):
            self.at += 1
            return self.d[self.at - 1] == TRUE
        if kind == BYTE:
            self.at += 1
            return self.d[self.at - 1]
        if kind in (I16, I32, I64):
            return self.zigzag()
        if kind in (DOUBLE, BINARY, UUID):
            n = {DOUBLE: 8, UUID: 16}.get(kind) or self.varint_len(kind)
            self.at += n
            return self.d[self.at - n : self.at]
        if kind in (LIST, SET):
            head = self.d[self.at]
            self.at += 1
            n = head >> 4 if head >> 4 < 15 else self.varint()
            return head & 15, [self.value(head & 15) for _ in range(n)]
        if kind == MAP:
            n = self.varint()
            kinds = self.value(BYTE) if n else 0
            return kinds, [(self.value(kinds >> 4), self.value(kinds & 15)) for _ in range(n)]
        return self.struct()

    def varint_len(self, kind: int) -> int:
        return self.varint() if kind == BINARY else 0

    def struct(self) -> list:
        fields, last = [], 0
        while True:
            head = self.d[self.at]
            self.at += 1
            if head == 0:
                return fields
            last = last + (head >> 4) if head >> 4 else self.zigzag()
            kind = head & 15
            fields.append((last, kind, kind == TRUE if kind in (TRUE, FALSE) else self.value(kind)))


class _Writer:
    def __init__(self) -> None:
        self.out = bytearray()

    def varint(self, n: int) -> None:
        while n > 127:
            self.out.append(n & 127 | 128)
            n >>= 7
        self.out.append(n)

    def zigzag(self, n: int) -> None:
        self.varint(n << 1 if n >= 0 else (-n << 1) - 1)

    def value(self, kind: int, v) -> None:
        if kind in (TRUE, FALSE):
            self.out.append(TRUE if v else FALSE)
        elif kind == BYTE:
            self.out.append(v)
        elif kind in (I16, I32, I64):
            self.zigzag(v)
        elif kind in (DOUBLE, UUID):
            self.out += v
        elif kind == BINARY:
            self.varint(len(v))
            self.out += v
        elif kind in (LIST, SET):
            of, items = v
            self.out.append(min(len(items), 15) << 4 | of)
            if len(items) > 14:
                self.varint(len(items))
            for x in items:
                self.value(of, x)
        elif kind == MAP:
            kinds, items = v
            self.varint(len(items))
            if items:
                self.out.append(kinds)
            for a, b in items:
                self.value(kinds >> 4, a)
                self.value(kinds & 15, b)
        else:
            self.struct(v)

    def struct(self, fields: list) -> None:
        last = 0
        for i, kind, v in fields:
            wire = (TRUE if v else FALSE) if kind in (TRUE, FALSE) else kind
            if 0 < i - last < 16:
                self.out.append(i - last << 4 | wire)
            else:
                self.out.append(wire)
                self.zigzag(i)
            last = i
            if kind not in (TRUE, FALSE):
                self.value(kind, v)
        self.out.append(0)


def get(fields: list, i: int, default=None):
    return next((v for f, _, v in fields if f == i), default)


def put(fields: list, i: int, v) -> list:
    """The struct with another value for a field that it has."""
    return [(f, k, v if f == i else x) for f, k, x in fields]


def drop(fields: list, ids: tuple[int, ...]) -> list:
    return [x for x in fields if x[0] not in ids]


def _open(path: str):
    """(file system, path in it). Paths are taken as they are: a percent sign in a name is no escape."""
    scheme, mark, rest = path.partition("://")
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if not mark:
        return pafs.LocalFileSystem(), path
    place, _, key = rest.partition("/")
    fs, root = pafs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{place}/")
    return fs, f"{root.rstrip('/')}/{key}"


def read_footer(path: str) -> tuple[list, int]:
    """The footer's struct and the size of the file."""
    fs, p = _open(path)
    with fs.open_input_file(p) as f:
        size = f.size()
        if size < 12 or f.read_at(4, 0) != MAGIC or (tail := f.read_at(8, size - 8))[4:] != MAGIC:
            raise ValueError("not a Parquet file with a plain footer")
        n = struct.unpack("<I", tail[:4])[0]
        if n > size - 12:
            raise ValueError("the footer is longer than the file")
        fields = _Reader(f.read_at(n, size - 8 - n)).struct()
    if get(fields, FILE_ENCRYPTION) is not None:
        raise ValueError("encrypted")
    return fields, size


def summary(path: str) -> tuple[int, int, int]:
    """Rows, blocks and bytes of a file."""
    fields, size = read_footer(path)
    return get(fields, FILE_ROWS), len(get(fields, FILE_GROUPS, (0, []))[1]), size


def _schema_bytes(footer: list) -> bytes:
    w = _Writer()
    w.value(LIST, get(footer, FILE_SCHEMA))
    return bytes(w.out)


def _span(group: list) -> tuple[int, int]:
    """First and last byte of a block's column chunks."""
    starts, ends = [], []
    for chunk in get(group, GROUP_COLUMNS)[1]:
        if get(chunk, CHUNK_PATH) is not None or get(chunk, CHUNK_META) is None:
            raise ValueError("column data lie in another file")
        m = get(chunk, CHUNK_META)
        first = min(x for x in (get(m, META_DATA), get(m, META_DICTIONARY) or None) if x)
        starts.append(first)
        ends.append(first + get(m, META_SIZE))
    return (min(starts), max(ends)) if starts else (0, 0)


def _moved(group: list, by: int, ordinal: int) -> list:
    """The block's metadata with all offsets shifted; page indexes and bloom filters, which stay behind, are no longer named."""
    chunks = []
    for chunk in get(group, GROUP_COLUMNS)[1]:
        m = drop(get(chunk, CHUNK_META), META_BLOOM)
        for i in (META_DATA, META_INDEX, META_DICTIONARY):
            if get(m, i):
                m = put(m, i, get(m, i) + by)
        c = put(drop(chunk, CHUNK_INDEXES), CHUNK_META, m)
        chunks.append(put(c, CHUNK_OFFSET, get(c, CHUNK_OFFSET) + by if get(c, CHUNK_OFFSET) else 0))
    out = put(group, GROUP_COLUMNS, (STRUCT, chunks))
    if get(out, GROUP_OFFSET):
        out = put(out, GROUP_OFFSET, get(out, GROUP_OFFSET) + by)
    return put(out, GROUP_ORDINAL, ordinal) if ordinal < 1 << 15 else drop(out, (GROUP_ORDINAL,))


def merge_files(paths: list[str], directory: str, name: str, known: dict[str, int | None] | None = None) -> list[tuple[str | None, int, int, int, int, str | None]]:
    """Merge files into as few as their schemas allow: (path, files, blocks, rows, bytes, problem) each.

    The order of files is that of ``paths``. Files without rows add no block but count
    as merged. A file whose rows differ from those in ``known`` is not merged. Raises if a written file does not hold the blocks and rows of its inputs.
    """
    by_schema: dict[bytes, list] = {}
    out = []
    for p in paths:
        try:
            footer, _ = read_footer(p)
            if known and known.get(p) is not None and known[p] != get(footer, FILE_ROWS):
                raise ValueError(f"{get(footer, FILE_ROWS)} rows instead of {known[p]}")
            for g in get(footer, FILE_GROUPS)[1]:
                _span(g)
            by_schema.setdefault(_schema_bytes(footer), []).append((p, footer))
        except (ValueError, IndexError, OSError, TypeError) as e:
            out.append((None, 0, 0, 0, 0, f"{p}: {e}"[:300]))
    for k, members in enumerate(by_schema.values()):
        out.append(_merge(members, f"{directory.rstrip('/')}/{name}-{k}.parquet"))
    return out


def _merge(members: list[tuple[str, list]], target: str) -> tuple[str, int, int, int, int, None]:
    fs, to = _open(target)
    fs.create_dir(to.rpartition("/")[0], recursive=True)
    groups, rows, part = [], 0, f"{to}.{uuid.uuid4().hex[:8]}.tmp"
    with fs.open_output_stream(part) as o:
        o.write(MAGIC)
        at = 4
        for path, footer in members:
            src, p = _open(path)
            with src.open_input_file(p) as f:
                for g in get(footer, FILE_GROUPS)[1]:
                    first, last = _span(g)
                    groups.append(_moved(g, at - first, len(groups)))
                    f.seek(first)
                    left = last - first
                    while left:
                        piece = f.read(min(COPY_BYTES, left))
                        if not piece:
                            raise OSError(f"{path} ends inside a block")
                        o.write(piece)
                        left -= len(piece)
                    at += last - first
            rows += get(footer, FILE_ROWS)
        new = put(put(members[0][1], FILE_GROUPS, (STRUCT, groups)), FILE_ROWS, rows)
        w = _Writer()
        w.struct(drop(new, (FILE_SIGNING_KEY,)))
        o.write(bytes(w.out) + struct.pack("<I", len(w.out)) + MAGIC)
    got, blocks, size = summary(part if fs.type_name == "local" else target.replace(to, part))
    want = sum(len(get(f, FILE_GROUPS)[1]) for _, f in members)
    if (got, blocks) != (rows, want) or sum(get(g, GROUP_ROWS) for g in groups) != rows:
        fs.delete_file(part)
        raise ValueError(f"{target}: {got} rows in {blocks} blocks instead of {rows} in {want}")
    fs.move(part, to)
    return target, len(members), blocks, rows, size, None

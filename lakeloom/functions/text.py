"""Text functions with PostgreSQL semantics, as JVM-side column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat(*cols: Column) -> Column:
    """Nulls count as empty."""
    return F.concat(*[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def concat_ws(separator: str, *cols: Column) -> Column:
    return F.concat_ws(separator, *[c.cast("string") for c in cols])


def left(s: Column, n: int) -> Column:
    """Negative n: all but the last -n characters."""
    return F.substring(s, 1, n) if n >= 0 else F.substr(s, F.lit(1), F.greatest(F.length(s) + n, F.lit(0)))


def right(s: Column, n: int) -> Column:
    """Negative n: all but the first -n characters."""
    if n < 0:
        return F.substr(s, F.lit(1 - n))
    return F.when(F.length(s) <= n, s).otherwise(F.substr(s, F.length(s) - n + 1, F.lit(n)))


def substr(s: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """The window from ``start`` may begin before the text, which shortens it; a negative length raises."""
    start = F.lit(start) if isinstance(start, int) else start
    if length is None:
        return F.substr(s, F.greatest(start, F.lit(1)))
    length = F.lit(length) if isinstance(length, int) else length
    cut = F.substr(s, F.greatest(start, F.lit(1)), F.greatest(length + F.least(start - 1, F.lit(0)), F.lit(0)))
    return F.when(length < 0, F.raise_error(F.lit("negative substring length not allowed"))).otherwise(cut)


def lpad(s: Column, n: int, fill: str = " ") -> Column:
    return F.lpad(s, max(n, 0), fill) if fill else F.substring(s, 1, max(n, 0))


def rpad(s: Column, n: int, fill: str = " ") -> Column:
    return F.rpad(s, max(n, 0), fill) if fill else F.substring(s, 1, max(n, 0))


def btrim(s: Column, chars: str = " ") -> Column:
    return F.btrim(s, F.lit(chars))


def ltrim(s: Column, chars: str = " ") -> Column:
    return F.ltrim(s, F.lit(chars))


def rtrim(s: Column, chars: str = " ") -> Column:
    return F.rtrim(s, F.lit(chars))


def initcap(s: Column) -> Column:
    """Upper case at the start of each run of ASCII letters and digits, lower case after it; all else is a boundary."""
    runs = F.regexp_extract_all(s, F.lit("([A-Za-z0-9]+|[^A-Za-z0-9]+)"), F.lit(1))
    one = lambda x: F.when(F.rlike(x, F.lit("^[A-Za-z0-9]")), F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))).otherwise(x)
    return F.array_join(F.transform(runs, one), "")


def chr_(n: Column) -> Column:
    """The character of a Unicode code point; 0 raises."""
    wide = F.decode(F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0")), "UTF-32")
    return F.when(n == 0, F.raise_error(F.lit("null character not permitted"))).otherwise(wide)


def split_part(s: Column, delimiter: str, n: int) -> Column:
    """Counted from the end if n is negative; 0 raises."""
    if n == 0:
        raise ValueError("field position must not be zero")
    return F.split_part(s, F.lit(delimiter), F.lit(n))


def _pattern(pattern: str, flags: str) -> str:
    java = {"i": "i", "x": "x", "s": "s", "n": "m", "m": "m"}
    on = "".join(java[f] for f in flags if f in java)
    return f"(?{on}){pattern}" if on else pattern


def _replacement(text: str) -> str:
    out, i = "", 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            d = text[i + 1]
            out += f"${d}" if d.isdigit() else "$0" if d == "&" else "\\\\" if d == "\\" else d
            i += 2
            continue
        out += "\\$" if c == "$" else c
        i += 1
    return out


def regexp_replace(s: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    """Replaces the first match, or all with the flag g; back-references are written \\\\1."""
    p, r = _pattern(pattern, flags), _replacement(replacement)
    if "g" in flags:
        return F.regexp_replace(s, p, r)
    # Only at the first match: what stands before it is matched along, as group 1, and put back; group 2 is the match.
    on = p[: len(p) - len(pattern)]
    shifted = re.sub(r"(?<!\\)\$(\d)", lambda m: f"${int(m[1]) + 2}", r)
    return F.regexp_replace(s, f"(?s)\\A(.*?){on}({pattern})", f"$1{shifted}")


def regexp_like(s: Column, pattern: str, flags: str = "") -> Column:
    return F.rlike(s, F.lit(_pattern(pattern, flags)))


def position(part: str, s: Column) -> Column:
    return F.locate(part, s)


def encode(b: Column, form: str) -> Column:
    if form == "hex":
        return F.lower(F.hex(b))
    if form == "base64":
        return F.base64(b)
    raise ValueError(f"unrecognized encoding: {form}")


def decode(s: Column, form: str) -> Column:
    if form == "hex":
        return F.unhex(s)
    if form == "base64":
        return F.unbase64(s)
    raise ValueError(f"unrecognized encoding: {form}")


def bpchar(s: Column, n: int) -> Column:
    """CHAR(n): cut to n characters, padded with blanks."""
    return F.rpad(F.substring(s, 1, n), n, " ")


def like(s: Column, pattern: str, *, insensitive: bool = False) -> Column:
    return s.ilike(pattern) if insensitive else s.like(pattern)


def starts_with(s: Column, prefix: Column | str) -> Column:
    return F.startswith(s, F.lit(prefix) if isinstance(prefix, str) else prefix)

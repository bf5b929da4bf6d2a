"""A small planar geometry kernel on plain Python values.

A geometry is ``(kind, data)``: Point (x, y[, z]) or None; LineString [points]; Polygon
[rings]; MultiPoint, MultiLineString, MultiPolygon and GeometryCollection a list of
geometries. Only what Spark's built-in functions lack is done here, in Arrow batches.
"""

from __future__ import annotations

import json
import math
import re
import struct

KINDS = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")
EPS = 1e-12
Geometry = tuple


# Reading and writing -----------------------------------------------------------------


def from_wkb(data: bytes) -> Geometry:
    at = 0

    def take(fmt: str):
        nonlocal at
        v = struct.unpack_from(order + fmt, data, at)
        at += struct.calcsize(order + fmt)
        return v

    def points(n: int, dims: int) -> list[tuple]:
        return [take(f"{dims}d")[: 3 if dims > 2 else 2] for _ in range(n)]

    def one() -> Geometry:
        nonlocal at, order
        order = "<" if data[at] else ">"
        at += 1
        (code,) = take("I")
        if code & 0x20000000:
            take("I")
        z = bool(code & 0x80000000) or (code & 0xFFFF) // 1000 in (1, 3)
        m = bool(code & 0x40000000) or (code & 0xFFFF) // 1000 in (2, 3)
        kind, dims = KINDS[(code & 0xFFFF) % 1000 - 1], 2 + z + m
        if kind == "Point":
            p = points(1, dims)[0]
            return kind, None if math.isnan(p[0]) else p
        if kind == "LineString":
            return kind, points(take("I")[0], dims)
        if kind == "Polygon":
            return kind, [points(take("I")[0], dims) for _ in range(take("I")[0])]
        return kind, [one() for _ in range(take("I")[0])]

    order = "<"
    return one()


def _has_z(g: Geometry) -> bool:
    return any(len(p) > 2 for p in all_points(g))


def to_wkb(g: Geometry) -> bytes:
    kind, d = g
    z = _has_z(g)
    put = lambda p: struct.pack("<3d" if z else "<2d", *(tuple(p) + (0.0,) * (z and len(p) < 3)))
    head = struct.pack("<BI", 1, KINDS.index(kind) + 1 + (1000 if z else 0))
    if kind == "Point":
        return head + (put(d) if d is not None else struct.pack("<2d", math.nan, math.nan))
    if kind == "LineString":
        return head + struct.pack("<I", len(d)) + b"".join(map(put, d))
    if kind == "Polygon":
        return head + struct.pack("<I", len(d)) + b"".join(struct.pack("<I", len(r)) + b"".join(map(put, r)) for r in d)
    return head + struct.pack("<I", len(d)) + b"".join(map(to_wkb, d))


def _num(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(float(x))


def to_wkt(g: Geometry) -> str:
    kind, d = g
    name = kind.upper() + (" Z" if _has_z(g) else "")
    if is_empty(g) and not d:
        return f"{name} EMPTY"
    pt = lambda p: " ".join(map(_num, p))
    run = lambda r: "(" + ", ".join(map(pt, r)) + ")"

    def body(k: str, x) -> str:
        if k == "Point":
            return f"({pt(x)})"
        if k == "LineString":
            return run(x)
        if k == "Polygon":
            return "(" + ", ".join(map(run, x)) + ")"
        if k == "GeometryCollection":
            return "(" + ", ".join(map(to_wkt, x)) + ")"
        return "(" + ", ".join((pt(y[1]) if k == "MultiPoint" else body(y[0], y[1])) for y in x) + ")"

    return f"{name} {body(kind, d)}"


def from_wkt(text: str) -> Geometry:
    toks = re.findall(r"[A-Za-z]+|[-+]?[0-9.]+(?:[eE][-+]?\d+)?|[(),]", re.sub(r"^\s*SRID=\d+;", "", text))
    at = 0

    def point() -> tuple:
        nonlocal at
        out = []
        while at < len(toks) and toks[at] not in "(),":
            out.append(float(toks[at]))
            at += 1
        return tuple(out[:3])

    def listed(item):
        nonlocal at
        if toks[at].upper() == "EMPTY":
            at += 1
            return []
        at += 1
        out = [item()]
        while toks[at] == ",":
            at += 1
            out.append(item())
        at += 1
        return out

    def wrapped() -> tuple:
        nonlocal at
        if toks[at] == "(":
            at += 1
            p = point()
            at += 1
            return p
        return point()

    def one() -> Geometry:
        nonlocal at
        kind = next(k for k in KINDS if k.upper() == toks[at].upper())
        at += 1
        if toks[at].upper() in ("Z", "M", "ZM"):
            at += 1
        if kind == "Point":
            p = listed(point)
            return kind, p[0] if p else None
        if kind == "LineString":
            return kind, listed(point)
        if kind == "Polygon":
            return kind, listed(lambda: listed(point))
        if kind == "MultiPoint":
            return kind, [("Point", p) for p in listed(wrapped)]
        if kind == "MultiLineString":
            return kind, [("LineString", r) for r in listed(lambda: listed(point))]
        if kind == "MultiPolygon":
            return kind, [("Polygon", r) for r in listed(lambda: listed(lambda: listed(point)))]
        return kind, listed(one)

    return one()


def to_geojson(g: Geometry, digits: int = 9) -> str:
    rnd = lambda p: [int(v) if v == int(v) else v for v in (round(x, digits) for x in p)]

    def obj(x: Geometry) -> dict:
        k, d = x
        if k == "GeometryCollection":
            return {"type": k, "geometries": [obj(y) for y in d]}
        if k == "Point":
            c = rnd(d) if d else []
        elif k == "LineString":
            c = [rnd(p) for p in d]
        elif k == "Polygon":
            c = [[rnd(p) for p in r] for r in d]
        else:
            c = [obj(y)["coordinates"] for y in d]
        return {"type": k, "coordinates": c}

    return json.dumps(obj(g), separators=(",", ":"))


def from_geojson(text: str) -> Geometry:
    def one(o: dict) -> Geometry:
        k, c = o["type"], o.get("coordinates")
        if k == "GeometryCollection":
            return k, [one(x) for x in o["geometries"]]
        if k == "Point":
            return k, tuple(map(float, c)) if c else None
        if k == "LineString":
            return k, [tuple(map(float, p)) for p in c]
        if k == "Polygon":
            return k, [[tuple(map(float, p)) for p in r] for r in c]
        return k, [one({"type": k[5:], "coordinates": x}) for x in c]

    return one(json.loads(text))


# Parts ------------------------------------------------------------------------------


def parts(g: Geometry) -> list[Geometry]:
    """Single geometries inside."""
    return [y for x in g[1] for y in parts(x)] if g[0].startswith(("Multi", "GeometryC")) else [g]


def all_points(g: Geometry) -> list[tuple]:
    out = []
    for k, d in parts(g):
        out += ([d] if d is not None else []) if k == "Point" else d if k == "LineString" else [p for r in d for p in r]
    return out


def is_empty(g: Geometry) -> bool:
    return not all_points(g)


def dimension(g: Geometry) -> int:
    return max((0 if k == "Point" else 1 if k == "LineString" else 2 for k, _ in parts(g)), default=0)


def runs(g: Geometry) -> list[list[tuple]]:
    """Lines and rings."""
    return [r for k, d in parts(g) for r in ([d] if k == "LineString" else d if k == "Polygon" else [])]


def segments(g: Geometry) -> list[tuple]:
    return [(a, b) for r in runs(g) for a, b in zip(r, r[1:]) if a[:2] != b[:2]]


def mapped(g: Geometry, f) -> Geometry:
    k, d = g
    if k == "Point":
        return k, None if d is None else f(d)
    if k == "LineString":
        return k, [f(p) for p in d]
    if k == "Polygon":
        return k, [[f(p) for p in r] for r in d]
    return k, [mapped(x, f) for x in d]


def reshaped(g: Geometry, f) -> Geometry:
    """Each line and ring as ``f`` makes it."""
    k, d = g
    if k == "LineString":
        return k, f(d)
    if k == "Polygon":
        return k, [f(r) for r in d]
    return g if k == "Point" else (k, [reshaped(x, f) for x in d])


def collected(gs: list[Geometry]) -> Geometry:
    kinds = {g[0] for g in gs}
    one = kinds.pop() if len(kinds) == 1 else ""
    return ("Multi" + one, gs) if one in KINDS[:3] else ("GeometryCollection", gs)


# Measures ---------------------------------------------------------------------------


def ring_area(r: list[tuple]) -> float:
    x0, y0 = r[0][:2] if r else (0.0, 0.0)
    return sum((a[0] - x0) * (b[1] - y0) - (b[0] - x0) * (a[1] - y0) for a, b in zip(r, r[1:])) / 2


def area(g: Geometry) -> float:
    return sum(abs(ring_area(d[0])) - sum(abs(ring_area(h)) for h in d[1:]) for k, d in parts(g) if k == "Polygon" and d)


def _len(r: list[tuple]) -> float:
    return sum(math.dist(a[:2], b[:2]) for a, b in zip(r, r[1:]))


def length(g: Geometry) -> float:
    return sum(_len(d) for k, d in parts(g) if k == "LineString")


def perimeter(g: Geometry) -> float:
    return sum(_len(r) for k, d in parts(g) if k == "Polygon" for r in d)


def centroid(g: Geometry) -> Geometry:
    dim, w, sx, sy = dimension(g), 0.0, 0.0, 0.0
    for k, d in parts(g):
        if dim == 2 and k == "Polygon":
            for i, r in enumerate(d):
                s = (1 if i == 0 else -1) * (1 if ring_area(r) >= 0 else -1)
                for a, b in zip(r, r[1:]):
                    c = (a[0] * b[1] - b[0] * a[1]) * s
                    w, sx, sy = w + c * 3, sx + (a[0] + b[0]) * c, sy + (a[1] + b[1]) * c
        elif dim == 1 and k == "LineString":
            for a, b in zip(d, d[1:]):
                c = math.dist(a[:2], b[:2])
                w, sx, sy = w + c, sx + (a[0] + b[0]) / 2 * c, sy + (a[1] + b[1]) / 2 * c
        elif dim == 0 and d is not None:
            w, sx, sy = w + 1, sx + d[0], sy + d[1]
    if w == 0:
        p = all_points(g)
        return "Point", (sum(q[0] for q in p) / len(p), sum(q[1] for q in p) / len(p)) if p else None
    return "Point", (sx / w, sy / w)


def bbox(g: Geometry) -> tuple | None:
    p = all_points(g)
    return (min(q[0] for q in p), min(q[1] for q in p), max(q[0] for q in p), max(q[1] for q in p)) if p else None


def rectangle(x0: float, y0: float, x1: float, y1: float) -> Geometry:
    return "Polygon", [[(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)]]


def envelope(g: Geometry) -> Geometry:
    b = bbox(g)
    if b is None:
        return g
    if b[0] == b[2] and b[1] == b[3]:
        return "Point", b[:2]
    return ("LineString", [b[:2], b[2:]]) if b[0] == b[2] or b[1] == b[3] else rectangle(*b)


def cross(o: tuple, a: tuple, b: tuple) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def convex_hull(g: Geometry) -> Geometry:
    p = sorted({q[:2] for q in all_points(g)})
    if len(p) < 2:
        return ("Point", p[0]) if p else ("GeometryCollection", [])

    def half(ps):
        out: list[tuple] = []
        for q in ps:
            while len(out) > 1 and cross(out[-2], out[-1], q) <= 0:
                out.pop()
            out.append(q)
        return out

    ring = half(p)[:-1] + half(p[::-1])[:-1]
    return ("LineString", [p[0], p[-1]]) if len(ring) < 3 else ("Polygon", [[*ring, ring[0]]])


def _nearest(p: tuple, s: tuple) -> tuple:
    (ax, ay), (bx, by) = s[0][:2], s[1][:2]
    n = (bx - ax) ** 2 + (by - ay) ** 2
    t = max(0.0, min(1.0, ((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / n)) if n else 0.0
    return ax + t * (bx - ax), ay + t * (by - ay)


def shortest(a: Geometry, b: Geometry) -> tuple[float, tuple, tuple] | None:
    """(distance, point of a, point of b)."""
    if is_empty(a) or is_empty(b):
        return None
    for x, y, flip in ((a, b, False), (b, a, True)):
        for p in all_points(x)[:1] if dimension(y) == 2 else []:
            if locate(p, y) != "E":
                return 0.0, p[:2], p[:2]
        del flip
    sa, sb = segments(a), segments(b)
    for s in sa:
        for t in sb:
            if (m := meet(s, t)) and m:
                return 0.0, m[0], m[0]
    best = min(((math.dist(p[:2], q[:2]), p[:2], q[:2]) for p in all_points(a) for q in all_points(b)), default=None)
    for p in all_points(a):
        for t in sb:
            q = _nearest(p, t)
            best = min(best, (math.dist(p[:2], q), p[:2], q))
    for q in all_points(b):
        for s in sa:
            p = _nearest(q, s)
            best = min(best, (math.dist(p, q[:2]), p, q[:2]))
    return best


def simplify(r: list[tuple], tolerance: float) -> list[tuple]:
    """Douglas-Peucker."""
    if len(r) < 3:
        return r
    keep, todo = {0, len(r) - 1}, [(0, len(r) - 1)]
    while todo:
        i, j = todo.pop()
        far, at = max(((math.dist(r[k][:2], _nearest(r[k], (r[i], r[j]))), k) for k in range(i + 1, j)), default=(0.0, 0))
        if far > tolerance:
            keep.add(at)
            todo += [(i, at), (at, j)]
    return [r[k] for k in sorted(keep)]


# Relations --------------------------------------------------------------------------


def on_segment(p: tuple, s: tuple) -> bool:
    a, b = s
    scale = max(abs(a[0]), abs(a[1]), abs(b[0]), abs(b[1]), 1.0)
    return abs(cross(a, b, p)) <= EPS * scale * max(math.dist(a[:2], b[:2]), EPS) * 1e3 and min(a[0], b[0]) - EPS * scale <= p[0] <= max(a[0], b[0]) + EPS * scale and min(a[1], b[1]) - EPS * scale <= p[1] <= max(a[1], b[1]) + EPS * scale


def meet(s: tuple, t: tuple) -> list[tuple]:
    """Where two segments meet: no, one or (the ends of a shared stretch) two points."""
    (a, b), (c, d) = s, t
    if max(a[0], b[0]) < min(c[0], d[0]) or max(c[0], d[0]) < min(a[0], b[0]) or max(a[1], b[1]) < min(c[1], d[1]) or max(c[1], d[1]) < min(a[1], b[1]):
        return []
    out = {p[:2] for p, u in ((a, t), (b, t), (c, s), (d, s)) if on_segment(p, u)}
    if out:
        return sorted(out)
    den = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
    if den == 0:
        return []
    u = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / den
    v = ((c[0] - a[0]) * (b[1] - a[1]) - (c[1] - a[1]) * (b[0] - a[0])) / den
    return [(a[0] + u * (b[0] - a[0]), a[1] + u * (b[1] - a[1]))] if 0 <= u <= 1 and 0 <= v <= 1 else []


def _in_ring(p: tuple, r: list[tuple]) -> str:
    inside = False
    for a, b in zip(r, r[1:]):
        if on_segment(p, (a, b)):
            return "B"
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            inside = not inside
    return "I" if inside else "E"


def _line_ends(g: Geometry) -> set[tuple]:
    """Boundary of lines: ends that occur an odd number of times."""
    odd: set[tuple] = set()
    for k, d in parts(g):
        if k == "LineString" and d and d[0][:2] != d[-1][:2]:
            odd ^= {d[0][:2]}
            odd ^= {d[-1][:2]}
    return odd


def locate(p: tuple, g: Geometry) -> str:
    """Whether a point lies in the interior, on the boundary or in the exterior."""
    found = "E"
    for k, d in parts(g):
        if k == "Polygon" and d:
            w = _in_ring(p, d[0])
            if w == "I":
                for h in d[1:]:
                    x = _in_ring(p, h)
                    w = "E" if x == "I" else "B" if x == "B" else w
                    if x != "E":
                        break
        elif k == "LineString":
            w = "I" if any(on_segment(p, s) for s in zip(d, d[1:])) else "E"
            w = "B" if w == "I" and p[:2] in _line_ends(g) else w
        else:
            w = "I" if d is not None and p[:2] == d[:2] else "E"
        if w == "I":
            return "I"
        found = "B" if w == "B" else found
    return found


def inner_point(g: Geometry) -> tuple | None:
    """A point in the interior."""
    best: tuple = (-1.0, None)
    for k, d in parts(g):
        if k == "Polygon" and d:
            ys = sorted({p[1] for r in d for p in r})
            for y0, y1 in zip(ys, ys[1:]):
                y = (y0 + y1) / 2
                xs = sorted(a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for r in d for a, b in zip(r, r[1:]) if (a[1] > y) != (b[1] > y))
                for x0, x1 in zip(xs[::2], xs[1::2]):
                    best = max(best, (x1 - x0, ((x0 + x1) / 2, y)), key=lambda t: t[0])
    if best[1] is not None:
        return best[1]
    s = segments(g)
    if s:
        a, b = s[len(s) // 2]
        return (a[0] + b[0]) / 2, (a[1] + b[1]) / 2
    p = all_points(g)
    return p[0][:2] if p else None


def _pieces(g: Geometry, h: Geometry) -> list[tuple]:
    """Midpoints of the pieces into which g's segments are cut by h's segments and points."""
    out, other, pts = [], segments(h), [p for k, p in parts(h) if k == "Point" and p is not None]
    for s in segments(g):
        cuts = {s[0][:2], s[1][:2]} | {p for t in other for p in meet(s, t)} | {p[:2] for p in pts if on_segment(p, s)}
        line = sorted(cuts, key=lambda p: (p[0] - s[0][0]) ** 2 + (p[1] - s[0][1]) ** 2)
        out += [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in zip(line, line[1:]) if math.dist(a, b) > EPS]
    return out


def relate(a: Geometry, b: Geometry) -> set[str]:
    """Which of the parts I, B, E of ``a`` meet those of ``b``: a set such as {"II", "IE", "BB"}."""
    out: set[str] = set()
    for g, h, name in ((a, b, lambda x, y: x + y), (b, a, lambda x, y: y + x)):
        dim = dimension(g)
        ends = _line_ends(g)
        for p in all_points(g):
            mine = "B" if dim == 2 or p[:2] in ends else "I"
            out.add(name(mine, locate(p, h)))
        for p in _pieces(g, h):
            out.add(name("B" if dim == 2 else "I", w := locate(p, h)))
            if dim == 2 and w == "I" and dimension(h) == 2:
                out |= {"II", name("I", "I")}
            if dim == 2 and w == "E":
                out.add(name("I", "E"))  # near that piece, g's interior lies outside h as well
            if dim == 1 and w == "I" and dimension(h) == 2:
                out.add("II")
        if dim == 2 and (q := inner_point(g)):
            out.add(name("I", locate(q, h)))
            if dimension(h) < 2:
                out.add(name("I", "E"))
        for s in segments(g):
            for t in segments(h):
                for p in meet(s, t):
                    out.add(name(locate(p, g), locate(p, h)))
    if dimension(a) == 2 and dimension(b) == 2:
        if "BE" in out or "EB" in out or "BI" in out or "IB" in out:
            if "BI" in out or "IB" in out:
                out.add("II")
            if "BE" in out and "BI" not in out and "EB" not in out and "II" in out:
                out.add("IE")
        if "IB" in out:
            out.add("IE")  # b's boundary inside a: b's outside is there, too
        if "BI" in out:
            out.add("EI")
    elif dimension(a) == 2 and dimension(b) == 1 and "II" in out:
        out.add("IE")
    return out


def _met(r: set[str]) -> bool:
    return bool(r & {"II", "IB", "BI", "BB"})


def intersects(a: Geometry, b: Geometry) -> bool:
    x, y = bbox(a), bbox(b)
    if x is None or y is None or x[2] < y[0] or y[2] < x[0] or x[3] < y[1] or y[3] < x[1]:
        return False
    return _met(relate(a, b))


def covers(a: Geometry, b: Geometry) -> bool:
    return intersects(a, b) and not relate(a, b) & {"EI", "EB"}


def contains(a: Geometry, b: Geometry) -> bool:
    return covers(a, b) and "II" in relate(a, b)


def contains_properly(a: Geometry, b: Geometry) -> bool:
    r = relate(a, b)
    return "II" in r and not r & {"BI", "BB", "EI", "EB"}


def equals(a: Geometry, b: Geometry) -> bool:
    return is_empty(a) and is_empty(b) or (covers(a, b) and covers(b, a))


def touches(a: Geometry, b: Geometry) -> bool:
    return intersects(a, b) and "II" not in relate(a, b)


def crosses(a: Geometry, b: Geometry) -> bool:
    x, y = dimension(a), dimension(b)
    if not intersects(a, b) or (x, y) in ((0, 0), (2, 2)):
        return False
    r = relate(a, b)
    if x == y == 1:
        shared = any(locate(p, b) != "E" for p in _pieces(a, b))
        return "II" in r and not shared
    return "II" in r and (("IE" in r) if x < y else ("EI" in r))


def overlaps(a: Geometry, b: Geometry) -> bool:
    if dimension(a) != dimension(b) or not intersects(a, b):
        return False
    r = relate(a, b)
    if dimension(a) == 1 and not any(locate(p, b) != "E" for p in _pieces(a, b)):
        return False
    return "II" in r and "IE" in r and "EI" in r


def is_simple(g: Geometry) -> bool:
    if dimension(g) == 0:
        p = [q[:2] for q in all_points(g)]
        return len(p) == len(set(p))
    s = segments(g)
    for i, a in enumerate(s):
        for j in range(i + 1, len(s)):
            m = meet(a, s[j])
            ends = {a[0][:2], a[1][:2]} & {s[j][0][:2], s[j][1][:2]}
            if m and (len(m) > 1 or m[0] not in ends):
                return False
    return True


def is_valid(g: Geometry) -> bool:
    for k, d in parts(g):
        if k == "LineString" and d and len({p[:2] for p in d}) < 2:
            return False
        if k == "Polygon":
            if any(len(r) < 4 or r[0][:2] != r[-1][:2] or not is_simple(("LineString", r)) for r in d):
                return False
            if any(_in_ring(p, d[0]) == "E" for h in d[1:] for p in h):
                return False
    return True


def turned(r: list[tuple], clockwise: bool) -> list[tuple]:
    return r[::-1] if (ring_area(r) < 0) != clockwise else r


def normalized(g: Geometry) -> Geometry:
    """A canonical form: rings start at their least point, the outer one clockwise; parts are sorted."""

    def ring(r, clockwise):
        open_ = turned(r, clockwise)[:-1]
        at = open_.index(min(open_))
        out = open_[at:] + open_[:at]
        return [*out, out[0]]

    k, d = g
    if k == "Polygon":
        return k, [ring(d[0], True), *sorted((ring(h, False) for h in d[1:]), reverse=True)] if d else d
    if k == "LineString":
        return k, min(d, d[::-1])
    return g if k == "Point" else (k, sorted((normalized(x) for x in d), key=to_wkt, reverse=True))


# Geography --------------------------------------------------------------------------

# The WGS 84 ellipsoid, in metres.
MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563


def spheroid_distance(p: tuple, q: tuple) -> float:
    """Metres between two (longitude, latitude) points, by Vincenty's inverse formula; spherical where that does not converge."""
    if p[:2] == q[:2]:
        return 0.0
    b = MAJOR * (1 - FLATTENING)
    u1, u2 = (math.atan((1 - FLATTENING) * math.tan(math.radians(x[1]))) for x in (p, q))
    lon = lam = math.radians(q[0] - p[0])
    for _ in range(200):
        sl, cl = math.sin(lam), math.cos(lam)
        ss = math.hypot(math.cos(u2) * sl, math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * cl)
        if ss == 0:
            return 0.0
        cs = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * cl
        sig = math.atan2(ss, cs)
        sa = math.cos(u1) * math.cos(u2) * sl / ss
        c2 = 1 - sa * sa
        cm = cs - 2 * math.sin(u1) * math.sin(u2) / c2 if c2 else 0.0
        c = FLATTENING / 16 * c2 * (4 + FLATTENING * (4 - 3 * c2))
        new = lon + (1 - c) * FLATTENING * sa * (sig + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
        if abs(new - lam) < 1e-12:
            k = c2 * (MAJOR**2 - b**2) / b**2
            aa = 1 + k / 16384 * (4096 + k * (k * (320 - 175 * k) - 768))
            bb = k / 1024 * (256 + k * (k * (74 - 47 * k) - 128))
            ds = bb * ss * (cm + bb / 4 * (cs * (2 * cm * cm - 1) - bb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
            return b * aa * (sig - ds)
        lam = new
    a, c = (math.radians(x[1]) for x in (p, q))
    return 6371008.8 * math.acos(max(-1.0, min(1.0, math.sin(a) * math.sin(c) + math.cos(a) * math.cos(c) * math.cos(lon))))


def spheroid_length(g: Geometry, rings: bool = False) -> float:
    return sum(spheroid_distance(a, b) for k, d in parts(g) for r in (d if k == "Polygon" and rings else [d] if k == "LineString" and not rings else []) for a, b in zip(r, r[1:]))


def spheroid_area(g: Geometry) -> float:
    """Square metres, on the sphere of the ellipsoid's area (latitudes made authalic)."""
    e2 = FLATTENING * (2 - FLATTENING)
    e = math.sqrt(e2)
    qp = 1 + (1 - e2) / (2 * e) * math.log((1 + e) / (1 - e)) if e else 2.0

    def sin_authalic(lat: float) -> float:
        s = math.sin(math.radians(lat))
        return (1 - e2) * (s / (1 - e2 * s * s) + 1 / (2 * e) * math.log((1 + e * s) / (1 - e * s))) / qp

    r2 = MAJOR**2 * qp / 2

    def ring(r) -> float:
        total = 0.0
        for a, b in zip(r, r[1:]):
            # the edge is cut, so that the band under it is exact enough
            n = max(1, int(max(abs(b[0] - a[0]), abs(b[1] - a[1])) * 8))
            for i in range(n):
                y = a[1] + (b[1] - a[1]) * (i + 0.5) / n
                total += math.radians((b[0] - a[0]) / n) * sin_authalic(y)
        return abs(total) * r2

    return sum(ring(d[0]) - sum(map(ring, d[1:])) for k, d in parts(g) if k == "Polygon" and d)


def web_mercator(p: tuple, back: bool) -> tuple:
    if back:
        return math.degrees(p[0] / MAJOR), math.degrees(2 * math.atan(math.exp(p[1] / MAJOR)) - math.pi / 2)
    return MAJOR * math.radians(p[0]), MAJOR * math.log(math.tan(math.pi / 4 + math.radians(p[1]) / 2))


# Overlay ----------------------------------------------------------------------------


def _snap(p: tuple) -> tuple:
    return round(p[0], 9) + 0.0, round(p[1], 9) + 0.0


def _directed(g: Geometry) -> list[tuple]:
    """Edges of polygons with the interior to their left."""
    out = []
    for k, d in parts(g):
        for i, r in enumerate(d if k == "Polygon" else []):
            r = turned(r, clockwise=i > 0)
            out += [(_snap(a), _snap(b)) for a, b in zip(r, r[1:]) if _snap(a) != _snap(b)]
    return out


def _cut(edges: list[tuple], others: list[tuple]) -> list[tuple]:
    out = []
    for s in edges:
        cuts = {s[0], s[1]} | {_snap(p) for t in others for p in meet(s, t)}
        line = sorted(cuts, key=lambda p: (p[0] - s[0][0]) ** 2 + (p[1] - s[0][1]) ** 2)
        out += list(zip(line, line[1:]))
    return out


def _rings(edges: list[tuple]) -> list[list[tuple]]:
    """Closed rings of directed edges, each the tightest with its interior to the left."""
    after: dict[tuple, list[tuple]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    out = []
    for start in list(after):
        while after.get(start):
            ring = [start, after[start].pop()]
            while ring[-1] != start:
                ways = after.get(ring[-1])
                if not ways:
                    break  # an open end, which only rounding leaves
                back = math.atan2(ring[-2][1] - ring[-1][1], ring[-2][0] - ring[-1][0])
                best = min(ways, key=lambda q: (back - math.atan2(q[1] - ring[-1][1], q[0] - ring[-1][0])) % (2 * math.pi) or 2 * math.pi)
                ways.remove(best)
                ring.append(best)
            if ring[-1] == start and len(ring) > 3:
                out.append(ring)
    return out


def overlay(a: Geometry, b: Geometry, how: str) -> Geometry:
    """Union, intersection or difference of two polygonal geometries that are valid in themselves."""
    ea, eb = _directed(a), _directed(b)
    pa, pb = _cut(ea, eb), _cut(eb, ea)
    in_a, in_b = set(pa), set(pb)
    middle = lambda s: ((s[0][0] + s[1][0]) / 2, (s[0][1] + s[1][1]) / 2)
    kept = []
    for s in pa:
        if s in in_b:
            w = "same"
        elif (s[1], s[0]) in in_b:
            w = "opposite"
        else:
            w = locate(middle(s), b)
        if w in {"union": ("E", "same"), "intersection": ("I", "same"), "difference": ("E", "opposite")}[how]:
            kept.append(s)
    for s in pb:
        if s in in_a or (s[1], s[0]) in in_a:
            continue
        w = locate(middle(s), a)
        if how == "difference" and w == "I":
            kept.append((s[1], s[0]))
        elif how != "difference" and w == ("E" if how == "union" else "I"):
            kept.append(s)
    rings = _rings(kept)
    outer = [[r] for r in rings if ring_area(r) > 0]
    for h in (r for r in rings if ring_area(r) < 0):
        around = [o for o in outer if _in_ring(inner_point(("Polygon", [h])), o[0]) != "E"]
        if around:
            min(around, key=lambda o: ring_area(o[0])).append(h)
    return ("Polygon", outer[0] if outer else []) if len(outer) < 2 else ("MultiPolygon", [("Polygon", o) for o in outer])


def _chained(pieces: list[tuple]) -> Geometry:
    lines: list[list[tuple]] = []
    for a, b in pieces:
        if lines and lines[-1][-1] == a:
            lines[-1].append(b)
        else:
            lines.append([a, b])
    return ("LineString", lines[0] if lines else []) if len(lines) < 2 else ("MultiLineString", [("LineString", r) for r in lines])


def combine(a: Geometry, b: Geometry, how: str) -> Geometry:
    """Overlay of geometries of any one dimension each; what falls short of the result's dimension is left out."""
    da, db = dimension(a), dimension(b)
    if is_empty(a) or is_empty(b):
        return {"union": b if is_empty(a) else a, "intersection": b if is_empty(b) else a, "difference": a}[how]
    if da == db == 2:
        return overlay(a, b, how)
    if how == "union":
        rest = combine(a, b, "difference") if da < db else a
        other = b if da < db else combine(b, a, "difference") if db < da else combine(b, a, "difference")
        both = [g for x in (rest, other) for g in parts(x) if not is_empty(g)]
        return both[0] if len(both) == 1 else collected(both)
    if how == "intersection" and db < da:
        a, b, da = b, a, db
    keep = (lambda p: locate(p, b) != "E") if how == "intersection" else (lambda p: locate(p, b) == "E")
    if da == 0:
        pts = [("Point", p) for p in sorted({q[:2] for q in all_points(a)}) if keep(p)]
        return pts[0] if len(pts) == 1 else ("MultiPoint", pts)
    if da == 1:
        pieces = _cut([(_snap(s[0]), _snap(s[1])) for s in segments(a)], segments(b))
        return _chained([s for s in pieces if keep(((s[0][0] + s[1][0]) / 2, (s[0][1] + s[1][1]) / 2))])
    return a  # a surface less a line or point


def merged_lines(g: Geometry) -> Geometry:
    """Lines joined at ends that exactly two of them share."""
    lines = [list(map(_snap, r)) for k, r in parts(g) if k == "LineString" and len(r) > 1]
    joined = True
    while joined:
        joined, ends = False, {}
        for i, r in enumerate(lines):
            for p in (r[0], r[-1]):
                ends.setdefault(p, []).append(i)
        for p, at in ends.items():
            if len(at) == 2 and at[0] != at[1]:
                x, y = lines[at[0]], lines[at[1]]
                x = x if x[-1] == p else x[::-1]
                y = y if y[0] == p else y[::-1]
                lines = [r for i, r in enumerate(lines) if i not in at] + [x + y[1:]]
                joined = True
                break
    return ("LineString", lines[0] if lines else []) if len(lines) < 2 else ("MultiLineString", [("LineString", r) for r in lines])

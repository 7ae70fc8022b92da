"""Geometry on the unit 3-sphere as column expressions. A point is four columns, in the order x, y, z, w.

Everything here stays inside generated code; bit-level curves and hashes are in ``curves``."""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Point = Sequence[Column]
#: The golden ratio and the plastic number (the real root of p**3 = p + 1).
PHI = (1 + math.sqrt(5)) / 2
PSI = 1.32471795724474602596


def point(prefix: str = "") -> list[Column]:
    return [F.col(prefix + c) for c in "xyzw"]


def dot(a: Point, b: Point) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])


def norm(a: Point) -> Column:
    return F.sqrt(dot(a, a))


def euclidean(a: Point, b: Point) -> Column:
    d = [x - y for x, y in zip(a, b, strict=True)]
    return norm(d)


def geodesic(a: Point, b: Point) -> Column:
    """Angle between unit vectors; the product is held to [-1, 1], as rounding may carry it outside."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


def geodesic_fast(a: Point, b: Point) -> Column:
    return 2 * F.asin(F.least(F.lit(1.0), euclidean(a, b) / 2))


def within(a: Point, b: Point, distance: float | Column) -> Column:
    return geodesic(a, b) <= distance


def chord_bound(radius: float) -> float:
    """Straight-line distance of points ``radius`` apart on the sphere: a cheap necessary condition."""
    return 2 * math.sin(radius / 2)


def is_valid(a: Point, tolerance: float = 1e-10) -> Column:
    return F.abs(norm(a) - 1) < tolerance


def normalize(a: Point, zero: Sequence[float] | None = None) -> list[Column]:
    """To length one; a zero vector stays as it is, or becomes ``zero``."""
    size = norm(a)
    return [F.when(size == 0, x if zero is None else F.lit(float(z))).otherwise(x / size) for x, z in zip(a, zero or (0, 0, 0, 0), strict=True)]


def interpolate(a: Point, b: Point, t: float | Column) -> list[Column]:
    """Along the great circle; straight where the points are closer than 1e-10. Antipodal points have no one such circle."""
    angle = geodesic(a, b)
    s = F.sin(angle)
    fa, fb = F.sin((1 - F.lit(t)) * angle) / F.nullif(s, F.lit(0.0)), F.sin(F.lit(t) * angle) / F.nullif(s, F.lit(0.0))
    return [F.when(angle < 1e-10, x + (y - x) * F.lit(t)).otherwise(x * fa + y * fb) for x, y in zip(a, b, strict=True)]


def hopf(a: Point) -> list[Column]:
    """(|z1|^2 - |z2|^2, 2 Re z1 z2*, 2 Im z1 z2*) for z1 = x + iy, z2 = z + iw."""
    x, y, z, w = a
    return [x * x + y * y - z * z - w * w, 2 * (x * z + y * w), 2 * (y * z - x * w)]


def hopf_inverse(s: Sequence[Column], angle: Column) -> list[Column]:
    """The point over ``s`` (on the 2-sphere) at ``angle`` on its fibre."""
    r1, r2 = F.sqrt(F.greatest(F.lit(0.0), (1 + s[0]) / 2)), F.sqrt(F.greatest(F.lit(0.0), (1 - s[0]) / 2))
    phase = angle - F.atan2(s[2], s[1])
    return [r1 * F.cos(angle), r1 * F.sin(angle), r2 * F.cos(phase), r2 * F.sin(phase)]


def spiral(i: Column, n: int | Column) -> list[Column]:
    """The ``i``-th of ``n`` evenly spread points: a Fibonacci spiral on the 2-sphere lifted by a second irrational angle."""
    t = (i + 0.5) / n
    y = 1 - 2 * t
    r = F.sqrt(F.greatest(F.lit(0.0), 1 - y * y))
    turn = 2 * math.pi * PHI * t
    return hopf_inverse([r * F.cos(turn), y, r * F.sin(turn)], 2 * math.pi * PSI * t)


def codepoint_point(cp: Column) -> list[Column]:
    """A codepoint's placeholder position, of length one by construction."""
    theta, phi, psi = math.pi * cp / 1114111, 2 * math.pi * (cp % 360) / 360, math.pi * (cp % 180) / 180
    half = theta / 2
    return [F.cos(half) * F.cos((phi + psi) / 2), F.cos(half) * F.sin((phi + psi) / 2), F.sin(half) * F.cos((phi - psi) / 2), F.sin(half) * F.sin((phi - psi) / 2)]


def to_cube(a: Point) -> list[Column]:
    return [(x + 1) / 2 for x in a]


def box_distance(a: Point, low: Point, high: Point) -> Column:
    return norm([F.greatest(lo - x, F.lit(0.0), x - hi) for x, lo, hi in zip(a, low, high, strict=True)])


def boxes_meet(low1: Point, high1: Point, low2: Point, high2: Point) -> Column:
    return _all([(a <= d) & (c <= b) for a, b, c, d in zip(low1, high1, low2, high2, strict=True)])


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def centroid(prefix: str = "") -> list[Column]:
    """Aggregates: the mean of the group's points carried back to the sphere; (1, 0, 0, 0) where the mean is zero."""
    return normalize([F.avg(prefix + c) for c in "xyzw"], (1, 0, 0, 0))


def centroid_of_numbers(a: Column) -> Column:
    """Of an array x1, y1, z1, w1, x2, ...: the mean point on the sphere as (x, y, z, w). Empty gives null; a length that four
    does not divide raises."""
    mean = lambda k: F.aggregate(F.sequence(F.lit(0), F.floor(F.size(a) / 4).cast("int") - 1), F.lit(0.0), lambda s, i: s + F.get(a, (4 * i + k).cast("int")).cast("double")) / (F.size(a) / 4)
    made = F.struct(*[c.alias(n) for c, n in zip(normalize([mean(k) for k in range(4)], (1, 0, 0, 0)), "xyzw", strict=True)])
    return F.when(F.size(a) % 4 != 0, F.raise_error(F.lit("length is not a multiple of 4"))).when(F.size(a) > 0, made)


def bounds(prefix: str = "") -> list[Column]:
    return [f(prefix + c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyzw"]


def tortuosity(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Per ``key``: length of the path through its points in ``order`` over the distance of its ends; 0 for none or a closed path."""
    w = Window.partitionBy(key).orderBy(order)
    step = rows.withColumn("_step", geodesic(point(), [F.lag(c).over(w) for c in "xyzw"]))
    ends = step.groupBy(key).agg(F.sum("_step").alias("_length"), *[f(F.struct(*[F.col(c) for c in "xyzw"]), F.col(order)).alias(n) for n, f in (("_first", F.min_by), ("_last", F.max_by))])
    apart = geodesic([F.col(f"_first.{c}") for c in "xyzw"], [F.col(f"_last.{c}") for c in "xyzw"])
    return ends.select(key, F.when(apart > 0, F.coalesce("_length", F.lit(0.0)) / apart).otherwise(0.0).alias("tortuosity"))


def _field(p: Column) -> list[Column]:
    return [p[c] for c in "xyzw"]


def path_tortuosity(path: Column) -> Column:
    """Of an array of points: planar length over the 4-D distance of the ends; 1 if the length is 0; the length if the ends meet."""
    n = F.size(path)
    step = lambda i: F.sqrt(F.pow(F.get(path, i)["x"] - F.get(path, i - 1)["x"], 2) + F.pow(F.get(path, i)["y"] - F.get(path, i - 1)["y"], 2))
    length = F.when(n > 1, F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), lambda s, i: s + step(i))).otherwise(0.0)
    apart = euclidean(_field(F.get(path, F.lit(0))), _field(F.get(path, n - 1)))
    return F.when(length == 0, 1.0).when(apart == 0, length).otherwise(length / apart)


def hausdorff(a: Column, b: Column) -> Column:
    """Of two arrays of points, with straight 4-D distances."""
    one = lambda p, q: F.array_max(F.transform(p, lambda x: F.array_min(F.transform(q, lambda y: euclidean(_field(x), _field(y))))))
    return F.greatest(one(a, b), one(b, a))


def frechet(a: Column, b: Column) -> Column:
    """Discrete Fréchet distance of two arrays of points with geodesic steps: rows of the table of least leashes, folded."""
    d = lambda p, q: geodesic(_field(p), _field(q))
    first = F.aggregate(b, F.array().cast("array<double>"), lambda row, q: F.array_append(row, F.greatest(d(F.get(a, F.lit(0)), q), F.coalesce(F.array_max(row), F.lit(0.0)))))

    def next_row(row: Column, p: Column) -> Column:
        leash = lambda out, i: F.greatest(d(p, F.get(b, i)), F.when(i == 0, F.get(row, F.lit(0))).otherwise(F.least(F.get(row, i), F.get(row, i - 1), F.get(out, i - 1))))
        return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), F.array().cast("array<double>"), lambda out, i: F.array_append(out, leash(out, i)))

    rest = F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.element_at(F.aggregate(rest, first, next_row), -1))


def decimate(path: Column, most: int = 16) -> Column:
    """At most ``most`` of an array's items, evenly chosen with both ends."""
    n = F.size(path)
    return F.when(n <= most, path).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(path, F.floor(i * (n - 1) / (most - 1)).cast("int"))))

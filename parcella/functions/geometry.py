"""Geometry as Column builders: plain arithmetic over flat DOUBLE columns, so that Catalyst folds, prunes and compiles it."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

Axis = tuple[Column, Column, Column]
#: Parameters of a camera model by its id, and the models with one focal length: fixed values of the file format and of the
#: readers that this engine must agree with.
PARAMETERS = {0: 3, 1: 4, 2: 4, 3: 5, 4: 8, 5: 8, 6: 12, 7: 5, 8: 4, 9: 5, 10: 12}
ONE_FOCAL, ONE_FOCAL_STRICT = (0, 2, 8), (0, 2, 3, 8, 9)
#: By how much a view's half angles are widened.
WIDEN = 1.05


def total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def dot(a: Axis, b: Axis) -> Column:
    return total([x * y for x, y in zip(a, b)])


def axis(*names: str) -> Axis:
    return tuple(F.col(n) for n in names)  # type: ignore[return-value]


def rotation(w: Column, x: Column, y: Column, z: Column) -> list[list[Column]]:
    """World-to-camera matrix of a unit quaternion."""
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def normalised(*parts: Column) -> list[Column]:
    """The parts over their length, which must not be zero."""
    length = F.sqrt(total([p * p for p in parts]))
    return [F.when(length == 0, F.raise_error(F.lit("a quaternion has no length")).cast("double")).otherwise(p / length) for p in parts]


def centre(rows: list[list[Column]], t: Axis) -> list[Column]:
    """A camera's place, -R'T."""
    return [-total([rows[k][j] * t[k] for k in range(3)]) for j in range(3)]


def focal(model: Column, params: Column, strict: bool = False) -> tuple[Column, Column]:
    """fx and fy. By default models 3 and 9 take their second parameter for fy, as existing scenes were assigned that way."""
    single = model.isin(*(ONE_FOCAL_STRICT if strict else ONE_FOCAL))
    return params[0], F.when(single, params[0]).otherwise(params[1])


class Frame:
    """A ground frame: rows u, v, h in world axes, and an origin."""

    def __init__(self, rows: list[list[float]], origin: list[float]) -> None:
        self.rows, self.origin = rows, origin

    def to_ground(self, p: Axis) -> list[Column]:
        off = [x - F.lit(float(o)) for x, o in zip(p, self.origin)]
        return [total([d * F.lit(float(r)) for d, r in zip(off, row)]) for row in self.rows]

    def to_world(self, p: Axis) -> list[Column]:
        return [total([x * F.lit(float(self.rows[k][j])) for k, x in enumerate(p)]) + F.lit(float(self.origin[j])) for j in range(3)]

    def turned(self, a: Axis) -> list[Column]:
        """A direction of the world in ground axes."""
        return [total([x * F.lit(float(r)) for x, r in zip(a, row)]) for row in self.rows]


def acute_angle(a: Axis, b: Axis) -> Column:
    cosine = dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))
    return F.degrees(F.acos(F.least(F.lit(1.0), F.abs(cosine))))


class Box:
    """Bounds as six columns, named by a prefix: <prefix>_u0, _v0, _h0 and _u1, _v1, _h1."""

    def __init__(self, prefix: str) -> None:
        self.low = axis(*(f"{prefix}_{a}0" for a in "uvh"))
        self.high = axis(*(f"{prefix}_{a}1" for a in "uvh"))

    def holds(self, p: Axis) -> Column:
        """Closed on all sides."""
        return reduce(lambda a, b: a & b, [(x >= lo) & (x <= hi) for x, lo, hi in zip(p, self.low, self.high)])

    def owns(self, p: Axis, outer: Axis) -> Column:
        """Closed below and open above, but for faces on the outer bound of all blocks."""
        return reduce(lambda a, b: a & b, [(x >= lo) & ((x < hi) | ((hi == out) & (x == hi))) for x, lo, hi, out in zip(p, self.low, self.high, outer)])

    def overlap(self, other: Box) -> list[Column]:
        return [F.least(a, b) - F.greatest(c, d) for a, b, c, d in zip(self.high, other.high, self.low, other.low)]

    def overlaps(self, other: Box) -> Column:
        return reduce(lambda a, b: a & b, [e > 0 for e in self.overlap(other)])


def affine(m: list[float], p: Axis) -> list[Column]:
    """p under a 4x4 matrix in column-major order, divided by w, which must not vanish."""
    row = lambda k: total([p[j] * F.lit(float(m[4 * j + k])) for j in range(3)]) + F.lit(float(m[12 + k]))
    w = row(3)
    w = F.when(F.abs(w) <= 1e-12, F.raise_error(F.lit("a point has no finite image")).cast("double")).otherwise(w)
    return [row(k) / w for k in range(3)]


def view_slopes(fx: Column, fy: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Tangents of the widened half angles; focal lengths and sizes must be positive."""
    bad = (fx <= 0) | (fy <= 0) | (width <= 0) | (height <= 0)
    side = lambda f, n: F.when(bad, F.raise_error(F.lit("focal lengths and sizes must be positive")).cast("double")).otherwise(F.tan(F.lit(WIDEN) * F.atan(n / (2 * f))))
    return side(fx, width), side(fy, height)


def view_meets_box(r: list[Axis], c: Axis, tx: Column, ty: Column, near: float | Column, far: float | Column, box: Box) -> Column:
    """Whether a view's frustum and a box may meet, by eight separating axes.

    r: right, down and forward of the camera, and c its centre, in the box's axes. The intervals of the frustum on these
    axes follow from near, far and the slopes; no corners are needed. Box axes come first, as they tell most apart.
    """
    near, far = (x if isinstance(x, Column) else F.lit(float(x)) for x in (near, far))
    mid = [(a + b) / 2 for a, b in zip(box.low, box.high)]
    half = [(b - a) / 2 for a, b in zip(box.low, box.high)]
    off = [m - x for m, x in zip(mid, c)]
    bound = F.greatest(F.lit(1.0), *[F.abs(x) for x in (*box.low, *box.high)], *[F.abs(x) + far * (1 + tx + ty) for x in c])
    eps = bound * 1e-12
    tests = []
    for j in range(3):
        spread = tx * F.abs(r[0][j]) + ty * F.abs(r[1][j])
        low, high = r[2][j] - spread, r[2][j] + spread
        tests.append((F.greatest(near * high, far * high) >= off[j] - half[j] - eps) & (F.least(near * low, far * low) <= off[j] + half[j] + eps))

    def interval(a: list[Column], low: Column, high: Column, length: Column) -> Column:
        at = total([x * y for x, y in zip(a, off)])
        reach = total([e * F.abs(x) for e, x in zip(half, a)])
        return (high >= at - reach - eps * length) & (low <= at + reach + eps * length)

    tests.append(interval(list(r[2]), near, far, F.lit(1.0)))
    zero = F.lit(0.0)
    for row, t, other in ((r[0], tx, ty), (r[1], ty, tx)):
        length = F.sqrt(1 + t * t)
        # with near planes this small the side axes have no direction and are left out
        vanishes = 2 * other * near * near * length <= F.lit(2.220446049250313e-16)
        plus, minus = [x + t * f for x, f in zip(row, r[2])], [x - t * f for x, f in zip(row, r[2])]
        tests.append(vanishes | interval(plus, zero, 2 * far * t, length))
        tests.append(vanishes | interval(minus, -2 * far * t, zero, length))
    return reduce(lambda a, b: a & b, tests)


#: Corners of a box by number: bit 0 is u, bit 1 v, bit 2 h. Edges join corners that differ in one bit.
CORNERS = [tuple(n >> k & 1 for k in range(3)) for n in range(8)]
EDGES = sorted((a, b) for a, b in product(range(8), repeat=2) if a < b and bin(a ^ b).count("1") == 1)



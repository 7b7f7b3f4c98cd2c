from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcella.functions.geometry import EDGES, Frame
from parcella.operators import blocks
from parcella.plans.scene import IDENTITY

POSE = "camera_index long, x double, y double, z double, r00 double, r01 double, r02 double, r10 double, r11 double, r12 double, r20 double, r21 double, r22 double, fx double, fy double, width int, height int"


def pose(spark, f=100.0, rows=((1, 0, 0), (0, 1, 0), (0, 0, 1))):
    flat = [float(x) for r in rows for x in r]
    return blocks.in_ground(spark.createDataFrame([(0, 0.0, 0.0, 0.0, *flat, f, f, 200, 200)], POSE), IDENTITY, slopes=True)


def box(spark, *rows):
    names = ", ".join(f"{p}_{a}{k} double" for p in ("core", "context") for k in (0, 1) for a in "uvh")
    return spark.createDataFrame([(n, *map(float, low), *map(float, high), *map(float, low), *map(float, high)) for n, (low, high) in enumerate(rows)], "block_id int, " + names)


def corner_axes(rows, f, near, far):
    """Corners of a widened view from the origin, and eight directions that may part it from a box."""
    t = np.tan(1.05 * np.arctan(100 / f))
    corners = np.array([[sx * t * d, sy * t * d, d] for d in (near, far) for sx in (-1, 1) for sy in (-1, 1)]) @ rows
    right, down, forward = rows
    return corners, [*np.eye(3), forward, right + t * forward, right - t * forward, down + t * forward, down - t * forward]


def test_views_meet_boxes_as_their_corners_say(spark):
    rng = np.random.default_rng(11)
    met = 0
    for _ in range(6):
        q, r = np.linalg.qr(rng.standard_normal((3, 3)))
        rows = q * np.sign(np.diag(r))
        rows[0] *= np.sign(np.linalg.det(rows))
        f, near, far = rng.uniform(60, 300), rng.uniform(0.2, 2), rng.uniform(4, 15)
        low = rng.uniform(-12, 10, (60, 3))
        high = low + rng.uniform(0.1, 4, (60, 3))
        found = {r["block_id"] for r in blocks.assign_by_view(pose(spark, f, rows), box(spark, *zip(low.tolist(), high.tolist())), near, far).collect()}
        corners, axes = corner_axes(rows, f, near, far)
        for n, (lo, hi) in enumerate(zip(low, high)):
            ends = np.array([[(lo, hi)[bits >> k & 1][k] for k in range(3)] for bits in range(8)])
            apart = any((corners @ a).max() < (ends @ a).min() or (corners @ a).min() > (ends @ a).max() for a in axes)
            assert (n in found) == (not apart or bool((lo <= 0).all() and (hi >= 0).all()))
        met += len(found)
    assert 20 < met < 300


def test_the_sweep_finds_each_planes_own_pairs(spark):
    rng = np.random.default_rng(4)
    low = rng.uniform(-6, 6, (40, 3))
    some = box(spark, *zip(low.tolist(), (low + 1).tolist()))
    one = pose(spark, 90.0)
    swept = {r["far"]: r for r in blocks.sweep_far_plane(one, some, 0.5, [2.0, 8.0, 4.0], 100.0, 0).collect()}
    for far, r in swept.items():
        assert r["max_blocks"] == blocks.assign_by_view(one, some, 0.5, far).count() == r["mean_blocks"]
    inside = sum(bool((x <= 0).all() and (x + 1 >= 0).all()) for x in low)
    assert len(swept) == 3 and all((r["orphans"], r["multi_owned"]) == (int(inside == 0), int(inside > 1)) for r in swept.values())


def test_view_never_loses_a_centre(spark):
    inside = box(spark, ((-0.1, -0.1, -0.1), (0.05, 0.05, 0.05)))
    assert blocks.assign_by_view(pose(spark), inside, 1.0, 10.0).count() == 1


def test_bad_focal_length_is_an_error_on_the_view_path_only(spark):
    bad = pose(spark, f=-1.0)
    with pytest.raises(Exception, match="positive"):
        blocks.assign_by_view(bad, box(spark, ((0, 0, 5), (1, 1, 6))), 1.0, 10.0).count()
    assert blocks.assign_by_centre(bad, box(spark, ((-1, -1, -1), (1, 1, 1)))).count() == 1


def test_ownership_is_half_open_then_closed_then_nobody(spark):
    two = box(spark, ((0, 0, 0), (1, 1, 1)), ((1, 0, 0), (2, 1, 1)))
    places = spark.createDataFrame([(k, float(k), 0.5, 0.5) for k in range(4)], "splat_id long, u double, v double, h double")
    got = {r["splat_id"]: r["owner"] for r in blocks.owners(places, two, "splat_id").collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: -1}


def test_the_two_half_open_rules_differ_on_a_shared_face_at_the_outer_bound(spark):
    two = box(spark, ((0, 0, 0), (1, 1, 1)), ((1, 0, 0), (2, 1, 1)))
    place = spark.createDataFrame([(0, 1.0, 1.0, 0.5)], "camera_index long, u double, v double, h double")
    assert blocks.owners(place, two, "camera_index").first()["owner"] == 0
    assert blocks.partition_owners(place, two).first()["owners"] == 1


def test_a_place_that_is_not_finite_is_an_error(spark):
    places = spark.createDataFrame([(0, float("nan"), 0.0, 0.0)], "splat_id long, u double, v double, h double")
    with pytest.raises(Exception, match="finite"):
        blocks.owners(places, box(spark, ((0, 0, 0), (1, 1, 1))), "splat_id").collect()


def test_grid_join_equals_broadcast_join(spark):
    import random

    rng = random.Random(3)
    rows = spark.createDataFrame([(k, rng.uniform(-5, 5), rng.uniform(-5, 5), 0.0) for k in range(500)], "camera_index long, u double, v double, h double")
    some = []
    for _ in range(30):
        u, v = rng.uniform(-5, 4), rng.uniform(-5, 4)
        some.append(((u, v, -1), (u + rng.uniform(0, 3), v + rng.uniform(0, 3), 1)))
    b = box(spark, *some)
    plain = {tuple(r) for r in blocks.range_join(rows, b, "context").select("camera_index", "block_id").collect()}
    grid = [tuple(r) for r in blocks.range_join(rows, b, "context", cell=0.7).select("camera_index", "block_id").collect()]
    assert len(grid) == len(plain) and set(grid) == plain and plain


def test_frame_goes_there_and_back(spark):
    f = Frame([[0.8, 0.6, 0.0], [-0.6, 0.8, 0.0], [0.0, 0.0, 1.0]], [1.0, 2.0, 3.0])
    df = spark.createDataFrame([(4.0, 5.0, 6.0)], "x double, y double, z double")
    g = df.select(*(c.alias(n) for n, c in zip("uvh", f.to_ground(tuple(F.col(c) for c in "xyz")))))
    back = g.select(*f.to_world(tuple(F.col(c) for c in "uvh"))).first()
    assert [round(x, 9) for x in back] == [4.0, 5.0, 6.0]


def test_kept_points_equal_a_loop_over_random_tracks(spark):
    import random

    rng = random.Random(9)
    places = {p: tuple(rng.uniform(-2, 2) for _ in range(3)) for p in range(40)}
    seen = [(rng.randrange(40), rng.randrange(12), k) for k in range(160)] + [(0, 1, 900), (0, 1, 901)]
    places[0] = (0.1, 0.2, 0.3)
    own = {0: {1, 2, 3, 4}, 1: {4, 5, 6, 7, 8}}
    b = box(spark, ((-1, -1, -1), (1.5, 1, 1)), ((0, -2, -2), (2, 2, 2)))
    limits = {0: ((-1, -1, -1), (1.5, 1, 1)), 1: ((0, -2, -2), (2, 2, 2))}
    points = spark.createDataFrame([(p, *x) for p, x in places.items()], "point_id long, u double, v double, h double")
    observations = spark.createDataFrame(seen, "point_id long, image_id long, point2d int")
    members = spark.createDataFrame([(n, i) for n, ids in own.items() for i in ids], "block_id int, image_id long")
    got = {(r["block_id"], r["point_id"]): r["entries"] for r in blocks.block_points(blocks.kept_observations(points, observations, b, members)).collect()}
    want = {}
    for n, (lo, hi) in limits.items():
        for p, x in places.items():
            entries = sum(q == p and i in own[n] for q, i, _ in seen)  # entries count, not distinct images
            if entries >= 2 and all(a <= y <= z for a, y, z in zip(lo, x, hi)):
                want[n, p] = entries
    assert got == want and (0, 0) in got and len(got) > 4


def test_twelve_edges():
    assert len(EDGES) == 12

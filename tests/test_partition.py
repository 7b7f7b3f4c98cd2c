from __future__ import annotations

import math
import random

import numpy as np
import pytest

from parcella.functions.ordered import numbered, with_previous
from parcella.operators import frames, partition
from parcella.operators.partition import Core

def wandering(n=80, seed=3):
    """A walk whose heading drifts, with a bound on its steps."""
    rng = random.Random(seed)
    at, heading, out = [0.0, 0.0], 0.0, []
    for _ in range(n):
        heading += rng.gauss(0, 0.4)
        at = [at[0] + math.cos(heading), at[1] + 0.7 * math.sin(heading)]
        out.append(tuple(at))
    return out


SHAPES = {
    "lane": [(1.5 * k, 0.25 * (k % 3)) for k in range(61)],
    "spiral": [(0.15 * k * math.cos(0.35 * k), 0.15 * k * math.sin(0.35 * k)) for k in range(90)],
    "walk": wandering(),
}
LIMITS = 14, 9.0


def table(spark, points, shuffle=False):
    rows = [(k, float(u), float(v)) for k, (u, v) in enumerate(points)]
    if shuffle:
        random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "camera_index long, u double, v double")


@pytest.mark.parametrize("name", SHAPES)
def test_kd_leaves_keep_limits_and_do_not_overlap(spark, name):
    owned, bounds = partition.kd_partition(table(spark, SHAPES[name]), *LIMITS, 2.0)
    groups = {}
    for r in owned.collect():
        groups.setdefault(r["block_id"], []).append((r["u"], r["v"]))
    assert sum(map(len, groups.values())) == len(SHAPES[name])
    for b, at in groups.items():
        assert 3 <= len(at) <= LIMITS[0] and np.ptp(np.array(at), axis=0).max() <= LIMITS[1]
        box = bounds[b]
        assert all(box["u0"] <= u <= box["u1"] and box["v0"] <= v <= box["v1"] for u, v in at)
    for a in bounds:
        for b in bounds:
            if a["block_id"] < b["block_id"]:
                assert min(a["u1"], b["u1"]) <= max(a["u0"], b["u0"]) or min(a["v1"], b["v1"]) <= max(a["v0"], b["v0"])


def test_kd_does_not_depend_on_row_order(spark):
    a = partition.kd_partition(table(spark, SHAPES["spiral"]), *LIMITS)[0]
    b = partition.kd_partition(table(spark, SHAPES["spiral"], shuffle=True), *LIMITS)[0]
    key = lambda df: sorted((r["camera_index"], r["block_id"]) for r in df.collect())
    assert key(a) == key(b)


def test_kd_on_the_sorted_path_equals_the_windowed_one(spark, monkeypatch):
    a = partition.kd_partition(table(spark, SHAPES["walk"]), *LIMITS)[1]
    monkeypatch.setattr(partition, "IN_TASK", 10)
    assert partition.kd_partition(table(spark, SHAPES["walk"]), *LIMITS)[1] == a


def test_kd_that_cannot_split_is_an_error(spark):
    with pytest.raises(ValueError, match="can't be split"):
        partition.kd_partition(table(spark, [(0.0, 0.0)] * 10), 5, 12.0)


def test_splits_are_told_in_the_order_of_leaves(spark):
    points = [(float(k), 0.0) for k in range(12)]
    _, bounds, cuts = partition.kd_tree(table(spark, points), 4, 100.0)
    assert partition.split_actions([b["leaf"] for b in bounds], cuts) == ["spatial_split(0,u,5.5)", "spatial_split(0,u,2.5)", "spatial_split(2,u,8.5)"]


def placed(spark, rows):
    return spark.createDataFrame([(n, *map(float, p), leaf) for n, (p, leaf) in enumerate(rows)], "camera_index long, u double, v double, h double, leaf int")


def test_deoverlap_trims_merges_and_reclaims(spark):
    west = [(1, 1, 0), (2, 2, 0), (3, 1, 0)]
    east = [(7, 1, 0), (8, 2, 0), (9, 1, 0)]
    at = placed(spark, [(p, 0) for p in west] + [(p, 1) for p in east])
    a = Core((0.0, 0.0, -1.0), (6.0, 4.0, 5.0), 3, (1.0, 3.0, 1.0, 2.0), (0,))
    b = Core((4.0, 0.0, -1.0), (10.0, 4.0, 5.0), 3, (7.0, 9.0, 1.0, 2.0), (1,))
    (one, two), actions = partition.deoverlap([a, b], at, 4, 20.0, 0.5, (-1.0, 5.0), 1.0)
    assert one.high[0] == two.low[0] == 5.0 and actions == ["trim(0,1,u,5)"] and one.origin == two.origin == "trimmed(u)"
    (whole,), actions = partition.deoverlap([a, b], at, 6, 20.0, 0.5, (-1.0, 5.0), 1.0)
    assert whole.leaves == (0, 1) and whole.low == (0.5, 0.5, -1.0) and actions == ["merge(0,1)"] and whole.origin == "merged(0,1)"
    # the narrowest axis may be the height
    c = Core((0.0, 0.0, 4.5), (6.0, 4.0, 9.0), 3, (1.0, 3.0, 1.0, 2.0), (1,))
    low, high = placed(spark, [(p, 0) for p in west]), [(x, y, 6) for x, y, _ in west]
    (x, y), actions = partition.deoverlap([a, c], low.unionByName(placed(spark, [((0, 0, 0), 9)] * 3 + [(p, 1) for p in high]).where("leaf = 1")), 4, 1.0, 0.5, (-1.0, 5.0), 1.0)
    assert actions == ["trim(0,1,h,4.75)"] and x.high[2] == y.low[2] == 4.75
    # a camera outside its core comes back, and owners are looked for before doubles are complained about
    (grown,), actions = partition.deoverlap([a], placed(spark, [((1, 1, 0), 0), ((7, 1, 0), 0)]), 4, 20.0, 0.5, (-1.0, 5.0), 1.0)
    assert grown.high == (7.0, 4.0, 5.0) and actions == ["reclaim(1)"] and grown.origin == "spatial"
    with pytest.raises(ValueError, match="0 blocks"):
        partition.deoverlap([a], placed(spark, [((9, 1, 0), 5)]), 4, 20.0, 0.5, (-1.0, 5.0), 1.0)


def test_sequential_groups_close_at_limits_and_the_tail_joins(spark):
    line = [(0.5 * k, 0.0) for k in range(53)]
    got, actions, warnings = partition.sequential(table(spark, line), 10, 100.0, slack=1.0)
    assert sorted(r["count"] for r in got.groupBy("group_id").count().collect()) == [3, 10, 10, 10, 10, 10] and not actions and not warnings  # no stub
    joined, actions, warnings = partition.sequential(table(spark, line[:52]), 10, 100.0, slack=1.5)
    assert max(r["count"] for r in joined.groupBy("group_id").count().collect()) == 12 and actions == ["merge_tail(4,5)"] and not warnings


def test_a_small_tail_that_cannot_join_stays_or_fails(spark):
    line = [(float(k), 0.0) for k in range(64)]
    kept, actions, warnings = partition.sequential(table(spark, line), 20, 1000.0)
    assert sorted(r["count"] for r in kept.groupBy("group_id").count().collect()) == [4, 20, 20, 20] and not actions and len(warnings) == 1
    with pytest.raises(ValueError, match="2 cameras"):
        partition.sequential(table(spark, line[:22]), 20, 1000.0)
    with pytest.raises(ValueError, match="2 cameras"):  # a quarter of the limit, hence no stub, but too few all the same
        partition.sequential(table(spark, line[:10]), 8, 1000.0)


def test_the_composition_owns_every_camera_once(spark):
    points = SHAPES["walk"]
    images = spark.createDataFrame([(k, f"f{k:05d}", u, v, 0.0) for k, (u, v) in enumerate(points)], "image_id long, name string, x double, y double, z double")
    flat = frames.Frame([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], [0.0, 0.0, 0.0])
    said = lambda n, rms: frames.Diagnostics("orientation", [0, 0, 1], 0.0, [0, 0, 1], 1.0, False, None, rms, 0.0, 80.0, 1.0, [0.0] * 3, n)
    config = frames.default_config(80.0, 1.0, 0.0, len(points))
    made = partition.partition_trajectory(images, flat, said(len(points), 4.0), config)
    assert sorted(r["camera_index"] for r in made.owned.collect()) == list(range(len(points)))
    rows = made.blocks.orderBy("block_id").collect()
    assert [r["block_id"] for r in rows] == list(range(len(rows))) and sum(r["cameras"] for r in rows) == len(points) and len(rows) == len(made.actions) + 1
    assert made.grade_percent == pytest.approx(5.0) and len(made.warnings) == 1
    assert all(r["context_u0"] < r["core_u0"] and r["context_h0"] == r["core_h0"] for r in rows)
    with pytest.raises(ValueError, match="another number"):
        partition.partition_trajectory(images, flat, said(3, 0.0), config)


def test_numbering_and_previous_rows(spark):
    df = spark.createDataFrame([(f"n{k:03d}", k) for k in range(300)], "name string, k int").repartition(7)
    rows = with_previous(numbered(df, "name"), "position", {"before": "k"}, chunk=10).collect()
    assert all(r["position"] == r["k"] and (r["before"] == r["k"] - 1 if r["k"] else r["before"] is None) for r in rows) and len(rows) == 300


def rig(spark, places, turns):
    """Poses at places whose down and forward axes are columns of a turn (3x3) applied to those of a level camera."""
    rows = []
    for k, (p, t) in enumerate(zip(places, turns)):
        down, forward = t @ np.array([0.0, 0.0, -1.0]), t @ np.array([0.0, 1.0, 0.0])
        rows.append((f"n{k:04d}", *map(float, p), *map(float, (*np.cross(down, forward), *down, *forward))))
    return spark.createDataFrame(rows, "name string, x double, y double, z double, " + ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3)))


def about(axis, degrees):
    """The turn about a coordinate axis."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    i, j = (k for k in range(3) if k != axis)
    m = np.eye(3)
    m[i, i], m[i, j], m[j, i], m[j, j] = c, -s, s, c
    return m


def test_a_level_rig_gives_its_up_axis(spark):
    places = [(12 * math.sin(0.13 * k), 5 * math.cos(0.21 * k), 0.0) for k in range(70)]
    frame, d = frames.fit(rig(spark, places, [about(2, 9.0 * k) for k in range(70)]), 1.0)
    assert d.estimator == "orientation" and d.dispersion_deg < 0.1 and np.allclose(frame.rows[2], [0, 0, 1], atol=1e-9)
    assert np.allclose(np.array(frame.rows) @ np.array(frame.rows).T, np.eye(3), atol=1e-12)
    steps = np.linalg.norm(np.diff(np.array(places), axis=0), axis=1)
    assert d.arc_length == pytest.approx(steps.sum()) and d.median_spacing == pytest.approx(np.median(steps)) and d.residual_max < 1e-9


def test_rolling_cameras_take_the_null_space(spark):
    """Cameras that look up and down by turns agree on no down axis, but their right axes stay level."""
    places = [(0.4 * k, math.sin(k), 0.0) for k in range(60)]
    frame, d = frames.fit(rig(spark, places, [about(2, 25.0 * k) @ about(0, (-28, 0, 28)[k % 3]) for k in range(60)]))
    assert d.estimator == "nullspace" and abs(frame.rows[2][2]) > 0.98 and any("scale" in w for w in d.warnings)


def test_config_defaults_reject_unknown_settings():
    assert frames.default_config(100.0, 1.0, 0.5, 90)["max_cameras"] == 23
    with pytest.raises(ValueError, match="unknown"):
        frames.default_config(100.0, 1.0, 0.5, 90, colour=1)

"""Partitioning cameras into blocks: kd splits level by level, de-overlapping, and sequential groups."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcella.functions.ordered import numbered, with_previous
from parcella.operators.blocks import partition_owners
from parcella.session import checkpointed

#: Cameras of a block at least; levels and rounds at most.
LEAST, LEVELS, ROUNDS = 3, 64, 100
#: Rows of a leaf up to which its order is found in one task; larger ones are sorted as a whole table.
IN_TASK = 5_000_000


def camera_index(images: DataFrame) -> DataFrame:
    """images with camera_index, the position in the order of their unique names."""
    return numbered(images, "name", name="camera_index")


def leaf_stats(leaves: DataFrame, max_cameras: int, max_extent: float) -> DataFrame:
    """Per leaf: cameras, spans, the axis of a split (the larger span, u of equals) and whether one is needed."""
    stats = leaves.groupBy("leaf").agg(F.count("*").alias("cameras"), (F.max("u") - F.min("u")).alias("span_u"), (F.max("v") - F.min("v")).alias("span_v"))
    split = (F.col("cameras") > max_cameras) | (F.greatest("span_u", "span_v") > max_extent)
    return stats.withColumn("axis", F.when(F.col("span_u") >= F.col("span_v"), "u").otherwise("v")).withColumn("split", split)


def _ranked(rows: DataFrame, largest: int) -> DataFrame:
    """rows with rank (from 0) and previous coordinate in their leaf, by coordinate and camera_index."""
    if largest <= IN_TASK:
        w = Window.partitionBy("leaf").orderBy("at", "camera_index")
        return rows.withColumn("rank", F.row_number().over(w) - 1).withColumn("before", F.lag("at").over(w))
    placed = with_previous(numbered(rows, "leaf", "at", "camera_index", name="place"), "place", {"before": "at"})
    first = placed.groupBy("leaf").agg(F.min("place").alias("first"))
    return placed.join(first, "leaf").withColumn("rank", F.col("place") - F.col("first")).drop("place", "first")


def split_points(leaves: DataFrame, stats: DataFrame, largest: int) -> DataFrame:
    """Of each leaf to be split: axis, cut (cameras below) and plane. A cut leaves LEAST cameras on both sides, parts distinct
    coordinates and is the nearest to half, the lower of equals; without one, cut is null."""
    todo = stats.where("split").select("leaf", "axis", "cameras")
    rows = leaves.join(F.broadcast(todo), "leaf").withColumn("at", F.when(F.col("axis") == "u", F.col("u")).otherwise(F.col("v")))
    ok = (F.col("rank") >= LEAST) & (F.col("rank") <= F.col("cameras") - LEAST) & (F.col("before") < F.col("at"))
    best = F.min(F.when(ok, F.struct(F.abs(F.col("rank") - F.col("cameras") / 2).alias("off"), F.col("rank").alias("cut"), ((F.col("before") + F.col("at")) / 2).alias("plane"))))
    found = _ranked(rows, largest).groupBy("leaf", "axis").agg(best.alias("best"))
    return found.select("leaf", "axis", F.col("best.cut").cast("long").alias("cut"), F.col("best.plane").alias("plane"))


def kd_partition(centres: DataFrame, max_cameras: int, max_extent: float, margin: float = 0.0) -> tuple[DataFrame, list[dict]]:
    """centres (camera_index, u, v) with block_id, and the blocks' bounds in u and v."""
    return kd_tree(centres, max_cameras, max_extent, margin)[:2]


def kd_tree(centres: DataFrame, max_cameras: int, max_extent: float, margin: float = 0.0) -> tuple[DataFrame, list[dict], dict[str, tuple[str, float]]]:
    """kd_partition, and the axis and plane of every leaf that was split.

    All leaves of a level split in one pass; a leaf is named by its path of lower (0) and upper (1) halves, so paths in order
    number the blocks. Only per-leaf rows reach the driver. Leaves at rest are numbered as they come and aren't read again.
    """
    leaves = checkpointed(centres.select("camera_index", "u", "v", F.lit("").alias("leaf")))
    root = leaves.agg(F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1"), F.count("*").alias("n")).first()
    if root["n"] < LEAST:
        raise ValueError(f"at least {LEAST} cameras are needed")
    bounds = {"": {"u0": root["u0"] - margin, "u1": root["u1"] + margin, "v0": root["v0"] - margin, "v1": root["v1"] + margin}}
    cuts: dict[str, tuple[str, float]] = {}
    rest: list[DataFrame] = []
    for _ in range(LEVELS):
        stats = {r["leaf"]: r for r in leaf_stats(leaves, max_cameras, max_extent).collect()}  # a row per leaf
        todo = [r for r in stats.values() if r["split"]]
        if not todo:
            rest.append(leaves)
            break
        table = leaves.sparkSession.createDataFrame([(r["leaf"], r["axis"], r["cameras"], True) for r in todo], "leaf string, axis string, cameras long, split boolean")
        if len(todo) < len(stats):
            names = F.broadcast(table.select("leaf"))
            rest.append(leaves.join(names, "leaf", "left_anti").select("camera_index", "u", "v", "leaf"))
            leaves = leaves.join(names, "leaf", "left_semi")
        found = split_points(leaves, table, max(r["cameras"] for r in todo)).collect()
        stuck = [r["leaf"] for r in found if r["plane"] is None]
        if stuck:
            raise ValueError(f"leaf {stuck[0]!r} can't be split with {LEAST} cameras on both sides")
        for r in found:
            whole = bounds.pop(r["leaf"])
            cuts[r["leaf"]] = r["axis"], r["plane"]
            bounds[r["leaf"] + "0"] = whole | {f"{r['axis']}1": r["plane"]}
            bounds[r["leaf"] + "1"] = whole | {f"{r['axis']}0": r["plane"]}
        planes = leaves.sparkSession.createDataFrame([(r["leaf"], r["axis"], r["plane"]) for r in found], "leaf string, axis string, plane double")
        at = F.when(F.col("axis") == "u", F.col("u")).otherwise(F.col("v"))
        half = F.when(at < F.col("plane"), "0").otherwise("1")
        leaves = checkpointed(leaves.join(F.broadcast(planes), "leaf").select("camera_index", "u", "v", F.concat("leaf", half).alias("leaf")))
    else:
        raise RuntimeError(f"not settled after {LEVELS} levels")
    names = sorted(bounds)
    ids = leaves.sparkSession.createDataFrame(list(zip(names, range(len(names)))), "leaf string, block_id int")
    whole = reduce(DataFrame.unionByName, [x.select("camera_index", "u", "v", "leaf") for x in rest])
    return whole.join(F.broadcast(ids), "leaf").select("camera_index", "block_id", "u", "v", "leaf"), [bounds[x] | {"block_id": k, "leaf": x} for k, x in enumerate(names)], cuts


def core_boxes(owned: DataFrame, margin: float | Column, low: float | Column, high: float | Column) -> DataFrame:
    """Per block: bounds of its cameras, wider by a margin, with a fixed height."""
    m = margin if isinstance(margin, Column) else F.lit(margin)
    out = [f(a).alias(f"{f.__name__}_{a}") for a in "uv" for f in (F.min, F.max)]
    rows = owned.groupBy("block_id").agg(*out)
    cols = {f"core_{a}{k}": (F.col(f"min_{a}") - m if k == 0 else F.col(f"max_{a}") + m) for a in "uv" for k in (0, 1)}
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return rows.select("block_id", *(c.alias(n) for n, c in cols.items()), lit(low).alias("core_h0"), lit(high).alias("core_h1"))


def split_actions(leaves: list[str], cuts: dict[str, tuple[str, float]]) -> list[str]:
    """The splits in the order in which one leaf after the other is split, each with its leaf's place in the list by then: all
    before it have come to rest."""
    return [f"spatial_split({sum(x < path for x in leaves if not x.startswith(path))},{axis},{plane:.17g})" for path, (axis, plane) in sorted(cuts.items())]


@dataclass(frozen=True)
class Core:
    """A block's core in u, v and h on the driver: its box, its cameras' number and bounds in u and v, the leaves whose
    cameras it has, and how it came about."""

    low: tuple[float, float, float]
    high: tuple[float, float, float]
    cameras: int
    bounds: tuple[float, float, float, float]
    leaves: tuple[int, ...]
    origin: str = "spatial"

    def overlap(self, other: Core) -> np.ndarray:
        return np.minimum(self.high, other.high) - np.maximum(self.low, other.low)


def _together(a: Core, b: Core) -> tuple[float, float, float, float]:
    return (min(a.bounds[0], b.bounds[0]), max(a.bounds[1], b.bounds[1]), min(a.bounds[2], b.bounds[2]), max(a.bounds[3], b.bounds[3]))


def _trimmed(a: Core, b: Core, k: int) -> tuple[Core, Core, float]:
    """Both, cut halfway through their overlap on axis k."""
    mid = (max(a.low[k], b.low[k]) + min(a.high[k], b.high[k])) / 2
    put = lambda t: tuple(mid if n == k else x for n, x in enumerate(t))
    origin = f"trimmed({'uvh'[k]})"
    upper = lambda c: replace(c, high=put(c.high), origin=origin)
    lower = lambda c: replace(c, low=put(c.low), origin=origin)
    return (upper(a), lower(b), mid) if a.low[k] <= b.low[k] else (lower(a), upper(b), mid)


def box_table(spark: SparkSession, cores: list[Core]) -> DataFrame:
    """block_id and the cores' bounds as columns."""
    rows = [(n, *map(float, c.low), *map(float, c.high)) for n, c in enumerate(cores)]
    return spark.createDataFrame(rows, "block_id int, " + ", ".join(f"core_{a}{k} double" for k in (0, 1) for a in "uvh"))


def deoverlap(cores: list[Core], placed: DataFrame, max_cameras: int, max_extent: float, margin: float, pads: tuple[float, float], slack: float) -> tuple[list[Core], list[str]]:
    """Cores without overlap, and what was done: the first overlapping pair is merged within the limits or trimmed on its
    narrowest axis, until there is none; then a camera that no core owns is given back to its block.

    placed: (camera_index, u, v, h, leaf), leaf a number of those in cores. The driver holds cores, never cameras: whom a
    core owns is asked of the table, once when no pair overlaps and after each camera that is given back.
    """
    cores, actions = list(cores), []
    for _ in range(ROUNDS):
        pair = next(((i, j) for i in range(len(cores)) for j in range(i + 1, len(cores)) if (cores[i].overlap(cores[j]) > 0).all()), None)
        if pair:
            i, j = pair
            a, b = cores[i], cores[j]
            u0, u1, v0, v1 = all_of = _together(a, b)
            if a.cameras + b.cameras <= slack * max_cameras and max(u1 - u0, v1 - v0) <= slack * max_extent:
                cores[i] = Core((u0 - margin, v0 - margin, pads[0]), (u1 + margin, v1 + margin, pads[1]), a.cameras + b.cameras, all_of, a.leaves + b.leaves, f"merged({i},{j})")
                del cores[j]
                actions.append(f"merge({i},{j})")
            else:
                k = int(np.argmin(a.overlap(b)))
                cores[i], cores[j], mid = _trimmed(a, b, k)
                actions.append(f"trim({i},{j},{'uvh'[k]},{mid:.17g})")
            continue
        owned = partition_owners(placed.select("camera_index", "u", "v", "h"), box_table(placed.sparkSession, cores)).where("owners <> 1")
        first = owned.agg(F.min(F.when(F.col("owners") == 0, F.col("camera_index"))).alias("lost"), F.count_if(F.col("owners") > 1).alias("several")).first()
        if first["lost"] is None:
            if first["several"]:
                raise ValueError("cameras with several owners in blocks that don't overlap")
            return cores, actions
        r = placed.where(F.col("camera_index") == first["lost"]).first()
        of = [k for k, c in enumerate(cores) if r["leaf"] in c.leaves]
        if len(of) != 1:
            raise ValueError(f"camera {first['lost']} has {len(of)} blocks to go back to")
        c, p = cores[of[0]], (r["u"], r["v"], r["h"])
        cores[of[0]] = replace(c, low=tuple(map(min, c.low, p)), high=tuple(map(max, c.high, p)))
        actions.append(f"reclaim({first['lost']})")
    raise ValueError(f"blocks still overlap after {ROUNDS} rounds")


@dataclass(frozen=True)
class Partition:
    """Settled blocks: a table of their boxes, memberships by core (block_id, camera_index), and what happened."""

    blocks: DataFrame
    owned: DataFrame
    actions: list[str]
    grade_percent: float
    warnings: list[str]


def partition_trajectory(images: DataFrame, frame, diagnostics, config: dict[str, float]) -> Partition:
    """Blocks over a fitted trajectory: kd leaves, de-overlapped, with contexts, numbered from 0 in the order of leaves."""
    if diagnostics.arc_length <= 0:
        raise ValueError("the path's length must be positive")
    u, v, h = frame.to_ground(tuple(F.col(c) for c in "xyz"))
    placed = checkpointed(camera_index(images).select("camera_index", u.alias("u"), v.alias("v"), h.alias("h")))
    pads = (-float(config["pad_down"]), float(config["pad_up"]))
    limits = (int(config["max_cameras"]), float(config["core_extent"]))
    leaves, bounds, cuts = kd_tree(placed, *limits, float(config["lateral_margin"]))
    per = {r["block_id"]: r for r in leaves.groupBy("block_id").agg(F.count("*").alias("n"), *(f(a).alias(f"{f.__name__}_{a}") for a in "uv" for f in (F.min, F.max))).collect()}
    cores = [Core((b["u0"], b["v0"], pads[0]), (b["u1"], b["v1"], pads[1]), r["n"], (r["min_u"], r["max_u"], r["min_v"], r["max_v"]), (b["block_id"],)) for b in bounds for r in [per[b["block_id"]]]]
    named = placed.join(leaves.select("camera_index", F.col("block_id").alias("leaf")), "camera_index")
    if placed.count() != diagnostics.cameras:
        raise ValueError("the diagnostics are of another number of cameras")
    settled, actions = deoverlap(cores, named, *limits, float(config["lateral_margin"]), pads, float(config["merge_slack"]))
    of = images.sparkSession.createDataFrame([(leaf, n) for n, c in enumerate(settled) for leaf in c.leaves], "leaf int, block_id int")
    owned = named.join(F.broadcast(of), "leaf").select("block_id", "camera_index")  # a row per leaf
    rows = [(n, c.origin, c.cameras) for n, c in enumerate(settled)]
    origins = images.sparkSession.createDataFrame(rows, "block_id int, provenance string, cameras long")
    spans = owned.groupBy("block_id").agg(F.min("camera_index").alias("first_camera"), F.max("camera_index").alias("last_camera"))
    share = float(config["context_share"])
    boxes = box_table(images.sparkSession, settled)
    grown = {f"context_{a}{k}": F.col(f"core_{a}{k}") + (2 * k - 1) * (0.0 if a == "h" else share) * (F.col(f"core_{a}1") - F.col(f"core_{a}0")) for a in "uvh" for k in (0, 1)}
    grade = 100 * diagnostics.residual_rms / diagnostics.arc_length
    warnings = [f"one plane doesn't give heights here (grade {grade:.2f} %): blocks need heights of their own cameras"] if grade > 3 else []
    return Partition(boxes.withColumns(grown).join(origins, "block_id").join(spans, "block_id"), owned, split_actions([b["leaf"] for b in bounds], cuts) + actions, grade, warnings)


def sequential(centres: DataFrame, max_cameras: int, max_extent: float, slack: float = 1.0, tail: float = 0.25) -> tuple[DataFrame, list[str], list[str]]:
    """centres (camera_index, u, v) with group_id, actions and warnings: a group closes when one more camera would pass the limits.

    The fold needs the cameras in order, one after the other; it streams over one sorted partition and keeps one group's
    bounds. A last group under a share of the limit joins the one before if that stays within slack, or else stays with a
    warning. A last group of fewer than LEAST cameras that doesn't join is an error.
    """

    def fold(batches):
        import pandas as pd

        group, count, low, high = 0, 0, None, None
        for b in batches:
            ids = np.empty(len(b), np.int64)
            for k, p in enumerate(b[["u", "v"]].to_numpy()):
                lo, hi = (p, p) if count == 0 else (np.minimum(low, p), np.maximum(high, p))
                if count and (count + 1 > max_cameras or (hi - lo).max() > max_extent):
                    group, count, lo, hi = group + 1, 0, p, p
                count, low, high, ids[k] = count + 1, lo, hi, group
            yield pd.DataFrame({"camera_index": b["camera_index"], "u": b["u"], "v": b["v"], "group_id": ids})

    rows = centres.select("camera_index", "u", "v").coalesce(1).sortWithinPartitions("camera_index")
    groups = checkpointed(rows.mapInPandas(fold, "camera_index long, u double, v double, group_id long"))
    last = groups.groupBy("group_id").agg(F.count("*").alias("n"), *(f(a).alias(f"{f.__name__}_{a}") for a in "uv" for f in (F.min, F.max))).orderBy(F.col("group_id").desc()).limit(2).collect()
    if not last:
        raise ValueError(f"at least {LEAST} cameras are needed")
    warnings = []
    if len(last) == 2 and last[0]["n"] < tail * max_cameras:
        a, b = last
        span = max(max(a[f"max_{x}"], b[f"max_{x}"]) - min(a[f"min_{x}"], b[f"min_{x}"]) for x in "uv")
        if a["n"] + b["n"] <= slack * max_cameras and span <= slack * max_extent:
            joined = groups.withColumn("group_id", F.least(F.col("group_id"), F.lit(b["group_id"])))
            return joined, [f"merge_tail({b['group_id']},{a['group_id']})"], warnings
        warnings.append("the last segment is small; joining it would pass the limits")
    if last[0]["n"] < LEAST:
        raise ValueError(f"the last group has {last[0]['n']} cameras and can't join the one before")
    return groups, [], warnings

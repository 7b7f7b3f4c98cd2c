"""Blocks against cameras, points and splats: memberships, filters, ownership, export guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcella.functions.geometry import Axis, Box, axis, view_meets_box, view_slopes

#: Fixed limits of an export: points of a block, and share of the scene's points.
LEAST_POINTS, LEAST_SHARE = 1000, 0.005
LEAST_CAMERAS = 32
#: Blocks up to which a block table is sent to all tasks; beyond, points meet blocks by grid cells.
BROADCAST_BLOCKS = 20_000


def finite(*columns: str) -> Column:
    """The condition that values are numbers; NaN is above all numbers in Spark and must not pass a comparison."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return ok


def range_join(rows: DataFrame, blocks: DataFrame, prefix: str, place: tuple[str, str, str] = ("u", "v", "h"), cell: float | None = None) -> DataFrame:
    """rows joined with the blocks whose box holds their place.

    Few blocks are broadcast. More than BROADCAST_BLOCKS, or with a cell size given, every box is spread over the cells of
    a grid that it touches and rows, which have one cell each, meet them in an equi-join: no pair arises twice.
    """
    hit = Box(prefix).holds(axis(*place))
    if cell is None and blocks.count() <= BROADCAST_BLOCKS:
        return rows.join(F.broadcast(blocks), hit)
    if cell is None:
        size = blocks.agg(F.greatest(*(F.percentile_approx(F.col(f"{prefix}_{a}1") - F.col(f"{prefix}_{a}0"), 0.5) for a in "uv"))).first()[0]
        cell = float(size) or 1.0
    at = lambda c: F.floor(c / cell)
    spread = blocks
    for a in "uv":
        spread = spread.withColumn(f"__{a}", F.explode(F.sequence(at(F.col(f"{prefix}_{a}0")), at(F.col(f"{prefix}_{a}1")))))
    keyed = rows.withColumn("__u", at(F.col(place[0]))).withColumn("__v", at(F.col(place[1])))
    return keyed.join(spread, ["__u", "__v"]).where(hit).drop("__u", "__v")


def assign_by_centre(poses: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block_id, camera_index): centres within a context."""
    return range_join(poses, blocks, "context").select("block_id", "camera_index")


def frustum_or_centre(box: Box, near: float | Column, far: float | Column) -> Column:
    """Whether the view of a pose (u, v, h, g00..g22 in the box's axes, tx, ty) may meet a box, or its centre lies in it."""
    rows = [axis(*(f"g{k}{j}" for j in range(3))) for k in range(3)]
    place = axis("u", "v", "h")
    return view_meets_box(rows, place, F.col("tx"), F.col("ty"), near, far, box) | box.holds(place)


def in_ground(poses: DataFrame, frame, slopes: bool = False) -> DataFrame:
    """Poses with u, v, h and, for views, axes in the frame (g00..g22) and slopes."""
    out = dict(zip("uvh", frame.to_ground(axis("x", "y", "z"))))
    if slopes:
        for k in range(3):
            out |= {f"g{k}{j}": c for j, c in enumerate(frame.turned(axis(*(f"r{k}{i}" for i in range(3)))))}
        out |= dict(zip(("tx", "ty"), view_slopes(F.col("fx"), F.col("fy"), F.col("width"), F.col("height"))))
    return poses.withColumns(out)


def _reach(poses: DataFrame, near: float, far: float) -> DataFrame:
    """Views with the bounds of their frustum and centre in u and v, a little wider than the tests' tolerance."""
    out = {}
    for j, a in enumerate("uv"):
        spread = F.col("tx") * F.abs(F.col(f"g0{j}")) + F.col("ty") * F.abs(F.col(f"g1{j}"))
        low, high, at = F.col(f"g2{j}") - spread, F.col(f"g2{j}") + spread, F.col(a)
        slack = 1e-9 * (1 + F.abs(at) + far * (1 + F.col("tx") + F.col("ty")))
        out |= {f"__low_{a}": at + F.least(F.lit(0.0), near * low, far * low) - slack, f"__high_{a}": at + F.greatest(F.lit(0.0), near * high, far * high) + slack}
    return poses.withColumns(out)


def view_join(poses: DataFrame, blocks: DataFrame, near: float, far: float) -> DataFrame:
    """Views joined with the blocks whose context they may meet or whose context holds their centre.

    Bounds of views and blocks are spread over the cells of a grid as wide as the larger of a typical block and a typical
    view, and meet there by an equi-join; a pair is tested in the first cell that both touch.
    """
    reach = _reach(poses, near, far)
    wide = blocks.agg(F.greatest(*(F.percentile_approx(F.col(f"context_{a}1") - F.col(f"context_{a}0"), 0.5) for a in "uv")).alias("w")).first()[0]
    long = reach.agg(F.greatest(*(F.avg(F.col(f"__high_{a}") - F.col(f"__low_{a}")) for a in "uv")).alias("w")).first()[0]
    cell = max(float(wide or 0), float(long or 0)) or 1.0
    at = lambda c: F.floor(c / cell)
    spread = blocks
    for a in "uv":
        reach = reach.withColumn(f"__first_{a}", at(F.col(f"__low_{a}"))).withColumn(f"__cell_{a}", F.explode(F.sequence(F.col(f"__first_{a}"), at(F.col(f"__high_{a}")))))
        spread = spread.withColumn(f"__from_{a}", at(F.col(f"context_{a}0"))).withColumn(f"__cell_{a}", F.explode(F.sequence(F.col(f"__from_{a}"), at(F.col(f"context_{a}1")))))
    if spread.count() <= BROADCAST_BLOCKS:
        spread = F.broadcast(spread)
    first = (F.col("__cell_u") == F.greatest("__first_u", "__from_u")) & (F.col("__cell_v") == F.greatest("__first_v", "__from_v"))
    met = reach.join(spread, ["__cell_u", "__cell_v"]).where(first & frustum_or_centre(Box("context"), near, far))
    return met.drop(*(f"__{n}_{a}" for n in ("low", "high", "first", "from", "cell") for a in "uv"))


def assign_by_view(poses: DataFrame, blocks: DataFrame, near: float, far: float) -> DataFrame:
    """(block_id, camera_index): views that may meet a context, and centres within it."""
    if not 0 <= near < far:
        raise ValueError("0 <= near < far must hold")
    return view_join(poses, blocks, near, far).select("block_id", "camera_index")


def frustum_planes(median_spacing: float, extent: float, multiplier: float) -> tuple[float, float]:
    """Near and far planes in scene units: the captures' spacing, and a multiple of a core's extent."""
    if not median_spacing > 0 or median_spacing == float("inf"):
        raise ValueError("the median spacing must be finite and positive")
    near, far = median_spacing, multiplier * extent
    if not near < far:
        raise ValueError("0 <= near < far must hold")
    return near, far


#: How memberships may be found.
PREDICATES = {"centre": assign_by_centre, "frustum": assign_by_view}


def membership_counts(indexed: DataFrame, members: DataFrame) -> DataFrame:
    """Per camera the number of blocks that have it, 0 included."""
    return indexed.select("camera_index").join(members, "camera_index", "left").groupBy("camera_index").agg(F.count("block_id").alias("blocks"))


def core_hits(indexed: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per camera the number of cores, closed on all sides, that hold its centre."""
    hit = range_join(indexed, blocks, "core").select("camera_index", "block_id")
    return indexed.select("camera_index").join(hit, "camera_index", "left").groupBy("camera_index").agg(F.count("block_id").alias("cores"))


def assignment_summary(indexed: DataFrame, members: DataFrame, blocks: DataFrame) -> DataFrame:
    """How many blocks a camera is in, and how many cameras no core or several cores hold."""
    per = membership_counts(indexed, members).join(core_hits(indexed, blocks), "camera_index")
    return per.agg(
        F.avg("blocks").alias("mean_blocks"), F.max("blocks").alias("max_blocks"), F.count_if(F.col("cores") == 0).alias("orphans"), F.count_if(F.col("cores") > 1).alias("multi_owned"), F.count("*").alias("cameras")
    )


def checked_assignment(indexed: DataFrame, members: DataFrame, blocks: DataFrame, least_cameras: int = LEAST_CAMERAS) -> DataFrame:
    """members, if every block has enough cameras and every camera's centre lies in one core."""
    few = blocks.select("block_id").join(members.groupBy("block_id").agg(F.count("*").alias("n")), "block_id", "left").where(F.coalesce("n", F.lit(0)) < least_cameras).orderBy("block_id").first()
    if few:
        raise ValueError(f"block {few['block_id']} has {few['n'] or 0} cameras, under {least_cameras}")
    odd = core_hits(indexed, blocks).where("cores <> 1").orderBy("camera_index").first()
    if odd:
        raise ValueError(f"the centre of camera {odd['camera_index']} lies in {odd['cores']} cores")
    return members


def owners(places: DataFrame, blocks: DataFrame, id_col: str) -> DataFrame:
    """Each place's owner: the lowest block that holds it, half open; else the lowest that holds it, closed; else -1."""
    where = axis("u", "v", "h")
    box = Box("core")
    half_open = where[0].isNotNull()
    for x, lo, hi in zip(where, box.low, box.high):
        half_open = half_open & (x >= lo) & (x < hi)
    good = places.withColumn("u", F.when(finite("u", "v", "h"), F.col("u")).otherwise(F.raise_error(F.lit("a place is not finite")).cast("double")))
    met = range_join(good, blocks, "core").select(id_col, F.when(half_open, F.col("block_id")).alias("inner"), F.col("block_id").alias("closed"))
    best = met.groupBy(id_col).agg(F.coalesce(F.min("inner"), F.min("closed")).alias("owner"))
    return good.join(best, id_col, "left").withColumn("owner", F.coalesce("owner", F.lit(-1)))


def partition_owners(indexed: DataFrame, blocks: DataFrame) -> DataFrame:
    """(camera_index, owners): blocks that own a centre, half open but for faces on the outer bound of all blocks."""
    from pyspark.sql import Window

    every = Window.partitionBy()
    outer = {f"outer_{a}": F.max(f"core_{a}1").over(every) for a in "uvh"}
    bounded = blocks.withColumns(outer)
    own: Axis = axis("outer_u", "outer_v", "outer_h")
    hit = range_join(indexed, bounded, "core").where(Box("core").owns(axis("u", "v", "h"), own))
    return indexed.select("camera_index").join(hit.select("camera_index", "block_id"), "camera_index", "left").groupBy("camera_index").agg(F.count("block_id").alias("owners"))


def kept_observations(points: DataFrame, observations: DataFrame, blocks: DataFrame, members: DataFrame) -> DataFrame:
    """(block_id, point_id, image_id, point2d): observations by a block's images of points within its context.

    Points meet blocks before observations meet points, so only candidates' tracks are joined; members (block_id, image_id)
    then prune them in an equi-join.
    """
    near = range_join(points, blocks, "context").select("block_id", "point_id")
    return observations.join(near, "point_id").join(members.select("block_id", "image_id").distinct(), ["block_id", "image_id"], "left_semi").select("block_id", "point_id", "image_id", "point2d")


def block_points(kept: DataFrame) -> DataFrame:
    """(block_id, point_id, entries): points with two kept track entries or more; entries of one image count each."""
    return kept.groupBy("block_id", "point_id").agg(F.count("*").alias("entries")).where("entries >= 2")


def guards(kept_points: DataFrame, blocks: DataFrame, total: DataFrame, least_points: int = LEAST_POINTS, least_share: float = LEAST_SHARE) -> DataFrame:
    """Per block: points, their share of all, and whether an export may go on. total: one row with n."""
    per = blocks.select("block_id").join(kept_points.groupBy("block_id").agg(F.count("*").alias("points")), "block_id", "left").withColumn("points", F.coalesce("points", F.lit(0)))
    share = F.col("points") / F.col("n")
    return per.crossJoin(F.broadcast(total)).select("block_id", "points", share.alias("share"), ((F.col("points") >= least_points) & (share >= least_share)).alias("passes"))


#: Multiples of a core's extent that a sweep tries.
MULTIPLIERS = (0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0)


def sweep_far_plane(poses: DataFrame, blocks: DataFrame, near: float, fars: list[float], most_mean: float = 2.0, least_cameras: int = LEAST_CAMERAS) -> DataFrame:
    """Per far plane: mean and most blocks of a camera, the smallest block, cameras that no core or several hold, and whether the
    gate passes.

    A view that meets a box with one far plane meets it with any farther one: views are joined with boxes once, by the
    farthest, and every pair finds the first plane that does.
    """
    spark, order = poses.sparkSession, sorted({float(f) for f in fars})
    tried = spark.createDataFrame([(f,) for f in order], "far double")
    # as a column and on the few pairs that meet at all, the plane is tested by one piece of generated code
    met = view_join(poses, blocks, near, order[-1]).crossJoin(F.broadcast(tried)).where(frustum_or_centre(Box("context"), near, F.col("far")))
    pairs = met.groupBy("block_id", "camera_index").agg(F.min("far").alias("from"))
    per_block = pairs.groupBy("block_id", "from").agg(F.count("*").alias("n"))
    counts = tried.crossJoin(F.broadcast(blocks.select("block_id"))).join(per_block, "block_id", "left")  # planes by blocks
    sizes = counts.groupBy("far", "block_id").agg(F.coalesce(F.sum(F.when(F.col("from") <= F.col("far"), F.col("n"))), F.lit(0)).alias("cameras"))
    sizes = sizes.groupBy("far").agg(F.min("cameras").alias("least_cameras"), F.sum("cameras").alias("links"))
    upto = [F.count_if(F.col("from") <= f).alias(f"m{k}") for k, f in enumerate(order)]
    most = pairs.groupBy("camera_index").agg(*upto).agg(*(F.max(f"m{k}").alias(f"m{k}") for k in range(len(order))))
    most = most.select(F.inline(F.array(*(F.struct(F.lit(f).alias("far"), F.coalesce(f"m{k}", F.lit(0)).alias("max_blocks")) for k, f in enumerate(order)))))
    whole = core_hits(poses, blocks).agg(F.count("*").alias("n"), F.count_if(F.col("cores") == 0).alias("orphans"), F.count_if(F.col("cores") > 1).alias("multi_owned"))
    rows = sizes.join(most, "far").crossJoin(F.broadcast(whole))
    mean = F.col("links") / F.col("n")
    passes = (mean <= most_mean) & (F.col("least_cameras") >= least_cameras) & (F.col("orphans") == 0) & (F.col("multi_owned") == 0)
    return rows.select("far", mean.alias("mean_blocks"), "max_blocks", "least_cameras", "orphans", "multi_owned", passes.alias("passes"))


def wireframe(blocks: DataFrame, prefix: str, samples: int) -> DataFrame:
    """Points along the twelve edges of each block's box."""
    if samples < 2:
        raise ValueError("an edge needs two samples")
    from parcella.functions.geometry import CORNERS, EDGES

    pick = lambda a, bit: F.when(bit == 1, F.col(f"{prefix}_{a}1")).otherwise(F.col(f"{prefix}_{a}0"))
    edges = blocks.sparkSession.createDataFrame([(n, *CORNERS[a], *CORNERS[b]) for n, (a, b) in enumerate(EDGES)], "edge int, au int, av int, ah int, bu int, bv int, bh int")
    rows = blocks.crossJoin(F.broadcast(edges)).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    t = F.col("sample") / (samples - 1)
    return rows.select("block_id", "edge", "sample", *((pick(a, F.col(f"a{a}")) * (1 - t) + pick(a, F.col(f"b{a}")) * t).alias(a) for a in "uvh"))

"""The registered queries over the scene. Values that depend on rounding or on a maths library are rounded to six digits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcella.functions.geometry import Box, acute_angle, affine, axis, centre, focal, normalised, rotation
from parcella.functions.ordered import with_previous
from parcella.operators import blocks, checks, frames, jobs, partition
from parcella.plans.scene import FRAME, IDENTITY, Tables, fixed_poses, with_context, with_intrinsics
from parcella.plans.sql import ORACLE_SQL  # noqa: F401
from parcella.session import shared_path

NEAR, FAR = 1.0, 20.0
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
    return f


def six(c: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + 0.0


def grounded(t: Tables) -> DataFrame:
    """Images with camera_index and ground coordinates."""
    return blocks.in_ground(partition.camera_index(t.images), FRAME)


@query
def images_with_intrinsics(t: Tables) -> DataFrame:
    return with_intrinsics(t.images, t.cameras).select("image_id", "camera_id", "model_id", "width", "height")


@query
def camera_centres(t: Tables) -> DataFrame:
    """Centres of images whose translation is their place with the sign turned."""
    unit = t.images.withColumns(dict(zip("wijk", normalised(*(F.col(c) for c in ("qw", "qx", "qy", "qz"))))))
    place = centre(rotation(*(F.col(c) for c in "wijk")), tuple(-F.col(c) for c in "xyz"))
    return unit.select("image_id", *(six(c).alias(n) for n, c in zip(("cx", "cy", "cz"), place)))


@query
def focal_lengths(t: Tables) -> DataFrame:
    fx, fy = focal(F.col("model_id"), F.col("params"))
    _, strict = focal(F.col("model_id"), F.col("params"), strict=True)
    return t.cameras.select("camera_id", fx.alias("fx"), fy.alias("fy"), strict.alias("fy_strict"))


@query
def camera_index(t: Tables) -> DataFrame:
    return partition.camera_index(t.images).select("image_id", "camera_index")


@query
def camera_spacing(t: Tables) -> DataFrame:
    rows = with_previous(partition.camera_index(t.images), "camera_index", {"px": "x", "py": "y", "pz": "z"})
    square = sum(((F.col(c) - F.col("p" + c)) * (F.col(c) - F.col("p" + c)) for c in "yz"), (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")))
    return rows.where("px is not null").select("camera_index", six(F.sqrt(square)).alias("spacing"))


@query
def spacing_arc_median(t: Tables) -> DataFrame:
    return frames.path_lengths(t.images).select(F.round("arc_length", 3).alias("arc_length"), six(F.col("median_spacing")).alias("median_spacing"))


@query
def centre_moments(t: Tables) -> DataFrame:
    return frames.moments(t.images).select(F.col("n").alias("cameras"), *(F.round(c, 4).alias(c) for c in ("cx", "cy", "cz", "xx", "xy", "xz", "yy", "yz", "zz")))


@query
def pca_condition(t: Tables) -> DataFrame:
    """Eigenvalues of the centres' covariance, largest first."""
    return frames.variances(frames.moments(t.images)).select(*(six(F.col(c), 3).alias(c) for c in ("largest", "middle", "smallest")))


@query
def orientation_angles(t: Tables) -> DataFrame:
    """The acute angle between each camera's down axis and the mean one."""
    poses = fixed_poses(t)
    mean = poses.agg(*(F.avg(f"r1{j}").alias(f"m{j}") for j in range(3)))
    return poses.crossJoin(F.broadcast(mean)).select("image_id", F.round(acute_angle(axis("r10", "r11", "r12"), axis("m0", "m1", "m2")), 4).alias("angle_deg"))


@query
def ground_coords(t: Tables) -> DataFrame:
    return t.images.select("image_id", *(six(c).alias(n) for n, c in zip("uvh", FRAME.to_ground(axis("x", "y", "z")))))


@query
def world_coords(t: Tables) -> DataFrame:
    return t.points.select("point_id", *(six(c).alias(n) for n, c in zip("abc", FRAME.to_world(axis("x", "y", "z")))))


@query
def height_residuals(t: Tables) -> DataFrame:
    g = t.images.select(*(c.alias(n) for n, c in zip("uvh", FRAME.to_ground(axis("x", "y", "z")))))
    far = F.greatest(F.max("h") - F.avg("h"), F.avg("h") - F.min("h"))
    return g.agg(six(F.sqrt(F.var_pop("h"))).alias("residual_rms"), six(far).alias("residual_max"), *(six(F.max(a) - F.min(a)).alias(f"extent_{a}") for a in "uvh"))


@query
def config_defaults(t: Tables) -> DataFrame:
    path = frames.path_lengths(t.images).select(F.round("arc_length", 3).alias("arc"), six(F.col("median_spacing")).alias("spacing"))
    n = t.images.agg(F.count("*").alias("n"), six(F.max(F.abs(F.col("z") - 0.5))).alias("residual"))
    return path.crossJoin(n).select(
        six(F.col("arc") / 4).alias("core_extent"),
        F.greatest(F.lit(3), F.ceil(F.col("n") / 4)).cast("long").alias("max_cameras"),
        six(5 * F.col("spacing")).alias("lateral_margin"),
        F.lit(0.1).alias("context_share"),
        six(F.greatest(2 * F.col("spacing"), F.col("residual"))).alias("pad_down"),
        six(12 * F.col("spacing")).alias("pad_up"),
    )


@query
def kd_split_level1(t: Tables) -> DataFrame:
    rows = grounded(t).select("camera_index", "u", "v", F.lit("").alias("leaf"))
    stats = partition.leaf_stats(rows, 100, 1e9)
    return partition.split_points(rows, stats, rows.count()).select("axis", "cut", six(F.col("plane")).alias("plane"))


def parted(t: Tables) -> DataFrame:
    g = grounded(t).select("camera_index", "u", "v")
    return partition.kd_partition(g, max(3, -(-g.count() // 8)), 1e9)[0]


@query
def kd_partition(t: Tables) -> DataFrame:
    return parted(t).select("camera_index", "leaf")


@query
def core_boxes(t: Tables) -> DataFrame:
    cores = partition.core_boxes(parted(t), 0.5, -1.0, 6.0)
    return cores.select("block_id", *(six(F.col(f"core_{a}{k}")).alias(f"{a}{k}") for a in "uvh" for k in (0, 1)))


@query
def context_boxes(t: Tables) -> DataFrame:
    return t.strips.select("block_id", *(six(F.col(f"context_{a}{k}")).alias(f"{a}{k}") for a in "uvh" for k in (0, 1)))


@query
def block_overlaps(t: Tables) -> DataFrame:
    """Pairs of contexts that overlap, and by how much."""
    s = t.strips.select("block_id", *(F.col(f"context_{a}{k}").alias(f"a_{a}{k}") for a in "uvh" for k in (0, 1)))
    other = s.select(F.col("block_id").alias("other_id"), *(F.col(f"a_{a}{k}").alias(f"b_{a}{k}") for a in "uvh" for k in (0, 1)))
    a, b = Box("a"), Box("b")
    pairs = s.join(F.broadcast(other), (F.col("block_id") < F.col("other_id")) & a.overlaps(b))  # four blocks
    return pairs.select("block_id", "other_id", *(six(e).alias(f"overlap_{n}") for n, e in zip("uvh", a.overlap(b))))


@query
def assign_centre(t: Tables) -> DataFrame:
    return blocks.assign_by_centre(grounded(t), t.strips)


def views(t: Tables) -> DataFrame:
    """Poses with view axes and slopes, materialised before the join refers to them."""
    from parcella.session import stored

    indexed = partition.camera_index(fixed_poses(t))
    return stored(blocks.in_ground(indexed, IDENTITY, slopes=True), "views")


def boxes(t: Tables) -> DataFrame:
    """Three small blocks in world axes, at the quarter points of the images' bounds."""
    bounds = t.images.agg(*(f(a).alias(f"{n}_{a}") for a in "xyz" for f, n in ((F.min, "low"), (F.max, "high"))))
    rows = bounds.select("*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("block_id"))
    mid = lambda a: F.col(f"low_{a}") + (F.col(f"high_{a}") - F.col(f"low_{a}")) * F.col("block_id") / 4
    core = {"core_u0": mid("x") - 2, "core_u1": mid("x") + 2, "core_v0": mid("y") - 2, "core_v1": mid("y") + 2, "core_h0": F.col("low_z") + 3, "core_h1": F.col("high_z") + 9}
    return with_context(rows.select("block_id", *(c.alias(n) for n, c in core.items())))


@query
def assign_frustum(t: Tables) -> DataFrame:
    return blocks.assign_by_view(views(t), boxes(t), NEAR, FAR)


@query
def far_plane_sweep(t: Tables) -> DataFrame:
    swept = blocks.sweep_far_plane(views(t), boxes(t), NEAR, [5.0, 10.0, 20.0, 40.0], 2.0, 3)
    best = swept.agg(F.max(F.when(F.col("passes"), F.col("far"))).alias("best_far"))
    return swept.crossJoin(best).select("far", six(F.col("mean_blocks")).alias("mean_blocks"), "max_blocks", "least_cameras", "orphans", "multi_owned", "passes", "best_far")


@query
def assignment_diagnostics(t: Tables) -> DataFrame:
    g = grounded(t)
    return blocks.assignment_summary(g, blocks.assign_by_centre(g, t.strips), t.strips).select(six(F.col("mean_blocks")).alias("mean_blocks"), "max_blocks", "orphans", "multi_owned", "cameras")


@query
def camera_blocks(t: Tables) -> DataFrame:
    g = grounded(t)
    rows = g.select("camera_index").join(blocks.assign_by_centre(g, t.strips), "camera_index", "left").groupBy("camera_index")
    return rows.agg(F.array_join(F.sort_array(F.collect_list("block_id")), ";").alias("assigned_block_ids"), F.count("block_id").alias("blocks_per_camera"))


@query
def block_summary(t: Tables) -> DataFrame:
    g = grounded(t)
    members = blocks.assign_by_centre(g, t.strips).groupBy("block_id").agg(F.count("*").alias("cameras"), F.min("camera_index").alias("first_camera"), F.max("camera_index").alias("last_camera"))
    size = t.strips.select("block_id", *(six(F.col(f"core_{a}1") - F.col(f"core_{a}0")).alias(f"extent_{a}") for a in "uvh"))
    return size.join(members, "block_id", "left").select("block_id", F.coalesce("cameras", F.lit(0)).alias("cameras"), "first_camera", "last_camera", "extent_u", "extent_v", "extent_h")


@query
def ownership_counts(t: Tables) -> DataFrame:
    return blocks.partition_owners(grounded(t), t.strips).groupBy("owners").agg(F.count("*").alias("cameras"))


def splat_places(t: Tables) -> DataFrame:
    return t.splats.select("splat_id", "label", *(F.col(a).alias(n) for a, n in zip("xyz", "uvh")))


def cubes(t: Tables) -> DataFrame:
    """Eight cubes of an edge of 0.2 about the origin, by number: bit 0 is u, bit 1 v, bit 2 h."""
    rows = t.spark.range(8).select(F.col("id").cast("int").alias("block_id"))
    bit = lambda k: F.shiftright("block_id", k).bitwiseAND(F.lit(1))
    return rows.select("block_id", *((F.lit(0.2) * (bit(k) - 1 + e)).alias(f"core_{a}{e}") for k, a in enumerate("uvh") for e in (0, 1)))


@query
def ownership_ids(t: Tables) -> DataFrame:
    return blocks.owners(splat_places(t), cubes(t), "splat_id").select("splat_id", "owner")


@query
def crop_counts(t: Tables) -> DataFrame:
    return blocks.owners(splat_places(t), cubes(t), "splat_id").groupBy("owner").agg(F.count("*").alias("splats"), F.count_distinct("label").alias("labels"))


@query
def merge_union(t: Tables) -> DataFrame:
    """Cropped splats of all blocks, each under its block and its row within it."""
    from pyspark.sql import Window

    kept = blocks.owners(splat_places(t), cubes(t), "splat_id").where("owner >= 0")
    row = F.row_number().over(Window.partitionBy("owner").orderBy("splat_id")) - 1
    return kept.select(F.col("owner").alias("block_id"), row.alias("row_no"), "splat_id", "label")


def members(t: Tables) -> DataFrame:
    g = grounded(t)
    return blocks.assign_by_centre(g, t.strips).join(g.select("camera_index", "image_id", "camera_id"), "camera_index")


def placed_points(t: Tables) -> DataFrame:
    return t.points.select("point_id", *(c.alias(n) for n, c in zip("uvh", FRAME.to_ground(axis("x", "y", "z")))))


def kept(t: Tables) -> DataFrame:
    return blocks.kept_observations(placed_points(t), t.observations, t.strips, members(t))


@query
def point_filter(t: Tables) -> DataFrame:
    per = blocks.block_points(kept(t)).groupBy("block_id").agg(F.count("*").alias("points"), F.sum("entries").alias("observations"))
    cameras = members(t).groupBy("block_id").agg(F.count("*").alias("cameras"))
    return cameras.join(per, "block_id", "left").select("block_id", "cameras", F.coalesce("points", F.lit(0)).alias("points"), F.coalesce("observations", F.lit(0)).alias("observations"))


@query
def track_prune(t: Tables) -> DataFrame:
    return blocks.block_points(kept(t)).select("block_id", "point_id", "entries")


@query
def point_guards(t: Tables) -> DataFrame:
    guarded = blocks.guards(blocks.block_points(kept(t)), t.strips, t.points.agg(F.count("*").alias("n")), 100, 0.05)
    return guarded.select("block_id", "points", six(F.col("share")).alias("share"), "passes")


@query
def block_camera_models(t: Tables) -> DataFrame:
    """Cameras that a block's images refer to."""
    used = members(t).select("block_id", "camera_id").distinct()
    return used.join(t.cameras, "camera_id").groupBy("block_id", "model_id").agg(F.count("*").alias("cameras"))


@query
def orphan_cameras(t: Tables) -> DataFrame:
    """Cameras that lie in no core of blocks a tenth narrower than the strips."""
    g = grounded(t)
    narrow = F.col("core_u1") - (F.col("core_u1") - F.col("core_u0")) * F.lit(0.1)
    inside = blocks.range_join(g, t.strips.withColumn("core_u1", narrow), "core").select("camera_index").distinct()
    return checks.orphans(g.select("camera_index", "image_id"), inside)


@query
def image_union_diff(t: Tables) -> DataFrame:
    """Images that observations name but no block keeps, and the other way round."""
    return checks.set_difference(t.observations.select("image_id"), members(t).select("image_id"))


@query
def affine_transform(t: Tables) -> DataFrame:
    m = [0.5, 0.25, 0.0, 0.001, -0.25, 0.5, 0.0, 0.0, 0.0, 0.0, 2.0, 0.0, 1.0, -1.0, 0.5, 1.0]
    return t.points.select("point_id", *(six(c).alias(n) for n, c in zip("abc", affine(m, axis("x", "y", "z")))))


@query
def wireframe(t: Tables) -> DataFrame:
    return blocks.wireframe(t.strips, "context", 5).select("block_id", "edge", "sample", *(six(F.col(a)).alias(a) for a in "uvh"))


def training_jobs(t: Tables) -> DataFrame:
    per = t.table("nation").select(F.col("n_nationkey").cast("int").alias("block_id"), (F.col("n_nationkey") * 7 + 32).cast("long").alias("cameras"))
    return jobs.jobs(per)


@query
def training_job_list(t: Tables) -> DataFrame:
    return training_jobs(t).withColumn("argv", F.array_join("argv", " "))


@query
def argv_rewrite(t: Tables) -> DataFrame:
    """Arguments with new paths; those of every third job have centring apart, of every other third within one element."""
    given = F.when(F.col("block_id") % 3 == 1, F.array(F.lit("--centralize"), F.lit("on"), F.lit("--eval"))).when(F.col("block_id") % 3 == 2, F.array(F.lit("--centralize=auto"))).otherwise(F.array().cast("array<string>"))
    moved = jobs.rewrite_argv(F.concat("argv", given), F.concat(F.lit("/mnt/in/"), F.col("job_id")), F.concat(F.lit("/mnt/out/"), F.col("job_id")), "crop.py")
    return training_jobs(t).select("job_id", F.array_join(moved, " ").alias("argv"))


@query
def launch_commands(t: Tables) -> DataFrame:
    """Commands that start the jobs in containers."""
    made = jobs.launch_commands(training_jobs(t), "/data/city/scene", "/data/run", "trainer", image="img:1", mount="/data", callback="/run/crop.py")
    return made.select("job_id", "block_id", F.array_join("command", " ").alias("command"))


def queue_events(t: Tables) -> DataFrame:
    """Events as a queue's log: types become states in the order of their names."""
    kinds = F.array(*[F.lit(k) for k in ("pending", "running", "succeeded", "failed", "pending")])
    e = t.table("events")
    names = F.sort_array(F.collect_set("event_type"))
    kind = e.agg(names.alias("names"))
    return e.crossJoin(F.broadcast(kind)).select(F.col("user_id").alias("job_id"), "ts", "event_id", F.element_at(kinds, F.array_position("names", F.col("event_type")).cast("int")).alias("state"))


@query
def latest_state(t: Tables) -> DataFrame:
    return jobs.latest_states(queue_events(t)).select("job_id", "event_id", "state")


@query
def job_status(t: Tables) -> DataFrame:
    """Every customer and every user of an event is a job; what ended has an exit code."""
    events = queue_events(t)
    every = t.table("customer").select(F.col("c_custkey").alias("job_id"), F.col("c_nationkey").alias("block_id")).join(events.select("job_id").distinct(), "job_id", "full")
    code = F.when(F.col("state") == "succeeded", 0).when(F.col("state") == "failed", 1)
    states = jobs.latest_states(events).select("job_id", "state", code.alias("exit_code"))
    return jobs.job_status(every, states).select("job_id", "block_id", "state", "exit_code")


@query
def queue_counts(t: Tables) -> DataFrame:
    return jobs.queue_counts(jobs.latest_states(queue_events(t)))


@query
def queue_recovery(t: Tables) -> DataFrame:
    """States after a restart in which every third process lives and failed jobs are tried again."""
    states = jobs.latest_states(queue_events(t)).select("job_id", "state", F.when(F.col("job_id") % 2 == 0, F.col("job_id")).alias("process_id"))
    alive = states.where("process_id % 3 = 0").select("process_id")
    return jobs.recovered(states, alive, True).groupBy("state").agg(F.count("*").alias("jobs"))


@query
def merge_status(t: Tables) -> DataFrame:
    """Jobs that succeeded have a crop of their block."""
    latest = jobs.latest_states(queue_events(t)).select(F.col("job_id").alias("block_id"), "state")
    return jobs.merge_status(latest.select("block_id"), latest.where("state = 'succeeded'").select("block_id"))


def hashed(t: Tables) -> DataFrame:
    return t.table("documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query
def source_hash_check(t: Tables) -> DataFrame:
    """Documents whose recorded digest is that of their neighbour's text, where the two differ."""
    now = t.table("documents").select(F.col("doc_id").alias("field"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    recorded = now.select((F.col("field") + 1).alias("field"), "digest").unionByName(now.where("field = 0"))
    return checks.stale_sources(recorded, now).select("field", F.col("digest").alias("recorded"), F.col("now").alias("current"))


@query
def tree_diff(t: Tables) -> DataFrame:
    left = hashed(t).unionByName(t.table("benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("digest")))
    right = hashed(t).withColumn("digest", F.when(F.col("path").cast("long") % 15 == 1, F.sha2(F.col("path").cast("binary"), 256)).otherwise(F.col("digest")))
    return checks.tree_difference(left, right).select("path", "digest", "other")


@query
def path_safety(t: Tables) -> DataFrame:
    path = F.element_at(F.array(F.concat(F.lit("blocks/"), F.col("p_name")), F.concat(F.lit("../"), F.col("p_name")), F.concat(F.lit("/"), F.col("p_name")), F.concat(F.col("p_name"), F.lit("/../x")), F.col("p_name")), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t.table("part").select("p_partkey", jobs.safe_path(path).alias("safe_path"), jobs.safe_name(path).alias("safe_name"))


@query
def duplicate_keys(t: Tables) -> DataFrame:
    return checks.duplicates(t.observations, "point_id", "image_id")


@query
def frame_fit(t: Tables) -> DataFrame:
    """The fitted frame's invariants: the estimator, counts, and how far its rows are from an orthonormal basis."""
    frame, d = frames.fit(fixed_poses(t))
    return t.spark.createDataFrame([(d.estimator, d.cameras, d.pca_degenerate, float(round(d.dispersion_deg, 4)), *(float(round(x, 4)) for x in frame.rows[2]), len(d.warnings))], "estimator string, cameras long, degenerate boolean, dispersion_deg double, h_x double, h_y double, h_z double, warnings int")


@query
def sequential_segments(t: Tables) -> DataFrame:
    """Groups of cameras in order, of 100 at most and within 45 units."""
    g = grounded(t).select("camera_index", "u", "v")
    return partition.sequential(g, 100, 45.0)[0].groupBy("group_id").agg(F.count("*").alias("cameras"), F.min("camera_index").alias("first_camera"))


@query
def partition_trajectory(t: Tables) -> DataFrame:
    """Blocks of the whole composition in the fixed frame: leaves, de-overlapped, with contexts and their cameras' number."""
    path = frames.path_lengths(t.images).first()
    n = t.images.count()
    d = frames.Diagnostics("orientation", [0.0, 0.0, 1.0], 0.0, [0.0, 0.0, 1.0], 1.0, False, None, 1.0, 1.0, path["arc_length"], path["median_spacing"], [0.0] * 3, n)
    config = {"core_extent": 1e9, "max_cameras": max(3, -(-n // 8)), "lateral_margin": 0.5, "context_share": 0.1, "pad_down": 1.0, "pad_up": 6.0, "merge_slack": 1.0}
    made = partition.partition_trajectory(t.images, FRAME, d, config)
    return made.blocks.select("block_id", "provenance", "cameras", "first_camera", "last_camera", *(six(F.col(f"context_{a}{k}"), 4).alias(f"{a}{k}") for a in "uvh" for k in (0, 1)))


def _local(t: Tables, name: str) -> str:
    """A place for a file that the driver and the tasks reach."""
    folder = shared_path(t.spark, "files")
    at = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    return f"{folder}/{name}"


@query
def ply_roundtrip(t: Tables) -> DataFrame:
    from parcella.sources.binary import read_ply, write_ply

    path = _local(t, "splats.ply")
    write_ply(t.splats.select("splat_id", "x", "y", "z", "label").withColumn("splat_id", F.col("splat_id").cast("int")), path, "splat_id")
    return read_ply(t.spark, path, rows=400).select("row_no", "splat_id", "x", "y", "z", "label")


@query
def merge_ply(t: Tables) -> DataFrame:
    """Splats on either side of a plane, written as a file each, merged to one file in the order of the sides, and read again."""
    from parcella.sources.binary import merge_ply as merged
    from parcella.sources.binary import read_ply, write_ply

    splats = t.splats.select("splat_id", "x", "y", "z", "label").withColumn("splat_id", F.col("splat_id").cast("int"))
    sides = {_local(t, "low.ply"): F.col("x") < 0, _local(t, "high.ply"): F.col("x") >= 0}
    for part, side in sides.items():
        write_ply(splats.where(side), part, "splat_id")
    path = _local(t, "merged.ply")
    merged(t.spark, list(sides), path)
    return read_ply(t.spark, path).select("row_no", "splat_id", "x", "y", "z", "label")


@query
def sparse_roundtrip(t: Tables) -> DataFrame:
    """Points with their tracks, written as a binary and read again."""
    from parcella.sources.binary import read_sparse, write_sparse

    track = t.observations.groupBy("point_id").agg(F.sort_array(F.collect_list(F.struct(F.col("image_id").cast("int").alias("image_id"), F.col("point2d").cast("int").alias("point2d_idx")))).alias("track"))
    rows = t.points.join(track, "point_id").select(F.col("point_id").alias("point3d_id"), F.array("x", "y", "z").alias("xyz"), F.array(*[F.lit(k).cast("short") for k in (1, 2, 3)]).alias("rgb"), F.lit(0.5).alias("error"), "track")
    path = _local(t, "points3D.bin")
    write_sparse(rows, path, "points")
    back = read_sparse(t.spark, path, "points", records=500)
    return back.select("point3d_id", *(six(F.get("xyz", k)).alias(a) for k, a in enumerate("xyz")), F.size("track").cast("long").alias("entries"), F.aggregate("track", F.lit(0).cast("long"), lambda s, m: s + m["image_id"]).alias("image_sum"))

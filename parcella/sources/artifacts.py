"""JSON artifacts and block exports: manifests, index, jobs, receipts and CSV reports, published whole or not at all."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Callable
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcella.functions.geometry import Frame
from parcella.operators.frames import Diagnostics

#: Versions of the artifacts, and what a manifest must have: fixed values of the format.
MANIFEST, INDEX, JOBS, RECEIPT = 2, 1, 1, 1
REQUIRED = ("schema", "block_id", "run_id", "ground_frame", "core", "context", "camera_indices", "frame_span", "provenance", "source")
BOX = "struct<min_g: array<double>, max_g: array<double>>"
FRAME = "struct<version: int, R: array<array<double>>, origin: array<double>>"
MANIFEST_SCHEMA = (
    f"schema int, block_id int, run_id string, ground_frame {FRAME}, core {BOX}, context {BOX}, camera_indices array<int>, frame_span array<int>, provenance string, "
    "source struct<cameras_sha256: string, images_sha256: string, points3D_sha256: string>, "
    "counts struct<cameras: int, camera_models: int, images: int, points3D: int, points3D_parent: int, points3D_fraction: double>"
)
INDEX_SCHEMA = "schema int, blocks array<struct<block_id: int, directory: string, camera_count: int>>"
JOBS_SCHEMA = "schema int, jobs array<struct<job_id: string, block_id: int, camera_count: int, max_cap: int, data_path: string, output_path: string, argv: array<string>>>"

#: The diagnostics file: its name and version, the poses that it is tied to, and its fields in the order of Diagnostics. Fixed values of the format.
DIAGNOSTICS_NAME, DIAGNOSTICS, IMAGES = "large_scene_trajectory_diagnostics.json", 1, os.path.join("sparse", "0", "images.bin")
DIAGNOSTIC_FIELDS = (
    "estimator_used",
    "normal_orientation",
    "orientation_dispersion_deg",
    "normal_pca",
    "pca_condition_ratio",
    "pca_degenerate",
    "agreement_deg",
    "height_residual_rms",
    "height_residual_max",
    "trajectory_arc_length",
    "median_inter_frame_spacing",
    "extent_ground",
    "n_cameras",
    "warnings",
)


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def sha256_file(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def save_json(path: str, value: dict) -> None:
    """Sorted keys, no NaN, written beside its name and then put in place."""
    text = json.dumps(value, sort_keys=True, indent=2, allow_nan=False)
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        f.write(text + "\n")
    os.replace(path + ".tmp", path)


def _whole(x) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def checked_manifest(m: dict) -> dict:
    missing = [k for k in REQUIRED if k not in m]
    if missing:
        raise ValueError(f"a manifest lacks {', '.join(missing)}")
    if m["schema"] != MANIFEST or not _whole(m["block_id"]) or m["block_id"] < 0:
        raise ValueError("a manifest has a wrong schema or block_id")
    cameras, span = m["camera_indices"], m["frame_span"]
    if not cameras or any(not _whole(c) for c in cameras) or cameras != sorted(set(cameras)):
        raise ValueError("camera_indices must be whole numbers, sorted and unique")
    if len(span) != 2 or span[0] > span[1] or not m["provenance"]:
        raise ValueError("frame_span or provenance is malformed")
    for a, b in (("core", "context"),):
        if any(x < y for x, y in zip(m[a]["min_g"], m[b]["min_g"])) or any(x > y for x, y in zip(m[a]["max_g"], m[b]["max_g"])):
            raise ValueError("the core must lie within the context")
    return m


def save_manifest(path: str, manifest: dict) -> None:
    save_json(path, checked_manifest(manifest))


def read_json(spark: SparkSession, path, schema: str) -> DataFrame:
    """JSON documents, one a file, that must fit the schema."""
    return spark.read.json(path, schema=schema, multiLine=True, mode="FAILFAST")


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """(block_id, directory, camera_count): blocks of an export; directories must be its direct children."""
    blocks = read_json(spark, f"{root}/index.json", INDEX_SCHEMA).where(F.col("schema") == INDEX).select(F.inline("blocks"))
    bad = F.col("directory").isNull() | (F.col("directory") == "") | F.contains("directory", F.lit("/")) | F.col("directory").isin(".", "..")
    return blocks.withColumn("directory", F.when(bad, F.raise_error(F.concat(F.lit("unsafe directory "), F.coalesce("directory", F.lit("null"))))).otherwise(F.col("directory")))


def read_manifests(spark: SparkSession, root: str, contiguous: bool = True) -> DataFrame:
    """Manifests of an export's blocks, in agreement with its index: ids, and one ground frame, to the bit. contiguous: ids must
    run from 0 on, as exports need and merges don't."""
    index = read_index(spark, root).select("block_id", "directory")
    path = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    found = spark.read.json(f"{root}/*/manifest.json", schema=MANIFEST_SCHEMA, multiLine=True, mode="FAILFAST").withColumn("directory", path)
    joined = index.join(found.withColumnRenamed("block_id", "own_id"), "directory", "left")
    ok = F.col("own_id").eqNullSafe(F.col("block_id")) & (F.col("schema") == MANIFEST)
    joined = joined.withColumn("block_id", F.when(ok, F.col("block_id")).otherwise(F.raise_error(F.concat(F.lit("no fitting manifest in "), F.col("directory"))).cast("int"))).drop("own_id")
    ids, frames = joined.agg(F.sort_array(F.collect_list("block_id")), F.count_distinct(F.to_json("ground_frame"))).first()
    if frames > 1:
        raise ValueError("the blocks' ground frames differ")
    if len(set(ids)) != len(ids) or contiguous and ids != list(range(len(ids))):
        raise ValueError(f"block ids {ids} repeat or leave gaps")
    return joined


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Jobs by block_id and job_id; ids must be unique file names."""
    from parcella.operators.jobs import safe_name

    rows = read_json(spark, path, JOBS_SCHEMA).where(F.col("schema") == JOBS).select(F.inline("jobs"))
    rows = rows.withColumn("job_id", F.when(safe_name(F.col("job_id")), F.col("job_id")).otherwise(F.raise_error(F.lit("a job's id is no file name"))))
    if rows.groupBy("job_id").count().where("count > 1").count():
        raise ValueError("job ids repeat")
    return rows.orderBy("block_id", "job_id")


def save_diagnostics(root: str, frame: Frame, diagnostics: Diagnostics) -> str:
    """The fitted frame and what its fit says, tied to the poses under root by their digest."""
    names = dict(zip(Diagnostics.__dataclass_fields__, DIAGNOSTIC_FIELDS))
    ground = {"version": 1, "R": [[float(x) for x in r] for r in frame.rows], "origin": [float(x) for x in frame.origin]}
    target = os.path.join(root, DIAGNOSTICS_NAME)
    plane = {names[k]: v for k, v in asdict(diagnostics).items()}
    save_json(target, {"schema": DIAGNOSTICS, "source": {"images_sha256": sha256_file(os.path.join(root, IMAGES))}, "ground_frame": ground, "plane_diagnostics": plane})
    return target


def load_diagnostics(root: str) -> tuple[Frame, Diagnostics]:
    """What save_diagnostics has written. Other schemas, missing fields and poses that have changed since are errors."""
    target = os.path.join(root, DIAGNOSTICS_NAME)
    with open(target, encoding="utf-8") as f:
        known = json.load(f)
    if not isinstance(known, dict) or known.get("schema") != DIAGNOSTICS:
        raise ValueError(f"{target} has another schema than {DIAGNOSTICS}")
    try:
        ground, plane, digest = known["ground_frame"], known["plane_diagnostics"], known["source"]["images_sha256"]
        frame = Frame([[float(x) for x in r] for r in ground["R"]], [float(x) for x in ground["origin"]])
        diagnostics = Diagnostics(*(plane[k] for k in DIAGNOSTIC_FIELDS))
    except (KeyError, TypeError) as e:
        raise ValueError(f"{target} is malformed: {e}") from e
    if [len(r) for r in frame.rows] != [3, 3, 3] or len(frame.origin) != 3:
        raise ValueError(f"{target} is malformed: the frame isn't one of three axes")
    if digest != sha256_file(os.path.join(root, IMAGES)):
        raise ValueError(f"{target} does not match {IMAGES}: the poses have changed since")
    return frame, diagnostics


def save_jobs(path: str, jobs: DataFrame) -> None:
    rows = [r.asDict() for r in jobs.orderBy("block_id", "job_id").collect()]  # a row per block
    save_json(path, {"schema": JOBS, "jobs": rows})


def assignment_csv(rows: DataFrame, path: str) -> None:
    """camera_index, assigned_block_ids, blocks_per_camera, in the order of cameras."""
    rows.select("camera_index", "assigned_block_ids", "blocks_per_camera").orderBy("camera_index").write.option("header", True).csv(path)


def receipt(kind: str, **fields) -> dict:
    return {"schema": RECEIPT, "kind": kind, **fields}


def receipt_matches(path: str, **fields) -> bool:
    """Whether a receipt is there and says this; files that it names aren't hashed."""
    try:
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
    except (OSError, ValueError):
        return False
    return known.get("schema") == RECEIPT and all(known.get(k) == v for k, v in fields.items())


def publish(target: str, fill: Callable[[str], None]) -> None:
    """fill writes into a folder beside target, which then takes target's name; nothing stays if it fails, and nothing that is
    there is overwritten."""
    if os.path.exists(target):
        raise FileExistsError(f"{target} is there already")
    stage = f"{target.rstrip('/')}.{uuid.uuid4().hex}"
    os.makedirs(stage)
    try:
        fill(stage)
        os.rename(stage, target)
    except BaseException:
        shutil.rmtree(stage, ignore_errors=True)
        raise


def export_blocks(target: str, blocks: DataFrame, guarded: DataFrame, points: DataFrame, manifests: dict[int, dict]) -> None:
    """Points by block as Parquet, manifests and index. guarded (block_id, passes) must pass for every block, before anything is
    written. blocks: block_id and cameras."""
    failed = [r["block_id"] for r in guarded.where(~F.col("passes")).collect()]
    if failed:
        raise ValueError(f"blocks {sorted(failed)} have too few points")
    counts = {r["block_id"]: r["cameras"] for r in blocks.select("block_id", "cameras").collect()}

    def fill(stage: str) -> None:
        points.repartition("block_id").sortWithinPartitions("block_id", "point_id").write.partitionBy("block_id").parquet(f"file://{stage}/points")
        for b in sorted(counts):
            os.makedirs(f"{stage}/block_{b:03d}")
            os.symlink("../../images", f"{stage}/block_{b:03d}/images")
            save_manifest(f"{stage}/block_{b:03d}/manifest.json", manifests[b])
        save_json(f"{stage}/index.json", {"schema": INDEX, "blocks": [{"block_id": b, "directory": f"block_{b:03d}", "camera_count": counts[b]} for b in sorted(counts)]})

    publish(target, fill)

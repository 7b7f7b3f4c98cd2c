from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from parcella.functions.geometry import Frame
from parcella.operators.frames import Diagnostics
from parcella.sources import artifacts
from parcella.streaming import queue


def manifest(b: int) -> dict:
    box = lambda lo, hi: {"min_g": [lo] * 3, "max_g": [hi] * 3}
    frame = {"version": 1, "R": [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], "origin": [0.1, 0.2, 0.3]}
    return {"schema": 2, "block_id": b, "run_id": "r", "ground_frame": frame, "core": box(0.0, 1.0), "context": box(-1.0, 2.0), "camera_indices": [0, 1], "frame_span": [0, 1], "provenance": "spatial", "source": {"cameras_sha256": "a", "images_sha256": "b", "points3D_sha256": "c"}}


def exported(spark, target, passes=True):
    blocks = spark.createDataFrame([(0, 2), (1, 2)], "block_id int, cameras int")
    points = spark.createDataFrame([(b, p) for b in (0, 1) for p in range(5)], "block_id int, point_id long")
    artifacts.export_blocks(target, blocks, blocks.select("block_id", F.lit(passes).alias("passes")), points, {b: manifest(b) for b in (0, 1)})


def test_export_is_whole_or_absent_and_reads_back(spark, tmp_path):
    target = str(tmp_path / "out")
    with pytest.raises(ValueError, match="too few"):
        exported(spark, target, passes=False)
    assert os.listdir(tmp_path) == []
    exported(spark, target)
    assert sorted(os.listdir(target)) == ["block_000", "block_001", "index.json", "points"]
    assert [r["block_id"] for r in artifacts.read_manifests(spark, target).orderBy("block_id").collect()] == [0, 1]
    assert spark.read.parquet(f"{target}/points").count() == 10
    with pytest.raises(FileExistsError):
        exported(spark, target)
    other = manifest(1)
    other["ground_frame"]["origin"][0] += 1e-16 + 1e-12
    artifacts.save_manifest(f"{target}/block_001/manifest.json", other)
    with pytest.raises(ValueError, match="frames differ"):
        artifacts.read_manifests(spark, target)


def test_a_failed_fill_leaves_nothing(tmp_path):
    def fill(stage):
        open(stage + "/x", "w").close()
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        artifacts.publish(str(tmp_path / "t"), fill)
    assert os.listdir(tmp_path) == []


@pytest.mark.parametrize("change", [{"schema": 1}, {"block_id": True}, {"camera_indices": [1, 0]}, {"camera_indices": []}, {"frame_span": [2, 1]}, {"provenance": ""}, {"core": {"min_g": [-2.0] * 3, "max_g": [1.0] * 3}}])
def test_malformed_manifests_are_errors(change):
    with pytest.raises(ValueError):
        artifacts.checked_manifest(manifest(0) | change)


def test_json_has_no_nan_and_receipts_compare(tmp_path):
    path = str(tmp_path / "r.json")
    with pytest.raises(ValueError):
        artifacts.save_json(path, {"x": float("nan")})
    artifacts.save_json(path, artifacts.receipt("crop", block_id=3, ply_sha256="a"))
    assert artifacts.receipt_matches(path, block_id=3) and not artifacts.receipt_matches(path, block_id=4)
    assert not artifacts.receipt_matches(str(tmp_path / "none"), block_id=3)


def test_diagnostics_are_tied_to_the_poses(tmp_path):
    root, poses = str(tmp_path), tmp_path / artifacts.IMAGES
    poses.parent.mkdir(parents=True)
    poses.write_bytes(b"poses")
    frame = Frame([[1.0, 0.0, 0.0], [0.0, 0.0, 1.0], [0.0, -1.0, 0.0]], [0.1, 2.0, -3.0])
    said = Diagnostics("pca", [0.0, 1.0, 0.0], 2.5, [0.0, 0.8, 0.6], 12.0, False, None, 0.2, 0.7, 90.0, 0.5, [40.0, 30.0, 1.0], 180, ["a warning"])
    path = artifacts.save_diagnostics(root, frame, said)
    back, known = artifacts.load_diagnostics(root)
    assert (back.rows, back.origin, known) == (frame.rows, frame.origin, said)
    whole = json.load(open(path))
    assert whole["plane_diagnostics"]["n_cameras"] == 180 and whole["plane_diagnostics"]["agreement_deg"] is None
    poses.write_bytes(b"other poses")
    with pytest.raises(ValueError, match="have changed"):
        artifacts.load_diagnostics(root)
    for change, said_of in (({"schema": 2}, "schema"), ({"plane_diagnostics": {}}, "malformed"), ({"ground_frame": {"R": [[1.0]], "origin": []}}, "malformed")):
        artifacts.save_json(path, whole | change)
        with pytest.raises(ValueError, match=said_of):
            artifacts.load_diagnostics(root)


def test_unsafe_directories_are_errors(spark, tmp_path):
    (tmp_path / "index.json").write_text(json.dumps({"schema": 1, "blocks": [{"block_id": 0, "directory": "../x", "camera_count": 1}]}))
    with pytest.raises(Exception, match="unsafe directory"):
        artifacts.read_index(spark, str(tmp_path)).collect()


def test_queue_as_a_stream(spark, tmp_path):
    schema = "job_id string, ts timestamp_ntz, event_id long, state string"
    rows = [("a", "2024-01-01 00:00:00", 1, "pending"), ("a", "2024-01-01 00:05:00", 2, "running"), ("b", "2024-01-01 00:06:00", 3, "failed")]
    log = str(tmp_path / "log")
    for r in rows:
        spark.createDataFrame([r], "job_id string, ts string, event_id long, state string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.mode("append").parquet(log)
    full = spark.read.parquet(log).schema
    assert full.simpleString().startswith("struct<job_id:string,ts:timestamp_ntz") and schema
    q = queue.publish(queue.running_states(queue.events(spark, log, full, 1)), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    last = max(int(p.split("=")[1]) for p in os.listdir(tmp_path / "out"))
    assert {r["job_id"]: r["state"] for r in spark.read.parquet(f"{tmp_path}/out/batch={last}").collect()} == {"a": "running", "b": "failed"}
    counts = queue.activity(spark.read.parquet(log)).agg(F.sum("events")).first()[0]
    assert counts == 3

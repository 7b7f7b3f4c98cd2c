from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from parcella.functions.geometry import PARAMETERS
from parcella.operators import checks, jobs
from parcella.sources.binary import count_records, merge_ply, ply_header, read_ply, read_sparse, write_ply, write_sparse


def test_cameras_of_every_model_round_trip(spark, tmp_path):
    rows = [(m + 1, m, 640, 480, [float(k) for k in range(n)]) for m, n in PARAMETERS.items()]
    df = spark.createDataFrame(rows[::-1], "camera_id int, model_id int, width long, height long, params array<double>")
    path = str(tmp_path / "cameras.bin")
    write_sparse(df, path, "cameras")
    assert count_records(path) == len(rows)
    assert [tuple(r) for r in read_sparse(spark, path, "cameras", records=4).orderBy("camera_id").collect()] == rows
    again = str(tmp_path / "again.bin")
    write_sparse(read_sparse(spark, path, "cameras"), again, "cameras")
    assert open(path, "rb").read() == open(again, "rb").read()


def test_images_round_trip(spark, tmp_path):
    rows = [(2, [1.0, 0.0, 0.0, 0.0], [1.0, 2.0, 3.0], 1, "b é.jpg", [(1.0, 2.0, 7), (3.0, 4.0, -1)]), (1, [0.5] * 4, [0.0] * 3, 1, "a.jpg", [])]
    df = spark.createDataFrame(rows, "image_id int, qvec array<double>, tvec array<double>, camera_id int, name string, points2d array<struct<x: double, y: double, point3d_id: long>>")
    path = str(tmp_path / "images.bin")
    write_sparse(df, path, "images")
    got = read_sparse(spark, path, "images").orderBy("image_id").collect()
    assert [r["name"] for r in got] == ["a.jpg", "b é.jpg"] and [tuple(m) for m in got[1]["points2d"]] == rows[0][5]


def test_the_last_of_repeated_records_counts_and_short_files_fail(spark, tmp_path):
    one = lambda k: struct.pack("<iiQQ3d", 1, 0, k, k, 1, 2, 3)
    path = tmp_path / "cameras.bin"
    path.write_bytes(struct.pack("<Q", 2) + one(5) + one(6))
    assert read_sparse(spark, str(path), "cameras").first()["width"] == 6
    path.write_bytes(struct.pack("<Q", 2) + one(5) + one(6)[:-1])
    with pytest.raises(Exception, match="ends within a record"):
        read_sparse(spark, str(path), "cameras").collect()
    path.write_bytes(struct.pack("<Q", 1) + struct.pack("<iiQQ", 1, 99, 1, 1))
    with pytest.raises(Exception, match="unknown camera model"):
        read_sparse(spark, str(path), "cameras").collect()


def vertex_file(path, values, kind="uchar", note="one"):
    head = f"ply\nformat binary_little_endian 1.0\ncomment {note}\nelement vertex {len(values)}\nproperty float x\nproperty {kind} red\nend_header\n"
    path.write_bytes(head.encode() + b"".join(struct.pack("<fB" if kind == "uchar" else "<fb", *v) for v in values))
    return str(path)


def test_files_of_vertices_merge_in_order_with_their_types(spark, tmp_path):
    rows = [[(k + b / 4, 250 - k) for k in range(n)] for b, n in enumerate((9, 0, 5))]
    parts = [vertex_file(tmp_path / f"{k}.ply", r, note=f"made by {k}") for k, r in enumerate(rows)]
    out = str(tmp_path / "all.ply")
    merge_ply(spark, parts, out, rows=4)
    assert ply_header(out).properties == [("x", "float"), ("red", "uchar")]
    assert [(r["x"], r["red"]) for r in read_ply(spark, out).orderBy("row_no").collect()] == sum(rows, [])
    assert (tmp_path / "all.ply").read_bytes().endswith(b"".join(struct.pack("<fB", *v) for v in sum(rows, [])))
    merge_ply(spark, [parts[1]], str(tmp_path / "none.ply"))
    assert ply_header(str(tmp_path / "none.ply")).vertices == 0
    other = vertex_file(tmp_path / "other.ply", [(1.0, 1)], kind="char")
    for bad in ([], [*parts, other]):
        with pytest.raises(ValueError):
            merge_ply(spark, bad, str(tmp_path / "bad.ply"))
    assert not (tmp_path / "bad.ply").exists()


def test_ply_round_trips_in_order_and_rejects_other_files(spark, tmp_path):
    df = spark.createDataFrame([(k, float(-k), float(k) / 4) for k in range(50)], "n int, x double, y float").repartition(5)
    path = str(tmp_path / "v.ply")
    write_ply(df, path, "n", comments=["made here"])
    back = read_ply(spark, path, rows=7).orderBy("row_no").collect()
    assert [r["n"] for r in back] == list(range(50)) and back[9]["x"] == -9.0
    data = open(path, "rb").read()
    for k, (bad, why) in enumerate(((data[:-1], "payload"), (data.replace(b"binary_little_endian", b"ascii"), "little-endian"), (data.replace(b"property int n", b"property list uchar int n"), "unsupported"))):
        p = tmp_path / f"{k}.ply"
        p.write_bytes(bad)
        with pytest.raises(Exception, match=why):
            read_ply(spark, str(p)).collect()


def test_parts_merge_only_with_equal_properties(spark):
    a, b = spark.createDataFrame([(1, 2.0)], "k int, x double"), spark.createDataFrame([(1, 2.0)], "k int, y double")
    with pytest.raises(ValueError, match="properties"):
        checks.ordered_union([(0, a), (1, b)], "k")


def test_queue_rules(spark):
    e = spark.createDataFrame([("a", 1, 1, "pending"), ("a", 1, 2, "running"), ("b", 1, 3, "failed"), ("c", 5, 4, "succeeded"), ("c", 2, 9, "running"), ("d", 1, 7, "running")], "job_id string, ts long, event_id long, state string")
    latest = jobs.latest_states(e)
    states = {r["job_id"]: r["state"] for r in latest.collect()}
    assert states == {"a": "running", "b": "failed", "c": "succeeded", "d": "running"}
    known = latest.withColumn("process_id", F.when(F.col("job_id") == "d", F.lit(7)))
    alive = spark.createDataFrame([(7,)], "process_id int")
    after = lambda retry: {r["job_id"]: r["state"] for r in jobs.recovered(known, alive, retry).collect()}
    assert after(False) == {"a": "pending", "b": "failed", "c": "succeeded", "d": "running"}
    assert after(True)["b"] == "pending"
    assert {r["state"]: r["jobs"] for r in jobs.queue_counts(latest).collect()} == {"pending": 0, "running": 2, "succeeded": 1, "failed": 1}
    with pytest.raises(Exception, match="unknown state"):
        jobs.job_status(e.select("job_id").distinct(), e.select("job_id").distinct().withColumn("state", F.lit("odd"))).collect()


def test_argv_rewrite(spark):
    start = ["--data-path", "a", "--output-path", "b"]
    cases = [
        (start, ["--centralize=off"]),
        ([*start, "--centralize", "on", "--more"], ["--centralize", "off", "--more"]),
        ([*start, "--centralize=auto", "--centralize", "on"], ["--centralize=off", "--centralize", "on"]),
    ]
    df = spark.createDataFrame([(n, argv) for n, (argv, _) in enumerate(cases)], "n int, argv array<string>")
    got = [r[0] for r in df.orderBy("n").select(jobs.rewrite_argv(F.col("argv"), F.lit("x"), F.lit("y"), "c.py")).collect()]
    assert got == [["--data-path", "x", "--output-path", "y", *rest, "--python-script", "c.py"] for _, rest in cases]
    for bad, why in ((["--data-path"], "data-path"), (["--data-path", "a"], "output-path"), ([*start, "--centralize"], "centralize")):
        with pytest.raises(Exception, match=f"no value after --{why}"):
            spark.createDataFrame([(bad,)], "argv array<string>").select(jobs.rewrite_argv(F.col("argv"), F.lit("x"), F.lit("y"))).collect()


def test_job_settings_and_devices(spark):
    b = spark.createDataFrame([(4, 40, "far/block")], "block_id int, cameras long, directory string")
    r = jobs.jobs(b, "mcmc", 10, 0).first()
    assert r["max_cap"] == 400 and r["data_path"] == "blocks/far/block" and r["output_path"] == "outputs/block_004" and r["argv"][-1] == "0"
    for wrong in ({"strategy": "x"}, {"cap_per_camera": 0}, {"cap_per_camera": True}, {"width": -1}):
        with pytest.raises(ValueError):
            jobs.jobs(b, **wrong)
    assert jobs.device_ids(" 0, 2 ,") == ["0", "2"]
    for wrong in ("", "1,1"):
        with pytest.raises(ValueError):
            jobs.device_ids(wrong)
    native = jobs.launch_commands(jobs.jobs(b), "/d", "/r", "train").first()["command"]
    assert native[:5] == ["train", "--headless", "--train", "--data-path", "/d/blocks/far/block"] and native[6] == "/r/outputs/block_004"
    with pytest.raises(ValueError, match="outside"):
        jobs.launch_commands(jobs.jobs(b), "/d", "/r", "train", image="i", mount="/elsewhere")


def test_mount_root_follows_links(tmp_path):
    (tmp_path / "data/blocks/b0").mkdir(parents=True)
    (tmp_path / "pictures").mkdir()
    with pytest.raises(ValueError, match="no folder"):
        jobs.mount_root(str(tmp_path / "data"), ["blocks/b0"])
    (tmp_path / "data/blocks/b0/images").symlink_to(tmp_path / "pictures")
    assert jobs.mount_root(str(tmp_path / "data"), ["blocks/b0"]) == str(tmp_path.resolve())


def test_merge_status_and_queues_that_are_taken_up_again(spark):
    two = spark.createDataFrame([(0,), (1,)], "block_id int")
    none = two.where("false")
    said = lambda *a, **k: tuple(jobs.merge_status(two, *a, **k).first())
    assert said(none) == ("awaiting crops", 0, 2) and said(two.limit(1)) == ("awaiting merge", 1, 2) and said(two, merged=True)[0] == "merged" and said(none, started=False) == ("not started", 0, 0)
    every = spark.createDataFrame([("a",), ("b",)], "job_id string")
    states = lambda *rows: spark.createDataFrame(rows, "job_id string, state string")
    assert {tuple(r) for r in jobs.checked_queue(every, states(("a", "failed"))).collect()} == {("a", "failed"), ("b", "pending")}
    with pytest.raises(Exception, match="several"):
        jobs.checked_queue(every, states(("a", "failed"), ("a", "pending"))).collect()
    with pytest.raises(Exception, match="unknown job"):
        jobs.job_status(every, states(("z", "failed"))).collect()

"""Training jobs and the queue that runs them, as tables: argument lists, states, transitions, merge status."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of a queue, and strategies that a trainer knows.
STATES = ("pending", "running", "succeeded", "failed")
STRATEGIES = ("mcmc", "mrnf", "igs+")


def jobs(blocks: DataFrame, strategy: str = "mrnf", cap_per_camera: int = 3000, width: int = 3840) -> DataFrame:
    """A job per block (block_id, cameras and, if it isn't block_NNN, directory): its limits, relative paths and arguments."""
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; there are {', '.join(STRATEGIES)}")
    if not whole(cap_per_camera) or cap_per_camera < 1 or not whole(width) or width < 0:
        raise ValueError("cap_per_camera must be positive, and width positive or zero")
    name = F.format_string("block_%03d", F.col("block_id"))
    cap = F.col("cameras") * cap_per_camera
    data = F.concat(F.lit("blocks/"), F.col("directory") if "directory" in blocks.columns else name)
    out = F.concat(F.lit("outputs/"), name)
    flags = {"--data-path": data, "--output-path": out, "--strategy": F.lit(strategy), "--max-cap": cap.cast("string"), "--max-width": F.lit(str(width))}
    argv = F.array(F.lit("--headless"), F.lit("--train"), *(x for k, v in flags.items() for x in (F.lit(k), v)))
    return blocks.select(name.alias("job_id"), "block_id", F.col("cameras").alias("camera_count"), cap.alias("max_cap"), data.alias("data_path"), out.alias("output_path"), argv.alias("argv"))


def _fail(*message: Column | str, kind: str = "array<string>") -> Column:
    return F.raise_error(F.concat(*(F.lit(m) if isinstance(m, str) else m for m in message))).cast(kind)


def rewrite_argv(argv: Column, data_path: Column, output_path: Column, callback: str | None = None) -> Column:
    """argv with the values of both path flags replaced and centring off, for a crop callback to be run after training.

    --centralize takes the element after it as its value; --centralize=... holds its own. The first of either is set to off,
    and without one --centralize=off is appended. A path flag that is missing, and a flag at the end, are errors.
    """

    def replaced(args: Column, flag: str, value: Column) -> Column:
        at = F.array_position(args, flag)
        moved = F.transform(args, lambda a, i: F.when(i == at, value).otherwise(a))
        return F.when((at == 0) | (at == F.size(args)), _fail(f"no value after {flag}")).otherwise(moved)

    args = replaced(replaced(argv, "--data-path", data_path), "--output-path", output_path)
    at = F.array_position(F.transform(args, lambda a: (a == "--centralize") | F.startswith(a, F.lit("--centralize="))), F.lit(True))
    apart = F.element_at(args, F.greatest(at, F.lit(1)).cast("int")) == "--centralize"
    off = (
        F.when(at == 0, F.concat(args, F.array(F.lit("--centralize=off"))))
        .when(apart & (at == F.size(args)), _fail("no value after --centralize"))
        .when(apart, F.transform(args, lambda a, i: F.when(i == at, "off").otherwise(a)))
        .otherwise(F.transform(args, lambda a, i: F.when(i + 1 == at, "--centralize=off").otherwise(a)))
    )
    return F.concat(off, F.array(F.lit("--python-script"), F.lit(callback))) if callback is not None else off


def safe_path(path: Column) -> Column:
    """Relative, without a parent step, and not empty."""
    return F.coalesce((path != "") & ~F.startswith(path, F.lit("/")) & ~F.array_contains(F.split(path, "/"), ".."), F.lit(False))


def safe_name(name: Column) -> Column:
    """A bare file name."""
    return F.coalesce((name != "") & ~F.contains(name, F.lit("/")) & ~F.contains(name, F.lit("\\")) & ~name.isin(".", ".."), F.lit(False))


def common_root(paths: Iterable[str]) -> str:
    """The deepest folder above all paths, which must exist."""
    every = list(paths)
    if not every:
        raise ValueError("no paths to find a common folder of")
    root = os.path.commonpath(every)
    if not os.path.isdir(root):
        raise ValueError(f"{root} is no folder")
    return root


def mount_root(dataset: str, data_paths: Iterable[str]) -> str:
    """The folder to be mounted for a dataset: above it and whatever the images links of its blocks lead to."""
    dataset = os.path.realpath(dataset)
    paths = [dataset]
    for block in data_paths:
        images = os.path.join(dataset, block, "images")
        if not os.path.isdir(images):
            raise ValueError(f"{images} leads to no folder")
        paths.append(os.path.realpath(images))
    return common_root(paths)


def device_ids(text: str) -> list[str]:
    """The ids of a comma-separated list; none, and repeated ones, are errors."""
    ids = [x.strip() for x in text.split(",") if x.strip()]
    if not ids or len(set(ids)) < len(ids):
        raise ValueError("ids of devices must be a list of different ones, parted by commas")
    return ids


def launch_commands(all_jobs: DataFrame, dataset: str, run: str, trainer: str, image: str | None = None, engine: str = "docker", mount: str | None = None, callback: str | None = None) -> DataFrame:
    """(job_id, block_id, command): how each job is started, natively or, with an image, in a container.

    A container sees mount (the dataset's folder or one above it) as /input, read only, and run as /run; it looks for the
    block's images once more after mounting, and gets the device that its worker chose passed through.
    """
    job, out = F.col("job_id"), f"{run}/outputs/"
    if image is None:
        args = rewrite_argv(F.col("argv"), F.concat(F.lit(f"{dataset}/"), "data_path"), F.concat(F.lit(out), job), callback)
        return all_jobs.select("job_id", "block_id", F.concat(F.array(F.lit(trainer)), args).alias("command"))
    mount = mount or dataset
    inside = os.path.relpath(dataset, mount)
    if inside.split("/")[0] == "..":
        raise ValueError(f"{dataset} lies outside {mount}")
    root = "/input" if inside == "." else f"/input/{inside}"
    block = F.concat(F.lit(f"{root}/"), "data_path")
    args = rewrite_argv(F.col("argv"), block, F.concat(F.lit("/run/outputs/"), job), callback)
    check = 'test -e "$BLOCK_IMAGES" || exit 64; exec "$TRAINER" "$@"'
    settings = [F.concat(F.lit("BLOCK_IMAGES="), block, F.lit("/images")), F.lit(f"TRAINER={trainer}"), F.lit("CUDA_VISIBLE_DEVICES"), F.lit(f"DATASET_ROOT={root}"), F.lit("RUN_DIR=/run"), F.concat(F.lit("BLOCK_ID="), F.col("block_id").cast("string"))]
    start = [F.lit(x) for x in (engine, "run", "--rm", "--gpus", "all", "-v", f"{mount}:/input:ro", "-v", f"{run}:/run:rw")]
    head = F.array(*start, *(x for s in settings for x in (F.lit("-e"), s)), *(F.lit(x) for x in ("--entrypoint", "/bin/sh", image, "-c", check, "sh")))
    return all_jobs.select("job_id", "block_id", F.concat(head, args).alias("command"))


def latest_states(events: DataFrame) -> DataFrame:
    """The last event (job_id, ts, event_id, state, ...) of each job; ties of time go to the larger event_id."""
    others = [c for c in events.columns if c not in ("job_id", "ts", "event_id")]
    last = F.max(F.struct("ts", "event_id", *others)).alias("e")
    return events.groupBy("job_id").agg(last).select("job_id", "e.*")


def job_status(all_jobs: DataFrame, states: DataFrame) -> DataFrame:
    """Every job with its state, "not started" where the queue has none. A state of no known kind, and one of an unknown job,
    are errors."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    joined = all_jobs.withColumn("__job", F.lit(True)).join(states.withColumnRenamed("job_id", "__of"), F.col("job_id") == F.col("__of"), "full")
    state = (
        F.when(F.col("__job").isNull(), _fail("the queue has a state of an unknown job, ", named("__of"), kind="string"))
        .when(F.col("state").isNull(), "not started")
        .when(F.col("state").isin(*STATES), F.col("state"))
        .otherwise(_fail("unknown state ", named("state"), kind="string"))
    )
    return joined.withColumn("state", state).drop("__job", "__of")


def queue_counts(states: DataFrame) -> DataFrame:
    """Jobs in each of the four states."""
    every = states.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    return every.join(states.groupBy("state").agg(F.count("*").alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("jobs"))


def merge_status(blocks: DataFrame, crops: DataFrame, started: bool = True, merged: bool = False) -> DataFrame:
    """One row (status, crops, blocks) from the exported blocks (block_id) and those with a complete crop: not started without a
    run, merged with a merge receipt, awaiting merge as soon as there is a crop, else awaiting crops."""
    if not started:
        return blocks.sparkSession.createDataFrame([("not started", 0, 0)], "status string, crops long, blocks long")
    cropped = crops.select("block_id").distinct().withColumn("cropped", F.lit(True))
    counts = blocks.select("block_id").join(cropped, "block_id", "left").agg(F.count("cropped").alias("crops"), F.count("*").alias("blocks"))
    text = F.when(F.lit(merged), "merged").when(F.col("crops") > 0, "awaiting merge").otherwise("awaiting crops")
    return counts.select(text.alias("status"), "crops", "blocks")


def checked_queue(all_jobs: DataFrame, states: DataFrame) -> DataFrame:
    """The states of a queue that is taken up again: one for every job, pending for jobs that have none yet. A job with several
    states, and a state of an unknown job, are errors."""
    per = states.groupBy("job_id").agg(F.count("*").alias("__n"), F.first("state").alias("state"))
    found = job_status(all_jobs.select("job_id"), per)
    one = F.when(F.col("__n") > 1, _fail("job ", F.col("job_id").cast("string"), " has several states", kind="string"))
    return found.select("job_id", one.otherwise(F.when(F.col("state") == "not started", "pending").otherwise(F.col("state"))).alias("state"))


def recovered(states: DataFrame, alive: DataFrame, retry_failed: bool = False) -> DataFrame:
    """The states after a restart: running jobs whose process (process_id) is dead or not known go back to pending, failed ones
    only on request; succeeded ones stay."""
    lives = alive.select("process_id").distinct().withColumn("__alive", F.lit(True))
    back = ((F.col("state") == "running") & F.col("__alive").isNull()) | ((F.col("state") == "failed") & F.lit(retry_failed))
    return states.join(lives, "process_id", "left").withColumn("state", F.when(back, "pending").otherwise(F.col("state"))).drop("__alive")


def claims(states: DataFrame, workers: int) -> DataFrame:
    """The next jobs in the order of their names: (job_id, worker)."""
    first = states.where("state = 'pending'").select("job_id").orderBy("job_id").limit(workers)
    return first.withColumn("worker", F.row_number().over(Window.orderBy("job_id")) - 1)


def outcome(exit_code: Column, crop_complete: Column) -> Column:
    """The state after a trainer ended: only exit code 0 with a complete crop succeeds."""
    return F.when((exit_code == 0) & crop_complete, "succeeded").otherwise("failed")


def next_try(exit_code: Column, mode: str, native: bool) -> Column:
    """Whether a job is started once more natively: its container engine failed before the trainer began (exit code 125), the
    mode was left to choose, and there is a native trainer."""
    return F.coalesce(exit_code == 125, F.lit(False)) & F.lit(mode == "auto" and native)

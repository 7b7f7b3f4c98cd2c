"""A scene over the driver's tables: orders are images, customers cameras, parts points, lineitems observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcella.functions.geometry import Frame, focal, normalised, rotation
from parcella.session import stored

#: The ground frame of queries that don't fit one.
FRAME = Frame([[0.8, 0.6, 0.0], [-0.6, 0.8, 0.0], [0.0, 0.0, 1.0]], [1.0, 2.0, 0.5])
IDENTITY = Frame([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], [0.0, 0.0, 0.0])


class Tables:
    """Views of one scale's tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def images(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.table("orders").select(
            k.alias("image_id"),
            F.col("o_custkey").alias("camera_id"),
            F.lpad(k.cast("string"), 10, "0").alias("name"),
            F.lit(1.0).alias("qw"),
            ((k % 7 - 3) * F.lit(0.05)).alias("qx"),
            ((k % 11 - 5) * F.lit(0.05)).alias("qy"),
            ((k % 5 - 2) * F.lit(0.05)).alias("qz"),
            (k / 100).alias("x"),
            (F.col("o_totalprice") / 10000).alias("y"),
            (k % 7 * F.lit(0.01)).alias("z"),
        )

    @property
    def cameras(self) -> DataFrame:
        k = F.col("c_custkey")
        f = (k % 400 + 800).cast("double")
        return self.table("customer").select(
            k.alias("camera_id"), (k % 11).cast("int").alias("model_id"), F.lit(1920).alias("width"), F.lit(1080).alias("height"), F.array(f, f + 10, F.lit(960.0), F.lit(540.0)).alias("params")
        )

    @property
    def points(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("point_id"), (F.col("p_partkey") * F.lit(0.075)).alias("x"), F.col("p_size").cast("double").alias("y"), (F.col("p_size") * F.lit(0.01)).alias("z"))

    @property
    def observations(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_partkey").alias("point_id"), F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("point2d"))

    @property
    def splats(self) -> DataFrame:
        e = F.col("embedding")
        return self.table("embeddings").select(F.col("vec_id").alias("splat_id"), *(F.get(e, k).cast("double").alias(a) for k, a in enumerate("xyz")), "label")

    @property
    def poses(self) -> DataFrame:
        """Images with their cameras and rotation rows; an image without its camera is an error."""
        joined = with_intrinsics(self.images, self.cameras)
        q = normalised(*(F.col(c) for c in ("qw", "qx", "qy", "qz")))
        unit = joined.withColumns(dict(zip(("w", "i", "j", "k"), q)))
        rows = rotation(*(F.col(c) for c in "wijk"))
        fx, fy = focal(F.col("model_id"), F.col("params"))
        flat = {f"r{a}{b}": rows[a][b] for a in range(3) for b in range(3)}
        return unit.withColumns(flat | {"fx": fx, "fy": fy}).select("image_id", "camera_id", "model_id", "name", "x", "y", "z", *flat, "fx", "fy", "width", "height")

    @property
    def strips(self) -> DataFrame:
        """Four blocks side by side over the images' bounds in ground axes, each with a context a tenth wider."""
        g = FRAME.to_ground(tuple(F.col(c) for c in "xyz"))
        bounds = self.images.select(*(x.alias(a) for x, a in zip(g, "uvh"))).agg(*(f(a).alias(f"{n}_{a}") for a in "uvh" for f, n in ((F.min, "low"), (F.max, "high"))))
        rows = bounds.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("block_id"))
        width = (F.col("high_u") - F.col("low_u")) / 4
        core = {"core_u0": F.col("low_u") + width * F.col("block_id"), "core_u1": F.col("low_u") + width * (F.col("block_id") + 1)}
        core |= {f"core_{a}{k}": F.col(f"{n}_{a}") for a in "vh" for k, n in ((0, "low"), (1, "high"))}
        return with_context(rows.select("block_id", *(c.alias(n) for n, c in core.items())))


def with_context(blocks: DataFrame, share: float = 0.1) -> DataFrame:
    """blocks with a context: the core, wider by a share of its extent on each side of u and v."""
    out = {}
    for a in "uvh":
        low, high = F.col(f"core_{a}0"), F.col(f"core_{a}1")
        grow = (high - low) * F.lit(0.0 if a == "h" else share)
        out |= {f"context_{a}0": low - grow, f"context_{a}1": high + grow}
    return blocks.withColumns(out)


def with_intrinsics(images: DataFrame, cameras: DataFrame) -> DataFrame:
    """images joined with their cameras; a camera_id without a camera is an error."""
    known = cameras.withColumn("__known", F.lit(True))
    lost = F.raise_error(F.concat(F.lit("no camera "), F.col("camera_id").cast("string")))
    joined = images.join(known, "camera_id", "left")
    return joined.withColumn("model_id", F.when(F.col("__known").isNull(), lost.cast("int")).otherwise(F.col("model_id"))).drop("__known")


def fixed_poses(tables: Tables) -> DataFrame:
    """Poses with everything computed once: what follows refers to their columns many times."""
    return stored(tables.poses, "poses")

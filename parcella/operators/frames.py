"""Fitting a ground frame to camera poses: one job of moments, eigenvectors of 3x3 matrices on the driver, one of residuals."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcella.functions.geometry import Frame, axis, dot
from parcella.functions.ordered import numbered, with_previous

#: Fixed limits: degrees of dispersion that pass, and that make orientations unusable; of agreement; ratio below which a
#: plane through the centres says nothing; share of the path length that residuals may have.
DISPERSION_OK, DISPERSION_MAX, AGREEMENT_OK, DEGENERATE, RESIDUAL_SHARE = 3.0, 10.0, 5.0, 10.0, 0.03
TINY = float(np.finfo(float).tiny)
DOWN, RIGHT, FORWARD = (tuple(f"r{k}{j}" for j in range(3)) for k in (1, 0, 2))


@dataclass
class Diagnostics:
    """What a fit says about how far it can be trusted."""

    estimator: str
    normal_orientation: list[float]
    dispersion_deg: float
    normal_pca: list[float]
    pca_ratio: float
    pca_degenerate: bool
    agreement_deg: float | None
    residual_rms: float
    residual_max: float
    arc_length: float
    median_spacing: float
    extent: list[float]
    cameras: int
    warnings: list[str] = field(default_factory=list)


def _unit(v: np.ndarray) -> np.ndarray:
    length = float(np.linalg.norm(v))
    if length == 0:
        raise ValueError("a direction has no length")
    return v / length


def _second(names: tuple[str, ...], scale=None) -> dict:
    """Sums of products of the (normalised) components of a direction."""
    n = F.sqrt(dot(axis(*names), axis(*names)))
    return {f"{a}{b}": F.sum(F.col(a) / n * F.col(b) / n) for i, a in enumerate(names) for b in names[i:]}


def _square(row, names: tuple[str, ...]) -> np.ndarray:
    m = np.empty((3, 3))
    for i, a in enumerate(names):
        for j, b in enumerate(names[i:], i):
            m[i, j] = m[j, i] = row[f"{a}{b}"]
    return m


def moments(poses: DataFrame) -> DataFrame:
    """Centroid and population covariance of the centres: cx, cy, cz and xx, xy, ... zz."""
    names = ("x", "y", "z")
    return poses.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"c{c}") for c in names), *(F.covar_pop(a, b).alias(a + b) for i, a in enumerate(names) for b in names[i:]))


def variances(moments: DataFrame) -> DataFrame:
    """(largest, middle, smallest) eigenvalues of the covariance of moments. Their error is that of the largest one's last
    digits; that of the cubic's closed form is the root of that, so that it returns negative variances for wide scenes."""

    def values(*parts: float | None) -> list[float] | None:
        if None in parts:
            return None
        xx, xy, xz, yy, yz, zz = parts
        return np.linalg.eigvalsh(np.array([[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]])).tolist()

    found = moments.select(F.udf(values, "array<double>")("xx", "xy", "xz", "yy", "yz", "zz").alias("v"))
    return found.select(*(F.col("v")[k].alias(c) for k, c in ((2, "largest"), (1, "middle"), (0, "smallest"))))


def path_lengths(poses: DataFrame) -> DataFrame:
    """Arc length and median distance of consecutive centres in the order of names."""
    places = with_previous(numbered(poses.select("name", "x", "y", "z"), "name"), "position", {"px": "x", "py": "y", "pz": "z"})
    step = F.sqrt(sum(((F.col(c) - F.col("p" + c)) * (F.col(c) - F.col("p" + c)) for c in "yz"), (F.col("x") - F.col("px")) * (F.col("x") - F.col("px"))))
    return places.where("px is not null").select(step.alias("step")).agg(F.sum("step").alias("arc_length"), F.median("step").alias("median_spacing"))


def fit(poses: DataFrame, units_per_metre: float | None = None) -> tuple[Frame, Diagnostics]:
    """The frame of poses (name, x, y, z, r00..r22) and its diagnostics."""
    if units_per_metre is not None and units_per_metre <= 0:
        raise ValueError("units_per_metre must be positive")
    sums = {**_second(DOWN), **_second(RIGHT), **_second(FORWARD)}
    row = moments(poses).crossJoin(poses.agg(*(v.alias(k) for k, v in sums.items()), *(F.avg(c).alias(f"mean_{c}") for c in DOWN))).first()  # one row each
    if row["n"] < 3:
        raise ValueError("at least three cameras are needed")
    covariance = _square({f"{a}{b}": row[f"{a}{b}"] for a in "xyz" for b in "xyz" if a <= b}, ("x", "y", "z"))
    values, vectors = np.linalg.eigh(covariance)
    pca, ratio = _unit(vectors[:, 0]), float(min(values[1] / max(values[0], TINY), np.finfo(float).max))
    dominant = np.linalg.eigh(_square(row, DOWN))[1][:, 2]
    if dominant @ np.array([row[f"mean_{c}"] for c in DOWN]) < 0:
        dominant = -dominant
    up = -dominant
    n = F.sqrt(dot(axis(*DOWN), axis(*DOWN)))
    cosine = sum(F.col(c) / n * float(d) for c, d in zip(DOWN, dominant))
    angle = F.degrees(F.acos(F.least(F.lit(1.0), F.abs(cosine))))
    dispersion = float(poses.agg(F.sqrt(F.avg(angle * angle))).first()[0])
    degenerate = ratio < DEGENERATE
    agreement = None if degenerate else float(np.degrees(np.arccos(min(1.0, abs(float(up @ pca))))))
    warnings = [f"the plane through the centres is degenerate (ratio {ratio:.6g})"] if degenerate else []
    if dispersion <= DISPERSION_MAX:
        estimator, normal = "orientation", up
        if dispersion > DISPERSION_OK:
            warnings.append(f"orientations scatter by {dispersion:.3f} degrees")
        elif agreement is not None and agreement > AGREEMENT_OK:
            warnings.append(f"orientations and centres disagree by {agreement:.3f} degrees")
    else:
        estimator = "nullspace"
        square, vectors = np.linalg.eigh(_square(row, RIGHT) + _square(row, FORWARD))
        normal = _unit(vectors[:, 0])
        normal = normal if normal @ up >= 0 else -normal
        warnings.append(f"orientations scatter by {dispersion:.3f} degrees: fitted to right and forward axes (ratio {np.sqrt(max(square[0], 0) / max(square[1], TINY)):.6g})")
    frame = frame_from(normal, covariance, np.array([row["cx"], row["cy"], row["cz"]]))
    u, v, h = frame.to_ground(axis("x", "y", "z"))
    rest = poses.select(u.alias("u"), v.alias("v"), h.alias("h")).agg(F.sqrt(F.var_pop("h")).alias("rms"), F.greatest(F.max("h") - F.avg("h"), F.avg("h") - F.min("h")).alias("far"), *((F.max(a) - F.min(a)).alias(a) for a in "uvh")).first()
    path = path_lengths(poses).first()
    if units_per_metre is None:
        warnings.append("the scale of the scene is not known")
    if path["arc_length"] > 0 and rest["rms"] > RESIDUAL_SHARE * path["arc_length"]:
        warnings.append("one plane fits this scene poorly")
    return frame, Diagnostics(
        estimator, up.tolist(), dispersion, pca.tolist(), ratio, degenerate, agreement, rest["rms"], rest["far"], path["arc_length"], path["median_spacing"], [rest[a] for a in "uvh"], row["n"], warnings
    )


def frame_from(normal: np.ndarray, covariance: np.ndarray, origin: np.ndarray) -> Frame:
    """The right-handed frame about a normal whose u follows the main direction of the centres; u's largest component, the
    first of equals, is positive."""
    h = _unit(normal)
    flat = np.eye(3) - np.outer(h, h)
    u = np.linalg.eigh(flat @ covariance @ flat)[1][:, 2]
    u = _unit(u if u[np.argmax(np.abs(u))] >= 0 else -u)
    v = _unit(np.cross(h, u))
    rows = np.stack([_unit(np.cross(v, h)), v, h])
    if np.linalg.det(rows) <= 0 or not np.allclose(rows @ rows.T, np.eye(3), rtol=0, atol=1e-12):
        raise AssertionError("the frame is not a right-handed orthonormal one")
    return Frame(rows.tolist(), origin.tolist())


def default_config(arc_length: float, spacing: float, residual: float, cameras: int, blocks: int = 4, **overrides: float) -> dict[str, float]:
    """Partition settings that follow from a fit."""
    config = {
        "core_extent": arc_length / blocks,
        "max_cameras": max(3, -(-cameras // blocks)),
        "lateral_margin": 5 * spacing,
        "context_share": 0.10,
        "pad_down": max(2 * spacing, residual),
        "pad_up": 12 * spacing,
        "merge_slack": 1.0,
    }
    unknown = set(overrides) - set(config)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return config | overrides

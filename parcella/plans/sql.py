"""The SQL that checks each scene query, written for DuckDB on the same tables."""

from __future__ import annotations

IMAGES = """images AS (
  SELECT o_orderkey AS image_id, o_custkey AS camera_id, lpad(o_orderkey::VARCHAR, 10, '0') AS name,
         1.0::DOUBLE AS qw, (o_orderkey % 7 - 3) * 0.05::DOUBLE AS qx, (o_orderkey % 11 - 5) * 0.05::DOUBLE AS qy, (o_orderkey % 5 - 2) * 0.05::DOUBLE AS qz,
         o_orderkey / 100 AS x, o_totalprice / 10000 AS y, o_orderkey % 7 * 0.01::DOUBLE AS z
  FROM orders)"""
INDEXED = IMAGES + """,
indexed AS (SELECT *, row_number() OVER (ORDER BY name) - 1 AS camera_index FROM images)"""
GROUND = INDEXED + """,
ground AS (
  SELECT camera_index, image_id, camera_id,
         (x - 1.0::DOUBLE) * 0.8::DOUBLE + (y - 2.0::DOUBLE) * 0.6::DOUBLE + (z - 0.5::DOUBLE) * 0.0::DOUBLE AS u,
         (x - 1.0::DOUBLE) * -0.6::DOUBLE + (y - 2.0::DOUBLE) * 0.8::DOUBLE + (z - 0.5::DOUBLE) * 0.0::DOUBLE AS v,
         (x - 1.0::DOUBLE) * 0.0::DOUBLE + (y - 2.0::DOUBLE) * 0.0::DOUBLE + (z - 0.5::DOUBLE) * 1.0::DOUBLE AS h
  FROM indexed)"""
STRIPS = GROUND + """,
bounds AS (SELECT min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1, min(h) AS h0, max(h) AS h1 FROM ground),
cores AS (
  SELECT k::INT AS block_id, u0 + (u1 - u0) / 4 * k AS u0, u0 + (u1 - u0) / 4 * (k + 1) AS u1, v0, v1, h0, h1
  FROM bounds, range(4) r(k)),
contexts AS (
  SELECT block_id, u0 - (u1 - u0) * 0.1::DOUBLE AS u0, u1 + (u1 - u0) * 0.1::DOUBLE AS u1,
         v0 - (v1 - v0) * 0.1::DOUBLE AS v0, v1 + (v1 - v0) * 0.1::DOUBLE AS v1, h0 - (h1 - h0) * 0.0::DOUBLE AS h0, h1 + (h1 - h0) * 0.0::DOUBLE AS h1
  FROM cores),
members AS (
  SELECT block_id, camera_index, image_id, camera_id FROM ground, contexts
  WHERE u BETWEEN u0 AND u1 AND v BETWEEN v0 AND v1 AND h BETWEEN h0 AND h1)"""
KEPT = STRIPS + """,
points AS (SELECT p_partkey AS point_id, p_partkey * 0.075::DOUBLE AS x, p_size::DOUBLE AS y, p_size * 0.01::DOUBLE AS z FROM part),
placed AS (
  SELECT point_id,
         (x - 1.0::DOUBLE) * 0.8::DOUBLE + (y - 2.0::DOUBLE) * 0.6::DOUBLE + (z - 0.5::DOUBLE) * 0.0::DOUBLE AS u,
         (x - 1.0::DOUBLE) * -0.6::DOUBLE + (y - 2.0::DOUBLE) * 0.8::DOUBLE + (z - 0.5::DOUBLE) * 0.0::DOUBLE AS v,
         (x - 1.0::DOUBLE) * 0.0::DOUBLE + (y - 2.0::DOUBLE) * 0.0::DOUBLE + (z - 0.5::DOUBLE) * 1.0::DOUBLE AS h
  FROM points),
kept AS (
  SELECT c.block_id, p.point_id, count(*) AS entries
  FROM placed p JOIN contexts c ON p.u BETWEEN c.u0 AND c.u1 AND p.v BETWEEN c.v0 AND c.v1 AND p.h BETWEEN c.h0 AND c.h1
  JOIN lineitem l ON l.l_partkey = p.point_id
  WHERE (c.block_id, l.l_orderkey) IN (SELECT block_id, image_id FROM members)
  GROUP BY ALL HAVING count(*) >= 2)"""
CAMERAS = """cameras AS (
  SELECT c_custkey AS camera_id, (c_custkey % 11)::INT AS model_id, 1920 AS width, 1080 AS height, (c_custkey % 400 + 800)::DOUBLE AS f FROM customer)"""
SPLATS = """splats AS (SELECT vec_id AS splat_id, label, embedding[1]::DOUBLE AS u, embedding[2]::DOUBLE AS v, embedding[3]::DOUBLE AS h FROM embeddings),
cubes AS (
  SELECT k::INT AS block_id, 0.2::DOUBLE * ((k & 1) - 1) AS u0, 0.2::DOUBLE * (k & 1) AS u1, 0.2::DOUBLE * ((k >> 1 & 1) - 1) AS v0, 0.2::DOUBLE * (k >> 1 & 1) AS v1,
         0.2::DOUBLE * ((k >> 2 & 1) - 1) AS h0, 0.2::DOUBLE * (k >> 2 & 1) AS h1
  FROM range(8) r(k)),
owned AS (
  SELECT s.splat_id, any_value(s.label) AS label,
         coalesce(min(block_id) FILTER (u >= u0 AND u < u1 AND v >= v0 AND v < v1 AND h >= h0 AND h < h1),
                  min(block_id) FILTER (u BETWEEN u0 AND u1 AND v BETWEEN v0 AND v1 AND h BETWEEN h0 AND h1), -1) AS owner
  FROM splats s, cubes GROUP BY s.splat_id)"""
QUEUE = """kinds AS (SELECT list_sort(list(DISTINCT event_type)) AS names FROM events),
queue AS (
  SELECT user_id AS job_id, ts, event_id, ['pending', 'running', 'succeeded', 'failed', 'pending'][list_position(names, event_type)] AS state FROM events, kinds),
latest AS (
  SELECT job_id, event_id, state FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS n FROM queue) WHERE n = 1)"""
STEPS = INDEXED + """,
steps AS (
  SELECT camera_index, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w) + (z - lag(z) OVER w) * (z - lag(z) OVER w)) AS step
  FROM indexed WINDOW w AS (ORDER BY name))"""
JOBS = """jobs AS (
  SELECT printf('block_%03d', n_nationkey) AS job_id, n_nationkey::INT AS block_id, (n_nationkey * 7 + 32)::BIGINT AS camera_count FROM nation)"""


def level(k: int) -> str:
    """One level of splits: leaves l{k} to l{k+1}."""
    return f""",
s{k} AS (SELECT leaf, count(*) AS n, max(u) - min(u) AS su, max(v) - min(v) AS sv FROM l{k} GROUP BY leaf),
r{k} AS (
  SELECT l.camera_index, l.leaf, s.n, s.n > cap AS todo, CASE WHEN su >= sv THEN u ELSE v END AS pos,
         row_number() OVER (PARTITION BY l.leaf ORDER BY CASE WHEN su >= sv THEN u ELSE v END, camera_index) - 1 AS rank
  FROM l{k} l JOIN s{k} s ON l.leaf = s.leaf, caps),
g{k} AS (SELECT *, lag(pos) OVER (PARTITION BY leaf ORDER BY rank) AS before FROM r{k}),
c{k} AS (
  SELECT leaf, min({{'off': abs(rank - n / 2), 'rank': rank}}).rank AS cut FROM g{k} WHERE todo AND rank BETWEEN 3 AND n - 3 AND before < pos GROUP BY leaf),
l{k + 1} AS (
  SELECT g.camera_index, u, v, g.leaf || CASE WHEN c.cut IS NULL THEN '' WHEN g.rank < c.cut THEN '0' ELSE '1' END AS leaf
  FROM g{k} g JOIN ground USING (camera_index) LEFT JOIN c{k} c ON g.leaf = c.leaf)"""


PARTED = GROUND + ", caps AS (SELECT greatest(3, ceil(count(*) / 8)) AS cap FROM ground), l0 AS (SELECT camera_index, u, v, '' AS leaf FROM ground)" + "".join(level(k) for k in range(5))


def frustum(far: str, source: str) -> str:
    """The eight interval tests between views and contexts, for a far plane given as SQL."""
    axes = []
    for j, a in enumerate("uvh"):
        spread = f"(tx * abs(r0{j}) + ty * abs(r1{j}))"
        low, high = f"(r2{j} - {spread})", f"(r2{j} + {spread})"
        axes.append(f"greatest({high}, {far} * {high}) >= (m{a} - {a}) - e{a} - eps AND least({low}, {far} * {low}) <= (m{a} - {a}) + e{a} + eps")

    def interval(terms: list[str], low: str, high: str, length: str) -> str:
        at = " + ".join(f"({t}) * (m{a} - {a})" for t, a in zip(terms, "uvh"))
        reach = " + ".join(f"e{a} * abs({t})" for t, a in zip(terms, "uvh"))
        return f"{high} >= ({at}) - ({reach}) - eps * {length} AND {low} <= ({at}) + ({reach}) + eps * {length}"

    axes.append(interval([f"r2{j}" for j in range(3)], "1.0", far, "1.0"))
    for k, t in ((0, "tx"), (1, "ty")):
        length = f"sqrt(1 + {t} * {t})"
        axes.append(interval([f"r{k}{j} + {t} * r2{j}" for j in range(3)], "0.0", f"2 * {far} * {t}", length))
        axes.append(interval([f"r{k}{j} - {t} * r2{j}" for j in range(3)], f"-2 * {far} * {t}", "0.0", length))
    inside = " AND ".join(f"{a} BETWEEN {a}0 AND {a}1" for a in "uvh")
    return f"({' AND '.join(axes)}) OR ({inside})"


VIEWS = f"""{INDEXED}, {CAMERAS},
unit AS (SELECT i.*, c.model_id, c.f, sqrt(qw * qw + qx * qx + qy * qy + qz * qz) AS q FROM indexed i JOIN cameras c USING (camera_id)),
turned AS (SELECT camera_index, x AS u, y AS v, z AS h, model_id, f, qw / q AS w, qx / q AS i, qy / q AS j, qz / q AS k FROM unit),
views AS (
  SELECT camera_index, u, v, h,
         1 - 2 * (j * j + k * k) AS r00, 2 * (i * j - w * k) AS r01, 2 * (i * k + w * j) AS r02,
         2 * (i * j + w * k) AS r10, 1 - 2 * (i * i + k * k) AS r11, 2 * (j * k - w * i) AS r12,
         2 * (i * k - w * j) AS r20, 2 * (j * k + w * i) AS r21, 1 - 2 * (i * i + j * j) AS r22,
         tan(1.05::DOUBLE * atan(1920 / (2 * f))) AS tx, tan(1.05::DOUBLE * atan(1080 / (2 * CASE WHEN model_id IN (0, 2, 8) THEN f ELSE f + 10 END))) AS ty
  FROM turned),
edges AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM images),
small AS (
  SELECT k::INT AS block_id, x0 + (x1 - x0) * k / 4 - 2 AS u0, x0 + (x1 - x0) * k / 4 + 2 AS u1, y0 + (y1 - y0) * k / 4 - 2 AS v0, y0 + (y1 - y0) * k / 4 + 2 AS v1, z0 + 3 AS h0, z1 + 9 AS h1
  FROM edges, range(1, 4) r(k)),
boxes AS (
  SELECT block_id, u0 - (u1 - u0) * 0.1::DOUBLE AS u0, u1 + (u1 - u0) * 0.1::DOUBLE AS u1, v0 - (v1 - v0) * 0.1::DOUBLE AS v0, v1 + (v1 - v0) * 0.1::DOUBLE AS v1, h0, h1 FROM small),
halves AS (SELECT *, (u0 + u1) / 2 AS mu, (v0 + v1) / 2 AS mv, (h0 + h1) / 2 AS mh, (u1 - u0) / 2 AS eu, (v1 - v0) / 2 AS ev, (h1 - h0) / 2 AS eh, 1e-10 AS eps FROM boxes)"""
MOMENTS = f"""WITH {IMAGES}, m AS (
  SELECT count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, y) AS yy, covar_pop(y, z) AS yz, covar_pop(z, z) AS zz FROM images)"""

ORACLE_SQL: dict[str, str] = {
    "images_with_intrinsics": f"WITH {IMAGES}, {CAMERAS} SELECT image_id, camera_id, model_id, width, height FROM images JOIN cameras USING (camera_id)",
    "camera_centres": f"""WITH {IMAGES}, unit AS (SELECT *, sqrt(qw * qw + qx * qx + qy * qy + qz * qz) AS q FROM images),
t AS (SELECT image_id, -x AS x, -y AS y, -z AS z, qw / q AS w, qx / q AS i, qy / q AS j, qz / q AS k FROM unit)
SELECT image_id,
  round(-((1 - 2 * (j * j + k * k)) * x + 2 * (i * j + w * k) * y + 2 * (i * k - w * j) * z), 6) + 0.0 AS cx,
  round(-(2 * (i * j - w * k) * x + (1 - 2 * (i * i + k * k)) * y + 2 * (j * k + w * i) * z), 6) + 0.0 AS cy,
  round(-(2 * (i * k + w * j) * x + 2 * (j * k - w * i) * y + (1 - 2 * (i * i + j * j)) * z), 6) + 0.0 AS cz FROM t""",
    "focal_lengths": f"""WITH {CAMERAS} SELECT camera_id, f AS fx, CASE WHEN model_id IN (0, 2, 8) THEN f ELSE f + 10 END AS fy,
  CASE WHEN model_id IN (0, 2, 3, 8, 9) THEN f ELSE f + 10 END AS fy_strict FROM cameras""",
    "camera_index": f"WITH {INDEXED} SELECT image_id, camera_index FROM indexed",
    "camera_spacing": f"WITH {STEPS} SELECT camera_index, round(step, 6) AS spacing FROM steps WHERE step IS NOT NULL",
    "spacing_arc_median": f"WITH {STEPS} SELECT round(sum(step), 3) AS arc_length, round(median(step), 6) AS median_spacing FROM steps",
    "centre_moments": MOMENTS + " SELECT n AS cameras, " + ", ".join(f"round({c}, 4) AS {c}" for c in ("cx", "cy", "cz", "xx", "xy", "xz", "yy", "yz", "zz")) + " FROM m",
    "pca_condition": MOMENTS
    + """, a AS (SELECT *, (xx + yy + zz) / 3 AS q FROM m),
b AS (SELECT *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM a),
c AS (SELECT *, (xx - q) / p AS bxx, (yy - q) / p AS byy, (zz - q) / p AS bzz, xy / p AS bxy, xz / p AS bxz, yz / p AS byz FROM b),
d AS (SELECT *, acos(greatest(-1.0, least(1.0, (bxx * (byy * bzz - byz * byz) - bxy * (bxy * bzz - byz * bxz) + bxz * (bxy * byz - byy * bxz)) / 2))) / 3 AS phi FROM c),
e AS (SELECT q, q + 2 * p * cos(phi) AS big, q + 2 * p * cos(phi + 2.0943951023931953::DOUBLE) AS small FROM d)
SELECT round(big, 3) AS largest, round(3 * q - big - small, 3) AS middle, round(small, 3) AS smallest FROM e""",
    "orientation_angles": f"""WITH {IMAGES}, unit AS (SELECT *, sqrt(qw * qw + qx * qx + qy * qy + qz * qz) AS q FROM images),
t AS (SELECT image_id, qw / q AS w, qx / q AS i, qy / q AS j, qz / q AS k FROM unit),
d AS (SELECT image_id, 2 * (i * j + w * k) AS a, 1 - 2 * (i * i + k * k) AS b, 2 * (j * k - w * i) AS c FROM t),
m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc FROM d)
SELECT image_id, round(degrees(acos(least(1.0, abs((a * ma + b * mb + c * mc) / sqrt(a * a + b * b + c * c) / sqrt(ma * ma + mb * mb + mc * mc))))), 4) AS angle_deg FROM d, m""",
    "ground_coords": f"WITH {GROUND} SELECT image_id, round(u, 6) + 0.0 AS u, round(v, 6) + 0.0 AS v, round(h, 6) + 0.0 AS h FROM ground",
    "world_coords": """WITH p AS (SELECT p_partkey AS point_id, p_partkey * 0.075::DOUBLE AS x, p_size::DOUBLE AS y, p_size * 0.01::DOUBLE AS z FROM part)
SELECT point_id, round(x * 0.8::DOUBLE + y * -0.6::DOUBLE + z * 0.0::DOUBLE + 1.0::DOUBLE, 6) + 0.0 AS a, round(x * 0.6::DOUBLE + y * 0.8::DOUBLE + z * 0.0::DOUBLE + 2.0::DOUBLE, 6) + 0.0 AS b,
  round(x * 0.0::DOUBLE + y * 0.0::DOUBLE + z * 1.0::DOUBLE + 0.5::DOUBLE, 6) + 0.0 AS c FROM p""",
    "height_residuals": f"""WITH {GROUND} SELECT round(sqrt(var_pop(h)), 6) AS residual_rms, round(greatest(max(h) - avg(h), avg(h) - min(h)), 6) AS residual_max,
  round(max(u) - min(u), 6) AS extent_u, round(max(v) - min(v), 6) AS extent_v, round(max(h) - min(h), 6) AS extent_h FROM ground""",
    "config_defaults": f"""WITH {STEPS}, p AS (SELECT round(sum(step), 3) AS arc, round(median(step), 6) AS spacing FROM steps),
n AS (SELECT count(*) AS n, round(max(abs(z - 0.5::DOUBLE)), 6) AS residual FROM images)
SELECT round(arc / 4, 6) AS core_extent, greatest(3, ceil(n / 4))::BIGINT AS max_cameras, round(5 * spacing, 6) AS lateral_margin, 0.1::DOUBLE AS context_share,
  round(greatest(2 * spacing, residual), 6) AS pad_down, round(12 * spacing, 6) AS pad_up FROM p, n""",
    "kd_split_level1": f"""WITH {GROUND}, s AS (SELECT count(*) AS n, max(u) - min(u) >= max(v) - min(v) AS along_u FROM ground),
a AS (SELECT camera_index, CASE WHEN along_u THEN u ELSE v END AS pos, n, along_u FROM ground, s),
r AS (SELECT *, row_number() OVER (ORDER BY pos, camera_index) - 1 AS rank, lag(pos) OVER (ORDER BY pos, camera_index) AS before FROM a),
c AS (SELECT * FROM r WHERE rank BETWEEN 3 AND n - 3 AND before < pos ORDER BY abs(rank - n / 2), rank LIMIT 1)
SELECT CASE WHEN along_u THEN 'u' ELSE 'v' END AS axis, rank AS cut, round((before + pos) / 2, 6) + 0.0 AS plane FROM c""",
    "kd_partition": f"WITH {PARTED} SELECT camera_index, leaf FROM l5",
    "core_boxes": f"""WITH {PARTED}, b AS (SELECT (row_number() OVER (ORDER BY leaf) - 1)::INT AS block_id, * FROM (SELECT leaf, min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1 FROM l5 GROUP BY leaf))
SELECT block_id, round(u0 - 0.5::DOUBLE, 6) + 0.0 AS u0, round(u1 + 0.5::DOUBLE, 6) + 0.0 AS u1, round(v0 - 0.5::DOUBLE, 6) + 0.0 AS v0, round(v1 + 0.5::DOUBLE, 6) + 0.0 AS v1, -1.0::DOUBLE AS h0, 6.0::DOUBLE AS h1 FROM b""",
    "context_boxes": f"WITH {STRIPS} SELECT block_id, " + ", ".join(f"round({a}{k}, 6) + 0.0 AS {a}{k}" for a in "uvh" for k in (0, 1)) + " FROM contexts",
    "block_overlaps": f"""WITH {STRIPS} SELECT a.block_id, b.block_id AS other_id, """
    + ", ".join(f"round(least(a.{x}1, b.{x}1) - greatest(a.{x}0, b.{x}0), 6) + 0.0 AS overlap_{x}" for x in "uvh")
    + " FROM contexts a JOIN contexts b ON a.block_id < b.block_id WHERE "
    + " AND ".join(f"least(a.{x}1, b.{x}1) - greatest(a.{x}0, b.{x}0) > 0" for x in "uvh"),
    "assign_centre": f"WITH {STRIPS} SELECT block_id, camera_index FROM members",
    "assign_frustum": f"WITH {VIEWS} SELECT block_id, camera_index FROM views, halves WHERE {frustum('20.0', 'views')}",
    "far_plane_sweep": f"""WITH {VIEWS}, fars AS (SELECT unnest([5.0::DOUBLE, 10.0, 20.0, 40.0]) AS far),
hits AS (SELECT far, block_id, camera_index FROM views, halves, fars WHERE {frustum('far', 'views')}),
sizes AS (SELECT f.far, b.block_id, count(h.camera_index) AS cameras FROM fars f CROSS JOIN boxes b LEFT JOIN hits h ON h.far = f.far AND h.block_id = b.block_id GROUP BY ALL),
s AS (SELECT far, min(cameras) AS least_cameras, sum(cameras)::BIGINT AS links FROM sizes GROUP BY far),
per AS (SELECT far, camera_index, count(*) AS k FROM hits GROUP BY ALL), most AS (SELECT far, max(k) AS max_blocks FROM per GROUP BY far),
inside AS (SELECT camera_index, count(b.block_id) AS cores FROM views LEFT JOIN small b ON u BETWEEN u0 AND u1 AND v BETWEEN v0 AND v1 AND h BETWEEN h0 AND h1 GROUP BY camera_index),
c AS (SELECT count(*) AS n, count(*) FILTER (cores = 0) AS orphans, count(*) FILTER (cores > 1) AS multi_owned FROM inside),
g AS (SELECT far, links / n AS mean, coalesce(max_blocks, 0) AS max_blocks, least_cameras, orphans, multi_owned,
      links / n <= 2.0 AND least_cameras >= 3 AND orphans = 0 AND multi_owned = 0 AS passes FROM s LEFT JOIN most USING (far), c)
SELECT far, round(mean, 6) AS mean_blocks, max_blocks, least_cameras, orphans, multi_owned, passes, max(far) FILTER (passes) OVER () AS best_far FROM g""",
    "assignment_diagnostics": f"""WITH {STRIPS}, per AS (SELECT g.camera_index, count(m.block_id) AS blocks FROM ground g LEFT JOIN members m USING (camera_index) GROUP BY ALL),
inside AS (SELECT camera_index, count(c.block_id) AS cores FROM ground LEFT JOIN cores c ON u BETWEEN u0 AND u1 AND v BETWEEN v0 AND v1 AND h BETWEEN h0 AND h1 GROUP BY camera_index)
SELECT round(avg(blocks), 6) AS mean_blocks, max(blocks) AS max_blocks, count(*) FILTER (cores = 0) AS orphans, count(*) FILTER (cores > 1) AS multi_owned, count(*) AS cameras FROM per JOIN inside USING (camera_index)""",
    "camera_blocks": f"""WITH {STRIPS} SELECT g.camera_index, coalesce(string_agg(m.block_id::VARCHAR, ';' ORDER BY m.block_id), '') AS assigned_block_ids, count(m.block_id) AS blocks_per_camera
FROM ground g LEFT JOIN members m USING (camera_index) GROUP BY g.camera_index""",
    "block_summary": f"""WITH {STRIPS} SELECT c.block_id, count(m.camera_index) AS cameras, min(m.camera_index) AS first_camera, max(m.camera_index) AS last_camera,
  round(any_value(c.u1 - c.u0), 6) + 0.0 AS extent_u, round(any_value(c.v1 - c.v0), 6) + 0.0 AS extent_v, round(any_value(c.h1 - c.h0), 6) + 0.0 AS extent_h
FROM cores c LEFT JOIN members m USING (block_id) GROUP BY c.block_id""",
    "ownership_counts": f"""WITH {STRIPS}, o AS (SELECT max(u1) AS ou, max(v1) AS ov, max(h1) AS oh FROM cores),
per AS (SELECT g.camera_index, count(c.block_id) AS owners FROM ground g CROSS JOIN o LEFT JOIN cores c
  ON u >= u0 AND (u < u1 OR (u1 = ou AND u = u1)) AND v >= v0 AND (v < v1 OR (v1 = ov AND v = v1)) AND h >= h0 AND (h < h1 OR (h1 = oh AND h = h1)) GROUP BY g.camera_index)
SELECT owners, count(*) AS cameras FROM per GROUP BY owners""",
    "ownership_ids": f"WITH {SPLATS} SELECT splat_id, owner FROM owned",
    "crop_counts": f"WITH {SPLATS} SELECT owner, count(*) AS splats, count(DISTINCT label) AS labels FROM owned GROUP BY owner",
    "merge_union": f"WITH {SPLATS} SELECT owner AS block_id, (row_number() OVER (PARTITION BY owner ORDER BY splat_id) - 1)::INT AS row_no, splat_id, label FROM owned WHERE owner >= 0",
    "point_filter": f"""WITH {KEPT}, c AS (SELECT block_id, count(*) AS cameras FROM members GROUP BY block_id), p AS (SELECT block_id, count(*) AS points, sum(entries)::BIGINT AS observations FROM kept GROUP BY block_id)
SELECT block_id, cameras, coalesce(points, 0) AS points, coalesce(observations, 0) AS observations FROM c LEFT JOIN p USING (block_id)""",
    "track_prune": f"WITH {KEPT} SELECT block_id, point_id, entries FROM kept",
    "point_guards": f"""WITH {KEPT}, per AS (SELECT c.block_id, count(k.point_id) AS points FROM cores c LEFT JOIN kept k USING (block_id) GROUP BY c.block_id), n AS (SELECT count(*) AS n FROM part)
SELECT block_id, points, round(points / n, 6) AS share, points >= 100 AND points / n >= 0.05::DOUBLE AS passes FROM per, n""",
    "block_camera_models": f"""WITH {STRIPS}, {CAMERAS}, used AS (SELECT DISTINCT block_id, camera_id FROM members) SELECT block_id, model_id, count(*) AS cameras FROM used JOIN cameras USING (camera_id) GROUP BY ALL""",
    "orphan_cameras": f"""WITH {STRIPS} SELECT camera_index, image_id FROM ground g WHERE NOT EXISTS (
  SELECT 1 FROM cores WHERE u BETWEEN u0 AND u1 - (u1 - u0) * 0.1::DOUBLE AND v BETWEEN v0 AND v1 AND h BETWEEN h0 AND h1)""",
    "image_union_diff": f"""WITH {STRIPS}, a AS (SELECT DISTINCT l_orderkey AS image_id FROM lineitem), b AS (SELECT DISTINCT image_id FROM members)
SELECT image_id, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT image_id, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "affine_transform": """WITH p AS (SELECT p_partkey AS point_id, p_partkey * 0.075::DOUBLE AS x, p_size::DOUBLE AS y, p_size * 0.01::DOUBLE AS z FROM part),
w AS (SELECT *, x * 0.001::DOUBLE + 1 AS w FROM p)
SELECT point_id, round((x * 0.5::DOUBLE + y * -0.25::DOUBLE + 1) / w, 6) + 0.0 AS a, round((x * 0.25::DOUBLE + y * 0.5::DOUBLE - 1) / w, 6) + 0.0 AS b, round((z * 2 + 0.5::DOUBLE) / w, 6) + 0.0 AS c FROM w""",
    "wireframe": f"""WITH {STRIPS}, pairs AS (SELECT a, b FROM range(8) p(a), range(8) q(b) WHERE a < b AND bit_count(xor(a, b)) = 1),
edges AS (SELECT (row_number() OVER (ORDER BY a, b) - 1)::INT AS edge, a, b FROM pairs), samples AS (SELECT k::INT AS sample, k / 4 AS t FROM range(5) r(k))
SELECT block_id, edge, sample, """
    + ", ".join(f"round(CASE WHEN a >> {k} & 1 = 1 THEN {x}1 ELSE {x}0 END * (1 - t) + CASE WHEN b >> {k} & 1 = 1 THEN {x}1 ELSE {x}0 END * t, 6) + 0.0 AS {x}" for k, x in enumerate("uvh"))
    + " FROM contexts, edges, samples",
    "training_job_list": f"""WITH {JOBS} SELECT job_id, block_id, camera_count, camera_count * 3000 AS max_cap, 'blocks/' || job_id AS data_path, 'outputs/' || job_id AS output_path,
  '--headless --train --data-path blocks/' || job_id || ' --output-path outputs/' || job_id || ' --strategy mrnf --max-cap ' || camera_count * 3000 || ' --max-width 3840' AS argv FROM jobs""",
    "argv_rewrite": f"""WITH {JOBS} SELECT job_id, '--headless --train --data-path /mnt/in/' || job_id || ' --output-path /mnt/out/' || job_id || ' --strategy mrnf --max-cap ' || camera_count * 3000 || ' --max-width 3840 '
  || CASE WHEN block_id % 3 = 1 THEN '--centralize off --eval' ELSE '--centralize=off' END || ' --python-script crop.py' AS argv FROM jobs""",
    "launch_commands": f"""WITH {JOBS} SELECT job_id, block_id, 'docker run --rm --gpus all -v /data:/input:ro -v /data/run:/run:rw -e BLOCK_IMAGES=/input/city/scene/blocks/' || job_id
  || '/images -e TRAINER=trainer -e CUDA_VISIBLE_DEVICES -e DATASET_ROOT=/input/city/scene -e RUN_DIR=/run -e BLOCK_ID=' || block_id
  || ' --entrypoint /bin/sh img:1 -c test -e "$BLOCK_IMAGES" || exit 64; exec "$TRAINER" "$@" sh --headless --train --data-path /input/city/scene/blocks/' || job_id
  || ' --output-path /run/outputs/' || job_id || ' --strategy mrnf --max-cap ' || camera_count * 3000 || ' --max-width 3840 --centralize=off --python-script /run/crop.py' AS command FROM jobs""",
    "latest_state": f"WITH {QUEUE} SELECT job_id, event_id, state FROM latest",
    "job_status": f"""WITH {QUEUE}, every AS (SELECT coalesce(c_custkey, job_id) AS job_id, c_nationkey AS block_id FROM customer FULL JOIN (SELECT DISTINCT job_id FROM queue) ON job_id = c_custkey)
SELECT e.job_id, block_id, coalesce(state, 'not started') AS state, CASE state WHEN 'succeeded' THEN 0 WHEN 'failed' THEN 1 END AS exit_code FROM every e LEFT JOIN latest l ON l.job_id = e.job_id""",
    "queue_counts": f"WITH {QUEUE} SELECT s.state, count(l.job_id) AS jobs FROM (VALUES ('pending'), ('running'), ('succeeded'), ('failed')) s(state) LEFT JOIN latest l ON l.state = s.state GROUP BY s.state",
    "queue_recovery": f"""WITH {QUEUE}, r AS (SELECT CASE WHEN state = 'failed' OR (state = 'running' AND job_id % 6 <> 0) THEN 'pending' ELSE state END AS state FROM latest)
SELECT state, count(*) AS jobs FROM r GROUP BY state""",
    "merge_status": f"""WITH {QUEUE}, c AS (SELECT count(*) AS blocks, count(*) FILTER (state = 'succeeded') AS crops FROM latest)
SELECT CASE WHEN crops > 0 THEN 'awaiting merge' ELSE 'awaiting crops' END AS status, crops, blocks FROM c""",
    "source_hash_check": """WITH n AS (SELECT doc_id AS field, sha256(text) AS digest FROM documents),
r AS (SELECT field + 1 AS field, digest FROM n UNION ALL SELECT field, digest FROM n WHERE field = 0)
SELECT r.field, r.digest AS recorded, n.digest AS current FROM r LEFT JOIN n USING (field) WHERE r.digest IS DISTINCT FROM n.digest""",
    "tree_diff": """WITH l AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS digest FROM documents UNION ALL SELECT 'b' || item_id, sha256(text) FROM benchmark),
r AS (SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 15 = 1 THEN sha256(doc_id::VARCHAR) ELSE sha256(text) END AS other FROM documents)
SELECT path, digest, other FROM l FULL JOIN r USING (path) WHERE digest IS DISTINCT FROM other""",
    "path_safety": """SELECT p_partkey, p_partkey % 5 IN (0, 4) AS safe_path, p_partkey % 5 = 4 AS safe_name FROM part""",
    "duplicate_keys": "SELECT l_partkey AS point_id, l_orderkey AS image_id, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "sequential_segments": f"""WITH RECURSIVE {GROUND},
near AS MATERIALIZED (
  SELECT a.camera_index AS i, b.camera_index AS j, max(b.u) OVER w - min(b.u) OVER w AS su, max(b.v) OVER w - min(b.v) OVER w AS sv
  FROM ground a CROSS JOIN range(101) o(k) JOIN ground b ON b.camera_index = a.camera_index + o.k
  WINDOW w AS (PARTITION BY a.camera_index ORDER BY b.camera_index)),
ends AS MATERIALIZED (SELECT i, min(j) FILTER (j - i >= 100 OR greatest(su, sv) > 45) AS nxt FROM near GROUP BY i),
seg(group_id, first) AS (SELECT 0::BIGINT, 0::BIGINT UNION ALL SELECT group_id + 1, nxt FROM seg JOIN ends ON i = first WHERE nxt IS NOT NULL),
sized AS (SELECT group_id, first, coalesce(lead(first) OVER (ORDER BY group_id), (SELECT count(*) FROM ground)) - first AS n, lead(first) OVER (ORDER BY group_id) IS NULL AS last FROM seg),
spans AS (SELECT max(u) - min(u) AS su, max(v) - min(v) AS sv, count(*) AS n FROM ground, (SELECT max(first) AS f FROM sized WHERE NOT last) WHERE camera_index >= f),
joins AS (SELECT (SELECT count(*) > 1 FROM sized) AND (SELECT n < 25 FROM sized WHERE last) AND n <= 100 AND greatest(su, sv) <= 45 AS yes FROM spans)
SELECT s.group_id - CASE WHEN s.last AND j.yes THEN 1 ELSE 0 END AS group_id, sum(n)::BIGINT AS cameras, min(first) AS first_camera FROM sized s, joins j GROUP BY ALL""",
    "sparse_roundtrip": """SELECT p_partkey AS point3d_id, round(p_partkey * 0.075::DOUBLE, 6) AS x, round(p_size::DOUBLE, 6) AS y, round(p_size * 0.01::DOUBLE, 6) AS z, count(*) AS entries, sum(l_orderkey)::BIGINT AS image_sum
FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL""",
    "ply_roundtrip": """SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_no, vec_id::INT AS splat_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label FROM embeddings""",
    "merge_ply": """SELECT row_number() OVER (ORDER BY embedding[1]::DOUBLE >= 0, vec_id) - 1 AS row_no, vec_id::INT AS splat_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label FROM embeddings""",
}

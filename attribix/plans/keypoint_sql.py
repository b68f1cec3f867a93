"""The keypoint queries in SQL: poses, roles and features of every clip from the embeddings table."""

from __future__ import annotations

from attribix.plans.shape import r

JOINTS = ("la", "ra", "lk", "rk", "lh", "rh", "ls", "rs", "nose")


def v(i: int) -> str:
    return f"CAST(embedding[{i + 1}] AS DOUBLE)"


def total(*at: int) -> str:
    return "(" + " + ".join(v(i) for i in at) + ")"


def dist(a: str, b: str) -> str:
    return f"sqrt(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y))"


def mid(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {{'x': ({a}.x + {b}.x) / 2, 'y': ({a}.y + {b}.y) / 2}} ELSE coalesce({a}, {b}) END"


def point(i: int) -> str:
    return f"""CASE WHEN abs(0.45 + {v(30 + i)} * 2) >= 0.3 THEN {{'x': 500 + 800 * {v(2 * i)} + 20 * {v(54 + i % 10)},
      'y': 500 + 800 * {v(2 * i + 1)} + 20 * {v(22 + i % 8)} + 40.0 * {11 - i}}} END"""


def cosine(ax: str, ay: str, bx: str, by: str) -> str:
    na, nb = f"sqrt(({ax}) * ({ax}) + ({ay}) * ({ay}))", f"sqrt(({bx}) * ({bx}) + ({by}) * ({by}))"
    return f"CASE WHEN {na} > 1e-6 AND {nb} > 1e-6 THEN (({ax}) * ({bx}) + ({ay}) * ({by})) / ({na} * {nb}) END"


def row_of(track: str, frame: str, name: str) -> str:
    """Left join of a track's row at one of the clip's frames."""
    return f"LEFT JOIN {track} {name} ON {name}.clip = o.clip AND {name}.frame = o.{frame}"


POSES = f"""kp AS (SELECT CAST(floor(vec_id / 36) AS BIGINT) AS clip, CAST(floor((vec_id % 36) / 3) AS BIGINT) AS frame, vec_id % 3 AS person,
  500 + 800 * {v(50)} - 20 * abs({total(*range(41, 45))}) AS x1, 500 + 800 * {v(51)} - 20 * abs({total(*range(45, 50))}) AS y1,
  620 + 800 * {v(50)} + 100 * {v(52)} AS x2, 800 + 800 * {v(51)} + 100 * {v(53)} AS y2,
  {", ".join(f"{point(i)} AS {j}" for i, j in enumerate(JOINTS))} FROM embeddings),
k2 AS (SELECT *, {{'x': (x1 + x2) / 2, 'y': (y1 + y2) / 2}} AS box, {mid('lh', 'rh')} AS hip, {mid('ls', 'rs')} AS chest, {dist('ls', 'rs')} AS width,
  {mid('la', 'ra')} AS feet, [p for p in [la, ra] if p IS NOT NULL] AS ankles FROM kp),
pose AS (SELECT *, coalesce(CASE WHEN {dist('nose', 'feet')} > 10 THEN {dist('nose', 'feet')} END,
  CASE WHEN {dist('hip', 'feet')} > 10 THEN {dist('hip', 'feet')} * 1.7 END, CASE WHEN width > 5 THEN width * 3.5 END) AS height FROM k2),
frames AS (SELECT DISTINCT clip, frame FROM pose)"""

ROLES = f"""{POSES},
contact AS (SELECT DISTINCT ON (clip) clip, frame AS contact_frame
  FROM frames JOIN (SELECT clip, round_even(0.5 * (max(frame) + 1), 0) AS target FROM frames GROUP BY clip) USING (clip)
  ORDER BY clip, abs(frame - target), frame),
here AS (SELECT clip, person, box FROM pose JOIN contact USING (clip) WHERE frame = contact_frame AND box IS NOT NULL),
pair AS (SELECT DISTINCT ON (a.clip) a.clip, a.box AS ca, b.box AS cb FROM here a JOIN here b ON a.clip = b.clip AND a.person < b.person
  ORDER BY a.clip, {dist('a.box', 'b.box')}, a.person, b.person),
players AS (SELECT clip, 'a' AS side, ca AS own, cb AS other FROM pair UNION ALL SELECT clip, 'b', cb, ca FROM pair
  UNION ALL SELECT clip, 'a', any_value(box), NULL FROM here GROUP BY clip HAVING count(*) = 1),
track AS (SELECT DISTINCT ON (clip, side, frame) pose.*, side FROM pose JOIN players USING (clip)
  WHERE box IS NOT NULL AND NOT coalesce({dist('box', 'other')} < 20, false) ORDER BY clip, side, frame, {dist('box', 'own')}, person),
peak AS (SELECT clip, side, quantile_cont(hip.y, 0.9) - quantile_cont(hip.y, 0.1) AS excursion FROM track WHERE hip IS NOT NULL
  GROUP BY clip, side HAVING count(*) >= 3),
top AS (SELECT DISTINCT ON (clip, side) clip, side, frame AS peak_frame FROM track WHERE hip IS NOT NULL ORDER BY clip, side, hip.y, frame),
chosen AS (SELECT * FROM (SELECT DISTINCT ON (clip) clip, side, peak_frame, coalesce(excursion, 0) AS excursion, other IS NOT NULL AS paired
  FROM players LEFT JOIN (SELECT * FROM peak JOIN top USING (clip, side)) USING (clip, side) ORDER BY clip, coalesce(excursion, 0) DESC, side)
  WHERE peak_frame IS NOT NULL),
shooter AS (SELECT track.* FROM track JOIN chosen USING (clip, side)),
defender AS (SELECT track.* FROM track JOIN chosen ON track.clip = chosen.clip AND track.side <> chosen.side),
landing AS (SELECT DISTINCT ON (clip) clip, frame AS landing_frame FROM shooter JOIN chosen USING (clip) WHERE frame > peak_frame AND len(ankles) > 0
  ORDER BY clip, feet.y DESC, frame),
ground AS (SELECT clip, arg_min(height, rn) AS height_grounded FROM (SELECT clip, height, row_number() OVER (PARTITION BY clip
    ORDER BY coalesce(list_max([p.y for p in ankles]), 0) DESC, frame) AS rn FROM shooter) WHERE rn <= 3 AND height > 0 GROUP BY clip),
base AS (SELECT clip, contact_frame, peak_frame, coalesce(landing_frame, peak_frame) AS landing_frame, excursion, paired, height_grounded, n_shooter_frames
  FROM chosen JOIN contact USING (clip) JOIN (SELECT clip, count(*) AS n_shooter_frames FROM shooter GROUP BY clip) USING (clip)
  LEFT JOIN landing USING (clip) LEFT JOIN ground USING (clip)),
placed AS (SELECT o.*, coalesce(l.feet, l.hip) AS land, l.hip AS hip_land, p.hip AS hip_peak, p.width AS width_peak,
    coalesce(height_grounded, CASE WHEN l.height > 0 THEN l.height END) AS person_height
  FROM base o {row_of('shooter', 'landing_frame', 'l')} {row_of('shooter', 'peak_frame', 'p')}),
sized AS (SELECT *, paired AND land IS NOT NULL AS ok, excursion / person_height AS exc_norm,
    CASE WHEN hip_peak IS NOT NULL AND land IS NOT NULL THEN {{'x': hip_peak.x, 'y': land.y}} ELSE land END AS zone,
    coalesce(CASE WHEN width_peak > 0 THEN width_peak END, person_height * 0.28) AS zone_radius
  FROM placed WHERE person_height IS NOT NULL),
judged AS (SELECT *, least(1.0, exc_norm / 0.35) * CASE WHEN ok THEN 1.0 ELSE 0.5 END * CASE WHEN exc_norm BETWEEN 0.05 AND 0.7 THEN 1.0 ELSE 0.5 END AS confidence
  FROM sized),
roles AS (SELECT c.clip, c.contact_frame, coalesce(j.ok, false) AS ok, j.* EXCLUDE (clip, contact_frame, ok) FROM contact c LEFT JOIN judged j ON c.clip = j.clip)"""

ROLES_SQL = f"""WITH {ROLES} SELECT clip, ok, contact_frame, peak_frame, landing_frame, {r('person_height')} AS person_height, {r('zone.x')} AS zone_x,
  {r('zone.y')} AS zone_y, {r('zone_radius')} AS zone_radius, {r('exc_norm')} AS exc_norm, {r('confidence')} AS confidence, n_shooter_frames FROM roles"""

BODY = ("la", "ra", "lk", "rk", "lh", "rh", "ls", "rs")
TAIL = "(arg_max(v, frame) FILTER (WHERE rn <= {n}) - arg_min(v, frame) FILTER (WHERE rn <= {n})) / nullif(count(*) FILTER (WHERE rn <= {n}) - 1, 0)"
WIDTH = "greatest(0, least(sc.x2, dc.x2) - greatest(sc.x1, dc.x1))"
HEIGHT = "greatest(0, least(sc.y2, dc.y2) - greatest(sc.y1, dc.y1))"


def area(t: str) -> str:
    return f"greatest(0, {t}.x2 - {t}.x1) * greatest(0, {t}.y2 - {t}.y1)"


#: Each feature in SQL over the joined rows of a clip.
VALUES = {
    "shooter_peak_height": "(o.hip_land.y - o.hip_peak.y) / h",
    "shooter_descent_velocity": "fall_step / h",
    "shooter_landing_frame_offset": "CAST(o.landing_frame - window_start AS DOUBLE)",
    "shooter_airtime_frames": "CAST(abs(o.landing_frame - o.peak_frame) AS DOUBLE)",
    "shooter_lateral_drift": "abs(o.hip_land.x - o.hip_peak.x) / h",
    "defender_ankle_in_zone_frac": "zone_frac",
    "min_ankle_distance": "min_d / h",
    "defender_ankle_at_landing": f"list_min([{dist('p', 'o.land')} for p in dl.ankles]) / h",
    "defender_foot_direction": f"CASE WHEN n_path >= 2 THEN {cosine('p1.x - p0.x', 'p1.y - p0.y', 'o.land.x - p0.x', 'o.land.y - p0.y')} END",
    "defender_stance_width": f"CASE WHEN dl.clip IS NULL THEN NULL WHEN dc.clip IS NOT NULL THEN {dist('dc.la', 'dc.ra')} ELSE {dist('dl.la', 'dl.ra')} END / h",
    "defender_ankle_below_shooter": "CAST(list_max([p.y for p in dl.ankles]) > o.land.y AS DOUBLE)",
    "overlap_duration_frames": "CAST(coalesce(longest, 0) AS DOUBLE)",
    "defender_retreat_velocity": "retreat_step / h",
    "contact_height": "CASE WHEN sc.clip IS NOT NULL AND dc.clip IS NOT NULL THEN (o.land.y - meeting_y) / h END",
    "body_overlap_area": f"CASE WHEN sc.clip IS NOT NULL AND dc.clip IS NOT NULL THEN coalesce({WIDTH} * {HEIGHT} / nullif({area('sc')} + {area('dc')} - {WIDTH} * {HEIGHT}, 0), 0) END",
    "relative_facing_angle": f"abs({cosine('sc.ls.x - sc.rs.x', 'sc.ls.y - sc.rs.y', 'dc.box.x - sc.chest.x', 'dc.box.y - sc.chest.y')})",
    "shooter_defender_distance_at_peak": f"{dist('o.hip_peak', 'dp.hip')} / h",
    "shooter_vertical_symmetry": "CAST(n_pre AS DOUBLE) / nullif(n_post, 0)",
    "defender_closing_speed": "-sep_step / h",
    "landing_zone_incursion_onset": "CAST(onset - o.peak_frame AS DOUBLE)",
}

FEATURES = f"""{ROLES},
good AS (SELECT *, person_height AS h FROM roles WHERE ok),
span AS (SELECT g.*, f.frame FROM frames f JOIN good g USING (clip)),
seen AS (SELECT s.clip, s.frame, s.zone, s.land, sh.hip AS s_hip, d.hip AS d_hip,
    list_sort([{{'d': {dist('p', 's.land')}, 'x': p.x, 'y': p.y}} for p in d.ankles])[1] AS near,
    coalesce(len([p for p in d.ankles if {dist('p', 's.zone')} < s.zone_radius]) > 0, false) AS in_zone
  FROM span s LEFT JOIN shooter sh ON sh.clip = s.clip AND sh.frame = s.frame LEFT JOIN defender d ON d.clip = s.clip AND d.frame = s.frame
  WHERE s.frame BETWEEN least(peak_frame, landing_frame) AND greatest(peak_frame, landing_frame)),
walk AS (SELECT *, {dist('s_hip', 'd_hip')} AS sep FROM seen),
runs AS (SELECT clip, max(n) AS longest FROM (SELECT clip, sum(hit) AS n FROM (SELECT clip, CAST(in_zone AS INTEGER) AS hit,
    row_number() OVER (PARTITION BY clip ORDER BY frame) - sum(CAST(in_zone AS INTEGER)) OVER (PARTITION BY clip ORDER BY frame) AS island FROM walk)
  GROUP BY clip, island) GROUP BY clip),
fall AS (SELECT clip, {TAIL.format(n=5)} AS fall_step FROM (SELECT clip, frame, s_hip.y AS v, row_number() OVER (PARTITION BY clip ORDER BY frame DESC) AS rn
  FROM walk WHERE s_hip IS NOT NULL) GROUP BY clip),
retreat AS (SELECT clip, {TAIL.format(n=3)} AS retreat_step FROM (SELECT clip, frame, {dist('near', 'zone')} AS v,
  row_number() OVER (PARTITION BY clip ORDER BY frame DESC) AS rn FROM walk WHERE near IS NOT NULL) GROUP BY clip),
closing AS (SELECT clip, (arg_max(sep, frame) - arg_min(sep, frame)) / nullif(count(*) - 1, 0) AS sep_step FROM walk WHERE sep IS NOT NULL GROUP BY clip),
path AS (SELECT clip, arg_min(near, frame) AS p0, arg_max(near, frame) AS p1, count(*) AS n_path FROM walk WHERE near IS NOT NULL GROUP BY clip),
inside AS (SELECT clip, avg(CAST(in_zone AS DOUBLE)) AS zone_frac, min(near.d) AS min_d, min(frame) FILTER (WHERE in_zone) AS onset FROM walk GROUP BY clip),
counts AS (SELECT clip, min(frame) AS window_start, count(*) FILTER (WHERE frame <= peak_frame) AS n_pre, count(*) FILTER (WHERE frame >= peak_frame) AS n_post
  FROM span GROUP BY clip),
meeting AS (SELECT clip, arg_min((p.y + q.y) / 2, {dist('p', 'q')}) AS meeting_y FROM (
    SELECT o.clip, unnest([p for p in [{', '.join(f'sc.{j}' for j in BODY)}] if p IS NOT NULL]) AS p,
      [q for q in [{', '.join(f'dc.{j}' for j in BODY)}] if q IS NOT NULL] AS qs
    FROM good o JOIN shooter sc ON sc.clip = o.clip AND sc.frame = o.contact_frame JOIN defender dc ON dc.clip = o.clip AND dc.frame = o.contact_frame),
    unnest(qs) AS u(q) GROUP BY clip),
computed AS (SELECT o.clip, {', '.join(f'{sql} AS {name}' for name, sql in VALUES.items())}
  FROM good o {row_of('shooter', 'contact_frame', 'sc')} {row_of('defender', 'contact_frame', 'dc')} {row_of('defender', 'landing_frame', 'dl')}
  {row_of('defender', 'peak_frame', 'dp')} {' '.join(f'LEFT JOIN {t} ON {t}.clip = o.clip' for t in ("inside", "counts", "path", "runs", "fall", "retreat", "closing", "meeting"))}),
features AS (SELECT roles.clip, coalesce(confidence, 0.0) AS role_assignment_confidence, CAST(computed.clip IS NULL AS DOUBLE) AS has_missing_data,
  computed.* EXCLUDE (clip) FROM roles LEFT JOIN computed ON roles.clip = computed.clip)"""

NAMES = (*VALUES, "role_assignment_confidence", "has_missing_data")
FEATURES_SQL = f"WITH {FEATURES} SELECT clip, {', '.join(f'{r(n)} AS {n}' for n in NAMES)} FROM features"

MATRIX_SQL = f"""WITH {FEATURES},
labelled AS (SELECT CAST(floor(vec_id / 36) AS BIGINT) AS clip, CAST(arg_min(label % 2, vec_id) AS INTEGER) AS label FROM embeddings GROUP BY 1),
n AS (SELECT label, count(*) AS nc FROM labelled GROUP BY 1),
t AS (SELECT *, sum(nc) OVER () AS na, ceil(sum(nc) OVER () * 0.2) AS nt FROM n),
s AS (SELECT *, nc * nt / na AS share, floor(nc * nt / na) AS base FROM t),
q AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY share - base DESC, label) <= nt - sum(base) OVER () THEN 1 ELSE 0 END AS n_val FROM s),
split AS (SELECT clip, CASE WHEN rn <= n_val THEN 'val' ELSE 'train' END AS fold FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(clip || '#42'), clip) AS rn
  FROM labelled) JOIN q USING (label))
SELECT clip, {', '.join(f'{r(f"coalesce({n}, 0)")} AS {n}' for n in NAMES)}, coalesce(label, -1) AS label, coalesce(fold, 'none') AS fold
FROM features LEFT JOIN labelled USING (clip) LEFT JOIN split USING (clip)"""

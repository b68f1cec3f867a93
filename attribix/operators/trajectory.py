"""Keypoint tracks as tables: roles of the two players, key frames, zone and contact features.

The input is the long keypoint table (one row per clip, frame, person, joint)
and a frame table with every processed frame, also those without a person.
Everything is a staged aggregate or join on the clip; no clip is collected.
Tables with several readers are written once between the stages, which also
keeps each plan small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attribix.functions.numeric import ratio
from attribix.operators.ordered import exact_quantiles, longest_run
from attribix.operators.sequence import closest_pair, distance, tail_slope
from attribix.session import checkpointed

# Thresholds, scale factors, joints and feature names of the published feature set.
MIN_CONF = 0.3
SAME_PLAYER_RADIUS = 20.0
MIN_HEIGHT_PX, MIN_SHOULDER_PX = 10.0, 5.0
HIP_TO_HEIGHT, SHOULDER_TO_HEIGHT, ZONE_TO_HEIGHT = 1.7, 3.5, 0.28
FULL_JUMP, JUMP_RANGE = 0.35, (0.05, 0.7)
TINY = 1e-6
BODY_JOINTS = (
    "left_ankle", "right_ankle", "left_knee", "right_knee", "left_hip", "right_hip", "left_shoulder", "right_shoulder",
)
POSE_JOINTS = (*BODY_JOINTS, "nose")
FEATURES = (
    "shooter_peak_height", "shooter_descent_velocity", "shooter_landing_frame_offset", "shooter_airtime_frames",
    "shooter_lateral_drift", "defender_ankle_in_zone_frac", "min_ankle_distance", "defender_ankle_at_landing",
    "defender_foot_direction", "defender_stance_width", "defender_ankle_below_shooter", "overlap_duration_frames",
    "defender_retreat_velocity", "contact_height", "body_overlap_area", "relative_facing_angle",
    "shooter_defender_distance_at_peak", "shooter_vertical_symmetry", "defender_closing_speed",
    "landing_zone_incursion_onset", "role_assignment_confidence", "has_missing_data",
)
#: Features that say how the others were found; no model learns from them.
EXCLUDED = ("has_missing_data", "role_assignment_confidence", "shooter_landing_frame_offset")
LEARNED = tuple(f for f in FEATURES if f not in EXCLUDED)
PROGRESS_BLOCK = 4096


def midpoint(a: Column, b: Column) -> Column:
    """Middle of two points; the one that is present when the other is missing."""
    both = F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"))
    return F.when(a.isNotNull() & b.isNotNull(), both).otherwise(F.coalesce(a, b))


def gap(a: Column, b: Column) -> Column:
    return distance(a["x"], a["y"], b["x"], b["y"])


def poses(keypoints: DataFrame, min_conf: float = MIN_CONF) -> DataFrame:
    """One row per (clip, frame, person): box, confident joints as points, and derived centres."""
    point = F.when(F.col("conf") >= min_conf, F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    wide = keypoints.groupBy("clip", "frame", "person").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("x1", "y1", "x2", "y2")],
        *[F.max(F.when(F.col("joint") == j, point)).alias(j) for j in POSE_JOINTS],
    )
    la, ra = F.col("left_ankle"), F.col("right_ankle")
    centre = F.struct(((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    return wide.select(
        "*",
        F.when(F.col("x1").isNotNull() & F.col("x2").isNotNull() & F.col("y1").isNotNull() & F.col("y2").isNotNull(), centre).alias("box"),
        midpoint(F.col("left_hip"), F.col("right_hip")).alias("hip"),
        midpoint(F.col("left_shoulder"), F.col("right_shoulder")).alias("chest"),
        gap(F.col("left_shoulder"), F.col("right_shoulder")).alias("shoulder_width"),
        midpoint(la, ra).alias("feet"),
        F.filter(F.array(la, ra), lambda p: p.isNotNull()).alias("ankles"),
    ).withColumn("height", body_height())


def body_height() -> Column:
    """First usable of nose-to-feet, hips-to-feet and shoulder width, scaled to a body height."""
    nose, hip = gap(F.col("nose"), F.col("feet")), gap(F.col("hip"), F.col("feet"))
    width = F.col("shoulder_width")
    return F.coalesce(
        F.when(nose > MIN_HEIGHT_PX, nose),
        F.when(hip > MIN_HEIGHT_PX, hip * HIP_TO_HEIGHT),
        F.when(width > MIN_SHOULDER_PX, width * SHOULDER_TO_HEIGHT),
    )


def contact_frames(frames: DataFrame, clips: DataFrame) -> DataFrame:
    """Processed frame nearest to the anchor; the earlier one on a tie."""
    target = F.bround(F.col("anchor_frac") * F.col("total_frames"))
    near = frames.join(clips.select("clip", target.alias("__t")), "clip")
    return near.groupBy("clip").agg(F.min_by("frame", F.struct(F.abs(F.col("frame") - F.col("__t")), "frame")).alias("contact_frame"))


def contact_players(pose: DataFrame, contact: DataFrame) -> DataFrame:
    """One row per (clip, side): own anchor and the other player's, side 'a' and 'b'.

    With a single person at contact there is only side 'a' and no other.
    """
    at = checkpointed(
        pose.join(contact, ["clip"]).filter((F.col("frame") == F.col("contact_frame")) & F.col("box").isNotNull())
        .select("clip", "person", F.col("box.x").alias("x"), F.col("box.y").alias("y"))
    )
    pair = closest_pair(at, ["clip"], "person", "x", "y").drop("dist")
    here = at.select("clip", "person", F.struct("x", "y").alias("c"))
    a = here.withColumnsRenamed({"person": "person_a", "c": "ca"})
    b = here.withColumnsRenamed({"person": "person_b", "c": "cb"})
    two = pair.join(a, ["clip", "person_a"]).join(b, ["clip", "person_b"])
    alone = at.groupBy("clip").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("x", "y")).alias("ca")).filter("n = 1")
    none = F.lit(None).cast("struct<x:double,y:double>")
    sides = F.array(
        F.struct(F.lit("a").alias("side"), F.col("ca").alias("own"), F.col("cb").alias("other")),
        F.struct(F.lit("b").alias("side"), F.col("cb").alias("own"), F.col("ca").alias("other")),
    )
    return two.select("clip", F.inline(sides)).unionByName(
        alone.select("clip", F.lit("a").alias("side"), F.col("ca").alias("own"), none.alias("other"))
    )


def tracks(pose: DataFrame, players: DataFrame) -> DataFrame:
    """Per (clip, side, frame) the person nearest to the side's anchor, not too near the other's."""
    rows = pose.filter(F.col("box").isNotNull()).join(players, "clip")
    taken = F.coalesce(gap(F.col("box"), F.col("other")) < SAME_PLAYER_RADIUS, F.lit(False))
    keep = [c for c in pose.columns if c not in ("clip", "frame")]
    best = rows.filter(~taken).groupBy("clip", "side", "frame").agg(
        F.min_by(F.struct(*keep), F.struct(gap(F.col("box"), F.col("own")).alias("d"), "person")).alias("p")
    )
    return best.select("clip", "side", "frame", "p.*")


def assign_roles(pose: DataFrame, frames: DataFrame, clips: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(roles, shooter track, defender track).

    Of the closest pair at contact, the one whose hips move more is the shooter.
    Roles hold the key frames, body height, landing zone and a confidence.
    """
    contact = checkpointed(contact_frames(frames, clips))
    players = checkpointed(contact_players(pose, contact))
    track = checkpointed(tracks(pose, players))
    hips = track.filter("hip IS NOT NULL").select("clip", "side", "frame", F.col("hip.y").alias("y"))
    spread = exact_quantiles(hips, ["clip", "side"], "y", {"lo": 0.1, "hi": 0.9})
    peak = hips.groupBy("clip", "side").agg(F.count(F.lit(1)).alias("n"), F.min_by("frame", F.struct("y", "frame")).alias("peak_frame"))
    side = (
        players.select("clip", "side", "other").join(peak.join(spread, ["clip", "side"]).filter("n >= 3"), ["clip", "side"], "left")
        .withColumn("excursion", F.coalesce(F.col("hi") - F.col("lo"), F.lit(0.0)))
    )
    best = F.struct("side", "peak_frame", "excursion", F.col("other").isNotNull().alias("paired"))
    chosen = checkpointed(
        side.groupBy("clip").agg(F.min_by(best, F.struct(-F.col("excursion"), "side")).alias("c"))
        .select("clip", "c.*").filter("peak_frame IS NOT NULL")
    )
    s_key = chosen.select("clip", "side")
    shooter = track.join(s_key, ["clip", "side"], "left_semi").drop("side")
    defender = track.join(s_key.select("clip", F.when(F.col("side") == "a", "b").otherwise("a").alias("side")), ["clip", "side"], "left_semi").drop("side")

    low = shooter.join(chosen.select("clip", "peak_frame"), "clip").filter((F.col("frame") > F.col("peak_frame")) & (F.size("ankles") > 0))
    landing = low.groupBy("clip").agg(F.max_by("frame", F.struct(F.col("feet.y"), -F.col("frame"))).alias("landing_frame"))
    lowest = F.coalesce(F.array_max(F.transform("ankles", lambda p: p["y"])), F.lit(0.0))
    grounded = (
        shooter.select("clip", "frame", "height", lowest.alias("__low"))
        .withColumn("__rn", F.row_number().over(Window.partitionBy("clip").orderBy(F.col("__low").desc(), "frame")))
        .filter("__rn <= 3").filter("height > 0")
        .groupBy("clip").agg(F.min_by("height", "__rn").alias("height_grounded"))
    )
    seen = shooter.groupBy("clip").agg(F.count(F.lit(1)).alias("n_shooter_frames"))
    base = (
        chosen.join(contact, "clip").join(seen, "clip").join(landing, "clip", "left").join(grounded, "clip", "left")
        .withColumn("landing_frame", F.coalesce("landing_frame", "peak_frame"))
    )
    at_land = shooter.select("clip", F.col("frame").alias("landing_frame"), F.coalesce("feet", "hip").alias("land"), F.col("height").alias("height_land"), F.col("hip").alias("hip_land"))
    at_peak = shooter.select("clip", F.col("frame").alias("peak_frame"), F.col("hip").alias("hip_peak"), F.col("shoulder_width").alias("width_peak"))
    joined = base.join(at_land, ["clip", "landing_frame"], "left").join(at_peak, ["clip", "peak_frame"], "left")
    height = F.coalesce("height_grounded", F.when(F.col("height_land") > 0, F.col("height_land")))
    zone = F.when(
        F.col("hip_peak").isNotNull() & F.col("land").isNotNull(), F.struct(F.col("hip_peak.x").alias("x"), F.col("land.y").alias("y"))
    ).otherwise(F.col("land"))
    roles = (
        joined.withColumn("person_height", height).filter("person_height IS NOT NULL")
        .withColumn("zone", zone)
        .withColumn("zone_radius", F.coalesce(F.when(F.col("width_peak") > 0, F.col("width_peak")), F.col("person_height") * ZONE_TO_HEIGHT))
        .withColumn("exc_norm", F.col("excursion") / F.col("person_height"))
        .withColumn("ok", F.col("paired") & F.col("land").isNotNull())
        .withColumn(
            "confidence",
            F.least(F.lit(1.0), F.col("exc_norm") / FULL_JUMP) * F.when(F.col("ok"), 1.0).otherwise(0.5)
            * F.when(F.col("exc_norm").between(*JUMP_RANGE), 1.0).otherwise(0.5),
        )
    )
    found = roles.select(
        "clip", "ok", "peak_frame", "landing_frame", "person_height", "zone", "zone_radius", "land", "hip_peak",
        "hip_land", "excursion", "exc_norm", "confidence", "n_shooter_frames",
    )
    out = contact.join(found, "clip", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    return checkpointed(out), shooter, defender


def box_overlap(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2)."""
    zero = F.lit(0.0)
    w = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = [F.greatest(zero, p[2] - p[0]) * F.greatest(zero, p[3] - p[1]) for p in (a, b)]
    return F.coalesce(ratio(w * h, area[0] + area[1] - w * h), zero)


def nearest_ankle(to: Column) -> Column:
    """Ankle of the row's ``ankles`` nearest to a point, as (d, x, y)."""
    return F.array_min(F.transform("ankles", lambda p: F.struct(gap(p, to).alias("d"), p["x"].alias("x"), p["y"].alias("y"))))


def cosine(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    na, nb = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
    return F.when((na > TINY) & (nb > TINY), (ax * bx + ay * by) / F.nullif(na * nb, F.lit(0.0)))


def joint_contact_y(s: str, d: str) -> Column:
    """Mid height of the closest shooter-defender joint pair, over a fixed 8 x 8 table inside the row."""
    def joints(side: str) -> Column:
        return F.filter(F.array(*[F.col(f"{side}.{j}") for j in BODY_JOINTS]), lambda p: p.isNotNull())

    pairs = F.flatten(
        F.transform(
            joints(s),
            lambda p: F.transform(joints(d), lambda q: F.struct(gap(p, q).alias("d"), ((p["y"] + q["y"]) / 2).alias("y"))),
        )
    )
    return F.aggregate(
        pairs,
        F.struct(F.lit(float("inf")).alias("d"), F.lit(None).cast("double").alias("y")),
        lambda best, p: F.when(p["d"] < best["d"], p).otherwise(best),
    )["y"]


def trajectory_features(roles: DataFrame, shooter: DataFrame, defender: DataFrame, frames: DataFrame) -> DataFrame:
    """The 22 named features per clip, null where they cannot be computed."""
    ok = roles.filter("ok")
    h = F.col("person_height")
    key = ok.select("clip", "contact_frame", "peak_frame", "landing_frame", "person_height", "zone", "zone_radius", "land")
    span = frames.join(key, "clip")
    descent = span.filter(F.col("frame").between(F.least("peak_frame", "landing_frame"), F.greatest("peak_frame", "landing_frame")))
    s_hip = shooter.select("clip", "frame", F.col("hip").alias("s_hip"))
    d_all = defender.select("clip", "frame", F.col("hip").alias("d_hip"), "ankles")
    walk = descent.join(s_hip, ["clip", "frame"], "left").join(d_all, ["clip", "frame"], "left").withColumn("near", nearest_ankle(F.col("land")))
    in_zone = F.coalesce(F.exists("ankles", lambda p: gap(p, F.col("zone")) < F.col("zone_radius")), F.lit(False))
    walk = checkpointed(walk.withColumn("in_zone", in_zone).withColumn("sep", gap(F.col("s_hip"), F.col("d_hip"))))

    block = F.floor(F.col("frame") / PROGRESS_BLOCK)
    run = longest_run(walk.select("clip", "frame", "in_zone"), ["clip"], ["frame"], block, F.col("in_zone"), "run")
    fall = tail_slope(walk.filter("s_hip IS NOT NULL").select("clip", "frame", F.col("s_hip.y").alias("v")), ["clip"], ["frame"], "v", 5)
    stepped = walk.filter("near IS NOT NULL")
    away = stepped.select("clip", "frame", distance("near.x", "near.y", "zone.x", "zone.y").alias("v"))
    retreat = tail_slope(away, ["clip"], ["frame"], "v", 3)
    closing = tail_slope(walk.filter("sep IS NOT NULL").select("clip", "frame", F.col("sep").alias("v")), ["clip"], ["frame"], "v", 1)
    path = stepped.groupBy("clip").agg(F.min_by("near", "frame").alias("p0"), F.max_by("near", "frame").alias("p1"), F.count(F.lit(1)).alias("n_path"))
    zone = walk.groupBy("clip").agg(
        F.avg(F.col("in_zone").cast("double")).alias("zone_frac"),
        F.min("near.d").alias("min_d"),
        F.min(F.when(F.col("in_zone"), F.col("frame"))).alias("onset"),
    )
    counts = span.groupBy("clip").agg(
        F.min("frame").alias("window_start"),
        F.count_if(F.col("frame") <= F.col("peak_frame")).alias("n_pre"),
        F.count_if(F.col("frame") >= F.col("peak_frame")).alias("n_post"),
    )

    def at(track: DataFrame, frame: str, name: str) -> DataFrame:
        return track.select("clip", F.col("frame").alias(frame), F.struct(*[c for c in track.columns if c not in ("clip", "frame")]).alias(name))

    wide = (
        ok.join(at(shooter, "contact_frame", "sc"), ["clip", "contact_frame"], "left")
        .join(at(defender, "contact_frame", "dc"), ["clip", "contact_frame"], "left")
        .join(at(defender, "landing_frame", "dl"), ["clip", "landing_frame"], "left")
        .join(at(defender, "peak_frame", "dp"), ["clip", "peak_frame"], "left")
        .join(zone, "clip", "left").join(counts, "clip", "left").join(path, "clip", "left")
        .join(run, "clip", "left")
        .join(fall.select("clip", F.col("tail_step").alias("fall_step")), "clip", "left")
        .join(retreat.select("clip", F.col("tail_step").alias("retreat_step")), "clip", "left")
        .join(closing.select("clip", F.col("mean_step").alias("sep_step")), "clip", "left")
    )
    land, peak_f, land_f = F.col("land"), F.col("peak_frame"), F.col("landing_frame")
    stance = F.coalesce(F.col("dc"), F.col("dl"))
    landed = F.col("dl").isNotNull()
    to_defender = F.col("dc.box"), F.col("sc.chest")
    value = {
        "shooter_peak_height": (F.col("hip_land.y") - F.col("hip_peak.y")) / h,
        "shooter_descent_velocity": F.col("fall_step") / h,
        "shooter_landing_frame_offset": (land_f - F.col("window_start")).cast("double"),
        "shooter_airtime_frames": F.abs(land_f - peak_f).cast("double"),
        "shooter_lateral_drift": F.abs(F.col("hip_land.x") - F.col("hip_peak.x")) / h,
        "defender_ankle_in_zone_frac": F.col("zone_frac"),
        "min_ankle_distance": F.col("min_d") / h,
        "defender_ankle_at_landing": F.array_min(F.transform("dl.ankles", lambda p: gap(p, land))) / h,
        "defender_foot_direction": F.when(
            F.col("n_path") >= 2,
            cosine(
                F.col("p1.x") - F.col("p0.x"), F.col("p1.y") - F.col("p0.y"), land["x"] - F.col("p0.x"), land["y"] - F.col("p0.y")
            ),
        ),
        "defender_stance_width": F.when(landed, gap(stance["left_ankle"], stance["right_ankle"])) / h,
        "defender_ankle_below_shooter": (F.array_max(F.transform("dl.ankles", lambda p: p["y"])) > land["y"]).cast("double"),
        "overlap_duration_frames": F.coalesce("run", F.lit(0)).cast("double"),
        "defender_retreat_velocity": F.col("retreat_step") / h,
        "contact_height": F.when(F.col("sc").isNotNull() & F.col("dc").isNotNull(), (land["y"] - joint_contact_y("sc", "dc")) / h),
        "body_overlap_area": F.when(
            F.col("sc").isNotNull() & F.col("dc").isNotNull(),
            box_overlap(*[[F.col(f"{t}.{c}") for c in ("x1", "y1", "x2", "y2")] for t in ("sc", "dc")]),
        ),
        "relative_facing_angle": F.abs(
            cosine(
                F.col("sc.left_shoulder.x") - F.col("sc.right_shoulder.x"), F.col("sc.left_shoulder.y") - F.col("sc.right_shoulder.y"),
                to_defender[0]["x"] - to_defender[1]["x"], to_defender[0]["y"] - to_defender[1]["y"],
            )
        ),
        "shooter_defender_distance_at_peak": gap(F.col("hip_peak"), F.col("dp.hip")) / h,
        "shooter_vertical_symmetry": ratio("n_pre", "n_post"),
        "defender_closing_speed": -F.col("sep_step") / h,
        "landing_zone_incursion_onset": (F.col("onset") - peak_f).cast("double"),
        "has_missing_data": F.lit(0.0),
    }
    computed = wide.select("clip", *[c.alias(n) for n, c in value.items()])
    out = roles.select("clip", F.coalesce("confidence", F.lit(0.0)).alias("role_assignment_confidence")).join(computed, "clip", "left")
    return out.withColumn("has_missing_data", F.coalesce("has_missing_data", F.lit(1.0))).select("clip", *FEATURES)


def feature_matrix(features: DataFrame, labels: DataFrame, split: DataFrame, fill: float | None = 0.0) -> DataFrame:
    """Features with label (-1 when unlabelled) and fold ('none' when in no split); nulls filled unless ``fill`` is None."""
    out = features.join(labels, "clip", "left").join(split, "clip", "left")
    out = out.withColumn("label", F.coalesce("label", F.lit(-1))).withColumn("fold", F.coalesce("fold", F.lit("none")))
    return out if fill is None else out.na.fill(fill, list(FEATURES))


def track_quality(keypoints: DataFrame, frames: DataFrame, min_conf: float = MIN_CONF) -> DataFrame:
    """Per clip: persons per frame, shares of frames with enough visible ankles, mean ankle confidence."""
    ankle = F.col("joint").isin("left_ankle", "right_ankle")
    seen = ankle & (F.col("conf") > min_conf)
    person = keypoints.groupBy("clip", "frame", "person").agg(
        F.count_if(seen).alias("n_seen"),
        F.sum(F.when(ankle & (F.col("conf") > 0), F.col("conf"))).alias("conf_sum"),
        F.count_if(ankle & (F.col("conf") > 0)).alias("conf_n"),
    )
    frame = person.groupBy("clip", "frame").agg(
        F.count(F.lit(1)).alias("n_persons"), F.count_if(F.col("n_seen") == 2).alias("n_both"),
        F.sum("conf_sum").alias("conf_sum"), F.sum("conf_n").alias("conf_n"),
    )
    rows = frames.join(frame, ["clip", "frame"], "left").na.fill(0, ["n_persons", "n_both", "conf_n"])
    return rows.groupBy("clip").agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.avg("n_persons").alias("mean_persons"),
        F.avg(F.when(F.col("n_persons") >= 2, 1.0).otherwise(0.0)).alias("two_persons_share"),
        F.avg(F.when(F.col("n_both") >= 1, 1.0).otherwise(0.0)).alias("one_both_ankles_share"),
        F.avg(F.when(F.col("n_both") >= 2, 1.0).otherwise(0.0)).alias("two_both_ankles_share"),
        F.coalesce(ratio(F.sum("conf_sum"), F.sum("conf_n")), F.lit(0.0)).alias("ankle_confidence"),
    )


def quality_summary(quality: DataFrame, one_bar: float = 0.80, two_bar: float = 0.60) -> DataFrame:
    means = ["mean_persons", "two_persons_share", "one_both_ankles_share", "two_both_ankles_share", "ankle_confidence"]
    out = quality.agg(F.count(F.lit(1)).alias("n_clips"), *[F.avg(c).alias(c) for c in means])
    return out.withColumn("meets_one_bar", F.col("one_both_ankles_share") >= one_bar).withColumn(
        "meets_two_bar", F.col("two_both_ankles_share") >= two_bar
    )

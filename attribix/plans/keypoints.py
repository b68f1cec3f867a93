"""Queries over keypoint tracks. Each vector of the embeddings table is read as one person's pose in one frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from attribix.operators import labels as L
from attribix.operators import trajectory as T
from attribix.plans import keypoint_sql, roles
from attribix.plans.registry import query
from attribix.plans.shape import r, rounded
from attribix.session import checkpointed

PERSONS, FRAMES = 3, 12
SEED = 42
JOINTS = (*T.POSE_JOINTS, "left_wrist", "right_wrist")
SCALE, CENTRE, SHIFT = 800.0, 500.0, 20.0


def keypoints(spark, sf):
    """Person, frame and clip follow from the vector's number; its values give box, joints and confidences."""
    e = roles.table(spark, sf, "embeddings").select("vec_id", "embedding")

    def v(i):
        return F.col("embedding")[i].cast("double")

    joints = F.array(
        *[
            F.struct(
                F.lit(j).alias("joint"), (CENTRE + SCALE * v(2 * i) + SHIFT * v(54 + i % 10)).alias("x"),
                (CENTRE + SCALE * v(2 * i + 1) + SHIFT * v(22 + i % 8) + 40.0 * (len(JOINTS) - i)).alias("y"),
                F.abs(F.lit(0.45) + v(30 + i) * 2).alias("conf"),
            )
            for i, j in enumerate(JOINTS)
        ]
    )
    step = PERSONS * FRAMES
    return e.select(
        F.floor(F.col("vec_id") / step).alias("clip"),
        F.floor(F.pmod(F.col("vec_id"), F.lit(step)) / PERSONS).alias("frame"),
        F.pmod(F.col("vec_id"), F.lit(PERSONS)).alias("person"),
        (CENTRE + SCALE * v(50) - SHIFT * F.abs(sum((v(i) for i in range(41, 45)), F.lit(0.0)))).alias("x1"),
        (CENTRE + SCALE * v(51) - SHIFT * F.abs(sum((v(i) for i in range(45, 50)), F.lit(0.0)))).alias("y1"),
        (CENTRE + 120 + SCALE * v(50) + 100 * v(52)).alias("x2"), (CENTRE + 300 + SCALE * v(51) + 100 * v(53)).alias("y2"),
        F.inline(joints),
    )


def frame_table(keys):
    return keys.select("clip", "frame").distinct()


def clip_table(frames):
    return frames.groupBy("clip").agg((F.max("frame") + 1).alias("total_frames"), F.lit(0.5).alias("anchor_frac"))


def assigned(spark, sf):
    pose = checkpointed(T.poses(keypoints(spark, sf)))
    frames = frame_table(pose)
    found, shooter, defender = T.assign_roles(pose, frames, clip_table(frames))
    return frames, found, shooter, defender


ANKLES_SQL = """k AS (SELECT CAST(floor(vec_id / 36) AS BIGINT) AS clip, CAST(floor((vec_id % 36) / 3) AS BIGINT) AS frame,
  abs(0.45 + CAST(embedding[31] AS DOUBLE) * 2) AS c0, abs(0.45 + CAST(embedding[32] AS DOUBLE) * 2) AS c1 FROM embeddings),
f AS (SELECT clip, frame, count(*) AS n, count(*) FILTER (WHERE c0 > 0.3 AND c1 > 0.3) AS nb, sum(c0 + c1) AS cs FROM k GROUP BY ALL)"""


@query(
    "track_quality",
    f"""WITH {ANKLES_SQL} SELECT clip, count(*) AS n_frames, {r('avg(n)')} AS mean_persons, {r('avg(CASE WHEN n >= 2 THEN 1.0 ELSE 0.0 END)')} AS two_persons_share,
        {r('avg(CASE WHEN nb >= 1 THEN 1.0 ELSE 0.0 END)')} AS one_both_ankles_share, {r('avg(CASE WHEN nb >= 2 THEN 1.0 ELSE 0.0 END)')} AS two_both_ankles_share,
        {r('sum(cs) / (2 * sum(n))')} AS ankle_confidence FROM f GROUP BY 1""",
)
def track_quality(spark, sf):
    points = keypoints(spark, sf)
    return rounded(T.track_quality(points, frame_table(points)))


@query(
    "quality_summary",
    f"""WITH {ANKLES_SQL}, q AS (SELECT clip, avg(n) AS mean_persons, avg(CASE WHEN n >= 2 THEN 1.0 ELSE 0.0 END) AS two_persons_share,
          avg(CASE WHEN nb >= 1 THEN 1.0 ELSE 0.0 END) AS one_both_ankles_share, avg(CASE WHEN nb >= 2 THEN 1.0 ELSE 0.0 END) AS two_both_ankles_share,
          sum(cs) / (2 * sum(n)) AS ankle_confidence FROM f GROUP BY 1)
        SELECT count(*) AS n_clips, {", ".join(f"{r(f'avg({c})')} AS {c}" for c in ("mean_persons", "two_persons_share", "one_both_ankles_share", "two_both_ankles_share", "ankle_confidence"))},
          avg(one_both_ankles_share) >= 0.8 AS meets_one_bar, avg(two_both_ankles_share) >= 0.6 AS meets_two_bar FROM q""",
)
def quality_summary(spark, sf):
    points = keypoints(spark, sf)
    return rounded(T.quality_summary(T.track_quality(points, frame_table(points))))


def matrix(spark, sf):
    """The features of all clips with label, fold and filled gaps. A clip's label is the first label of its vectors."""
    frames, found, shooter, defender = assigned(spark, sf)
    features = T.trajectory_features(found, shooter, defender, frames)
    vectors = roles.table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / (PERSONS * FRAMES)).alias("clip"), "vec_id", "label")
    labels = vectors.groupBy("clip").agg(F.min_by((F.col("label") % 2).cast("int"), "vec_id").alias("label"))
    split = L.stratified_split(labels, "clip", "label", 0.2, SEED).select("clip", "fold")
    return T.feature_matrix(features, labels, split)


@query("traj_matrix", keypoint_sql.MATRIX_SQL)
def traj_matrix(spark, sf):
    return rounded(matrix(spark, sf))


@query("traj_roles", keypoint_sql.ROLES_SQL)
def traj_roles(spark, sf):
    _, found, _, _ = assigned(spark, sf)
    return rounded(
        found.select(
            "clip", "ok", "contact_frame", "peak_frame", "landing_frame", "person_height", F.col("zone.x").alias("zone_x"),
            F.col("zone.y").alias("zone_y"), "zone_radius", "exc_norm", "confidence", "n_shooter_frames",
        )
    )


@query("traj_features", keypoint_sql.FEATURES_SQL)
def traj_features(spark, sf):
    frames, found, shooter, defender = assigned(spark, sf)
    return rounded(T.trajectory_features(found, shooter, defender, frames))

"""Roles and features of keypoint tracks against a direct per-clip computation."""

import math
import random

import numpy as np
import pytest

from attribix.operators import trajectory as T

SCHEMA = "clip string, frame int, person int, x1 double, y1 double, x2 double, y2 double, joint string, x double, y double, conf double"


def world(seed=2, n_clips=7):
    rnd = random.Random(seed)
    rows, frames, clips, poses = [], [], [], {}
    for c in range(n_clips):
        clip = f"c{c}"
        clips.append((clip, 40, 0.3))
        homes = [(rnd.uniform(100, 400), rnd.uniform(100, 200)) for _ in range(rnd.choice([1, 2, 3]) if c else 2)]
        for f in range(3, 23):
            frames.append((clip, f))
            for p, (hx, hy) in enumerate(homes):
                if rnd.random() < 0.12:
                    continue
                jump = -60 * math.exp(-((f - 12) ** 2) / 8) if p == 0 else 0
                bx, by = hx + rnd.gauss(0, 8), hy + jump + rnd.gauss(0, 4)
                box = (bx - 30, by - 80, bx + 30 + p, by + 90)
                joints = {}
                for j, (dx, dy) in {"nose": (0, -75), "left_shoulder": (-18, -50), "right_shoulder": (18, -50), "left_hip": (-10, 0), "right_hip": (10, 0), "left_knee": (-9, 40), "right_knee": (9, 40), "left_ankle": (-12, 85), "right_ankle": (12, 85)}.items():
                    joints[j] = (bx + dx + rnd.gauss(0, 2), by + dy + rnd.gauss(0, 2), rnd.choice([0.1, 0.6, 0.9, 0.9]))
                    rows.append((clip, f, p, *box, j, *joints[j]))
                poses.setdefault(clip, {}).setdefault(f, {})[p] = (box, {j: np.array(v[:2]) for j, v in joints.items() if v[2] >= 0.3})
    return rows, frames, clips, poses


def middle(*pts):
    have = [p for p in pts if p is not None]
    return sum(have) / len(have) if have else None


class Body:
    def __init__(self, pose):
        self.box, self.j = pose
        self.at = np.array([(self.box[0] + self.box[2]) / 2, (self.box[1] + self.box[3]) / 2])
        self.ankles = [self.j[k] for k in ("left_ankle", "right_ankle") if k in self.j]
        self.hip = middle(self.j.get("left_hip"), self.j.get("right_hip"))
        self.feet = middle(*self.ankles)
        self.width = np.linalg.norm(self.j["left_shoulder"] - self.j["right_shoulder"]) if {"left_shoulder", "right_shoulder"} <= self.j.keys() else None

    def height(self):
        for a, factor, least in ((self.j.get("nose"), 1, 10), (self.hip, 1.7, 10)):
            if a is not None and self.feet is not None and np.linalg.norm(a - self.feet) > least:
                return factor * np.linalg.norm(a - self.feet)
        return 3.5 * self.width if self.width and self.width > 5 else None


def expected(clip_poses, frames, total, anchor):
    people = {f: [Body(v) for _, v in sorted(clip_poses.get(f, {}).items())] for f in frames}
    contact = min(frames, key=lambda f: abs(f - round(anchor * total)))
    here = people[contact]
    if not here:
        return {"ok": False}
    if len(here) == 1:
        sides = [(here[0].at, None)]
    else:
        d, i, j = min((np.linalg.norm(here[i].at - here[j].at), i, j) for i in range(len(here)) for j in range(i + 1, len(here)))
        sides = [(here[i].at, here[j].at), (here[j].at, here[i].at)]
    tracks = []
    for own, other in sides:
        t = {}
        for f in frames:
            free = [b for b in people[f] if other is None or np.linalg.norm(b.at - other) >= 20]
            if free:
                t[f] = min(free, key=lambda b: np.linalg.norm(b.at - own))
        hips = [(b.hip[1], f) for f, b in t.items() if b.hip is not None]
        spread = np.percentile([h[0] for h in hips], 90) - np.percentile([h[0] for h in hips], 10) if len(hips) > 2 else 0.0
        tracks.append((spread, min(hips)[1] if len(hips) > 2 else None, t))
    first = 0 if len(tracks) == 1 or tracks[0][0] >= tracks[1][0] else 1
    spread, peak, s = tracks[first]
    d = tracks[1 - first][2] if len(tracks) == 2 else {}
    if peak is None:
        return {"ok": False}
    low = [(-b.feet[1], f) for f, b in s.items() if f > peak and b.feet is not None]
    land_f = min(low)[1] if low else peak
    order = sorted(s, key=lambda f: (-max([a[1] for a in s[f].ankles], default=0.0), f))[:3]
    h = next((s[f].height() for f in order if s[f].height()), None) or s[land_f].height()
    if not h:
        return {"ok": False}
    land = s[land_f].feet if s[land_f].feet is not None else s[land_f].hip
    out = {"ok": len(sides) == 2 and land is not None, "peak": peak, "land": land_f, "h": h, "confidence": min(1, spread / h / 0.35) * (1 if len(sides) == 2 and land is not None else 0.5) * (1 if 0.05 <= spread / h <= 0.7 else 0.5)}
    if not out["ok"]:
        return out
    zone = np.array([s[peak].hip[0], land[1]]) if s[peak].hip is not None else land
    radius = s[peak].width or h * 0.28
    window = [f for f in frames if min(peak, land_f) <= f <= max(peak, land_f)]
    inside = [f in d and any(np.linalg.norm(a - zone) < radius for a in d[f].ankles) for f in window]
    near = [min(d[f].ankles, key=lambda a: np.linalg.norm(a - land)) for f in window if f in d and d[f].ankles]
    hips = [s[f].hip[1] for f in window if f in s and s[f].hip is not None]
    sep = [np.linalg.norm(s[f].hip - d[f].hip) for f in window if f in s and f in d and s[f].hip is not None and d[f].hip is not None]
    run = best = 0
    for flag in inside:
        run = run + 1 if flag else 0
        best = max(best, run)
    feats = {
        "shooter_landing_frame_offset": land_f - frames[0], "shooter_airtime_frames": abs(land_f - peak),
        "defender_ankle_in_zone_frac": np.mean(inside), "overlap_duration_frames": best,
        "min_ankle_distance": min(np.linalg.norm(a - land) for a in near) / h if near else None,
        "shooter_descent_velocity": np.mean(np.diff(hips[-5:])) / h if len(hips) > 1 else None,
        "defender_closing_speed": -np.mean(np.diff(sep)) / h if len(sep) > 1 else None,
        "defender_retreat_velocity": np.mean(np.diff([np.linalg.norm(a - zone) for a in near[-3:]])) / h if len(near) > 1 else None,
        "shooter_vertical_symmetry": sum(f <= peak for f in frames) / sum(f >= peak for f in frames),
        "landing_zone_incursion_onset": window[inside.index(True)] - peak if any(inside) else None,
        "shooter_peak_height": (s[land_f].hip[1] - s[peak].hip[1]) / h if s[land_f].hip is not None else None,
    }
    if len(near) > 1:
        v, w = near[-1] - near[0], land - near[0]
        feats["defender_foot_direction"] = v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) if min(np.linalg.norm(v), np.linalg.norm(w)) > 1e-6 else None
    if land_f in d:
        feats["defender_ankle_at_landing"] = min(np.linalg.norm(a - land) for a in d[land_f].ankles) / h if d[land_f].ankles else None
    a, b = s.get(contact), d.get(contact)
    if a and b:
        joints = [(np.linalg.norm(a.j[p] - b.j[q]), (a.j[p][1] + b.j[q][1]) / 2) for p in T.BODY_JOINTS if p in a.j for q in T.BODY_JOINTS if q in b.j]
        feats["contact_height"] = (land[1] - min(joints)[1]) / h
        w = max(0, min(a.box[2], b.box[2]) - max(a.box[0], b.box[0])) * max(0, min(a.box[3], b.box[3]) - max(a.box[1], b.box[1]))
        area = sum((x.box[2] - x.box[0]) * (x.box[3] - x.box[1]) for x in (a, b))
        feats["body_overlap_area"] = w / (area - w)
    return {**out, "features": feats}


@pytest.fixture(scope="module")
def computed(spark):
    rows, frames, clips, poses = world()
    pose = T.poses(spark.createDataFrame(rows, SCHEMA))
    ft = spark.createDataFrame(frames, "clip string, frame int")
    found, shooter, defender = T.assign_roles(pose, ft, spark.createDataFrame(clips, "clip string, total_frames int, anchor_frac double"))
    feats = {r.clip: r for r in T.trajectory_features(found, shooter, defender, ft).collect()}
    roles = {r.clip: r for r in found.collect()}
    want = {c: expected(poses.get(c, {}), [f for k, f in frames if k == c], n, a) for c, n, a in clips}
    return roles, feats, want


def test_roles(computed):
    roles, _, want = computed
    assert any(w["ok"] for w in want.values())
    for clip, w in want.items():
        assert roles[clip].ok == w["ok"]
        if "h" in w:
            assert (roles[clip].peak_frame, roles[clip].landing_frame) == (w["peak"], w["land"])
            assert roles[clip].person_height == pytest.approx(w["h"]) and roles[clip].confidence == pytest.approx(w["confidence"])


def test_features(computed):
    _, feats, want = computed
    for clip, w in want.items():
        assert feats[clip].has_missing_data == (0.0 if w["ok"] else 1.0)
        for name, v in w.get("features", {}).items():
            assert feats[clip][name] == (None if v is None else pytest.approx(float(v))), (clip, name)


def test_matrix_and_quality(spark, computed):
    rows, frames, clips, _ = world()
    keys, ft = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(frames + [("empty", 1)], "clip string, frame int")
    got = {r.clip: r for r in T.track_quality(keys, ft).collect()}
    assert (got["empty"].mean_persons, got["empty"].ankle_confidence) == (0.0, 0.0)
    per = [(f, p) for c, f, p in {(r[0], r[1], r[2]) for r in rows} if c == "c0"]
    assert got["c0"].mean_persons == pytest.approx(len(per) / 20)
    s = T.quality_summary(T.track_quality(keys, ft)).first()
    assert s.n_clips == len(clips) + 1
    feats = spark.createDataFrame([("c0", *[None] * len(T.FEATURES))], "clip string, " + ", ".join(f"{f} double" for f in T.FEATURES))
    empty = spark.createDataFrame([], "clip string, label int"), spark.createDataFrame([], "clip string, fold string")
    row = T.feature_matrix(feats, *empty).first()
    assert (row.label, row.fold, row[T.FEATURES[0]]) == (-1, "none", 0.0)
    assert T.feature_matrix(feats, *empty, fill=None).first()[T.FEATURES[0]] is None

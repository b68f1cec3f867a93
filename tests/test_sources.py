"""Readers, sinks and streams on small files written by the test."""

import json

import pytest
from pyspark.sql import functions as F

from attribix.sources import documents as D
from attribix.sources import schemas
from attribix.sources import tables as S
from attribix.streaming import ingest


def session_doc(gid, actions):
    return json.dumps({"game": {"gameId": gid, "actions": actions}})


def foul(n, text, home="3", away="1", **more):
    return {"actionNumber": n, "actionType": "Foul", "subType": "Shooting", "description": text, "scoreHome": home, "scoreAway": away, **more}


def test_session_files(spark, tmp_path):
    (tmp_path / "0021400007.json").write_text(session_doc("", [{"actionType": "Jump"}, foul(2, "S.FOUL (A.Bell)", playerName="Full", playerNameI="F. Ull")]))
    (tmp_path / "b.json").write_text(session_doc("21400001", [foul(1, "x", "", "2"), foul(9, "y (B.Cole)", playerName="Only")]))
    (tmp_path / "c.json").write_text(session_doc("0021400002", []))
    (tmp_path / "d.json").write_text("{ broken")
    docs = D.read_sessions(spark, str(tmp_path))
    got = sorted((r.game_id, r.pos, r.actor_name, r.margin, r.committing_player_name, r.clock) for r in D.flatten_sessions(docs, fallback_id="stem").collect())
    assert got == [("0021400001", 0, "", 0, "", ""), ("0021400001", 1, "B.Cole", 2, "Only", ""), ("0021400007", 1, "A.Bell", 2, "F. Ull", "")]


def test_envelope_shapes(spark):
    one = {"headers": ["A", "B"], "rowSet": [["1", None], ["2", "x"]]}
    texts = [json.dumps(d) for d in ({"resultSets": [one, one]}, {"resultSet": one}, {"resultSets": one}, {"resultSet": [one]}, {"resultSets": []})]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = D.envelope_rows(df, "t", ["i"]).select("i", "row_pos", F.col("row")["A"].alias("a"), F.col("row")["B"].alias("b")).collect()
    assert sorted(tuple(r) for r in got) == [(i, p, *v) for i in range(4) for p, v in ((0, ("1", None)), (1, ("2", "x")))]


def test_envelopes_with_repeated_headers_and_short_rows(spark):
    sets = [{"headers": ["A", "B", "A"], "rowSet": [["1", "2", "3"], ["4"], ["5", "6", "7", "8"], []]}]
    texts = [json.dumps({"resultSets": sets}), json.dumps({"resultSets": [], "resultSet": sets[0] | {"rowSet": [["9", None]]}})]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {(r.i, r.row_pos): r.row for r in D.envelope_rows(df, "t", ["i"]).collect()}
    assert got == {(0, 0): {"A": "3", "B": "2"}, (0, 1): {"A": "4"}, (0, 2): {"A": "7", "B": "6"}, (0, 3): {}, (1, 0): {"A": "9", "B": None}}


def test_audit_documents(spark):
    texts = [json.dumps({"game": [{"GameDate": "2019-01-01"}], "l2m": [{"CallRatingName": " inc ", "CP": "A &amp; B", "DP": "D&#39;Angelo Jos&eacute;"}, {"CallRatingName": None}]}), json.dumps({"game": [], "l2m": []}), "{}"]
    docs = D.from_text(spark.createDataFrame(list(enumerate(texts)), "game_id int, t string"), "t", schemas.AUDIT)
    ev = D.audit_events(docs, ["game_id"]).collect()
    assert [(r.event_index, r.review_decision, r.incorrect, r.committing_player) for r in ev] == [(0, "INC", 1, "A & B"), (1, "", 0, None)]
    assert ev[0].disadvantaged_player == "D'Angelo José"
    rep = {r.game_id: (r.game_date, r.event_count, r.incorrect_count, r.has_report) for r in D.audit_reports(docs, ["game_id"]).collect()}
    assert rep == {0: ("2019-01-01", 2, 1, 1), 1: (None, 0, 0, 0), 2: (None, 0, 0, 0)}


def test_pages(spark):
    html = "<a href='L2MReport.html?gameId=0021400001'> L2MReport.html?gameId=0021400002 L2MReport.html?gameId=0021400001"
    block = json.dumps({"props": {"pageProps": {"game": {"officials": [{"personId": 5, "name": "Ann Bell", "firstName": "Ann", "familyName": "Bell", "jerseyNum": " 7 "}, {"personId": 6}]}}}})
    page = f'{html}<script id="__NEXT_DATA__" type="application/json">{block}</script>'
    df = spark.createDataFrame([(1, page), (2, "nothing")], "p int, html string")
    assert sorted((r.found_id, r.first_pos) for r in D.link_ids(df, ["p"], "html").collect()) == [("0021400001", 0), ("0021400002", 1)]
    got = [(r.official_id, r.official_name, r.jersey_num, r.role) for r in D.page_team(df, ["p"], "html").collect()]
    assert got == [(5, "Ann Bell", "7", "crew_chief"), (6, "", "", "official_2")]


def test_maps_splits_and_manifests(spark, tmp_path):
    (tmp_path / "anchors.json").write_text('{"g_1": {"foul_frac": 0.5, "half_width": 0.15},\n "g_2": {"foul_frac": 0.9}}')
    got = {r.key: (r.value.foul_frac, r.value.half_width) for r in D.read_keyed_map(spark, str(tmp_path / "anchors.json"), schemas.ANCHORS).collect()}
    assert got == {"g_1": (0.5, 0.15), "g_2": (0.9, None)}
    split = json.dumps({"train": {"n": 1, "keys": [{"game_id": "21400001", "event_id": 4}]}, "val": {"keys": [{"game_id": "0021400002", "event_id": 5}]}})
    doc = D.from_text(spark.createDataFrame([(split,)], "t string"), "t", schemas.SPLIT)
    assert sorted(tuple(r) for r in D.split_rows(doc).collect()) == [("0021400001", 4, "train"), ("0021400002", 5, "val")]
    man = [json.dumps({"clips": [{"game_id": "1", "event_id": 4, "description": d, "video_url_960": u}]}) for d, u in (("first", None), ("second", "u"))]
    docs = [D.manifest_clips(D.from_text(spark.createDataFrame([(m,)], "t string"), "t", schemas.MANIFEST), 2 - i) for i, m in enumerate(man)]
    won = S.first_wins([(d.drop("priority"), 2 - i) for i, d in enumerate(docs)], ["game_id", "event_id"], [F.col("description")]).collect()
    assert [(r.game_id, r.description, r.video_url) for r in won] == [("0000000001", "first", None)]


def test_keypoint_file(spark):
    text = json.dumps({"c_1": {"total_frames": 10, "anchor_frac": 0.5, "persons": [{"track_id": 3, "frames": {"4": {"bbox": [1, 2, 3, 4], "conf": 0.9, "keypoints": {"nose": [5, 6, 0.7]}}}}]}})
    df = spark.createDataFrame([(text,)], "t string").select(F.explode(F.from_json("t", schemas.KEYPOINTS)).alias("key", "value"))
    got = [tuple(r) for r in D.keypoint_rows(df).collect()]
    assert got == [("c_1", 4, 0, 1.0, 2.0, 3.0, 4.0, "nose", 5.0, 6.0, 0.7)]


def test_csv_with_missing_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text('fta,game_id,player_name\n7,21400001,"Bell, Ann"\nDNP,21400002,x\n')
    df = S.coerce_numbers(S.read_csv(spark, str(tmp_path / "a.csv"), schemas.SUBJECT_SESSION), ["fta", "min"])
    got = [(r.game_id, r.player_name, r.fta, r["min"], r.opponent_defrtg) for r in df.collect()]
    assert got == [("0021400001", "Bell, Ann", 7.0, 0.0, None), ("0021400002", "x", 0.0, 0.0, None)]
    with pytest.raises(ValueError, match="landing_foul"):
        S.require_columns(df, ["game_id", "landing_foul"])
    assert S.with_optional(df, {"extra": "int"}).schema["extra"].dataType.simpleString() == "int"
    cov = {r.column_name: r.filled_share for r in S.coverage_report(df, ["fta", "opponent_defrtg"]).collect()}
    assert cov == {"fta": 1.0, "opponent_defrtg": 0.0}


def test_resumable_append_and_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    S.append_new(first, path, ["id"])
    S.append_new(spark.createDataFrame([(2, "changed"), (3, "c")], "id int, v string"), path, ["id"])
    S.append_new(first, path, ["id"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    (tmp_path / "bad").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        S.append_new(first, str(tmp_path / "bad"), ["id"])
    S.write_parquet(first, str(tmp_path / "p"), ["v"])
    plan = spark.read.parquet(str(tmp_path / "p")).filter("v = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(v" in plan
    S.write_csv(first, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_placeholder_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"same size")
    (tmp_path / "b.bin").write_bytes(b"same sizE")
    (tmp_path / "c.bin").write_bytes(b"longer content")
    files = S.read_files(spark, str(tmp_path), "*.bin")
    known = spark.createDataFrame([(b"same size",)], "content binary").select(F.octet_length("content").alias("n_bytes"), F.md5("content").alias("md5"))
    got = S.placeholders(files, "content", known, ["path"]).collect()
    assert [r.path.rsplit("/", 1)[1] for r in got] == ["a.bin"]


def test_answer_repair(spark):
    texts = ['x {"phase": "IN_ACT"} y', '{"phase": "a } cut', "none", None, '{"phase": {"a": 1}, "b":']
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(D.parse_answer("t", "phase string").alias("o")).collect()
    assert [r.o.phase if r.o else None for r in got] == ["IN_ACT", "a }", None, None, None]


def test_stream_ingest_drops_redelivery_and_resumes(spark, tmp_path):
    src, out, state = (tmp_path / n for n in ("src", "out", "state"))
    src.mkdir()
    (src / "a.json").write_text(session_doc("0021400001", [foul(1, "x (A.Bell)"), foul(2, "y")]))
    (src / "b.json").write_text(session_doc("0021400001", [foul(2, "y")]))

    def run():
        ingest.ingest_available(ingest.session_stream(spark, str(src)), str(out), str(state), ["game_id", "event_num"]).awaitTermination()
        return sorted((r.game_id, r.event_num) for r in spark.read.parquet(str(out)).collect())

    assert run() == [("0021400001", 1), ("0021400001", 2)]
    (src / "c.json").write_text(session_doc("0021400002", [foul(5, "z")]))
    assert run() == [("0021400001", 1), ("0021400001", 2), ("0021400002", 5)]

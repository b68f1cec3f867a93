"""Nested documents to rows: session logs, envelopes, audit payloads, pages, keyed maps.

Each function takes parsed documents, so the same code serves files
(``read_*``) and JSON text columns (``from_text``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attribix.functions import derive
from attribix.functions.numeric import col
from attribix.sources import schemas

# Patterns and names of the page formats.
REPORT_LINK = r"L2MReport\.html\?gameId=(\d{10})"
CUT_OFF_ENDINGS = ['"}', "null}", "false}", "true}"]
PAGE_DATA_BLOCK = r'(?s)<script id="__NEXT_DATA__" type="application/json">(.*?)</script>'
FIRST_ROLE = "crew_chief"
OTHER_ROLE = "official_%d"


def from_text(df: DataFrame, text: str, schema: str, name: str = "doc") -> DataFrame:
    """Parse a JSON text column; a malformed text gives a null document."""
    return df.withColumn(name, F.from_json(text, schema, {"mode": "PERMISSIVE"}))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """One row per session document, with the file stem for documents without an id."""
    raw = spark.read.schema(schemas.SESSION).option("multiLine", True).json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    return raw.select(F.struct("game").alias("doc"), stem.alias("stem"))


def flatten_sessions(docs: DataFrame, keep_type: str | None = "Foul", fallback_id: str | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """One row per kept action, with its position, the parsed actor and the score margin."""
    game = F.coalesce(F.nullif(F.col("doc.game.gameId"), F.lit("")), *([F.col(fallback_id)] if fallback_id else []))
    rows = docs.select(*extra, game.alias("game_id"), F.posexplode_outer("doc.game.actions").alias("pos", "a"))
    if keep_type:
        rows = rows.filter(F.col("a.actionType") == keep_type)
    return rows.select(
        *extra,
        derive.pad_id("game_id").alias("game_id"),
        "pos",
        F.col("a.actionNumber").alias("event_num"),
        F.coalesce("a.period", F.lit(0)).alias("period"),
        derive.first_present("a.clock").alias("clock"),
        F.col("a.actionType").alias("event_type"),
        derive.first_present("a.subType").alias("foul_type"),
        derive.parse_actor("a.description").alias("actor_name"),
        F.col("a.personId").alias("committing_player_id"),
        derive.first_present("a.playerNameI", "a.playerName").alias("committing_player_name"),
        F.col("a.teamId").alias("committing_team_id"),
        derive.first_present("a.teamTricode").alias("committing_team_tricode"),
        derive.first_present("a.scoreHome").alias("score_home"),
        derive.first_present("a.scoreAway").alias("score_away"),
        derive.score_margin("a.scoreHome", "a.scoreAway").alias("margin"),
        derive.first_present("a.location").alias("location"),
        derive.first_present("a.description").alias("description"),
        F.coalesce("a.videoAvailable", F.lit(0)).alias("video_available"),
    )


def envelope_rows(df: DataFrame, text: str, keys: Sequence[str], index: int = 0) -> DataFrame:
    """Rows of a result set as header -> value maps.

    The set stands under ``resultSets`` or ``resultSet``, as a list or as one object.
    """
    many = F.from_json(text, schemas.ENVELOPE_LIST)
    one = F.from_json(text, schemas.ENVELOPE_ONE)
    # An empty list under the first name is none.
    as_list = F.coalesce(F.when(F.size(many["resultSets"]) > 0, many["resultSets"]), many["resultSet"])
    single = F.coalesce(one["resultSets"], one["resultSet"])
    chosen = F.coalesce(F.try_element_at(as_list, F.lit(index + 1)), single)
    rows = df.select(*keys, chosen.alias("__set"))
    rows = rows.select(*keys, F.col("__set.headers").alias("__h"), F.posexplode("__set.rowSet").alias("row_pos", "__row"))
    # Cut to the shorter side; of equal headers the last counts.
    pairs = F.slice(F.arrays_zip(F.col("__h").alias("h"), F.col("__row").alias("v")), 1, F.least(F.size("__h"), F.size("__row")))
    names = F.transform(pairs, lambda p: p["h"])
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), p["h"]))
    return rows.select(*keys, "row_pos", F.map_from_entries(last).alias("row"))


def audit_events(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per reviewed event, numbered from 0."""
    rows = docs.select(*keys, F.posexplode("doc.l2m").alias("event_index", "e"))
    return rows.select(
        *keys,
        "event_index",
        F.col("e.PeriodName").alias("period"),
        F.col("e.PCTime").alias("game_clock"),
        F.col("e.CallType").alias("call_type"),
        derive.decision_code("e.CallRatingName").alias("review_decision"),
        derive.is_error_decision("e.CallRatingName").alias("incorrect"),
        derive.html_unescape("e.CP").alias("committing_player"),
        derive.html_unescape("e.DP").alias("disadvantaged_player"),
        derive.html_unescape("e.Comment").alias("comment"),
        F.col("e.Difficulty").alias("difficulty"),
    )


def audit_reports(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per document with the counts taken from its own array, so no shuffle is needed."""
    events = F.coalesce(F.col("doc.l2m"), F.array().cast(docs.schema["doc"].dataType["l2m"].dataType))
    game = F.try_element_at("doc.game", F.lit(1))
    bad = F.filter(events, lambda e: derive.decision_code(e["CallRatingName"]).isin(derive.ERROR_DECISIONS))
    return docs.select(
        *keys,
        game["GameDate"].alias("game_date"),
        game["Home_team"].alias("home_team"),
        game["Away_team"].alias("away_team"),
        F.size(events).alias("event_count"),
        F.size(bad).alias("incorrect_count"),
        (F.size(events) > 0).cast("int").alias("has_report"),
    )


def link_ids(pages: DataFrame, keys: Sequence[str], html: str, pattern: str = REPORT_LINK) -> DataFrame:
    """Distinct ids found in a page, with the place of their first occurrence."""
    found = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    rows = pages.select(*keys, F.posexplode(found).alias("pos", "found_id"))
    return rows.groupBy(*keys, "found_id").agg(F.min("pos").alias("first_pos"))


def page_team(pages: DataFrame, keys: Sequence[str], html: str, pattern: str = PAGE_DATA_BLOCK) -> DataFrame:
    """Team rows from the JSON block of a page; the role follows from the position."""
    block = F.from_json(F.regexp_extract(html, pattern, 1), schemas.PAGE_DATA)
    rows = pages.select(*keys, F.posexplode(block["props"]["pageProps"]["game"]["officials"]).alias("pos", "o"))
    return rows.select(
        *keys,
        F.col("o.personId").alias("official_id"),
        derive.first_present("o.name").alias("official_name"),
        derive.first_present("o.firstName").alias("first_name"),
        derive.first_present("o.familyName").alias("last_name"),
        F.trim(derive.first_present("o.jerseyNum")).alias("jersey_num"),
        F.when(F.col("pos") == 0, FIRST_ROLE).otherwise(F.format_string(OTHER_ROLE, F.col("pos") + 1)).alias("role"),
    )


def keyed_map(df: DataFrame, keys: Sequence[str], text: str, value_schema: str, name: str = "key", value: str = "value") -> DataFrame:
    """Rows of a JSON object with free keys."""
    return df.select(*keys, F.explode(F.from_json(text, f"map<string, {value_schema}>")).alias(name, value))


def read_keyed_map(spark: SparkSession, path: str, map_schema: str, name: str = "key", value: str = "value") -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", map_schema)).alias(name, value))


def split_rows(docs: DataFrame) -> DataFrame:
    """(game_id, event_id, fold) from a split document."""
    def side(fold: str) -> DataFrame:
        return docs.select(F.explode(f"doc.{fold}.keys").alias("k")).select(
            derive.pad_id("k.game_id").alias("game_id"), F.col("k.event_id").alias("event_id"), F.lit(fold).alias("fold")
        )

    return side("train").unionByName(side("val"))


def manifest_clips(docs: DataFrame, priority: int) -> DataFrame:
    """Clips of a manifest with the priority of its source."""
    clips = docs.select(F.explode("doc.clips").alias("c")).select("c.*", F.lit(priority).alias("priority"))
    url = F.coalesce("video_url_720", "video_url_960", "video_url_320")
    return clips.withColumn("game_id", derive.pad_id("game_id")).withColumn("video_url", url)


def keypoint_rows(df: DataFrame, value: str = "value", clip: str = "key") -> DataFrame:
    """Long keypoint table: one row per (clip, frame, person, joint)."""
    persons = df.select(F.col(clip).alias("clip"), F.posexplode(F.col(value)["persons"]).alias("person", "p"))
    frames = persons.select("clip", "person", F.explode("p.frames").alias("frame", "f"))
    joints = frames.select("clip", "person", F.col("frame").cast("int").alias("frame"), F.col("f.bbox").alias("b"), F.explode_outer("f.keypoints").alias("joint", "k"))
    return joints.select(
        "clip", "frame", "person",
        *[F.try_element_at("b", F.lit(i + 1)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))],
        "joint",
        *[F.try_element_at("k", F.lit(i + 1)).alias(n) for i, n in enumerate(("x", "y", "conf"))],
    )


def brace_slice(text: str | Column) -> Column:
    """From the first '{' to the last '}', or '' when there is none."""
    return F.regexp_extract(col(text), r"(?s)\{.*\}", 0)


def parse_answer(text: str | Column, schema: str) -> Column:
    """A JSON object out of free text. A cut-off object is tried again with the usual closings."""
    chunk = brace_slice(text)
    attempts = [chunk, *[F.concat(chunk, F.lit(s)) for s in CUT_OFF_ENDINGS]]
    valid = [F.when(F.try_parse_json(a).isNotNull(), F.from_json(a, schema)) for a in attempts]
    return F.when(chunk != "", F.coalesce(*valid))

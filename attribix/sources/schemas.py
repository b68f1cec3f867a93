"""Explicit schemas of the raw inputs; nothing is inferred.

Field names are fixed values of the input formats.
"""

from __future__ import annotations

SESSION = """game struct<gameId: string, actions: array<struct<
  actionNumber: bigint, actionType: string, subType: string, period: int, clock: string, description: string,
  personId: bigint, playerName: string, playerNameI: string, teamId: bigint, teamTricode: string,
  scoreHome: string, scoreAway: string, location: string, videoAvailable: int>>>"""

RESULT_SET = "struct<headers: array<string>, rowSet: array<array<string>>>"
ENVELOPE_LIST = f"resultSets array<{RESULT_SET}>, resultSet array<{RESULT_SET}>"
ENVELOPE_ONE = f"resultSets {RESULT_SET}, resultSet {RESULT_SET}"

TEAM = """game_id string, official_id bigint, official_name string, first_name string, last_name string,
  jersey_num string, role string"""

AUDIT = """game array<struct<GameDate: string, HomeTeamId: string, AwayTeamId: string, Home_team: string,
  Away_team: string, HomeTeamScore: string, VisitorTeamScore: string, L2M_Comments: string>>,
  l2m array<struct<PeriodName: string, PCTime: string, CallType: string, CallRatingName: string, CP: string,
  DP: string, Comment: string, Difficulty: string, posID: string, posStart: string, posEnd: string,
  teamIdInFavor: string, errorInFavor: string, VideolLink: string>>"""

SUBJECT_LOG = "GAME_ID string, FTA string, MIN string, FGA string, player_name string, nba_id bigint, season_type string"
SUBJECT_SESSION = """game_id string, player_name string, nba_id bigint, fta string, fga string, min string,
  opponent_defrtg string, is_playoff string, season string, is_floor_primary string"""
LABELS_BINARY = """game_id string, event_id int, period int, clock string, description string, fouled_player_name string,
  fouled_team_tricode string, committing_player_name string, committing_team_tricode string,
  caller_official_name string, landing_foul string, note string, timestamp string"""
LABELS_AXES = """game_id string, event_id int, period int, clock string, description string, opponent string,
  mechanism string, body_part string, timing string, severity string, severity_note string, location string, timestamp string"""

ANCHORS = "map<string, struct<foul_frac: double, half_width: double>>"
SPLIT_KEY = "struct<n: int, n_yes: int, n_no: int, indices: array<int>, keys: array<struct<game_id: string, event_id: int>>>"
SPLIT = f"seed int, test_size double, n_total int, train {SPLIT_KEY}, val {SPLIT_KEY}"
CLIP = """struct<game_id: string, event_id: int, period: int, clock: string, description: string, opponent: string,
  video_url_960: string, video_url_720: string, video_url_320: string, season_start_yy: int>"""
MANIFEST = f"clips array<{CLIP}>"
KEYPOINTS = """map<string, struct<fps: double, total_frames: int, anchor_frac: double, half_width: double,
  window: array<double>, frame_indices: array<int>, n_frames_processed: int, n_persons: int,
  persons: array<struct<track_id: int, frames: map<string, struct<bbox: array<double>, conf: double,
  keypoints: map<string, array<double>>>>>>>>"""
PAGE_DATA = """props struct<pageProps: struct<game: struct<officials: array<struct<
  personId: bigint, name: string, firstName: string, familyName: string, jerseyNum: string>>>>>"""
EMBEDDINGS = "game_id string, event_id int, embedding array<float>, label int"

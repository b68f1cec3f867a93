"""Scalar derivations as column expressions."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from attribix.functions.numeric import col

# Patterns and codes of the input formats.
ACTOR_TAIL = r"(?U)\(([A-Z]\.\s*\w+)\)\s*$"
ACTOR_TAIL_WIDE = r"(?U)\(([A-Z]\.\s*[\w'’.-]+(?:\s+[\w'’.-]+)*)\)\s*$"
ID_WIDTH = 10
SEASON_TYPE_CODES = {"002": "RS", "004": "PO"}
ERROR_DECISIONS = ["IC", "INC"]
ARM_TOKENS = ["HAND", "ARM", "ARMS", "WRIST", "FOREARM", "FINGERS", "FINGER", "ARM_OR_HAND", "HAND_OR_ARM"]
ARM_FRAGMENTS = "HAND|ARM|WRIST"
ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
MIN_WINDOW = 0.05


def parse_actor(text: str | Column, wide: bool = False) -> Column:
    """Name in the trailing parentheses, '' when there is none.

    The strict pattern takes one surname word; ``wide`` also takes hyphenated
    and two-word surnames.
    """
    return F.coalesce(F.regexp_extract(col(text), ACTOR_TAIL_WIDE if wide else ACTOR_TAIL, 1), F.lit(""))


def filled_share(c: str | Column) -> Column:
    """Aggregate share of rows with a non-empty value."""
    return F.avg(F.when(col(c) != "", 1.0).otherwise(0.0))


def score_margin(home: str | Column, away: str | Column) -> Column:
    """Integer difference of two score texts; 0 when either is blank or malformed."""
    return F.coalesce(col(home).try_cast("int") - col(away).try_cast("int"), F.lit(0))


def first_present(*cols: str | Column, default: str = "") -> Column:
    return F.coalesce(*[col(c) for c in cols], F.lit(default))


def pad_id(c: str | Column, width: int = ID_WIDTH) -> Column:
    """Zero-pad an all-digit id to ``width``; longer or non-numeric ids pass through."""
    text = F.trim(col(c).cast("string"))
    return F.when(text.rlike(r"^\d+$") & (F.length(text) < width), F.lpad(text, width, "0")).otherwise(text)


def season_year(session_id: str | Column) -> Column:
    """Start year from characters 4-5 of a session id."""
    return F.substring(col(session_id), 4, 2).try_cast("int") + 2000


def season_label(year: str | Column) -> Column:
    """2014 -> '2014-15'; the century wraps (1999 -> '1999-00')."""
    y = col(year).cast("int")
    return F.format_string("%d-%02d", y, F.pmod(y + 1, F.lit(100)))


def season_start(label: str | Column) -> Column:
    return F.substring(col(label), 1, 4).try_cast("int")


def season_type(session_id: str | Column, other: str | None = None) -> Column:
    """Season type from the id prefix; unknown prefixes give ``other``."""
    prefix = F.substring(col(session_id), 1, 3)
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for code, name in SEASON_TYPE_CODES.items():
        chain = chain.when(prefix == code, F.lit(name))
    return chain.otherwise(F.lit(other).cast("string"))


def short_name(first: str | Column, last: str | Column) -> Column:
    """'Ann', 'Bell' -> 'A.Bell'; null without a first name."""
    return F.concat(F.nullif(F.substring(col(first), 1, 1), F.lit("")), F.lit("."), col(last))


def decision_code(c: str | Column) -> Column:
    return F.upper(F.trim(F.coalesce(col(c), F.lit(""))))


def is_error_decision(c: str | Column) -> Column:
    return decision_code(c).isin(ERROR_DECISIONS).cast("int")


def token(c: str | Column) -> Column:
    """Trimmed upper-case token with '-' and ' ' as '_'; null becomes ''."""
    return F.upper(F.translate(F.trim(F.coalesce(col(c), F.lit(""))), "- ", "__"))


def is_arm_token(c: str | Column) -> Column:
    t = token(c)
    return ~t.isin("", "UNCLEAR") & (t.isin(ARM_TOKENS) | t.rlike(ARM_FRAGMENTS))


def slug(c: str | Column, drop_hyphen: bool = False) -> Column:
    """Lower-case, spaces to '_', apostrophes dropped; one variant drops hyphens too."""
    s = F.replace(F.replace(F.lower(col(c)), F.lit(" "), F.lit("_")), F.lit("'"), F.lit(""))
    return F.replace(s, F.lit("-"), F.lit("")) if drop_hyphen else s


def composite_key(*cols: str | Column) -> Column:
    return F.concat_ws("_", *[col(c).cast("string") for c in cols])


def split_key(key: str | Column) -> tuple[Column, Column]:
    """Undo ``composite_key``: everything before the last '_', and the part after it."""
    k = col(key)
    return F.regexp_extract(k, r"^(.*)_[^_]*$", 1), F.regexp_extract(k, r"_([^_]*)$", 1)


def _names() -> tuple[dict[str, str], dict[str, str]]:
    """Named entities with a semicolon, and the old ones that also stand without."""
    full = {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")}
    return full, {k: v for k, v in html.entities.html5.items() if not k.endswith(";")}


def _lookup(names: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.from_json(F.lit(json.dumps(names)), "map<string,string>"), key)


def _number_entity(digits: Column, base: int) -> Column:
    """Character of a code point: the Windows characters for 128-159, U+FFFD for what is none, '' for what is forbidden."""
    short = F.ltrim(digits, F.lit("0"))
    code = F.when(F.length(short) <= 8, F.conv(F.when(short == "", "0").otherwise(short), base, 10).cast("bigint")).otherwise(F.lit(1 << 40))
    windows = {i: bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(128, 160)}
    plane_end = code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE
    forbidden = code.between(1, 8) | code.isin(11, 127) | code.between(14, 31) | code.between(0xFDD0, 0xFDEF) | plane_end
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (
        F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "\ufffd")
        .when(code == 13, "\r")
        .when(code.between(128, 159), _lookup({str(k): v for k, v in windows.items()}, code.cast("string")))
        .when(forbidden, "").otherwise(char)
    )


def _entity(e: Column) -> Column:
    """Text of one match of ``ENTITY``. Without a semicolon the longest old name it begins with counts."""
    full, old = _names()
    body = F.rtrim(F.substring(e, 2, 1 << 20), F.lit(";"))
    closed = F.endswith(e, F.lit(";"))
    longest = max(map(len, old))
    begins = [
        F.when(F.length(body) >= n, F.concat(_lookup({k: v for k, v in old.items() if len(k) == n}, F.substring(body, 1, n)), F.substring(e, n + 2, 1 << 20)))
        for n in range(longest, 1, -1)
    ]
    common = F.when(e == "&amp;", "&").when(e == "&lt;", "<").when(e == "&gt;", ">").when(e == "&quot;", '"').when(e == "&#39;", "'")
    number = F.when(body.rlike("^#[xX]"), _number_entity(F.substring(body, 3, 1 << 20), 16)).otherwise(_number_entity(F.substring(body, 2, 1 << 20), 10))
    named = F.coalesce(F.when(closed, _lookup(full, body)), F.when(~closed, _lookup(old, body)), *begins, e)
    return F.coalesce(common, F.when(F.startswith(e, F.lit("&#")), number).otherwise(named))


def html_unescape(c: str | Column) -> Column:
    """Replace HTML entities once, so that ``&amp;lt;`` gives ``&lt;``; all named and numeric ones, in the JVM.

    The text is cut at its entities; only rows that hold one do any work.
    """
    text = col(c)
    found = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    between = F.split(text, ENTITY)
    joined = F.array_join(F.zip_with(between, found, lambda t, e: F.concat(t, F.when(e.isNull(), "").otherwise(_entity(e)))), "")
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def anchor_window(
    frac: str | Column, half: str | Column, default: tuple[float, float] = (0.0, 1.0), min_width: float = MIN_WINDOW
) -> Column:
    """Window around a relative anchor, clamped to [0, 1]; ``default`` when missing or too narrow."""
    lo = F.greatest(F.lit(0.0), col(frac) - col(half))
    hi = F.least(F.lit(1.0), col(frac) + col(half))
    wide = hi - lo >= min_width
    missing = col(frac).isNull() | col(half).isNull()
    return F.struct(
        F.when(~missing & wide, lo).otherwise(F.lit(default[0])).alias("lo"),
        F.when(~missing & wide, hi).otherwise(F.lit(default[1])).alias("hi"),
    )


def window_frames(lo: str | Column, hi: str | Column, total: str | Column, max_frames: int = 60) -> Column:
    """At most ``max_frames`` evenly spaced frame indices inside a relative window, in order, no repeats."""
    n_all = col(total).cast("int")
    start = F.greatest(F.lit(0), F.bround(col(lo) * n_all).cast("int"))
    end0 = F.least(n_all - 1, F.bround(col(hi) * n_all).cast("int"))
    end = F.when(end0 <= start, F.least(n_all - 1, start + 1)).otherwise(end0)
    span = end - start + 1
    n = F.least(F.lit(max_frames), span)
    steps = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: start + F.bround(i * (span - 1) / F.greatest(n - 1, F.lit(1)).cast("double")).cast("int"),
    )
    return F.when(n_all > 0, F.when(n > 1, F.array_distinct(steps)).otherwise(F.array(start)))

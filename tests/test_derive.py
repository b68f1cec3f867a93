"""Scalar derivations on the edge rows."""

import html
import html.entities
import random

import pytest
from pyspark.sql import functions as F

from attribix.functions import derive as D
from attribix.functions.numeric import pearson, per_unit, ratio, to_number


def one(spark, schema, rows, **cols):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in cols.items()]).collect()]


def test_actor_tail(spark):
    texts = [("Smith S.FOUL (P1.T1) (K.Fitzgerald)",), ("x (M.Gélinas)  ",), ("x (A. Bell)",), ("x (J.Van Duyne)",), ("x (K.Smith-Jones)",), ("no name",), (None,)]
    got = one(spark, "t string", texts, a=D.parse_actor("t"), w=D.parse_actor("t", wide=True))
    assert [g[0] for g in got] == ["K.Fitzgerald", "M.Gélinas", "A. Bell", "", "", "", ""]
    assert [g[1] for g in got] == ["K.Fitzgerald", "M.Gélinas", "A. Bell", "J.Van Duyne", "K.Smith-Jones", "", ""]


def test_margin_and_numbers(spark):
    got = one(spark, "h string, a string", [("101", "99"), ("", "5"), ("x", "5"), ("0", None)], m=D.score_margin("h", "a"))
    assert [g[0] for g in got] == [2, 0, 0, 0]
    got = one(spark, "t string", [("NaN",), ("",), ("DNP",), ("7.5",), (None,)], d=to_number("t"), n=to_number("t", None))
    assert got == [(0.0, None), (0.0, None), (0.0, None), (7.5, 7.5), (0.0, None)]


def test_ids_and_seasons(spark):
    ids = [("21400001",), ("0021400001",), ("004140000123",), ("x12",), ("0019900001",)]
    got = one(spark, "i string", ids, p=D.pad_id("i"), t=D.season_type("i"), l=D.season_type("i", "RS"))
    assert [g[0] for g in got] == ["0021400001", "0021400001", "004140000123", "x12", "0019900001"]
    assert [g[1] for g in got][1:3] == ["RS", "PO"] and got[4][1:] == (None, "RS")
    got = one(spark, "y int", [(2014,), (1999,), (2009,)], s=D.season_label("y"), b=D.season_start(D.season_label("y")))
    assert got == [("2014-15", 2014), ("1999-00", 1999), ("2009-10", 2009)]
    assert one(spark, "i string", [("0021400001",)], y=D.season_year("i")) == [(2014,)]


def test_short_name(spark):
    got = one(spark, "f string, l string", [("Ann", "Bell"), ("", "Bell"), (None, "Bell")], s=D.short_name("f", "l"))
    assert got == [("A.Bell",), (None,), (None,)]


def test_ratio_modes(spark):
    got = one(spark, "n double, d double", [(3.0, 0.0), (3.0, 0.5)], a=ratio("n", "d"), b=ratio("n", "d", "one"), c=ratio("n", "d", "floor1"), p=per_unit("n", "d"), q=per_unit("n", "d", zero="null"))
    assert got == [(None, 3.0, 3.0, 108.0, None), (6.0, 6.0, 3.0, 108.0, 216.0)]
    with pytest.raises(ValueError):
        ratio("n", "d", "other")


def test_pearson_is_null_on_a_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0)], "x double, y double, c double")
    assert tuple(df.agg(pearson("x", "y"), pearson("x", "c")).first()) == (pytest.approx(1.0), None)


def test_tokens(spark):
    got = one(spark, "t string", [(" fore-arm ",), ("arm or hand",), ("UNCLEAR",), (None,), ("hip",)], t=D.token("t"), a=D.is_arm_token("t"))
    assert got == [("FORE_ARM", True), ("ARM_OR_HAND", True), ("UNCLEAR", False), ("", False), ("HIP", False)]
    got = one(spark, "t string", [(" inc ",), ("Ic",), (None,)], d=D.decision_code("t"), e=D.is_error_decision("t"))
    assert got == [("INC", 1), ("IC", 1), ("", 0)]


def test_slug_and_keys(spark):
    got = one(spark, "n string", [("Ann O'Bell-Cole",)], a=D.slug("n"), b=D.slug("n", True))
    assert got == [("ann_obell-cole", "ann_obellcole")]
    left, right = D.split_key("k")
    assert one(spark, "k string", [("a_b_12",)], l=left, r=right) == [("a_b", "12")]


def test_html_unescape(spark):
    rnd = random.Random(4)
    parts = ["&", "amp", "lt", "notin", "not", "eacute", ";", "#", "x", "233", "xE9", "0", "128", "13", "1114112", "99999999999", "frac12", " ", "é", "AElig", "&#", "&#x", "D800", "FFFF", "NotEqualTilde"]
    texts = ["a &amp;lt; &#233; &#xE9; &eacute; &quot;x&quot;", "plain", "", "D&#39;Angelo Jos&eacute;", "&notit; &amp &#; &bogus; &#x110000; &#128; &#0;"]
    texts += ["".join(rnd.choices(parts, k=rnd.randint(1, 12))) for _ in range(600)]
    texts += [f"&{n}" for n in html.entities.html5] + [f"&#{n};" for n in (*range(0, 200), 0xD7FF, 0xFDD0, 0xFFFE, 0x1F600, 0x10FFFF)]
    got = one(spark, "t string", [(t,) for t in [*texts, None]], f=D.html_unescape("t"))
    assert [g[0] for g in got] == [*map(html.unescape, texts), None]


def test_anchor_window_and_frames(spark):
    rows = [(0.5, 0.15), (0.02, 0.15), (0.99, 0.15), (0.5, 0.01), (None, 0.15)]
    got = one(spark, "f double, h double", rows, w=D.anchor_window("f", "h"))
    assert [tuple(round(x, 4) for x in g[0]) for g in got] == [(0.35, 0.65), (0.0, 0.17), (0.84, 1.0), (0.0, 1.0), (0.0, 1.0)]
    got = one(spark, "lo double, hi double, n int", [(0.0, 1.0, 5), (0.0, 1.0, 1000), (0.5, 0.5, 10), (0.0, 1.0, 0)], f=D.window_frames("lo", "hi", "n"))
    assert got[0][0] == [0, 1, 2, 3, 4]
    assert len(got[1][0]) == 60 and got[1][0][0] == 0 and got[1][0][-1] == 999
    assert got[2][0] == [5, 6] and got[3][0] is None


def test_coverage(spark):
    df = spark.createDataFrame([("a",), ("",)], "a string")
    assert df.agg(D.filled_share("a")).first()[0] == 0.5
    assert D.first_present is not None and F is not None

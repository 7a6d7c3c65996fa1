"""NULL rules and rounding traps of the column functions."""

import datetime as dt

from pyspark.sql import functions as F

from seatflow.functions import cleaning as C
from seatflow.functions import dates as D
from seatflow.functions import metrics as M
from seatflow.functions import parsing as P
from seatflow.functions.keys import surrogate_key


def values(df, col):
    return [r[0] for r in df.select(col).collect()]


def test_scrub_is_case_sensitive_and_trims_first(rows):
    df = rows([(" na ",), ("NA",), (" na\t",), ("nap",), (None,)], "x string")
    assert values(df, C.scrub(F.col("x"))) == [None, "NA", None, "nap", None]


def test_canonical_and_apostrophe(rows):
    df = rows([(" girls’ ",)], "x string")
    assert values(df, C.canonical(C.straight_apostrophe(F.col("x")))) == ["GIRLS'"]


def test_recode_keeps_others(rows):
    df = rows([("a",), ("b",), (None,)], "x string")
    assert values(df, C.recode(F.col("x"), {"a": "z"})) == ["z", "b", None]


def test_policy_nulls(rows):
    df = rows([("1", 2018), ("1", 2019), ("2B", 2009), (None, 2018)], "c string, y long")
    assert values(df, M.has_full_figures(F.col("c"), F.col("y"))) == [False, True, True, True]


def test_guarded_ratio(rows):
    df = rows(
        [(134, 109, True), (1, 0, True), (1, None, True), (None, 5, True), (1, 2, False)],
        "a long, v long, ok boolean",
    )
    ratio = M.guarded_ratio(F.col("a"), F.col("v"), F.col("ok"))
    assert values(df, ratio) == [1.2294, None, None, None, None]


def test_risk_tier(rows):
    df = rows(
        [(3, 1.3), (3, 1.2), (1, 1.3), (0, 1.3), (3, None)], "n long, a double"
    )
    assert values(df, M.risk_tier(F.col("n"), F.col("a"))) == [
        "HIGH", "LOW", "MEDIUM", "LOW", "LOW",
    ]


def test_codes(rows):
    df = rows([("SC<1",), ("SC<1#",), ("PR>2",), ("SC#",), ("x",), (None,)], "c string")
    c = F.col("c")
    assert values(df, M.is_occurrence(c)) == [True, False, True, False, True, False]
    assert values(df, M.prefix_class(c)) == ["SC", "SC", "PR", "SC", None, None]
    assert values(df, M.code_band(c)) == [
        "within_1km", "within_1km_no_leftover", "beyond_2km", "beyond_2km_no_leftover", None, None,
    ]


def test_low_text_says_no_balloting_even_with_occurrences(rows):
    df = rows(
        [("LOW", 2, 1.1, 0.1), ("LOW", 0, None, None), ("HIGH", 3, 1.5, None), ("HIGH", 3, 1.5, 0.2)],
        "t string, n long, a double, d double",
    )
    out = values(df, M.explain_risk(*map(F.col, "tnad")))
    assert out[0].startswith("No balloting in the last 3 years. Average subscription rate of 1.10x.")
    assert "rate of unavailable." in out[1]
    assert "stabilising" in out[2] and "intensifying" in out[3]


def test_round_binary_is_float_rounding(spark):
    pairs = [(a, c) for c in range(1, 130) for a in range(c + 1)]
    df = spark.createDataFrame(pairs, "a long, c long").withColumn("x", F.col("a") / F.col("c"))
    for digits in (2, 4):
        got = df.select("a", "c", C.round_binary(F.col("x"), digits)).collect()
        assert all(g == round(a / c, digits) for a, c, g in got)
    tie = spark.createDataFrame([(569 / 800,), (0.125,), (1.005,)], "x double")
    assert values(tie, C.round_binary(F.col("x"), 4))[0] == 0.7113
    assert values(tie, C.round_binary(F.col("x"), 2))[1:] == [0.12, 1.0]


def test_chance_and_progress(rows):
    df = rows([(-1.0,), (1.0,), (1.25,), (4.0,)], "r double")
    assert values(df, M.chance_ratio(F.col("r"))) == [1.0, 1.0, 0.8, 0.25]
    df = rows([(40, 14), (40, 60), (0, 3)], "c long, n long")
    left, share = M.fill_progress(F.col("c"), F.col("n"))
    assert values(df, left) == [26, 0, 0]
    assert values(df, share) == [0.35, 1.0, 0.0]


def test_row_mean(rows):
    df = rows([(1.0, None, 2.0), (None, None, None)], "a double, b double, c double")
    assert values(df, M.row_mean(*map(F.col, "abc"))) == [1.5, None]


def test_lifecycle(rows):
    df = rows(
        [
            ("active", None, None, None),
            ("merged", 2021, None, "B"),
            ("relocated_gap", 2021, 2024, None),
            ("relocated_gap", 2024, 2025, None),
            ("relocated_gap", 2024, None, None),
            ("merged", 2021, None, None),
        ],
        "s string, f int, t int, m string",
    )
    active = D.is_active(F.col("s"), F.col("t"), "2025-03-01")
    assert values(df, active) == [True, False, True, False, False, False]
    text = D.status_text(active, *map(F.col, "sftm"))
    out = values(df, text)
    assert out[0] == out[2] == "School is active for enrollment"
    assert out[1].endswith("It was merged under B on 2021")
    assert out[3].endswith("ceased in 2024 and will be reopened in 2026")
    assert out[4] is None and out[5] is None


def test_surrogate_key_tells_null_from_empty(rows):
    df = rows([("a", None), ("a", ""), ("a", "b")], "x string, y string")
    keys = values(df, surrogate_key("x", "y"))
    assert len(set(keys)) == 3
    import hashlib

    assert keys[2] == hashlib.md5(b"a-b").hexdigest()


def test_times(rows):
    df = rows([(dt.datetime(2026, 7, 24, 20, 30),)], "t timestamp_ntz")
    assert values(df, D.iso_in_zone(F.col("t"), source="UTC")) == ["2026-07-25T04:30:00+08:00"]
    slot = D.slot_time(F.lit("2026-07-24").cast("date"), F.lit(2), F.lit("end_of_day"))
    assert values(df, D.iso_text(slot)) == ["2026-07-25T18:00:00+08:00"]


def test_parse_numbers(rows):
    df = rows(
        [("1,240",), ("  7 ",), ("",), ("x1",), ("76%: 3.5",), ("(300) ( 5)",), (None,)],
        "x string",
    )
    x = F.col("x")
    assert values(df, P.parse_int(x)) == [1240, 7, None, None, None, None, None]
    assert values(df, P.first_number(x)) == [1.0, 7.0, None, 1.0, 76.0, 300.0, None]
    assert values(df, P.paren_int(x)) == [None, None, None, None, None, 300, None]


def test_entities_in_one_pass(rows):
    import html

    texts = ["a &lt;b&gt; &amp;lt; &#39;x&#x27; &eacute;&nbsp;&rsquo;", "&unknown; & &;", "&#8627;&#128512;",
             "plain", "&#0;&#xD800;&#x110000;", "&amp;&amp;#39;", None]
    got = values(rows([(t,) for t in texts], "x string"), P.decode_entities(F.col("x")))
    assert got == [t and html.unescape(t) for t in texts]


def test_tooltip(rows):
    body = "SC within 1km needs to ballot\r\n\n Applicants: 1,056 \nVacancies: 20\nBallot Chance: 36.5%"
    df = rows([("SC&lt;1", body), ("", None), (None, "only text")], "t string, b string")
    tips = values(df, P.parse_tooltip(F.col("t"), F.col("b")))
    assert tuple(tips[0]) == ("SC<1", "SC within 1km needs to ballot", 1056, 20, 36.5)
    assert tuple(tips[1]) == (None,) * 5
    assert tuple(tips[2]) == (None, "only text", None, None, None)

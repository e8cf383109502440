"""Subtitle markup: goldens by the rules of each format, and round trips over all pairs of formats."""

import random

import pytest
from pyspark.sql import functions as F

from tidelane.functions import markup, styles

RUNS = "array<struct<start:int,end:int,style:int>>"


def parsed(spark, parser, *texts, kind="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, m {kind}")
    return [(r.x.text, [tuple(x) for x in r.x.runs], r.x.alignment) for r in df.select("i", parser(F.col("m")).alias("x")).orderBy("i").collect()]


def test_ass_rules(spark):
    got = parsed(spark, markup.ass_styled, r"{\b1}Bold{\b0} plain", r"a\Nb\nc\hd", r"{\i1\i0}x{comment}{\u1\s1}y{\r}z", r"{\b700}w{\b400}v{\bord3\be1}", r"{\an8}top{\a6}", r"{\p1}m 0 0{\p0}seen", r"{\i1}a{\rOther\b1}b", "no } brace {", None, r"{\fs20\b1\c&HFF&}k")
    assert got == [
        ("Bold plain", [(0, 4, 1)], 2), ("a\nb\nc d", [], 2), ("xyz", [(1, 2, 12)], 2), ("wv", [(0, 1, 1)], 2), ("top", [], 8),
        ("seen", [], 2), ("ab", [(0, 1, 2), (1, 2, 1)], 2), ("no } brace {", [], 2), ("", [], 2), ("k", [(0, 1, 1)], 2),
    ]
    assert parsed(spark, markup.ass_styled, r"{\a6}m")[0][2] == 8 and parsed(spark, markup.ass_styled, r"{\a10}m")[0][2] == 5


def test_vtt_rules(spark):
    got = parsed(spark, markup.vtt_styled, "<b>a<i>b</i></b>c", "<c.red>x</c> <v Bob>y</v>", "<b>a<c>b</b>c</c>d", "1 &lt; 2 &amp;&nbsp;3 &foo; &", "<00:01.000>t<ruby>k<rt>no</rt></ruby>", "a < b", "</b>x<u>", None)
    assert got == [
        ("abc", [(0, 1, 1), (1, 2, 3)], 2), ("x y", [], 2), ("abcd", [(0, 3, 1)], 2), ("1 < 2 & 3 &foo; &", [], 2), ("tk", [], 2), ("a < b", [], 2), ("x", [], 2), ("", [], 2),
    ]


def test_timed_text_rules(spark):
    style = b"\0\0\0\x16styl\0\1\0\1\0\x63\0\1\x03\x12\xff\xff\xff\xff"
    got = parsed(spark, markup.tx3g_styled, b"\0\3abc" + style, b"\0\6\xfe\xff\0a\0b", b"\0\2hi\0\0\0\x0cfrcd\0\0\0\0", b"", None, b"\0\x09ab", b"\0\1a\0\0\0\2styl", kind="binary")
    assert got == [("abc", [(1, 3, 3)], 2), ("ab", [], 2), ("hi", [], 2), ("", [], 2), ("", [], 2), ("ab", [], 2), ("a", [], 2)]


def test_normal_runs_equal_marks_by_character(spark):
    rng = random.Random(2)
    rows = [(i, [(a, a + rng.randrange(1, 6), rng.choice([1, 2, 3, 4])) for a in (rng.randrange(12) for _ in range(rng.randrange(6)))]) for i in range(150)]
    got = {r.i: [tuple(x) for x in r.n] for r in spark.createDataFrame(rows, f"i int, r {RUNS}").select("i", markup.normal_runs(F.col("r")).alias("n")).collect()}
    for i, runs in rows:
        marks = [0] * 20
        for a, b, s in runs:
            for k in range(a, b):
                marks[k] |= s
        want, k = [], 0
        while k < 20:
            e = k
            while e < 20 and marks[e] == marks[k]:
                e += 1
            if marks[k]:
                want.append((k, e, marks[k]))
            k = e
        assert got[i] == want


@pytest.mark.parametrize("struck", [False, True])
def test_round_trips_of_all_pairs(spark, struck):
    rng = random.Random(7)
    rows = []
    for i in range(120):
        text = "".join(rng.choice("ab é\n&;Z🙂") for _ in range(rng.randrange(1, 14)))
        runs = [(a, min(len(text), a + rng.randrange(1, 5)), rng.choice([1, 2, 4, 3, 7, 8, 9] if struck else [1, 2, 4, 3, 7])) for a in (rng.randrange(len(text)) for _ in range(rng.randrange(4)))]
        rows.append((i, text, runs))
    df = spark.createDataFrame(rows, f"i int, text string, r {RUNS}").withColumn("runs", markup.normal_runs(F.col("r"))).cache()
    forms = {"srt": (markup.to_srt_markup, styles.srt_styled), "ass": (markup.to_ass_markup, markup.ass_styled), "vtt": (markup.to_vtt_markup, markup.vtt_styled), "tx3g": (markup.to_tx3g, markup.tx3g_styled)}
    names = ["srt", "ass"] if struck else list(forms)
    want = {r.i: (r.text, [tuple(x) for x in r.runs]) for r in df.collect()}
    for a in names:
        once = df.withColumn("x", forms[a][1](forms[a][0](F.col("text"), F.col("runs")))).select("i", "x.text", "x.runs")
        for b in names:
            twice = once.select("i", forms[b][1](forms[b][0](F.col("text"), F.col("runs"))).alias("x"))
            assert {r.i: (r.x.text, [tuple(x) for x in r.x.runs]) for r in twice.collect()} == want, (a, b)

"""Operators on small inputs whose results were worked out by hand."""

import pytest
from pyspark.sql import functions as F

from cuewright.functions import similarity, time
from cuewright.functions import text as t
from cuewright.operators import aggregates, alignment, folds, joins, quality, state, windows
from cuewright.sources import html, subtitles


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_ranges_merge():
    assert time.time_ranges("7-9.5,4-7,3:00-3:20.25,3:10-3:15") == [(4, 9.5), (180, 200.25)]
    assert time.time_ranges("2m-150s, 5s-0.5m, 1h-1:00:01") == [(5, 30), (120, 150), (3600, 3601)]
    for bad in ("33", "9-3", "4:61-5:00", "1-2-3"):
        with pytest.raises(ValueError):
            time.time_ranges(bad)


@pytest.mark.parametrize("text,seconds", [("77", 77), ("4:", 240), ("2::7", 7207), ("3m7s", 187), (":07", 7), ("2:41", 161), ("2H", 7200), ("3:07.25", 187.25), ("1.25h", 4500), ("7s2m", 127), ("75:10", 4510), (" .5 ", 0.5)])
def test_duration(text, seconds):
    assert time.duration(text) == seconds


@pytest.mark.parametrize("text", [":", "::", "2:61", "3:75:00", "2h15", "", "1:2:3:4", "7.1234", "1:-5", "x"])
def test_bad_duration(text):
    with pytest.raises(ValueError):
        time.duration(text)


def test_durations_as_expressions(spark):
    for text in ("77", "4:", "2::7", "3m7s", ":07", "1.25H", "7s2m", ":", "2:61", "3:75:00", "2h15", "", "7.1234", "1:2:3:4"):
        try:
            expected = time.duration(text)
        except ValueError:
            expected = None
        assert spark.range(1).select(time.duration_column(F.lit(text))).first()[0] == expected
    assert time.section("10", None, "5") == (10, 15, 5) and time.section(None, "1:00") == (0, 60, None)
    with pytest.raises(ValueError):
        time.section("1", "2", "3")


def test_interval_rows_merge_when_they_touch(spark):
    df = spark.createDataFrame([("a", 10, 20), ("a", 20, 30), ("a", 40, 50), ("b", 1, 2), ("b", 0, 9)], "g string, start long, finish long")
    assert values(windows.merged_intervals(df, ["g"]), "g", "start") == [("a", 10, 30, 2), ("a", 40, 50, 1), ("b", 0, 9, 2)]


def test_alignment_scan_stops_early():
    left = [alignment.Cue(0, 5, 6, "x")]
    wide, near = alignment.Cue(0, 0, 10, "x"), alignment.Cue(1, 1, 2, "y")
    assert [(a.index, b.index) for a, b in alignment.align(left, [wide, near])[0]] == [(0, 1)]
    assert [(a.index, b.index) for a, b in alignment.align(left, [wide])[0]] == [(0, 0)]


def test_alignment_of_an_insertion():
    cue = alignment.Cue
    before = [cue(0, 0, 1, "A"), cue(1, 1, 2, "B"), cue(2, 2, 3, "C")]
    after = [cue(0, 0, 0.4, "Ins"), cue(1, 0.4, 1.4, "A"), cue(2, 1.4, 2.4, "B"), cue(3, 2.4, 3.4, "C")]
    pairs, removed, added = alignment.align(before, after)
    assert [(a.text, b.text) for a, b in pairs] == [("A", "A"), ("B", "B"), ("C", "C")]
    assert not removed and [c.text for c in added] == ["Ins"]


def test_tolerance_of_timing():
    one, other = [alignment.Cue(0, 0, 1, "A")], [alignment.Cue(0, 0.009, 1.009, "A")]
    assert [d[0] for d in alignment.differences(one, other, 0.01)] == ["same"]
    assert [d[0] for d in alignment.differences(one, [alignment.Cue(0, 0.02, 1.02, "A")], 0.01)] == ["timing_changed"]


def test_semantic_diff_with_an_empty_side(spark):
    schema = "doc_id string, cue_idx long, start_s double, finish_s double, text string"
    before = spark.createDataFrame([("a", 0, 0.0, 1.0, "x")], schema)
    got = alignment.semantic_diff(before, spark.createDataFrame([("b", 0, 0.0, 1.0, "x")], schema))
    assert [r[:2] for r in values(got, "doc_id")] == [("a", "removed"), ("b", "added")]


@pytest.mark.parametrize(
    "words,segments,expected",
    [
        ([(0, 0.0, 2.0), (1, 2.0, 4.0)], [("3", 0.0, 1.5), ("8", 1.5, 4.0)], ["3", "8"]),
        ([(0, 10.0, 11.0)], [("0", 0.0, 1.0), ("1", 5.0, 6.0)], ["1"]),
        ([(0, 1.0, 1.0)], [("A", 0.0, 1.0), ("B", 1.0, 2.0)], ["B"]),
        ([(0, 3.0, 4.0)], [("A", 0.0, 1.0), ("B", 5.0, 6.0)], ["B"]),
    ],
)
def test_speakers(spark, words, segments, expected):
    w = spark.createDataFrame([("d", *x) for x in words], "doc_id string, word long, start_s double, finish_s double")
    s = spark.createDataFrame([("d", *x) for x in segments], "doc_id string, speaker_id string, start_s double, finish_s double")
    assert [r[2] for r in values(joins.max_overlap(w, s, ["doc_id"], "word", width=2.0), "word")] == expected


def test_timing_score(spark):
    clips = spark.createDataFrame([("n", 1.0, 0.0, 0.0), ("f", 2.0, 0.0, 0.0)], "g string, speed double, start_error double, end_error double")
    got = {r.g: r for r in aggregates.timing_score(clips, ["g"]).collect()}
    assert got["n"].deviation_index == 0 and got["f"].deviation_index == 100


def test_percentile_rules_differ(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 11)], "x double")
    assert df.agg(aggregates.nearest_rank(0.1, "x")).first()[0] == 1
    assert df.agg(F.collect_list("x").alias("v")).select(aggregates.floor_rank(F.col("v"), 0.1)).first()[0] == 2


def test_scores(spark):
    assert spark.range(1).select(quality.signal_score(F.lit(0.8), F.lit(0.04), F.lit(-18.0))).first()[0] == pytest.approx(0.62)
    assert [spark.range(1).select(quality.grade(F.lit(x))).first()[0] for x in (90.38, 65, 50, 49.9)] == ["excellent", "good", "fair", "poor"]


def test_schedule():
    got = folds.schedule([folds.Clip(0, 1.5, 2.4), folds.Clip(2, 4, 2)], 5)
    assert [c.start for c in got] == [0, 2] and got[0].end == 2 and got[0].speed == pytest.approx(1.2) and got[1].speed == 1
    got = folds.schedule([folds.Clip(0, 2, 1), folds.Clip(3, 4, 2)], 5)
    assert got[0].speed == 1 and got[0].end == 1
    got = folds.schedule([folds.Clip(6, 8, 5)], 9)  # the time before the first clip comes first
    assert (got[0].start, got[0].end, got[0].speed) == (3, 8, 1)
    got = folds.schedule([folds.Clip(0, 2, 4), folds.Clip(4, 6, 8)], 7)  # needs 2 and 6 share a gap of 2, then one second behind
    assert [c.start for c in got] == [0, 2.5] and [round(c.speed, 6) for c in got] == [1.6, round(8 / 4.5, 6)]
    assert folds.schedule([], 5) == []
    with pytest.raises(ValueError):
        folds.schedule([folds.Clip(0, 0, 1)], 0)


def test_reference_fill():
    assert folds.reference_fill([3.0, 7.0]) == [0] and folds.reference_fill([5.0, 2.0, 3.0, 1.0]) == [0, 1, 3] and folds.reference_fill([9.0]) == [] and folds.reference_fill([]) == []
    assert folds.reference_fill([1.0, 9.0, 2.0, 8.0], least=4.0, most=8.0) == [0, 2]


def test_line_overlap():
    assert folds.overlapping_words("a phrase that would", "phrase that would open it") == 3
    assert folds.join_lines(["a hyphen-", "ated word", "and a word", "a word more"]) == "a hyphenated word and a word more"


def test_merge_and_split():
    e = folds.Entry
    merged = folds.merge_adjacent([e(0, 1, "one", "A"), e(1.5, 2, "two", None), e(2, 3, "three", "B"), e(9, 10, "far", "B")])
    assert [(m.text, m.speaker) for m in merged] == [("one two", "A"), ("three", "B"), ("far", "B")]
    parts = folds.split_long(e(0, 10, "word " * 30))
    assert all(len(p.text) <= 84 for p in parts) and parts[-1].finish == 10 and " ".join(p.text for p in parts).split() == ["word"] * 30


def test_similarity_against_plain_versions():
    import random

    def plain_lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        return row[-1]

    draw = random.Random(1)
    for _ in range(300):
        a, b = ([draw.choice("abc") for _ in range(draw.randint(0, 9))] for _ in range(2))
        assert similarity.lcs(a, b) == plain_lcs(a, b)
    assert similarity.error_rate(["the", "reference", "sentence"], ["a", "different", "phrase"]) == 1.0
    assert similarity.match_share(["olá", "mundo"], ["olá", "mundo"]) == 1.0


def test_rate_limit_and_slots(spark):
    sends = spark.createDataFrame([(0, 0), (1, 1), (2, 10)], "i long, t long")
    assert [r.send_at for r in state.rate_limited(sends.withColumn("g", F.lit(1)), ["g"], ["i"], "t", 2).orderBy("i").collect()] == [0, 2, 10]
    jobs = spark.createDataFrame([(0, 0, 5), (1, 1, 2), (2, 9, 1)], "i long, t long, s long").withColumn("g", F.lit(1))
    assert [(r.start_at, r.finish_at) for r in state.one_slot(jobs, ["g"], ["i"], "t", "s").orderBy("i").collect()] == [(0, 5), (5, 7), (9, 10)]


def test_windows_of_sentences(spark):
    schema = "doc string, i long, start_s double, finish_s double, ends_sentence boolean"
    one = spark.createDataFrame([("d", 0, 0.0, 4.0, False), ("d", 1, 4.0, 8.0, True), ("d", 2, 8.0, 30.0, False)], schema)
    assert values(windows.sentence_windows(one, ["doc"], "i"), "first") == [("d", 0, 1, 0.0, 8.0)]


def test_srt_round_trip(spark):
    text = "1\n00:00:01,000 --> 00:00:02,500\nHi\nthere\n\n2\n00:00:03,000 --> 00:00:04,000\nBye\n"
    docs = spark.createDataFrame([("a", text)], "doc_id string, text string")
    assert subtitles.rendered(subtitles.cues(docs)).first().text == text
    with pytest.raises(ValueError):
        subtitles.parse("1\n00:00:02,000 --> 00:00:01,000\nx")
    assert subtitles.timed_words("a <00:00:01.000>b c", 0, 2) == [("a", 0, 1), ("b", 1, 1.5), ("c", 1.5, 2)]
    assert subtitles.timed_words("a <00:00:09.000>b", 0, 2) == []


def test_noise_and_multisets(spark):
    df = spark.createDataFrame([("1. 2. 3. 4",), ("1.2.13.4",), ("see 1.2.3.4 there",)], "x string")
    assert [r[0] for r in df.select(t.noise(F.col("x"))).collect()] == [True, False, False]
    diff = spark.range(1).select(t.multiset_diff(F.array(*map(F.lit, "aab")), F.array(*map(F.lit, "ab")))).first()[0]
    assert diff == ["a"]


def test_html_blocks(spark):
    page = "<html lang='fr'><title>T</title><nav><p>no</p></nav><div>in<p>one &amp; two</p><h2>Head</h2></div><script>p</script><p>last"
    rows = html.blocks(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).orderBy("block_idx").collect()
    assert [(r.tag, r.level, r.text) for r in rows] == [("p", 0, "one & two"), ("h2", 2, "Head"), ("p", 0, "last")] and rows[1].font_size == 22
    assert rows[0].language == "fr"

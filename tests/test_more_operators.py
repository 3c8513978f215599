"""Cues, documents, logs and media tables on small inputs."""

import pytest
from pyspark.sql import functions as F

from cuewright.functions import media, time
from cuewright.operators import cues, documents, state
from cuewright.sources import records, subtitles


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_slice_clamps_and_rebases(spark):
    schema = "i int, start_s double, finish_s double, words array<struct<text:string,start_s:double,finish_s:double>>"
    df = spark.createDataFrame([(0, 0.0, 2.0, [("a", 0.0, 1.0), ("b", 1.0, 2.0)]), (1, 2.0, 4.0, []), (2, 4.0, 6.0, [("c", 5.5, 6.0)]), (3, 1.0, 1.5, [])], schema)
    got = {r.i: r for r in cues.sliced(df, 1.5, 5.0).collect()}
    assert sorted(got) == [0, 1]  # 2 loses its only word, 3 ends where the slice starts
    assert (got[0].start_s, got[0].finish_s) == (0.0, 0.5) and [tuple(w) for w in got[0].words] == [("b", 0.0, 0.5)]


def test_projection_of_tokens(spark):
    words = F.array(*(F.struct(F.lit(float(i)).alias("start_s"), F.lit(float(i + 1)).alias("finish_s")) for i in range(2)))
    got = one(spark, cues.projected(F.array(*map(F.lit, "abc")), words))
    assert [tuple(x) for x in got] == [("a", 0.0, 0.5), ("b", 0.5, 1.0), ("c", 1.0, 2.0)]
    words = F.array(*(F.struct(F.lit(float(i)).alias("start_s"), F.lit(float(i + 1)).alias("finish_s")) for i in range(5)))
    got = one(spark, cues.projected(F.array(*map(F.lit, "ab")), words))
    assert [tuple(x) for x in got] == [("a", 0.0, 3.0), ("b", 3.0, 5.0)]


def test_parts_get_time_by_length(spark):
    got = one(spark, cues.timed_parts(F.array(F.lit("aa"), F.lit("bbbb"), F.lit("cc")), F.lit(0.0), F.lit(8.0)))
    assert [tuple(x) for x in got] == [("aa", 0.0, 2.0), ("bbbb", 2.0, 6.0), ("cc", 6.0, 8.0)]


def test_maps_and_bilingual(spark):
    a, b = (F.create_map(*map(F.lit, x)) for x in (("k", "1", "l", "2"), ("k", "3")))
    assert one(spark, cues.merged_maps(a, b)) == {"l": "2", "k": "3"}
    assert one(spark, cues.without_keys(a, ["k"])) == {"l": "2"}
    assert one(spark, cues.bilingual(F.lit(" x "), F.lit("x"))) == "x" and one(spark, cues.bilingual(F.lit("x"), F.lit("y"))) == "x\ny"


def test_font_roles(spark):
    rows = [("d", 0, 24.0, False, "left", "Big")] + [("d", i, 18.0, False, "left", "Mid") for i in (1, 2, 3)] + [("d", i, 12.0, False, "left", "text") for i in range(4, 20)] + [("d", 20, 12.0, True, "center", "Bold"), ("d", 21, 8.0, False, "left", "note"), ("d", 22, 0.0, False, "left", "none")]
    df = spark.createDataFrame(rows, "doc_id string, line_idx int, font_size double, bold boolean, alignment string, text string").withColumn("italic", F.lit(False))
    got = {(r["size"], r.bold): (r.role, r.level) for r in documents.font_roles(df).collect()}
    assert got == {(24.0, False): ("title", None), (18.0, False): ("chapter", 1), (12.0, True): ("heading", 2), (12.0, False): ("body", None), (8.0, False): ("footnote", None)}
    assert documents.font_roles(df.limit(0)).collect() == []


@pytest.mark.parametrize("x,x_max,expected", [(200, 400, "center"), (80, 520, "left"), (120, 480, "left"), (400, 560, "right")])
def test_alignment(spark, x, x_max, expected):
    assert one(spark, documents.alignment(F.lit(float(x)), F.lit(float(x_max)), F.lit(600.0))) == expected


def test_sizes(spark):
    q = lambda x: one(spark, documents.quantised(F.lit(x)))
    assert q(12.2) != q(12.4) and q(12.1) == q(12.2)


def test_contents_pages(spark):
    toc = [("d", 1, f"Chapter {i} ..... {i}") for i in range(6)]
    text = [("d", p, "A line of text.") for p in (2, 3)]
    schema = "doc_id string, page int, text string"
    assert [r.page for r in documents.publication_pages(spark.createDataFrame(toc + text, schema)).orderBy("page").collect()] == [2, 3]
    assert [r.page for r in documents.publication_pages(spark.createDataFrame(toc, schema)).collect()] == [1]


def test_options_and_inputs(spark):
    df = spark.createDataFrame([(1, "lang=en fast\nhttps://a.example/x caption\nhttps://b.example lang=fr lang=de")], "message_id long, text string")
    got = [(r.n, r.url, r.options) for r in records.input_lines(df).orderBy("n").collect()]
    assert got == [(1, "https://a.example/x", {"lang": "en", "fast": "1", "caption": "1"}), (2, "https://b.example", {"fast": "1", "lang": "de"})]


def test_logs(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "key string, at long, v string"
    assert records.read_log(spark, path, schema).collect() == []
    for rows in ([("a", 1, "x"), ("b", 1, "y")], [("a", 2, "z"), ("c", 1, "w")]):
        records.append_log(spark.createDataFrame(rows, schema), path)
    live = spark.createDataFrame([("a",), ("c",)], "key string")
    got = records.compacted(records.read_log(spark, path, schema), live, ["key"], ["at"])
    assert sorted((r.key, r.v) for r in got.collect()) == [("a", "z"), ("c", "w")]


def test_cookies_and_keys(spark):
    df = spark.createDataFrame([("# a comment",), ("#HttpOnly_x.example\tTRUE\t/\tTRUE\t0\tsid\tv",), ("x.example\tTRUE\t/\tTRUE\t0\tlang\tv",), ("broken",)], "value string")
    assert [(r.domain, r.names) for r in records.netscape_cookies(df).collect()] == [("x.example", ["lang", "sid"])]
    a, b = F.create_map(*map(F.lit, ("k", "1", "l", "2"))), F.create_map(*map(F.lit, ("l", "2", "k", "1")))
    assert one(spark, records.cache_key(a)) == one(spark, records.cache_key(b))


def test_media_tables(spark):
    kinds = [(n, m, one(spark, media.document_kind(F.lit(n).cast("string"), F.lit(m).cast("string")))) for n, m in (("a.PDF", None), ("a.bin", "text/html"), (None, "text/plain"), ("a.bin", "text/plain"))]
    assert [k for *_, k in kinds] == ["pdf", None, "txt", None]
    assert one(spark, media.tempo_chain(F.lit(5.0))) == [2.0, 2.0, 1.25] and one(spark, media.tempo_chain(F.lit(1.5))) == [1.5]
    assert one(spark, media.tempo_chain(F.lit(1.0))) == [] and one(spark, media.tempo_filter(F.lit(4.0))) == "atempo=2.000000,atempo=2.000000"
    assert one(spark, media.fragments_length(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.5))))) == 3.0


def test_ranges_and_stamps(spark):
    ranges = one(spark, time.range_list(F.lit("6,1,3-5")))
    assert [tuple(r) for r in ranges] == [(6, 6), (1, 1), (3, 5)]
    assert one(spark, time.range_values(time.range_list(F.lit("6,1,3-5,4")))) == [1, 3, 4, 5, 6]
    with pytest.raises(Exception, match="not a range"):
        one(spark, time.range_list(F.lit("5-3")))
    assert one(spark, time.format_timestamp(F.lit(3661.0015))) == "01:01:01,002" and one(spark, time.parse_timestamp(F.lit("1:01:01,5"))) is None


def test_transcripts(spark):
    text = '{"language":"en","segments":[{"start":0.5,"end":1.5,"text":"hi","words":[{"word":"hi","start":0.5,"end":1.5,"prob":0.9}]}]}'
    row = subtitles.transcript_segments(spark.createDataFrame([("a", text)], "doc_id string, json string")).first()
    assert (row.start_s, row.finish_s, row.text, row.confidences) == (0.5, 1.5, "hi", [0.9])
    text = '{"segments":[{"start":0,"end":1,"text":"a","words":[{"word":"a","confidence":null,"p":0.5},{"word":"b","p":0.25},{"word":"c"}]}]}'
    row = subtitles.transcript_segments(spark.createDataFrame([("a", text)], "doc_id string, json string")).first()
    assert row.confidences == [None, 0.25, None]  # a name that is present wins, even with a null
    millis = '{"segments":[{"t0_ms":500,"t1_ms":1500,"text":"hi","words":[]}]}'
    row = subtitles.transcript_segments(spark.createDataFrame([("a", millis)], "doc_id string, json string"), millis=True).first()
    assert (row.start_s, row.finish_s) == (0.5, 1.5)
    with pytest.raises(Exception, match="no segments"):
        subtitles.transcript_segments(spark.createDataFrame([("a", "{}")], "doc_id string, json string")).collect()


def test_job_outcomes(spark):
    f = lambda s, o, a, adm: one(spark, state.cancel_outcome(F.lit(s).cast("string"), F.lit(o), F.lit(a), F.lit(adm)))
    assert [f(None, 1, 1, False), f("queued", 1, 2, False), f("queued", 1, 2, True), f("finished", 1, 1, False), f("cancelled", 1, 1, False)] == ["missing", "forbidden", "cancelled", "finished", "already cancelled"]
    df = spark.createDataFrame([(0, False), (1, True), (2, False)], "i int, failed boolean")
    assert [r.i for r in state.until_failure(df, "i", F.col("failed")).collect()] == [0]

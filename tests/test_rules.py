"""Validators, units, paragraphs, transcripts, captions and ASS events on worked examples."""

import functools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import oracle
from cuewright.functions import captions, validation
from cuewright.functions import sentences as splitter
from cuewright.functions import text as t
from cuewright.operators import aggregates, folds, lookups, paragraphs, templates, transcripts
from cuewright.operators.paragraphs import Line
from cuewright.operators.transcripts import Segment
from cuewright.sources import ass, records, subtitles

LEXICON = validation.Lexicon(
    common=frozenset("the of and is in a to this that we it".split()), anchors=frozenset(["meaning"]), connectors=frozenset(["and", "is"]), retained=frozenset(["hence"]),
    protected_connectors=frozenset(["and", "or"]), invalid=(r"\bdefinition of\b",), transport="ZXQ", suffixes="tion|ness",
)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "source,target,code",
    [
        ("One.", "Eins.", None), ("a\nb", "x y", "line_breaks"), ("a (b)", "x y", "delimiters"), ("a [[b]] c", "x [b] [c] y]", "delimiters"), ("a", "x &amp;nbsp;", "entities"),
        ("“a”", "”x“", "quotes"), ("“a”", "„x“", None), ("a", "x “ ”", "quotes"), ("a", "x ZXQ", "markers"), ("a", "x Ж", "script"), ("Ж a", "Ж x", None),
        ("so this is the text of it", "so this is the text of it", "untranslated"), ("we go to the house", "", "untranslated"), ("a = b", "a = b", None), ("hence one", "hence eins", "untranslated"),
        ("⟦P1⟧ and ⟦P2⟧", "⟦P1⟧ and ⟦P2⟧", "untranslated"), ("One two.", "die definition of eins", "target_language"), ("One two three four. Five.", "Eins zwei drei vier. Eins zwei drei vier.", "duplicate_sentence"),
        (None, None, None), ("", "x", None),
    ],
)
def test_validate(source, target, code):
    assert validation.validate(source, target, LEXICON) == code


def test_validate_parts():
    assert validation.validate("the Om is", "das Omega ist", LEXICON, ["Om"]) == "protected_values" and validation.validate("the Om is", "das Om ist", LEXICON, ["Om"]) is None
    assert validation.delimiter_tree("(a [b]) {c}") == ["([])", "{}"] and validation.delimiter_tree("(a]") is None
    chinese = validation.Lexicon(target="zh")
    assert not validation.delimiters_changed("(a) {b}", "{b} (a)", "zh") and validation.delimiters_changed("(a) {b}", "{b} (a)", "de") and chinese.target == "zh"
    assert validation.structure_compatible("<b>x</b><i>y</i>", "<b>x</b><i>z</i>") and not validation.structure_compatible("<b>x</b>", "<i>x</i>")
    assert validation.structure_compatible("<i>a</i><b><i>c</i></b>", "<b><i>a</i></b><i>c</i>") and not validation.structure_compatible("<i>a</i><i>b</i>", "<i>a<i>b</i></i>")
    assert validation.protected_fragment("dhármo śaraṇaṁ gacchāmi buddhaṁ", LEXICON) and not validation.protected_fragment("this is the meaning of ā and ī", LEXICON)
    assert validation.protected_inline("śānti", LEXICON) and validation.protected_inline("a", validation.Lexicon()) and not validation.protected_inline("peace", LEXICON)
    assert validation.repeats("One two three four. One two three four! Five six.") == [2]
    assert validation.entities_kept("a &ndash; b", "x – y") == "x &ndash; y" and validation.single_dashes("a - b", "x -- y") == "x - y" and validation.latin_marks("a，b", "de") == "a,b"
    assert validation.anchors_in_order("⟦P1⟧ <i>a</i> ⟦P2⟧", "⟦P1⟧ ⟦P2⟧ <i>x</i>") and not validation.anchors_in_order("⟦P1⟧⟦P2⟧", "⟦P2⟧⟦P1⟧")
    assert validation.editorial_depth("a [b [c]] [d]") == [1, 2, 1]


def test_validation_columns(spark):
    df = spark.createDataFrame([("a (b)", "x"), ("One.", "Eins."), (None, None)], "source string, target string")
    assert [r[0] for r in df.select(validation.validate_column(LEXICON)(F.col("source"), F.col("target"))).collect()] == ["delimiters", None, None]


def test_units_round_trip(spark):
    """Every page comes back from its template and units, every unit from its masked text; the table form holds the same."""
    pages = spark.read.parquet(f"{oracle.DATA}/pages.parquet")
    texts = {r.page_id: r.html for r in pages.collect()}
    for html in [*texts.values(), "", "plain. Text only!", "<p>a</p>tail <b>x</b>", "<div>One. <p>Two.</p> Three</div><!-- c. d. -->"]:
        done = templates.unitize(html or "")
        assert templates.rendered(done.template, done.units) == (html or "")
        for source in done.units.values():
            unit = templates.prepare_unit(source)
            assert templates.rendered(templates.restored(unit.text, unit.tokens), unit.nested) == source
    rows = templates.document_units(pages.withColumn("kind", F.lit("clash"))).collect()
    for page, html in texts.items():
        assert "".join(r.text for r in sorted((r for r in rows if r.page_id == page), key=lambda r: r.ordinal)) == (html or "")
    assert any(r.kind == "unit" for r in rows)


def test_unit_rules():
    unit = templates.prepare_unit("See prajñā (deep wisdom), [note] and [[a long story]], at https://x.org/a or 3.5 and śānti, śakti.")
    assert unit.text == "See __P0001__, __P0002__note__P0003__ and __P0004__, at __P0005__ or __P0006__ and __P0007__."
    assert set(unit.nested.values()) == {"deep wisdom", "a long story"} and unit.tokens["__P0007__"] == "śānti, śakti"
    assert templates.restored("x __ p0001 __ y __P0002__", {"__P0001__": "A", "__P0002__": "B"}) == "x A y B"
    assert templates.restored("only text", {"__P0001__": "A"}) == "A only text"
    for bad in ("__P0001__ __P0001__", "__P0001__ __P0009__"):
        with pytest.raises(ValueError):
            templates.restored(bad, {"__P0001__": "A"})
    key = templates.unit_key("x", "1", "de")
    with pytest.raises(ValueError):
        templates.rendered(f"⟦U{key}⟧", {key: f"a ⟦U{key}⟧"})


def test_paragraphs(spark):
    lines = [Line("A BOLD TITLE", 1, 20, True), Line("The first line of an ex-", 1, 12), Line("ample1 goes on.", 1, 12), Line("New paragraph here", 1, 12), Line("1 The note itself.", 1, 8), Line("goes on there.", 1, 8), Line("and ends on the next page.", 2, 12), Line("7", 2, 12)]
    found = paragraphs.detected(lines)
    assert [p.text for p in found][:2] == ["A BOLD TITLE", "The first line of an example1 goes on."]
    noted = paragraphs.with_notes(paragraphs.merged_pages(found))
    assert noted[1].text == "The first line of an example goes on." and noted[1].notes["1"].startswith("The note itself.")
    assert paragraphs.detected([]) == [] and paragraphs.merged_blocks([("ONE HEAD\n\ntext goes\non here", [1]), ("and on.", [2]), (None, [3])]) == [("ONE HEAD", [1], False, "heading"), ("text goes on here and on.", [1, 2], True, "text")]
    table = spark.createDataFrame([("d", i, x.text, x.page, float(x.size), x.bold) for i, x in enumerate(lines)], "doc string, i int, text string, page int, size double, bold boolean")
    rows = sorted(paragraphs.paragraphs(table, "doc", "i").collect(), key=lambda r: r.paragraph)
    assert [r.text for r in rows] == [p.text for p in noted] and rows[1].notes == noted[1].notes


def test_line_joins(spark):
    assert folds.overlapping_words("he said, (Hello there)", "hello there again") == 2 and folds.overlapping_words("a word", "word b") == 0 and folds.overlapping_words("one sentence", "Sentence two") == 1
    df = spark.createDataFrame([(["a hyphen-", "ated word"], [3.0, 7.0], "aa bb cccccc")], "lines array<string>, lengths array<double>, text string")
    assert tuple(df.select(folds.joined_lines(F.col("lines")), folds.chosen_pieces(F.col("lengths")), folds.packed(5)(F.col("text"))).first()) == ("a hyphenated word", [0], ["aa bb", "ccccc", "c"])
    clips = spark.createDataFrame([("d", 0, 6.0, 8.0, 5.0, 9.0)], "doc_id string, cue_idx long, start_s double, finish_s double, duration_s double, total_s double")
    assert tuple(folds.scheduled(clips).first()) == ("d", 0, 3.0, 8.0, 1.0)


def test_sentence_splitter_is_no_recursion():
    assert len(splitter.split_long("x" * 1_000_000, 100)) == 10_000
    assert splitter.split_long("one two; three four, five six", 12) == ["one two;", "three four,", "five six"]


def test_cue_folds():
    E = folds.Entry
    words = [E(i, i + 1, w) for i, w in enumerate(["Dr.", "Who", "came.", '"', " ", "Then", "left", "…", "ok"])]
    assert [s.text for s in folds.sentences(words)] == ['Dr. Who came."', "Then left …", "ok"]
    assert folds.packed_items("aaaa bbbb cccc dddd e".split(), 19) == [["aaaa", "bbbb"], ["cccc", "dddd", "e"]] and folds.packed_items(["x" * 50, "y"], 10) == [["x" * 50], ["y"]] and folds.packed_items([], 5) == []
    parts = folds.split_long(E(0, 10, "aaaa bbbb cccc dddd e"), 19)
    assert [p.text for p in parts] == ["aaaa bbbb", "cccc dddd e"] and parts[-1].finish == 10 and parts[0].finish == 10 * 9 / 20 and folds.split_long(E(0, 1, "short"), 19) == [E(0, 1, "short")]
    joined = folds.merge_across([[E(0, 1, " Hel"), E(1, 2, "lo")], [E(2, 3, "w"), E(3, 4, " end.")], [E(4, 5, "New")], [E(5, 6, "er")]])
    assert [[w.text for w in e] for e in joined] == [[" Hellow"], [" end."], ["Newer"]]
    shout = lambda texts: ["Translation: " + t.upper() for t in texts]
    done = folds.translated([E(0, 4, "one two. three"), E(4.5, 6, "four")], shout)
    assert [d.text for d in done] == ["ONE TWO. THREE FOUR"] and (done[0].start, done[0].finish) == (0, 6)
    assert folds.translated_lines([["a <00:01.000>b", "c"], ["<1:00:02,500>XT0Q"]], lambda x: [t.replace("a", "z") for t in x]) == [["z <00:01.000>b", "c"], ["<1:00:02,500>XT0Q"]]
    for bad in (lambda x: x[:-1], lambda x: ["gone"] * len(x)):
        with pytest.raises(ValueError):
            folds.translated_lines([["a <00:01.000>b"]], bad)
    with pytest.raises(ValueError):
        folds.translated([E(0, 1, "x")], lambda x: [])


def test_boundaries(spark):
    long = "A running line of more than forty characters"
    pages = [["Head 1", "text", long], ["head 2", "Own", "x " + long.upper() + " y"], ["HEAD 3", "else", long], ["Head", "only", "last"]]
    rows = [("d", p, i, x) for p, lines in enumerate(pages) for i, x in enumerate(lines)] + [("few", 0, 0, "Head"), ("few", 1, 0, "Head")]
    df = spark.createDataFrame(rows, "doc_id string, page int, line_idx int, text string")
    left = {(r.doc_id, r.page, r.text) for r in aggregates.without_boundaries(df).collect()}
    assert left == {("d", 0, "text"), ("d", 0, long), ("d", 1, "Own"), ("d", 1, "x " + long.upper() + " y"), ("d", 2, "else"), ("d", 2, long), ("d", 3, "Head"), ("d", 3, "only"), ("d", 3, "last"), ("few", 0, "Head"), ("few", 1, "Head")}
    more = df.unionByName(spark.createDataFrame([("d", 4, 0, "n"), ("d", 4, 1, long)], df.schema))
    left = {r.text for r in aggregates.without_boundaries(more).filter("doc_id = 'd'").collect()}
    assert left == {"text", "Own", "else", "Head", "only", "last", "n"}  # the long line recurs now, and goes inside another line, too
    assert [(r.boundary, r.n) for r in aggregates.repeated_boundaries(more).collect()] == [(long.lower(), 3)]


def test_documents_stay_byte_for_byte():
    for text in ("1\r\n00:01 --> 00:02\r\nOne\r\n\r\n\r\nNOTE x\r\n\r\n2\r\n00:03 --> 00:04\r\nTwo\r\nlines\r\n\r\n", "WEBVTT\n\n00:01 --> 00:02\na", "", "\n\n"):
        assert subtitles.rewritten(text, {}) == text and "".join(a + b for a, b in subtitles.raw_blocks(text)) == text
    text = "1\r\n00:01 --> 00:02\r\nOne\r\n\r\n2\r\n00:03 --> 00:04\r\nTwo\r\n"
    assert subtitles.rewritten(text, {1: "new\ntext"}) == text.replace("Two", "new\r\ntext")
    assert subtitles.with_word_times([("a", 1.0), ("b", 3661.0015)]) == "a <01:01:01.002>b"


def test_windows(spark):
    good = (0.95,) * 9
    segments = [Segment(0, 3, "one two three four", good), Segment(3, 6, "five six seven eight.", good), Segment(6, 7, "nine.", (0.2,)), Segment(7, 30, "too long.", good)]
    assert [[s.start for s in w] for w in transcripts.windows(segments)] == [[0, 3]]
    assert transcripts.trimmed([segments[2], *segments[:3]]) == segments[:2] and transcripts.trimmed([segments[2]]) == []
    found = transcripts.candidates(segments)
    assert [(c[0], c[1]) for c in found] == [(0, 6)] and found[0][3] == pytest.approx(0.95 * 0.95)
    assert transcripts.candidates([Segment(i, i + 1, "a b c.", good) for i in range(9)]) == []  # it repeats itself
    df = spark.createDataFrame([("r", i, float(s.start), float(s.finish), s.text, list(s.confidences)) for i, s in enumerate(segments)], "doc_id string, cue_idx int, start_s double, finish_s double, text string, confidences array<double>")
    rows = transcripts.reference_candidates(df).collect()
    assert [(r["rank"], r.start_s, r.finish_s) for r in rows] == [(1, 0.0, 6.0)]
    placed = transcripts.ranked_candidates(transcripts.reference_candidates(df), spark.createDataFrame([("r", 0.0, 0.5)], "doc_id string, start_s double, signal_score double")).first()
    assert placed.place == 1 and placed.score == pytest.approx(0.5 + 0.2 * 0.9025)


def test_transcript_scores(spark):
    s = one(spark, transcripts.transcript_score(F.lit("One two, three!"), F.lit("one x three four"), F.array(F.lit(0.5), F.lit(None).cast("double"), F.lit(1.0)), F.lit("en"), "en", 0.5))
    assert (s.expected_words, s.recognized_words, s.matching_words, s.match_rate, s.word_error_rate, s.confidence_mean, s.confidence_p10, s.accepted) == (3, 4, 2, 0.5, 2 / 3, 0.75, 0.5, True)
    empty = one(spark, transcripts.transcript_score(F.lit(None).cast("string"), F.lit(""), F.array().cast("array<double>"), F.lit(None).cast("string"), "en"))
    assert empty.match_rate == 0 and empty.confidence_mean is None and not empty.accepted
    counts = transcripts.alignment_counts("Ça va bien ici", "ca va mal")
    assert (counts["matches"], counts["substitutions"], counts["deletions"], counts["insertions"], counts["wer"]) == (2, 1, 1, 0, 0.5)
    ok = transcripts.reference_accepted(F.lit(True), F.lit(" "), "en", F.lit(0.85), F.lit(0.75), F.lit(0.8))
    assert one(spark, ok) and not one(spark, transcripts.reference_accepted(F.lit(True), F.lit("de"), "en", F.lit(1.0), F.lit(1.0), F.lit(1.0)))


def test_ass_events():
    words = [ass.TimedWord("a", 1, 2), ass.TimedWord("b", 2, 3, 1), ass.TimedWord("c", 3, 4, 1), ass.TimedWord("d", 0.5, 5)]
    assert ass.word_groups(words) == [(1, 2, "a"), (2, 4, "b c"), (0.5, 5, "d")]
    assert [(a, b) for a, b, _ in ass.events(1, 5, "x", words)] == [(1, 2), (2, 5)] and ass.events(1, 5, "x\ny", [])[0][2] == "x\\Ny"
    assert ass.events(1, 5, "x", words[:2], "karaoke")[0][2] == "{\\k100}a {\\k100}b" and ass.dialogue((0, 3661.005, "t")).split(",")[1:3] == ["0:00:00.00", "1:01:01.01"]
    assert ass.canonical_vtt("WEBVTT\r\n\r\n00:01,000 --> 00:02,500 a:1,2\r\n{\\an8}x<00:01,500>y\\Nz") == "WEBVTT\n\n00:01.000 --> 00:02.500 a:1,2\nx<00:01.500>y\nz"
    for bad in ("00:02.000 --> 00:01.000", b"\xff"):
        with pytest.raises(ValueError):
            ass.canonical_vtt(bad)
    assert ass.marked_boundaries("ab cd e", ["ab", "c", "d", "e"]) == ["ab", " c", "d", " e"]
    assert ass.tokenised("Don't stop, 42 times!") == ["Don't", "stop,", "42", "times!"]


def test_captions(spark):
    c = one(spark, captions.caption(F.lit("A_b"), F.lit("me."), F.lit(" line\n\nmore "), F.lit("https://www.x.org/a"), F.lit("#t")))
    assert c == "_A\\_b_\nme\\.\n\n_line_\n\n_more_\n\nx\\.org/a".replace("/a", "\\/a") + "\n\n\\\\#t"
    assert captions.cut_markdown("ab_cdef", 4) == "ab__"[:2] + "__" or captions.cut_markdown("ab_cdef", 4).count("_") % 2 == 0
    assert captions.cut_markdown("abc\\_d", 4) == "abc" and captions.cut_album("long text here\n\nx.org", 12) == "long t\n\nx.org"[:12] or len(captions.cut_album("long text here\n\nx.org", 12)) <= 12
    assert captions.fitted("abcdef", lambda x: f"[{x}]" if x else "", 5) == "[abc]" and captions.fitted("abc", lambda x: "toolong", 3) == "toolong"
    parts, urls = captions.split_for_translation("One. Two!\n\nThree. https://a.b/c")
    assert parts == [["One.", "Two!"], ["\n\n"], ["Three."]] and urls == "https://a.b/c" and captions.rejoined(parts, urls) == "One. Two!\n\nThree. https://a.b/c"
    assert one(spark, captions.unescaped(F.lit("a\\.b\\_c"))) == "a.b\\_c" and one(spark, t.trailing_urls(F.lit("x\n\na.org/x\n\nb.de"))) == "\n\na.org/x\n\nb.de"
    with pytest.raises(Exception, match="not a post"):
        one(spark, captions.post_target(F.lit("https://x.y/z")))


def test_addresses(spark):
    df = spark.createDataFrame([(x,) for x in ("8.8.8.8", "10.1.1.1", "::1", "2001:4860:4860::8888", "::ffff:10.0.0.1", "x", None, "300.1.1.1")], "ip string")
    assert [r[0] for r in df.select(lookups.public_ip(F.col("ip"))).collect()] == [True, False, False, True, False, False, False, False]


def test_choices(spark):
    cache, units = spark.createDataFrame([("k", None), ("l", "x")], "key string, target string"), spark.createDataFrame([("k", "a"), ("l", "a"), ("m", "a")], "key string, source string")
    assert [r.key for r in lookups.validated_cache(units, cache, "key", lambda a, b: b != a).collect()] == ["l"]
    with pytest.raises(Exception, match="unclassified"):
        lookups.classified(units, spark.createDataFrame([("k", "v")], "key string, v string"), "key", "v").collect()
    with pytest.raises(Exception, match="not listed"):
        lookups.listed_before(spark.createDataFrame([("g", 1, "t")], "g string, i int, title string"), ["g"], ["i"], F.lit(False)).collect()
    shown, more = lookups.reviewed(spark.range(25), ["id"])
    assert shown.count() == 20 and more.first().more == 5
    with pytest.raises(Exception, match="too many URLs"):
        records.input_lines(spark.createDataFrame([("m", "\n".join(f"https://x.y/{i}" for i in range(11)))], "message_id string, text string")).collect()


def test_cover_at_the_edge_is_the_same_however_its_images_are_dealt(spark):
    widths = [10.0, 204.0, 385.0, 88.0, 88.0, 225.0]  # half of 2000 together; the doubles come to 0.5 or just below it, by their order
    rows = [(page, i, w, 1.0, 2000.0, 1.0) for page, ws in (("up", widths), ("down", widths[::-1])) for i, w in enumerate(ws)]
    total = lambda ws: functools.reduce(lambda s, w: s + w / 2000.0, ws, 0.0)
    expected = {"up": (2, total(widths), False), "down": (3, total(widths[::-1]), True)}
    assert total(widths) < 0.5 <= total(widths[::-1])
    for seed, parts in ((0, 1), (1, 1), (2, 4), (3, 12)):
        random.Random(seed).shuffle(rows)
        images = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "page string, ordinal int, width double, height double, page_width double, page_height double")
        assert {r.page: (r.largest, r.total_share, r.is_cover) for r in lookups.cover(images, "page").collect()} == expected
    blank = spark.createDataFrame([("p", 0, None, 1.0, 2000.0, 1.0), ("p", 1, 1000.0, 1.0, 2000.0, 1.0), ("q", 0, None, 1.0, 2000.0, 1.0)], images.schema)
    assert {r.page: (r.total_share, r.stacked, r.is_cover) for r in lookups.cover(blank, "page").collect()} == {"p": (0.5, 2.0, True), "q": (None, 1.0, None)}


def test_trigrams_of_batches():
    draw = random.Random(0)
    lists = [[draw.choice("abc") for _ in range(draw.randint(0, 12))] for _ in range(300)]
    from cuewright.operators.aggregates import trigram_shares

    expected = [len(set(zip(w, w[1:], w[2:]))) / (len(w) - 2) if len(w) > 2 else 0.0 for w in lists]
    assert trigram_shares(pa.array(lists, pa.list_(pa.string()))).to_pylist() == expected
    assert trigram_shares(pa.array([None, []], pa.list_(pa.string()))).to_pylist() == [0.0, 0.0]

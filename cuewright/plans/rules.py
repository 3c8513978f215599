"""Queries of decision tables, lookups, checks and measures on the driver's tables, each with SQL written from the rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.functions import captions, media, validation
from cuewright.functions import text as t
from cuewright.functions import time as clock
from cuewright.operators import aggregates, cues, documents, lookups, quality, state
from cuewright.session import table


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clocks and periods made of sizes, malformed ones among them; null where the rule refuses."""
    n, k = F.col("p_size"), F.col("p_partkey")
    form = k % 9
    text = (
        F.when(form == 0, F.concat(n, F.lit(":"), k % 75)).when(form == 1, F.concat(n, F.lit("::"), k % 60)).when(form == 2, F.concat(n, F.lit("H"), k % 90, F.lit("m")))
        .when(form == 3, F.concat(k % 90, F.lit("s"), n, F.lit("m"))).when(form == 4, F.concat(F.lit(" "), n, F.lit(".5h "))).when(form == 5, F.concat(n, F.lit(":")))
        .when(form == 6, F.concat(n, F.lit(":"), k % 80, F.lit(":00.25"))).when(form == 7, F.concat(n, F.lit(".1234"))).otherwise(F.lit(":"))
    )
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text")).withColumn("seconds", clock.duration_column(F.col("text")))


def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sizes of media for a length and a limit, default width, and formats by their names."""
    seconds, limit = (F.col("l_partkey") % 9000 + 1).cast("double"), F.when(F.col("l_suppkey") % 4 == 0, 50.0).when(F.col("l_suppkey") % 4 == 1, 60.0).when(F.col("l_suppkey") % 4 == 2, 2000.0)
    names = F.element_at(F.array(*map(F.lit, ("mp4", "hevc", "webm", "h264", "nothing"))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    sized = media.limited(seconds, limit, 1920, 96)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", seconds.alias("seconds"), limit.alias("limit_mb"), names.alias("wanted"), sized.alias("s"))
    chosen = media.chosen_format("video", ("h264", "h265", "vp9"), "h264", F.nullif("wanted", F.lit("h264")), F.col("seconds"), long_default="h265")
    return rows.select("l_orderkey", "l_linenumber", "seconds", "limit_mb", "s.width", "s.rate", "s.maxrate", "s.buffer_mb", media.default_width(F.col("limit_mb")).alias("default_width"), media.audio_minutes(F.lit(96), F.col("limit_mb")).alias("audio_minutes"), chosen.alias("format"))


def encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sizes in points, and how a pause is encoded for a format."""
    k = F.col("p_partkey")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    size = F.concat(F.col("p_size"), pick(("pt", "px", "em", "%", "rem", ""), k))
    size = F.when(k % 17 == 0, "X-Large").when(k % 19 == 0, "none").otherwise(size)
    codec, profile = pick(("mp3", "opus", "aac", "pcm_s16le", "flac", "", "vorbis"), k), pick(("LC", "HE-AAC", "he-aacv2"), F.col("p_size"))
    e = media.pause_encoding(codec, profile, F.col("p_size") - 10, F.when(k % 2 == 0, "s16").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", media.size_in_points(size, F.lit(12.0)).alias("points"), e.alias("e")).select("p_partkey", "points", "e.*")


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that are addresses, public networks, targets of posts."""
    k = F.col("l_partkey") * 7 + F.col("l_suppkey")
    first = F.element_at(F.array(*map(F.lit, (10, 100, 127, 169, 172, 192, 198, 203, 224, 8, 0, 255, 300))), (k % 13 + 1).cast("int"))
    ip = F.concat_ws(".", first, F.when(k % 3 == 0, 168).when(k % 3 == 1, 64).otherwise(k % 256), k % 5, F.col("l_linenumber"))
    word = F.concat(F.when(k % 2 == 0, "https://").otherwise(""), F.when(k % 5 == 0, "nohost").otherwise("a-b.Example.org"), F.when(k % 7 == 0, ":80/x?y#z").when(k % 7 == 1, "/ x").otherwise(""))
    post = captions.post_target(F.concat(F.lit("https://t.me/user_"), F.col("l_suppkey"), F.lit("/"), F.col("l_partkey"), F.when(k % 2 == 0, "?single").otherwise("")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ip.alias("ip"), lookups.public_ip(ip).alias("public"), t.url_token(word).alias("is_address"), post["username"].alias("username"), post["message_id"].alias("message_id"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """items of an order as spans of time against the next one."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")  # a few lines an order
    a0 = (F.col("l_partkey") % 50).cast("double")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", a0.alias("a0"), (a0 + F.col("l_quantity").cast("double")).alias("a1"))
    rows = rows.withColumn("b0", F.lead("a0").over(w)).withColumn("b1", F.lead("a1").over(w)).filter("b0 IS NOT NULL")
    four = [F.col(c) for c in ("a0", "a1", "b0", "b1")]
    return rows.select("l_orderkey", "l_linenumber", lookups.overlap(*four).alias("overlap"), lookups.union_share(*four).alias("iou"), lookups.gap(*four).alias("gap"), lookups.beyond(F.col("a0"), F.col("b0"), 5.0).alias("beyond"))


def means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means with their rules for nothing, rates, groups in order of first appearance, and checks passed, by supplier."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ordinal"), F.col("l_quantity").cast("long").alias("q"), F.col("l_returnflag").alias("flag"))
    groups = lookups.ordered_groups(rows, ["l_suppkey"], "ordinal")
    passed = lookups.checks_passed(rows, ["l_suppkey"], F.col("q") > 25)
    few = rows.filter("q > 49 AND flag = 'R'").groupBy("l_suppkey").agg(F.collect_list(F.col("q")).alias("few"))
    speed = rows.groupBy("l_suppkey").agg(lookups.real_time_factor(F.when(F.col("flag") == "R", F.col("q")).otherwise(0), F.col("q")).alias("rtf"))
    joined = groups.join(passed, "l_suppkey").join(speed, "l_suppkey").join(few, "l_suppkey", "left").withColumn("few", F.coalesce("few", F.array().cast("array<bigint>")))
    return joined.select("l_suppkey", "first", "rows", "passed", "total", "rtf", lookups.mean_or(F.col("few"), 0.0).alias("mean_or_zero"), lookups.mean_or(F.col("few"), None).alias("mean_or_null"), lookups.rms_or(F.col("few"), 0.0).alias("rms"))


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages: which the service reacts to, which upload is picked, and what is left of blank translations."""
    events = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("/"), F.col("event_type"))).when(F.col("event_id") % 5 == 1, "  ").otherwise(F.col("event_type"))
    message = events.select("event_id", "user_id", text.alias("text"), (F.col("event_id") % 11 == 0).alias("outgoing"), (F.col("event_id") % 3 == 0).alias("has_file"), (F.col("user_id") % 2 == 0).alias("in_group"))
    uploads = F.array(F.lit("video"), F.when(F.col("event_id") % 2 == 0, "audio").otherwise("document"), F.lit("audio"))
    wanted = F.when(F.col("event_id") % 3 == 0, "audio").when(F.col("event_id") % 3 == 1, "document").otherwise("photo")
    return message.select("event_id", lookups.reacts(message, [3, 5, 8]).alias("reacts"), lookups.first_match(uploads, [lambda u: u == wanted]).alias("picked"), t.present(F.col("text")).alias("kept")).filter("reacts OR kept IS NOT NULL")


def chosen_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by name and code, the preferred one of several, and the first audio stream of a probe."""
    names = {"english": "en", "deu": "de", "french": "fr"}
    k = F.col("p_partkey")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    requested = pick(("EN", "deu", "French-CA", "pt-BR", "xyz"), k)
    codes = F.when(k % 3 == 0, F.array(F.lit("fr"), F.lit("de-AT"), F.lit("EN"))).when(k % 3 == 1, F.array(F.lit("pt"), F.lit("es"))).otherwise(F.array(F.lit("es"), F.lit("DEU")))
    probe = F.concat(F.lit('{"streams":[{"index":0,"codec_type":"video"},{"index":1,"codec_type":"'), F.when(k % 4 == 0, "data").otherwise("audio"), F.lit('","codec_name":"aac","sample_rate":"'), F.col("p_size") * 1000, F.lit('","channels":2,"bit_rate":"N/A"}]}'))
    a = lookups.audio_format(probe)
    return table(spark, sf_dir, "part").select("p_partkey", lookups.language_code(requested, names).alias("code"), lookups.preferred_language(codes, requested, names).alias("preferred"), a["sample_rate"].alias("sample_rate"), a["bit_rate"].alias("bit_rate"), a["codec_name"].alias("codec"))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation up to its third, numbered; conversations without a third are left aside."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("title"))
    long = turns.groupBy("conv_id").agg(F.max("turn").alias("top")).filter("top >= 2").select("conv_id")
    return lookups.listed_before(turns.join(long, "conv_id", "left_semi"), ["conv_id"], ["turn"], F.col("turn") == 2)


def galleries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses out of rows of a gallery's JSON."""
    rows = F.concat(F.lit('[["2","folder"],["3","'), F.col("url"), F.lit('","x"],["6","meta"],["3","second"]]'))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(lookups.gallery_urls(rows), " ").alias("urls"))


def found_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of two catalogues' entries whose slug or title is a name."""
    one = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ordinal"), F.lower("n_name").alias("slug"), F.col("n_name").alias("title"))
    two = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("ordinal"), F.lower("r_name").alias("slug"), F.col("r_name").alias("title"))
    return lookups.found_by_name([one, two], "asia").unionByName(lookups.found_by_name([one, two], "FRANCE"))


def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sentences, days' openings as segments of the same kind."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("speaker_id"), F.col("event_id").alias("ordinal"), F.col("event_id").cast("double").alias("start_s"))
    sentences = events.withColumn("finish_s", F.col("start_s") + F.col("event_id") % 7)
    segments = events.filter("event_id % 4 = 0").withColumn("finish_s", F.col("start_s") + F.col("event_id") % 5)
    return lookups.by_speaker(sentences, segments, ["user_id"])


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the language that a manifest has for the digest of their text."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(t.norm_ws(F.col("text")), 256).alias("digest"))
    manifest = turns.select("digest").distinct().withColumn("language", F.when(F.col("digest") < "8", "sa").otherwise("bn"))
    return lookups.classified(turns, manifest, "digest", "language")


def cached_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines against altered copies as their translations; those that pass the plain checks."""
    source = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("source"))
    k = F.col("key") % 7
    target = F.when(k == 0, F.replace("source", F.lit("\n"), F.lit(" "))).when(k == 1, F.concat("source", F.lit("&amp;nbsp;"))).when(k == 2, F.concat("source", F.lit(" Жи"))).when(k == 3, F.concat("source", F.lit(" definition of it"))).otherwise(F.concat("source", F.lit(" fine")))
    cache = source.withColumn("target", target).filter("key % 10 <> 9").select("key", "target")

    def valid(a, b):
        return validation.breaks_kept(a, b) & validation.no_new(a, b, r"(?i)&amp;(?=#\d+|#x[\da-f]+|[a-z]\w+)") & validation.no_new_script(a, b) & validation.invalid_phrase(b, [r"\bdefinition of\b"]).isNull()

    return lookups.validated_cache(source, cache, "key", valid).select("key", F.md5("target").alias("digest"))


def reference_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of analyses written and read again, and the parts that need no rounding."""
    n = F.col("l_quantity").cast("int")
    log = F.concat(F.lit("x Peak level dB: -99.0\n Peak level dB: -"), n, F.lit(".25\nRMS level dB: -inf\nEntropy: 0."), n, F.lit("\nZero crossings rate: 0.05\nBit depth: 16/16\nBit depth: "), n, F.lit("/32 Summary: I: -1 Summary:\n I:         -"), n, F.lit(".5 LUFS\n LRA:   3.5 LU\n Peak: -1.5 dBFS silence_duration: 1.5 silence_duration: "), n)
    frames = F.concat(F.lit("lavfi.astats.Overall.RMS_level=-inf lavfi.astats.Overall.RMS_level=-"), n, F.lit(".5 lavfi.astats.Overall.RMS_level=-12 lavfi.astats.Overall.RMS_level=-50"))
    signal, loud, frame = quality.logged_signal(log), quality.logged_loudness(log), quality.frame_signal(quality.frame_levels(frames))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", signal["peak_db"].alias("peak"), signal["rms_db"].alias("rms"), signal["entropy"].alias("entropy"), signal["bit_depth"].alias("depth"), loud["integrated_lufs"].alias("lufs"),
        quality.logged_silence(log).alias("silence"), frame["estimated_noise_floor_db"].alias("floor_db"), frame["estimated_snr_db"].alias("snr"), frame["leading_rms_db"].alias("leading"),
    )


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10, F64: heading rules on lines of documents, and the geometry of alignment."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).filter(F.trim("text") != "")
    x = (F.length("text") * 7 % 60 * 10).cast("double")
    edge = x + F.length("text") % 45 * 10
    rules = lines.select(
        "doc_id", documents.heading_like(F.col("text")).alias("line_rule"), documents.heading_like(F.col("text"), short_needs_capital=False).alias("paragraph_rule"), documents.heading_line(F.col("text")).alias("text_rule"),
        documents.alignment(x, edge, F.lit(600.0)).alias("alignment"), documents.quantised((F.length("text") % 29 - 1) / F.lit(4.0)).alias("size"),
    )
    count = lambda c: F.count_if(F.col(c))
    return rules.groupBy("doc_id").agg(count("line_rule").alias("line_rule"), count("paragraph_rule").alias("paragraph_rule"), count("text_rule").alias("text_rule"), F.count_if(F.col("alignment") == "center").alias("centred"), F.count_if(F.col("alignment") == "right").alias("right"), F.sum("size").alias("sizes"), F.count("size").alias("sized"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashtags out of words, and texts cut to a share of a limit."""
    words = F.array(F.concat(F.lit("#"), F.col("c_mktsegment")), F.concat_ws(" ", F.lit("my"), F.col("c_mktsegment")), F.lit("three words here"), F.lit("!!"), F.concat(F.col("c_mktsegment"), F.lit("!")))
    return table(spark, sf_dir, "customer").select("c_custkey", captions.hashtags(words).alias("tags"), captions.shortened(F.repeat(F.col("c_name"), 3), 60, 50).alias("cut"))


def covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of an order as images of a page."""
    images = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("ordinal"), F.col("l_quantity").cast("double").alias("width"), (F.col("l_partkey") % 40).cast("double").alias("height"), F.lit(50.0).alias("page_width"), F.lit(40.0).alias("page_height"))
    return lookups.cover(images, "l_orderkey").select("l_orderkey", "largest", "widest", "stacked", "is_cover")


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6: turns as changes of the lines of a status: the last state of each, in order of appearance, without those that are gone."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("line_id"), F.concat_ws(" ", "role", "turn").alias("line"))
    return lookups.status_lines(turns, ["conv_id"], "turn", "line", F.col("turn") % 5 == 4)


def ordered_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of a recording in their order, numbered by recording."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, "removed").when(F.col("turn") % 3 == 1, "added").otherwise("text").alias("kind"), F.when(F.col("turn") % 3 != 1, F.col("turn")).alias("before_idx"), F.when(F.col("turn") % 3 != 0, F.col("turn") / 2).alias("after_idx"))
    w = Window.partitionBy("conv_id").orderBy(*lookups.detail_order(("text", "added", "removed")), "turn")  # one recording's details
    return rows.select("conv_id", "turn", F.row_number().over(w).alias("place"))


def numbered_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: parts by name, turned round and numbered."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"))
    return lookups.user_order(parts, "title", "p_partkey", sort=True, reverse=True, number=True).select("p_partkey", "title", F.col("position").cast("long").alias("position"))


def worst_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten items of each flag that are farthest from natural speed, items of the fourth line."""
    clips = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.pow(F.lit(2.0), F.col("l_linenumber") - 4).alias("speed"))
    return aggregates.worst(clips, ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).select("l_returnflag", "place", "index", "deviation", "l_orderkey", "l_linenumber")


def valid_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: of the first parts of each brand by size, the first of an even number, with how many were refused."""
    w = Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")  # the parts of a brand, ranked
    ranked = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", F.row_number().over(w).alias("rank"))
    return lookups.first_valid(ranked, ["p_brand"], "rank", F.col("p_partkey") % 4 == 0)


def resumed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8: documents that a manifest of events leaves to be done: none, not done at last, or done on another length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("digest"))
    events = table(spark, sf_dir, "events").select((F.col("event_id") % 150).alias("doc_id"), "event_id", "event_type")
    manifest = events.join(docs, "doc_id").select("doc_id", "event_id", "event_type", F.when(F.col("event_id") % 3 == 0, F.col("digest") + 1).otherwise(F.col("digest")).alias("digest"))
    return lookups.resumed(docs, manifest, "doc_id", "event_id", "digest", F.col("event_type") != "error")


def compacted_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6, Q8: the last event of every user who is still a customer."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return lookups.compacted(events, table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("user_id")), "user_id", "event_id")


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3: one slot a user; errors are stop commands and bypass it."""
    service = (F.col("value").cast("decimal(18,2)") * 60_000_000).cast("long")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("arrival"), service.alias("service"))
    return state.slots_with_bypass(events, ["user_id"], ["arrival", "event_id"], "arrival", "service", F.col("event_type") == "error").drop("event_type")


def cleaned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options, fences, titles and names cleaned, prompts and styles put together."""
    name, k = F.col("p_name"), F.col("p_partkey")
    fields = {"title": name, "author": F.when(k % 2 == 0, "  ").otherwise(F.col("p_brand")), "page_count": F.col("p_size"), "source_name": F.col("p_type")}
    title = F.when(k % 3 == 0, F.concat(F.lit('{"title": "'), name, F.lit('"}'))).when(k % 3 == 1, F.concat(F.lit('["'), name, F.lit('", "x"]'))).otherwise(F.concat(F.lit(' "'), name, F.lit('" ')))
    return table(spark, sf_dir, "part").select(
        "p_partkey", t.voice_option(F.concat(F.lit("medium-pitch, british-accent,, "), F.replace(name, F.lit(" "), F.lit("_")))).alias("voice"), t.unfenced(F.concat(F.lit("```JSON\n"), name, F.lit("\n``` "))).alias("unfenced"), t.short_title(title).alias("title"),
        t.translated_name(name, F.when(k % 2 == 0, F.lit(" / ")).otherwise(F.concat(F.col("p_brand"), F.lit("/x")))).alias("file"), t.publication_input(fields, F.lit("s"), F.when(k % 5 == 0, name)).alias("prompt"),
        t.css_rules(F.col("p_size") / F.lit(4.0), F.when(k % 2 == 0, "center"), k % 3 == 0, F.lit(False), F.lit(None).cast("string")).alias("css"), t.style_json(size=F.col("p_size"), alignment=F.when(k % 2 == 0, "center")).alias("style"),
    )


def nested_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a turn moved and stretched, those that end too late left out."""
    words = F.transform(F.slice(F.split("text", " "), 1, 40), lambda w, i: F.struct(F.length(w).alias("n"), i.cast("double").alias("start_s"), (i + 1).cast("double").alias("finish_s")))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("words"))
    moved = cues.retimed(F.col("words"), F.lit(0.0), F.lit(40.0), F.lit(5.0), F.lit(25.0))
    kept = F.filter(moved, lambda w: w["finish_s"] <= 15)
    return turns.select("conv_id", "turn", F.size(kept).alias("n"), F.aggregate(kept, F.lit(0.0), lambda s, w: s + w["start_s"]).alias("starts"), F.aggregate(kept, F.lit(0), lambda s, w: s + w["n"]).alias("letters"))


SQL = {
    "durations": r"""
WITH t AS (SELECT p_partkey, p_size AS n, p_partkey AS k, p_partkey % 9 AS f FROM part),
x AS (SELECT *, CASE f WHEN 0 THEN n || ':' || k % 75 WHEN 1 THEN n || '::' || k % 60 WHEN 2 THEN n || 'H' || k % 90 || 'm' WHEN 3 THEN k % 90 || 's' || n || 'm' WHEN 4 THEN ' ' || n || '.5h ' WHEN 5 THEN n || ':' WHEN 6 THEN n || ':' || k % 80 || ':00.25' WHEN 7 THEN n || '.1234' ELSE ':' END AS text FROM t)
SELECT p_partkey, text, CASE f WHEN 0 THEN CASE WHEN k % 75 < 60 THEN n * 60.0::DOUBLE + k % 75 END WHEN 1 THEN n * 3600.0::DOUBLE + k % 60 WHEN 2 THEN n * 3600.0::DOUBLE + k % 90 * 60 WHEN 3 THEN k % 90 + n * 60.0::DOUBLE
  WHEN 4 THEN (n + 0.5::DOUBLE) * 3600 WHEN 5 THEN n * 60.0::DOUBLE WHEN 6 THEN CASE WHEN k % 80 < 60 THEN n * 3600.0::DOUBLE + k % 80 * 60 + 0.25::DOUBLE END END AS seconds FROM x""",
    "limits": """
WITH t AS (SELECT l_orderkey, l_linenumber, (l_partkey % 9000 + 1)::DOUBLE AS seconds, CASE l_suppkey % 4 WHEN 0 THEN 50.0::DOUBLE WHEN 1 THEN 60.0::DOUBLE WHEN 2 THEN 2000.0::DOUBLE END AS limit_mb, ['mp4', 'hevc', 'webm', NULL, 'nothing'][l_linenumber % 5 + 1] AS wanted FROM lineitem),
m AS (SELECT *, ceil(seconds / 60) AS minutes, ceil(limit_mb * 20 / 50) AS threshold FROM t),
f AS (SELECT *, ceil((minutes - threshold) / 8.0::DOUBLE) AS falls, minutes > threshold AS over FROM m),
w AS (SELECT *, CASE WHEN over THEN CAST(greatest(1920 - 80 * falls, 640) AS INTEGER) ELSE 1920 END AS w0, CASE WHEN over THEN CAST(greatest(96 - 8 * falls, 48) AS INTEGER) ELSE 96 END AS rate FROM f),
v AS (SELECT *, floor(limit_mb - seconds * rate / 8 / 1000) AS video FROM w)
SELECT l_orderkey, l_linenumber, seconds, limit_mb, CAST(w0 - w0 % 2 AS INTEGER) AS width, CAST(rate AS INTEGER) AS rate, CASE WHEN limit_mb IS NOT NULL THEN CAST(least(floor(8 * (0.99::DOUBLE * video * 1000) / seconds), 50000) AS INTEGER) END AS maxrate, CAST(video AS INTEGER) AS buffer_mb,
  CASE WHEN limit_mb IS NULL OR limit_mb > 500 THEN 1920 WHEN limit_mb > 50 THEN 1080 ELSE 720 END AS default_width, 1000 * limit_mb / 12 / 60.0::DOUBLE AS audio_minutes,
  CASE wanted WHEN 'mp4' THEN 'h264' WHEN 'hevc' THEN 'h265' WHEN 'webm' THEN 'vp9' ELSE CASE WHEN seconds >= 600 THEN 'h265' ELSE 'h264' END END AS format FROM v""",
    "encodings": """
WITH t AS (SELECT p_partkey, p_partkey AS k, p_size AS n, ['mp3', 'opus', 'aac', 'pcm_s16le', 'flac', '', 'vorbis'][p_partkey % 7 + 1] AS codec, p_size % 3 AS p FROM part),
e AS (SELECT *, CASE codec WHEN 'mp3' THEN 'libmp3lame' WHEN 'opus' THEN 'libopus' WHEN 'vorbis' THEN 'libvorbis' WHEN 'aac' THEN CASE WHEN p = 0 THEN 'aac' END WHEN '' THEN NULL ELSE codec END AS encoder FROM t)
SELECT p_partkey, CASE WHEN k % 17 = 0 THEN 18.0 WHEN k % 19 = 0 THEN NULL ELSE CASE k % 6 WHEN 1 THEN n * 0.75 WHEN 2 THEN n * 12.0 WHEN 3 THEN n * 12 / 100.0 WHEN 4 THEN n * 12.0 ELSE n END END::DOUBLE AS points,
  encoder, CASE WHEN codec = 'aac' AND p = 0 THEN 'aac_low' END AS profile, CASE WHEN encoder IS NOT NULL AND n > 10 AND codec NOT IN ('pcm_s16le', 'flac') THEN n - 10 END AS bit_rate, CASE WHEN codec = 'pcm_s16le' AND k % 2 = 0 THEN 's16' END AS sample_format FROM e""",
    "addresses": """
WITH t AS (SELECT *, l_partkey * 7 + l_suppkey AS k FROM lineitem),
o AS (SELECT *, [10, 100, 127, 169, 172, 192, 198, 203, 224, 8, 0, 255, 300][k % 13 + 1] AS a, CASE k % 3 WHEN 0 THEN 168 WHEN 1 THEN 64 ELSE k % 256 END AS b, k % 5 AS c FROM t)
SELECT l_orderkey, l_linenumber, a || '.' || b || '.' || c || '.' || l_linenumber AS ip,
  NOT (a IN (0, 10, 127, 300) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND (b = 168 OR b = 0 AND c IN (0, 2))) OR (a = 198 AND (b IN (18, 19) OR b = 51 AND c = 100)) OR (a = 203 AND b = 0 AND c = 113)) AS public,
  k % 5 <> 0 AND k % 7 <> 1 AS is_address, 'user_' || l_suppkey AS username, l_partkey::BIGINT * 1048576 AS message_id FROM o""",
    "spans": """
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, (l_partkey % 50)::DOUBLE AS a0, (l_partkey % 50)::DOUBLE + l_quantity::DOUBLE AS a1 FROM lineitem),
n AS (SELECT *, lead(a0) OVER w AS b0, lead(a1) OVER w AS b1 FROM t WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)),
o AS (SELECT *, greatest(0.0::DOUBLE, least(a1, b1) - greatest(a0, b0)) AS overlap FROM n WHERE b0 IS NOT NULL)
SELECT l_orderkey, l_linenumber, overlap, CASE WHEN (a1 - a0) + (b1 - b0) - overlap > 0 THEN overlap / ((a1 - a0) + (b1 - b0) - overlap) ELSE 0.0 END AS iou, greatest(0.0::DOUBLE, b0 - a1, a0 - b1) AS gap, abs(a0 - b0) > 5 + 1e-9 AS beyond FROM o""",
    "means": """
SELECT l_suppkey, min(l_orderkey * 8 + l_linenumber) AS first, count(*) AS rows, count(*) FILTER (l_quantity > 25) AS passed, count(*) AS total, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity::BIGINT ELSE 0 END)::DOUBLE / sum(l_quantity::BIGINT)::DOUBLE AS rtf,
  coalesce(avg(l_quantity::DOUBLE) FILTER (l_quantity > 49 AND l_returnflag = 'R'), 0) AS mean_or_zero, avg(l_quantity::DOUBLE) FILTER (l_quantity > 49 AND l_returnflag = 'R') AS mean_or_null, coalesce(sqrt(avg(l_quantity::DOUBLE * l_quantity::DOUBLE) FILTER (l_quantity > 49 AND l_returnflag = 'R')), 0) AS rms
FROM lineitem GROUP BY l_suppkey""",
    "gate": r"""
WITH m AS (SELECT event_id, user_id, CASE event_id % 5 WHEN 0 THEN '/' || event_type WHEN 1 THEN '  ' ELSE event_type END AS text FROM events),
g AS (SELECT event_id, event_id % 11 <> 0 AND (regexp_matches(text, '\S') OR event_id % 3 = 0) AND user_id NOT IN (3, 5, 8) AND (user_id % 2 <> 0 OR starts_with(text, '/')) AS reacts,
  CASE event_id % 3 WHEN 0 THEN 'audio' WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN 'video' ELSE 'document' END ELSE 'video' END AS picked, nullif(trim(text), '') AS kept FROM m)
SELECT * FROM g WHERE reacts OR kept IS NOT NULL""",
    "chosen_streams": """
SELECT p_partkey, ['en', 'de', 'fr', 'pt', NULL][p_partkey % 5 + 1] AS code,
  CASE p_partkey % 3 WHEN 0 THEN ['EN', 'de-AT', 'fr', 'EN', 'EN'][p_partkey % 5 + 1] WHEN 1 THEN 'pt' ELSE ['es', 'DEU', 'es', 'es', 'es'][p_partkey % 5 + 1] END AS preferred,
  CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size * 1000 AS INTEGER) END AS sample_rate, CAST(NULL AS INTEGER) AS bit_rate, CASE WHEN p_partkey % 4 <> 0 THEN 'aac' END AS codec FROM part""",
    "listings": """
WITH n AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number, max(turn) OVER (PARTITION BY conv_id) AS top FROM conversations)
SELECT conv_id, turn, '0' || number || ' ' || role AS title, CAST(number AS INTEGER) AS number FROM n WHERE top >= 2 AND turn < 2""",
    "galleries": "SELECT page_id, url || ' second' AS urls FROM pages",
    "found_names": "SELECT r_regionkey AS ordinal, lower(r_name) AS slug, r_name AS title, 1 AS list FROM region WHERE r_name = 'ASIA' UNION ALL SELECT n_nationkey, lower(n_name), n_name, 0 FROM nation WHERE n_name = 'FRANCE'",
    "speakers": """
WITH s AS (SELECT user_id, event_type AS speaker_id, min(event_id) AS first, count(*) AS sentences, sum((event_id % 7)::DOUBLE) AS spoken_s, count(*) FILTER (event_id % 4 = 0) AS segments, coalesce(sum((event_id % 5)::DOUBLE) FILTER (event_id % 4 = 0), 0) AS segment_s FROM events GROUP BY 1, 2)
SELECT * FROM s""",
    "classes": r"""SELECT conv_id, turn, digest, CASE WHEN digest < '8' THEN 'sa' ELSE 'bn' END AS language FROM (SELECT conv_id, turn, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM conversations)""",
    "cached_units": r"""
WITH t AS (SELECT doc_id AS key, text AS source, CASE doc_id % 7 WHEN 0 THEN replace(text, chr(10), ' ') WHEN 1 THEN text || '&amp;nbsp;' WHEN 2 THEN text || ' Жи' WHEN 3 THEN text || ' definition of it' ELSE text || ' fine' END AS target FROM documents WHERE doc_id % 10 <> 9)
SELECT key, md5(target) AS digest FROM t WHERE key % 7 NOT IN (1, 2, 3) AND (key % 7 <> 0 OR source NOT LIKE '%' || chr(10) || '%')""",
    "reference_scores": """
WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, -(n + 0.25::DOUBLE) AS peak, 0.0::DOUBLE AS rms, CAST('0.' || n AS DOUBLE) AS entropy, n AS depth, -(n + 0.5::DOUBLE) AS lufs, 1.5::DOUBLE + n AS silence,
  least(-12.0::DOUBLE, -(n + 0.5::DOUBLE)) AS floor_db, abs(-12.0::DOUBLE + n + 0.5::DOUBLE) AS snr, -120.0::DOUBLE AS leading FROM t""",
    "headings": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents), c AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w, length(text) AS n FROM l WHERE trim(text) <> ''),
r AS (SELECT *, regexp_matches(text, '\p{L}') AND len(w) BETWEEN 1 AND 10 AS base, NOT regexp_matches(text, '(?m)[.!?]$') AS open_end, len(list_filter(w, lambda x: x = upper(x) AND length(x) > 1)) > len(w) * 0.6::DOUBLE AS shouted, len(list_filter(w, lambda x: NOT regexp_matches(x, '^[A-Z]'))) = 0 AS capital,
  (n * 7 % 60 * 10)::DOUBLE AS x, (n * 7 % 60 * 10)::DOUBLE + n % 45 * 10 AS x2, (n % 29 - 1) / 4.0::DOUBLE AS size FROM c),
g AS (SELECT *, CASE WHEN x2 <= x THEN x ELSE x2 END AS edge FROM r),
a AS (SELECT *, abs((x + edge) / 2 - 300) <= 600 * 0.08::DOUBLE AND x > 600 * 0.18::DOUBLE AND 600 - edge > 600 * 0.18::DOUBLE AND edge - x <= 600 * 0.55::DOUBLE AS centre FROM g)
SELECT doc_id, count(*) FILTER (base AND ((len(w) <= 3 AND open_end AND regexp_matches(text, '^\s*\p{Lu}')) OR shouted OR (capital AND open_end))) AS line_rule, count(*) FILTER (base AND ((len(w) <= 3 AND open_end) OR shouted OR (capital AND open_end))) AS paragraph_rule,
  count(*) FILTER (len(w) BETWEEN 1 AND 10 AND (len(list_filter(w, lambda x: x = upper(x))) > len(w) * 0.8::DOUBLE OR len(list_filter(w, lambda x: NOT regexp_matches(x, '^[A-Z][a-z]+$'))) = 0)) AS text_rule,
  count(*) FILTER (centre) AS centred, count(*) FILTER (NOT centre AND 600 - edge + 2 < x * 0.5::DOUBLE AND x > 150) AS right, sum(CASE WHEN size > 0 THEN floor(size * 2 + 0.5::DOUBLE) / 2 END) AS sizes, count(*) FILTER (size > 0) AS sized FROM a GROUP BY doc_id""",
    "tags": """SELECT c_custkey, '#' || upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || ' #My' || upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS tags, left(c_name || c_name || c_name, 30) AS cut FROM customer""",
    "covers": """
WITH i AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS w, (l_partkey % 40)::DOUBLE AS h FROM lineitem), s AS (SELECT *, w * h / 2000.0::DOUBLE AS share FROM i)
SELECT l_orderkey, arg_max(l_linenumber, {'s': share, 'o': -l_linenumber}) AS largest, max(w) AS widest, sum(h) / 40 AS stacked, max(share) >= 0.5::DOUBLE OR (sum(share) >= 0.5::DOUBLE AND sum(h) / 40 >= 0.5::DOUBLE) AS is_cover FROM s GROUP BY l_orderkey""",
    "statuses": """
WITH s AS (SELECT conv_id, role, min(turn) AS first, max(turn) AS last FROM conversations GROUP BY conv_id, role)
SELECT conv_id, string_agg(role || ' ' || last, chr(10) ORDER BY first, role || ' ' || last) AS status FROM s WHERE last % 5 <> 4 GROUP BY conv_id""",
    "ordered_details": """
WITH r AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS k, CASE WHEN turn % 3 <> 1 THEN turn::DOUBLE ELSE 'infinity'::DOUBLE END AS b, CASE WHEN turn % 3 <> 0 THEN turn / 2.0::DOUBLE ELSE 'infinity'::DOUBLE END AS a FROM conversations)
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY least(a, b), k, b, a, turn) AS INTEGER) AS place FROM r""",
    "numbered_titles": """
WITH n AS (SELECT p_partkey, p_name, count(*) OVER () + 1 - row_number() OVER (ORDER BY p_name, p_partkey) AS position FROM part)
SELECT p_partkey, CASE WHEN position < 10 THEN '0' ELSE '' END || position || ' ' || p_name AS title, position FROM n""",
    "worst_clips": """
WITH c AS (SELECT l_returnflag, l_orderkey, l_linenumber, abs(l_linenumber - 4) * 100.0::DOUBLE AS deviation, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS index FROM lineitem)
SELECT l_returnflag, CAST(place AS INTEGER) AS place, index, deviation, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY deviation DESC, index) AS place FROM c) WHERE place <= 10""",
    "valid_candidates": """
WITH r AS (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS rank FROM part), b AS (SELECT p_brand, min(rank) AS rank FROM r WHERE rank <= 20 AND p_partkey % 4 = 0 GROUP BY p_brand)
SELECT p_brand, p_partkey, p_size, CAST(rank AS INTEGER) AS rank, CAST(rank - 1 AS INTEGER) AS refused FROM r JOIN b USING (p_brand, rank)""",
    "resumed_entries": """
WITH m AS (SELECT event_id % 150 AS doc_id, event_id, event_type, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS off FROM events), l AS (SELECT doc_id, arg_max(event_type, event_id) AS kind, arg_max(off, event_id) AS off FROM m GROUP BY doc_id)
SELECT d.doc_id, n_chars AS digest FROM documents d LEFT JOIN l USING (doc_id) WHERE l.kind IS NULL OR l.kind = 'error' OR l.off = 1""",
    "compacted_cache": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events WHERE user_id IN (SELECT c_custkey * 2 FROM customer) GROUP BY user_id",
    "slots": """
WITH e AS (SELECT event_id, user_id, event_type = 'error' AS free, epoch_us(ts) AS arrival, CAST(CAST(value AS DECIMAL(18,2)) * 60000000 AS BIGINT) AS service FROM events),
s AS (SELECT *, CAST(sum(service) OVER (PARTITION BY user_id ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM e WHERE NOT free),
f AS (SELECT event_id, user_id, arrival, service, max(arrival - (total - service)) OVER (PARTITION BY user_id ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING) + total AS finish_at FROM s UNION ALL SELECT event_id, user_id, arrival, service, arrival + service FROM e WHERE free)
SELECT *, finish_at - service AS start_at FROM f""",
    "cleaned_names": r"""
SELECT p_partkey, 'moderate pitch, british accent, ' || p_name AS voice, p_name AS unfenced, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand || ' x' END AS file,
  'Filename: ' || CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE p_type END || chr(10) || chr(10) || 'Metadata:' || chr(10) || 'title: ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ', author: ' || p_brand END || ', page_count: ' || p_size || chr(10) || chr(10) || 'Sample pages:' || chr(10) || 's' AS prompt,
  'font-size: ' || regexp_replace(CAST(round(p_size / 4.0::DOUBLE, 1) AS VARCHAR), '\.0$', '') || 'pt' || CASE WHEN p_partkey % 2 = 0 THEN '; text-align: center' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN '; font-weight: bold' ELSE '' END AS css,
  '{"size":' || p_size || CASE WHEN p_partkey % 2 = 0 THEN ',"alignment":"center"}' ELSE '}' END AS style FROM part""",
    "nested_words": """
WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations), k AS (SELECT *, least(len(w), 40, 20) AS n FROM w)
SELECT conv_id, turn, CAST(n AS INTEGER) AS n, list_sum(list_transform(range(0, n), lambda i: 5 + i * 0.5::DOUBLE))::DOUBLE AS starts, CAST(list_sum(list_transform(w[1:n], lambda x: length(x))) AS INTEGER) AS letters FROM k""",
}

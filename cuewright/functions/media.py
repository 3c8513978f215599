"""Decision tables and expressions of media processing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats of sources by extension, and kinds of documents by MIME type; json and html are formats, but no documents.
FORMAT_BY_EXTENSION = {"yml": "yaml", "yaml": "yaml", "json": "json", "pdf": "pdf", "epub": "epub", "html": "html", "htm": "html", "txt": "txt"}
DOCUMENTS = ("yaml", "pdf", "epub", "txt")
KIND_BY_MIME = {"application/x-yaml": "yaml", "application/pdf": "pdf", "application/epub+zip": "epub", "text/plain": "txt"}


def format_of(name: Column) -> Column:
    """The format of a source by the extension of its path."""
    extension = F.lower(F.regexp_extract(name, r"[^/.][^/]*\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for kind, value in FORMAT_BY_EXTENSION.items():
        out = F.when(extension == kind, value).otherwise(out)
    return out


def document_kind(name: Column, mime: Column) -> Column:
    """By the extension of the name if that is a document's, else by MIME type; plain text only counts where there is no name."""
    unnamed = F.coalesce(name, F.lit("")) == ""
    by_mime = F.lit(None).cast("string")
    for kind, value in KIND_BY_MIME.items():
        match = F.coalesce(mime, F.lit("")) == kind
        by_mime = F.when(match & unnamed if value == "txt" else match, value).otherwise(by_mime)
    by_name = format_of(name)
    return F.when(by_name.isin(*DOCUMENTS), by_name).otherwise(by_mime)


def send_type(mime: Column, declared: Column | None = None) -> Column:
    """How a file is sent: by MIME type, else as declared, else as a document."""
    mime = F.coalesce(mime, F.lit(""))
    rest = F.when(declared.isin("audio", "photo", "video", "document"), declared).otherwise("document") if declared is not None else F.lit("document")
    return F.when(mime.startswith("audio/"), "audio").when(mime.startswith("image/"), "photo").when(mime.startswith("video/"), "video").otherwise(rest)


def album_item(mime: Column, declared: Column | None = None) -> Column:
    """Whether a file can go into an album."""
    return send_type(mime, declared).isin("photo", "video")


def tempo_chain(factor: Column) -> Column:
    """factors of at most 2 whose product is a tempo; none for the natural one."""
    halves = F.greatest(F.lit(0), F.ceil(F.log2(factor) - 1e-12).cast("int") - 1)
    rest = factor / F.pow(F.lit(2.0), halves)
    return F.concat(F.array_repeat(F.lit(2.0), halves), F.when(rest == 1.0, F.array().cast("array<double>")).otherwise(F.array(rest)))


def tempo_filter(factor: Column) -> Column:
    """the chain as filters, six digits each."""
    return F.array_join(F.transform(tempo_chain(factor), lambda x: F.concat(F.lit("atempo="), F.format_string("%.6f", x))), ",")


def cut_expression(ranges: Column, variable: str = "t") -> Column:
    """an expression that is true inside the ranges."""
    return F.array_join(F.transform(ranges, lambda r: F.concat(F.lit(f"between({variable},"), r["start"].cast("string"), F.lit(","), r["finish"].cast("string"), F.lit(")"))), "+")


def cut_total(ranges: Column, media: Column) -> Column:
    """Seconds that ranges cut; ranges beyond the media, or all of it, are an error."""
    total = F.aggregate(ranges, F.lit(0.0), lambda s, r: s + r["finish"] - r["start"])
    last = F.array_max(F.transform(ranges, lambda r: r["finish"]))
    return F.when((last <= media) & (total < media), total).otherwise(F.raise_error(F.lit("ranges do not fit the media")).cast("double"))


def fragments_length(formats: Column) -> Column:
    """The longest of the formats, each the sum of its fragments; null if there are none."""
    sums = F.transform(formats, lambda f: F.aggregate(f, F.lit(0.0), lambda s, x: s + x))
    return F.array_max(sums)


def first_supported(context: Column, sources: list[tuple[str, str]], fallback: str) -> Column:
    """The first source whose pattern matches."""
    out = F.lit(fallback)
    for name, pattern in reversed(sources):
        out = F.when(context.rlike(pattern), name).otherwise(out)
    return out


# Steps by which width and audio rate fall, and the highest video rate in kbit/s.
WIDTH_STEP, RATE_STEP, STEP_MINUTES, HIGHEST_MAXRATE = 80, 8, 8, 50_000


def audio_minutes(rate_kbit: Column, limit_mb: Column) -> Column:
    """minutes of audio at a rate that fit a size."""
    return 1000 * limit_mb / F.floor(rate_kbit / 8) / F.lit(60.0)


def video_threshold(limit_mb: Column) -> Column:
    """minutes of video from which quality falls: 20 for 50 MB, rounded up."""
    return F.ceil(limit_mb * F.lit(20.0) / 50)


def limited(seconds: Column, limit_mb: Column, width: int, rate: int, percent: float = 0.99, steps: tuple[int, int, int] = (WIDTH_STEP, RATE_STEP, STEP_MINUTES), highest: int = HIGHEST_MAXRATE) -> Column:
    """width, audio rate, maximal video rate (kbit/s) and buffer (MB) for a length and a size limit.

    Beyond the threshold both width and audio rate fall by a step for every begun interval, the width to a third and
    the rate to a half at least; an odd width is made even. No limit, or no length, leaves width and rate alone.
    """
    width_step, rate_step, minutes_step = steps
    minutes, threshold = F.ceil(seconds / 60), video_threshold(limit_mb)
    falls = F.ceil((minutes - threshold) / F.lit(float(minutes_step)))
    narrow = F.greatest(F.lit(width) - width_step * falls, F.lit(width // 3))
    lower = F.greatest(F.lit(rate) - rate_step * falls, F.lit(rate // 2))
    over = minutes > threshold
    new_width = F.when(over, narrow - narrow % 2).otherwise(F.lit(width)).cast("int")
    new_rate = F.when(over, lower).otherwise(F.lit(rate)).cast("int")
    video = F.floor(limit_mb - seconds * new_rate / 8 / 1000)
    maxrate = F.least(F.floor(8 * (F.lit(percent) * video * 1000) / seconds), F.lit(highest)).cast("int")
    some = limit_mb.isNotNull() & (seconds > 0)
    return F.struct(F.when(some, new_width).otherwise(width).alias("width"), F.when(some, new_rate).otherwise(rate).alias("rate"), F.when(some, maxrate).alias("maxrate"), F.when(some, video.cast("int")).alias("buffer_mb"))


def default_width(limit_mb: Column) -> Column:
    """1920 without a limit or beyond 500 MB, 1080 beyond 50 MB, else 720."""
    return F.when(limit_mb.isNull() | (limit_mb > 500), 1920).when(limit_mb > 50, 1080).otherwise(720)


# Other names of formats.
FORMAT_NAMES = {"video": {"mp4": "h264", "x264": "h264", "h.264": "h264", "hevc": "h265", "x265": "h265", "h.265": "h265", "webm": "vp9"}, "audio": {"m4a": "aac", "ogg": "opus"}}


def chosen_format(kind: str, known: tuple[str, ...], default: str, wanted: Column, seconds: Column, limited_size: bool = False, long_default: str | None = None) -> Column:
    """the wanted format under its usual name, else the default (another for ten minutes or more, if there is one). An unknown one
    gives way to the default; with a size limit, short audio goes as aac instead of opus."""
    usual = F.when(seconds >= 600, long_default).otherwise(default) if long_default else F.lit(default)
    out = wanted
    for name, value in FORMAT_NAMES.get(kind, {}).items():
        out = F.when(wanted == name, value).otherwise(out)
    out = F.coalesce(out, usual)
    if limited_size:
        out = F.when((out == "opus") & (seconds <= 122), "aac").otherwise(out)
    return F.when(out.isin(*known), out).otherwise(usual)


# Sizes by name, in points.
NAMED_SIZES = {"xx-small": 8.0, "x-small": 10.0, "small": 11.0, "medium": 12.0, "large": 14.0, "x-large": 18.0, "xx-large": 24.0}


def size_in_points(value: Column, base: Column) -> Column:
    """a size in points: names, pt, px (three quarters), em and rem (of the base), percent; a bare number counts as points."""
    raw = F.lower(F.btrim(value))
    number = F.nullif(F.regexp_extract(raw, r"^(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")
    out = F.when(raw.endswith("pt"), number).when(raw.endswith("px"), F.round(number * 0.75, 2)).when(raw.endswith("em"), F.round(number * base, 2)).when(raw.endswith("%"), F.round(number * base / 100.0, 2)).otherwise(number)
    for name, size in NAMED_SIZES.items():
        out = F.when(raw == name, size).otherwise(out)
    return out


def pause_encoding(codec: Column, profile: Column, bit_rate: Column, sample_format: Column, fdk: bool = False) -> Column:
    """how a pause is encoded so that it can be joined to audio of a format: encoder, profile, bit rate and sample format; all null if it can't."""
    lossless = codec.startswith("pcm_") | (codec == "flac")
    aac = F.lit("libfdk_aac") if fdk else F.when(~F.coalesce(profile, F.lit("")).rlike("(?i)HE-AAC"), "aac")
    encoder = F.when(codec == "mp3", "libmp3lame").when(codec == "opus", "libopus").when(codec == "vorbis", "libvorbis").when(codec == "aac", aac).when(codec != "", codec)
    upper = F.upper(profile)
    named = F.when(codec == "aac", F.when(upper == "LC", "aac_low").when(upper == "HE-AAC", "aac_he").when(upper == "HE-AACV2", "aac_he_v2"))
    some = encoder.isNotNull()
    return F.struct(
        encoder.alias("encoder"), F.when(some, named).alias("profile"), F.when(some & (bit_rate > 0) & ~lossless, bit_rate).alias("bit_rate"),
        F.when(some & codec.startswith("pcm_"), F.nullif(sample_format, F.lit(""))).alias("sample_format"),
    )

"""Subtitle documents: SRT and WebVTT as rows of cues, transcripts in JSON, and back."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CUE = T.StructType(
    [
        T.StructField("cue_idx", T.LongType()),
        T.StructField("cue_id", T.StringType()),
        T.StructField("start_s", T.DoubleType()),
        T.StructField("finish_s", T.DoubleType()),
        T.StructField("text", T.StringType()),
    ]
)
TIMING = re.compile(r"^\s*((?:\d+:)?[0-5]\d:[0-5]\d[.,]\d{3})\s+-->\s+((?:\d+:)?[0-5]\d:[0-5]\d[.,]\d{3})")
INLINE = re.compile(r"<((?:\d+:)?[0-5]\d:[0-5]\d[.,]\d{3})>")


def seconds(stamp: str) -> float:
    *rest, s = stamp.replace(",", ".").split(":")
    whole, fraction = s.split(".")
    minutes = 0
    for part in rest:
        minutes = minutes * 60 + int(part)
    return ((minutes * 60 + int(whole)) * 1000 + int(fraction)) / 1000.0


def stamp(value: float, mark: str = ",") -> str:
    millis = int(value * 1000 + 0.5)
    return f"{millis // 3_600_000:02d}:{millis // 60_000 % 60:02d}:{millis // 1000 % 60:02d}{mark}{millis % 1000:03d}"


def parse(document: str, vtt: bool = False) -> list[tuple[int, str | None, float, float, str]]:
    """Cues of a document. Blocks stand between blank lines; the id is the nearest line above the timing; a
    cue without text is dropped; a finish that is not after its start is an error."""
    text = document.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    if vtt and not text.startswith("WEBVTT"):
        raise ValueError("no WEBVTT header")
    out = []
    for number, block in enumerate(re.split(r"\n[ \t]*\n+", text), 1):
        lines = block.split("\n")
        at = next((i for i, line in enumerate(lines) if "-->" in line), None)
        if at is None:
            continue
        timing = TIMING.match(lines[at])
        if not timing or seconds(timing[2]) <= seconds(timing[1]):
            raise ValueError(f"bad timing: {lines[at]!r}")
        above = [x.strip() for x in lines[:at] if x.strip()]
        body = "\n".join(lines[at + 1 :]).strip()
        if body:
            out.append((len(out), above[-1] if above else str(number) if vtt else None, seconds(timing[1]), seconds(timing[2]), body))
    return out


def timed_words(text: str, start: float, finish: float) -> list[tuple[str, float, float]]:
    """Words of a cue with inline timestamps; a mark that is out of the cue or does not rise leaves none. Words between two marks share their time evenly."""
    parts = INLINE.split(text)
    marks = [start, *(seconds(x) for x in parts[1::2]), finish]
    if len(parts) == 1 or any(b < a or (0 < i < len(marks) - 2 and b <= a) for i, (a, b) in enumerate(zip(marks, marks[1:], strict=False))):
        return []
    out = []
    for chunk, a, b in zip(parts[::2], marks, marks[1:], strict=False):
        words = re.sub(r"<[^>]*>", "", chunk).split()
        for i, w in enumerate(words):
            out.append((w, a + (b - a) * i / len(words), b if i + 1 == len(words) else a + (b - a) * (i + 1) / len(words)))
    return out


def cues(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vtt: bool = False) -> DataFrame:
    """Rows of cues of whole documents; one document per row of the input, so long ones spread with their files."""
    schema = T.StructType([documents.schema[id_col], *CUE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, *cue) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for cue in parse(text or "WEBVTT" * vtt, vtt)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=pa.schema([pa.field(id_col, batch.schema.field(0).type), ("cue_idx", pa.int64()), ("cue_id", pa.string()), ("start_s", pa.float64()), ("finish_s", pa.float64()), ("text", pa.string())]))

    return documents.select(id_col, text_col).mapInArrow(run, schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Cues of the SRT and WebVTT files below a path."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
    is_vtt = F.lower("doc_id").endswith(".vtt")
    return cues(files.filter(~is_vtt)).unionByName(cues(files.filter(is_vtt), vtt=True))


def rendered(cue_rows: DataFrame, vtt: bool = False) -> DataFrame:
    """K1: one document of text per doc_id. Cues without length are dropped; a finish is at least 1 ms after its start."""
    mark = "." if vtt else ","
    from cuewright.functions.time import format_timestamp

    start = F.floor(F.col("start_s") * 1000 + 0.5) / 1000
    finish = F.greatest(F.floor(F.col("finish_s") * 1000 + 0.5) / 1000, start + 0.001)
    ordered = F.array_sort(F.collect_list(F.struct("cue_idx", F.concat(format_timestamp(start, mark), F.lit(" --> "), format_timestamp(finish, mark), F.lit("\n"), F.col("text")).alias("body"))))
    blocks = F.transform(F.col("blocks"), lambda b, i: F.concat((i + 1).cast("string"), F.lit("\n"), b["body"]))
    text = F.concat(F.lit("WEBVTT\n\n" if vtt else ""), F.array_join(blocks, "\n\n"), F.lit("\n"))
    return cue_rows.filter("finish_s > start_s").groupBy("doc_id").agg(ordered.alias("blocks")).select("doc_id", text.alias("text"))


TRANSCRIPT = "language string, text string, segments array<struct<id:int,start:double,`end`:double,text:string,speaker_id:string,cue_id:string,avg_logprob:double,words:array<string>>>"
MILLIS = "language string, text string, segments array<struct<t0_ms:bigint,t1_ms:bigint,text:string,words:array<struct<text:string,t0_ms:bigint,t1_ms:bigint,p:double>>>>"


def transcript_segments(documents: DataFrame, json_col: str = "json", millis: bool = False) -> DataFrame:
    """Segments of transcripts in JSON, in seconds; milliseconds are divided by 1000.0. A document without segments is an error."""
    parsed = documents.withColumn("_t", F.from_json(json_col, MILLIS if millis else TRANSCRIPT))
    segments = F.when(F.col("_t.segments").isNull(), F.raise_error(F.lit("no segments")).cast(parsed.select("_t.segments").schema[0].dataType)).otherwise(F.col("_t.segments"))
    rows = parsed.select("doc_id", F.posexplode(segments).alias("cue_idx", "s"))
    if millis:
        return rows.select("doc_id", "cue_idx", (F.col("s.t0_ms") / 1000.0).alias("start_s"), (F.col("s.t1_ms") / 1000.0).alias("finish_s"), "s.text", F.transform("s.words", lambda w: w["p"]).alias("confidences"))
    return rows.select("doc_id", "cue_idx", F.col("s.start").alias("start_s"), F.col("s.end").alias("finish_s"), "s.text", F.transform("s.words", word_confidence).alias("confidences"), "s.avg_logprob")


def word_confidence(w: Column) -> Column:
    """Of the names under which models give a confidence, the first that is present: an explicit null there wins over later names.

    w: a word as JSON text, since a struct no longer tells a missing field from a null one.
    """
    names = F.json_object_keys(w)
    out = F.lit(None).cast("double")
    for name in reversed(("confidence", "probability", "prob", "p")):  # fixed values
        out = F.when(F.array_contains(names, name), F.get_json_object(w, f"$.{name}").try_cast("double")).otherwise(out)
    return out


def raw_blocks(text: str) -> list[tuple[str, str]]:
    """The blocks of a subtitle document as they stand, each with the blank lines behind it; joined they are the document again."""
    parts = re.split(r"((?>\r\n|\r|\n)(?:[ \t]*(?>\r\n|\r|\n))+)", text)
    return [(parts[i], parts[i + 1] if i + 1 < len(parts) else "") for i in range(0, len(parts), 2)]


def rewritten(text: str, changed: Mapping[int, str]) -> str:
    """K1: a document with new texts for some of its cues (by number, from 0). Everything else, line ends included, stays byte for byte."""
    end = next(iter(re.findall(r"\r\n|\r|\n", text)), "\n")
    out, cue = [], -1
    for block, gap in raw_blocks(text):
        lines = re.split(r"\r\n|\r|\n", block)
        timing = next((i for i, line in enumerate(lines) if "-->" in line), None)
        cue += timing is not None
        if timing is not None and cue in changed:
            tail = re.search(r"(?:\r\n|\r|\n)*$", block)[0]
            block = end.join([*lines[: timing + 1], *changed[cue].split("\n")]) + tail
        out.append(block + gap)
    return "".join(out)


def with_word_times(words: Sequence[tuple[str, float]]) -> str:
    """K1: words of a cue with the time of each in front, but for the first, whose time is that of the cue."""

    def stamp(seconds: float) -> str:
        units = int(seconds * 1000 + 0.5)
        return f"{units // 3600000:02d}:{units // 60000 % 60:02d}:{units // 1000 % 60:02d}.{units % 1000:03d}"

    return " ".join(w if i == 0 else f"<{stamp(at)}>{w}" for i, (w, at) in enumerate(words))

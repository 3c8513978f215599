"""Ordered folds whose state decides each step: no window function expresses them, so they run per document in Arrow functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Length of a merged cue in characters and the gap that may be bridged, in seconds.
LONGEST_CUE, WIDEST_GAP = 84, 1.0
# Seconds of reference speech.
REFERENCE_LEAST, REFERENCE_MOST = 4.0, 8.0
# Share of a full line that the last part needs, ends of sentences, marks that close them, titles, labels of translations, times in a line.
TAIL_SHARE = 0.35
SENTENCE_END, SENTENCE_MARK, CLOSERS = re.compile(r"[.!?…]$"), re.compile(r"[.!?]$"), re.compile(r"[\"')\]]+")
TITLE = re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof|Sr|Sra|St)\.", re.IGNORECASE)
LABEL = re.compile(r"^(?:translation|translated(?:\s+text)?|answer|response)\s*:\s*", re.IGNORECASE)
STAMP = re.compile(r"<(?:\d+:)?\d{1,2}:\d{2}[.,]\d{3}>")


@dataclass(frozen=True)
class Entry:
    start: float
    finish: float
    text: str
    speaker: str | None = None


def merge_adjacent(entries: Iterable[Entry], longest: int = LONGEST_CUE, gap: float = WIDEST_GAP) -> list[Entry]:
    """Join a cue to the one before while speakers agree (none agrees with any), the gap is small and both fit."""
    out: list[Entry] = []
    for e in entries:
        last = out[-1] if out else None
        if last and (last.speaker is None or e.speaker is None or last.speaker == e.speaker) and e.start - last.finish <= gap and len(last.text) + 1 + len(e.text) <= longest:
            out[-1] = Entry(last.start, max(last.finish, e.finish), f"{last.text} {e.text}".strip(), last.speaker if last.speaker is not None else e.speaker)
        else:
            out.append(e)
    return out


def packed_items(items: list[str], longest: int, tail: float = TAIL_SHARE) -> list[list[str]]:
    """Words in runs of at most `longest` characters. Where what is left over would be shorter than `tail` of that, the run before it ends
    where it is full and the rest just long enough, as nearly as can be; a single longer word is a run of its own."""
    runs: list[list[str]] = []
    held: list[str] = []
    least = int(longest * tail)
    for i, item in enumerate(items):
        if not held or len(" ".join([*held, item])) <= longest:
            held.append(item)
            continue
        left = len(" ".join(items[i:]))
        cut = len(held)
        if left < least and len(held) > 1:
            ends = [(len(" ".join(held[:k])), len(" ".join(held[k:])) + left, k) for k in range(1, len(held))]
            fitting = [(longest - first + abs(least - rest), k) for first, rest, k in ends if first <= longest and rest >= least]
            cut = min(fitting)[1] if fitting else cut
        runs.append(held[:cut])
        held = [*held[cut:], item]
    return [*runs, held] if held else runs


def split_long(entry: Entry, longest: int = LONGEST_CUE) -> list[Entry]:
    """A cue of more than `longest` characters in parts; time goes by length, and the last part ends with the cue."""
    if len(entry.text.strip()) <= longest:
        return [entry]
    texts = [" ".join(run) for run in packed_items(entry.text.split(), longest)] or [entry.text]
    total, at, out = sum(map(len, texts)) or 1, entry.start, []
    for i, text in enumerate(texts):
        finish = entry.finish if i + 1 == len(texts) else at + max(entry.finish - entry.start, 0.0) * len(text) / total
        out.append(replace(entry, start=at, finish=finish, text=text))
        at = finish
    return out


def sentences(words: Iterable[Entry]) -> list[Entry]:
    """A stream of words as sentences: up to a word that ends in . ! ? or an ellipsis and is no title such as Mr.; closing marks that
    stand alone behind it go on its last word. Blank words are passed over."""
    out: list[list[Entry]] = []
    held: list[Entry] = []
    ended = False
    for w in words:
        text = w.text.strip()
        if not text:
            continue
        if ended and CLOSERS.fullmatch(text):
            held[-1] = replace(held[-1], text=held[-1].text.rstrip() + text, finish=w.finish)
            out.append(held)
            held, ended = [], False
            continue
        if ended:
            out.append(held)
            held = []
        held.append(w)
        ended = bool(SENTENCE_END.search(text)) and not TITLE.fullmatch(text)
    return [Entry(h[0].start, h[-1].finish, " ".join(x.text.strip() for x in h), h[0].speaker) for h in ([*out, held] if held else out)]


def merge_split_words(tokens: Iterable[Entry]) -> list[Entry]:
    """A token without a space in front goes on the word before it, unless that ends a sentence."""
    out: list[Entry] = []
    for t in tokens:
        if out and not t.text.startswith(" ") and not SENTENCE_MARK.search(out[-1].text.strip()):
            out[-1] = replace(out[-1], finish=max(out[-1].finish, t.finish), text=out[-1].text + t.text)
        else:
            out.append(t)
    return out


def merge_across(entries: Sequence[Sequence[Entry]]) -> list[list[Entry]]:
    """Words of cues, where a cue that begins inside a word gives that part to the cue before it; a cue without words left is dropped."""
    out: list[list[Entry]] = []
    for words in (merge_split_words(e) for e in entries):
        while out and out[-1] and words and not words[0].text.startswith(" ") and not SENTENCE_MARK.search(out[-1][-1].text.strip()):
            last = out[-1][-1]
            out[-1][-1] = replace(last, text=last.text + words[0].text, finish=max(last.finish, words[0].finish))
            words = words[1:]
        if words:
            out.append(list(words))
    return out


def translated(entries: Sequence[Entry], translate: Callable[[list[str]], list[str]], batch: int = 50, longest: int = LONGEST_CUE, merge: bool = True) -> list[Entry]:
    """The words of cues as sentences, translated in batches, split where they are too long and merged where they fit. Another number of
    translations than of sentences is an error."""
    parts = [x for e in entries for x in sentences(timed_words(e))]
    texts: list[str] = []
    for at in range(0, len(parts), batch):
        some = translate([p.text for p in parts[at : at + batch]])
        if len(some) != len(parts[at : at + batch]):
            raise ValueError("another number of translations than of texts")
        texts += some
    out = [x for p, t in zip(parts, texts, strict=True) for x in split_long(replace(p, text=LABEL.sub("", t)), longest)]
    return merge_adjacent(out, longest) if merge else out


def timed_words(entry: Entry) -> list[Entry]:
    """The words of a cue with even shares of its time."""
    parts = entry.text.split()
    step = (entry.finish - entry.start) / max(1, len(parts))
    return [Entry(entry.start + i * step, entry.start + (i + 1) * step, w, entry.speaker) for i, w in enumerate(parts)]


def translated_lines(cues: Sequence[Sequence[str]], translate: Callable[[list[str]], list[str]]) -> list[list[str]]:
    """The lines of cues, translated line by line. Times inside a line are masked by a prefix that no line holds, must come back in order, and
    are put back; another number of lines is an error."""
    lines = [line for cue in cues for line in cue]
    n = 0
    while any(f"XT{n}Q" in line for line in lines):
        n += 1
    stamps = [STAMP.findall(line) for line in lines]
    counter = iter(range(sum(map(len, stamps))))
    masked = [STAMP.sub(lambda m: f"XT{n}Q{next(counter)}E", line) for line in lines]
    done = translate(masked)
    if len(done) != len(lines):
        raise ValueError("another number of lines")
    marker = re.compile(rf"XT{n}Q(\d+)E")
    for before, after in zip(masked, done, strict=True):
        if marker.findall(before) != marker.findall(after):
            raise ValueError("times inside a line were changed")
    every = [s for found in stamps for s in found]
    back = iter([marker.sub(lambda m: every[int(m[1])], line) for line in done])
    return [[next(back) for _ in cue] for cue in cues]


def overlapping_words(left: str, right: str, most: int = 8) -> int:
    """Words at the end of one line that open the next, marks at their edges and case aside: two or more, or one of six letters or more."""
    a, b = ([x for w in line.split() if (x := re.sub(r"^[\W_]+|[\W_]+$", "", w.lower()))] for line in (left, right))
    for n in range(min(most, len(a), len(b)), 1, -1):
        if a[-n:] == b[:n]:
            return n
    return 1 if a and b and a[-1] == b[0] and len(a[-1]) >= 6 else 0


def join_lines(lines: Iterable[str]) -> str:
    """Lines as one text: a hyphen at the end joins a word, repeated words are dropped."""
    out = ""
    for line in (" ".join(x.split()) for x in lines):
        if not line:
            continue
        if out.endswith("-"):
            out = out[:-1] + line
        else:
            out = " ".join(x for x in (out, " ".join(line.split()[overlapping_words(out, line) :])) if x)
    return out


@dataclass(frozen=True)
class Clip:
    start: float
    end: float
    duration: float
    speed: float = 1.0


def schedule(clips: list[Clip], total: float) -> list[Clip]:
    """A clip that is too long for its slot claims free time around it: first the time before the first clip, then each gap, shared by what
    its two clips still need, from left to right, then the time behind the last; what still does not fit is spoken faster.

    A clip without any time at all is an error. The end is where the speech ends.
    """
    limits = [min(c.end, total) - c.start for c in clips]
    need = [max(c.duration - limit, 0.0) for c, limit in zip(clips, limits, strict=True)]
    before, after = [0.0] * len(clips), [0.0] * len(clips)

    def claim(side: list[float], i: int, room: float) -> None:
        side[i] = min(room, need[i])
        need[i] -= side[i]

    if clips:
        claim(before, 0, max(clips[0].start, 0.0))
        for i in range(len(clips) - 1):
            room, wanted = max(clips[i + 1].start - clips[i].end, 0.0), need[i] + need[i + 1]
            if room > 0 and wanted > 0:
                shared = min(room, wanted)
                mine = shared * need[i] / wanted
                claim(after, i, mine)
                claim(before, i + 1, shared - mine)
        claim(after, len(clips) - 1, max(total - clips[-1].end, 0.0))
    out = []
    for c, limit, early, late in zip(clips, limits, before, after, strict=True):
        room = limit + early + late
        if room <= 0:
            raise ValueError("a clip has no time")
        speed = max(c.duration / room, 1.0) if c.duration > 0 else 1.0
        out.append(replace(c, start=c.start - early, end=c.start - early + c.duration / speed, speed=speed))
    return out


def reference_fill(lengths: list[float], least: float = REFERENCE_LEAST, most: float = REFERENCE_MOST) -> list[int]:
    """Places of the pieces that fit one after another into `most` seconds, in the order in which they are taken; while they do not reach
    `least`, the first piece left that still fits."""
    chosen, held = [], 0.0
    for i, n in enumerate(lengths):
        if held >= most:
            break
        if held + n <= most:
            chosen.append(i)
            held += n
    while held < least:
        more = next((i for i, n in enumerate(lengths) if i not in chosen and n <= most - held), None)
        if more is None:
            break
        chosen.append(more)
        held += lengths[more]
    return chosen


def pack(words: list[str], limit: int) -> list[str]:
    """words in chunks of at most `limit` characters; a longer word is cut."""
    out, line = [], ""
    for w in words:
        while len(w) > limit:
            if line:
                out.append(line)
                line = ""
            out.append(w[:limit])
            w = w[limit:]
        joined = f"{line} {w}".strip()
        if len(joined) > limit:
            out.append(line)
            line = w
        else:
            line = joined
    return [x for x in [*out, line] if x]


FOLDED = "doc_id string, cue_idx long, start_s double, finish_s double, text string, speaker_id string"


def per_document(cues: DataFrame, fold: Callable[[list[Entry]], list[Entry]]) -> DataFrame:
    """Run a fold over the cues of each document in order. A document is one recording or book; documents spread over the cluster."""
    schema = T.StructType.fromDDL(FOLDED)
    names = ("cue_idx", "start_s", "finish_s", "text", "speaker_id")
    types = (pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.string())

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)).sort_by("cue_idx")
        columns = [held.column(c).to_pylist() for c in names[1:]]
        done = fold([Entry(a, b, text or "", speaker) for a, b, text, speaker in zip(*columns, strict=True)])
        values = [range(len(done)), [e.start for e in done], [e.finish for e in done], [e.text for e in done], [e.speaker for e in done]]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(done), pa.string()), *(pa.array(v, t) for v, t in zip(values, types, strict=True))], names=schema.names)

    return cues.select("doc_id", *(c if c not in ("start_s", "finish_s") else F.col(c).cast("double").alias(c) for c in names)).groupBy("doc_id").applyInArrow(run, schema)


SCHEDULED = "doc_id string, cue_idx long, start_s double, finish_s double, speed double"


def scheduled(clips: DataFrame, total: str = "total_s") -> DataFrame:
    """W27 over a table: clips (doc_id, cue_idx, start_s, finish_s, duration_s) of each recording, whose length stands in `total`."""
    schema = T.StructType.fromDDL(SCHEDULED)

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)).sort_by("cue_idx")
        rows = [Clip(*x) for x in zip(*(held.column(c).to_pylist() for c in ("start_s", "finish_s", "duration_s")), strict=True)]
        done = schedule(rows, held.column(total)[0].as_py())
        values = [[key[0].as_py()] * len(done), held.column("cue_idx").to_pylist(), [c.start for c in done], [c.end for c in done], [c.speed for c in done]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)], names=schema.names)

    return clips.select("doc_id", "cue_idx", *(F.col(c).cast("double").alias(c) for c in ("start_s", "finish_s", "duration_s", total))).groupBy("doc_id").applyInArrow(run, schema)


def columns_of(*functions: tuple[Callable, str]) -> list[Callable[[Column], Column]]:
    """Plain functions of one array or text as Arrow functions of a column; a null gives a null."""

    def made(function: Callable, kind: str) -> Callable[[Column], Column]:
        @F.arrow_udf(kind)
        def apply(values: pa.Array) -> pa.Array:
            return pa.array([None if v is None else function(v) for v in values.to_pylist()], out)

        out = to_arrow_type(T._parse_datatype_string(kind) if not isinstance(kind, T.DataType) else kind)
        return apply

    return [made(f, k) for f, k in functions]


def joined_lines(lines: Column) -> Column:
    """W24 as an expression over an array of lines."""
    return columns_of((join_lines, "string"))[0](lines)


def chosen_pieces(lengths: Column) -> Column:
    """W28 as an expression over an array of seconds."""
    return columns_of((reference_fill, "array<int>"))[0](lengths)


def packed(limit: int) -> Callable[[Column], Column]:
    """F17 as an expression over a text."""
    return columns_of((lambda text: pack(text.split(), limit), "array<string>"))[0]

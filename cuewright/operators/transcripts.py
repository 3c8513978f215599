"""Scores of transcripts and choice of reference windows."""

from __future__ import annotations

import difflib
import math
import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.functions.similarity import edit_distance, lcs

# Limits of a usable recording and of its windows.
UNIQUE_LEAST, MEAN_LEAST, P10_LEAST, EDGE_LEAST, SIMILARITY_LEAST = 0.85, 0.85, 0.75, 0.6, 0.8
GROWS_FROM, GROWS_TO, SHORTEST, LONGEST, FEWEST_WORDS, MOST_WORDS, BEST = 4.0, 14.0, 4.0, 8.0, 8, 35, 5
LETTERS = regex.compile(r"\p{L}+")


def word_list(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def floor_percentile(values: Sequence[float], share: float) -> float | None:
    """A3: the value at floor(n * share) of the sorted values; none of none."""
    return sorted(values)[min(math.floor(len(values) * share), len(values) - 1)] if values else None


SCORE = "struct<expected_words:int,recognized_words:int,matching_words:int,match_rate:double,word_error_rate:double>"


def compared(expected: str | None, heard: str | None) -> tuple[int, int, int, float, float]:
    """Words of both, common words in order, their share of the longer text, and the word error rate."""
    a, b = word_list(expected), word_list(heard)
    common = lcs(a, b)
    return len(a), len(b), common, common / max(len(a), len(b)) if a and b else 0.0, edit_distance(a, b) / max(len(a), 1)


def transcript_score(expected: Column, heard: Column, confidences: Column, language: Column, wanted: str | None = None, least: float = 0.0) -> Column:
    """A5: comparison with the expected text, whether the language is the wanted one, mean and lowest tenth of the confidences (null without any),
    and acceptance: language and a match rate of at least `least`."""

    @F.arrow_udf(SCORE)
    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        rows = [compared(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
        names = ("expected_words", "recognized_words", "matching_words", "match_rate", "word_error_rate")
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    given = F.array_sort(F.filter(confidences, lambda x: x.isNotNull()))
    n = F.size(given)
    mean = F.when(n > 0, F.aggregate(given, F.lit(0.0), lambda s, x: s + x) / n)
    p10 = F.get(given, F.least(F.floor(n * F.lit(0.1)).cast("int"), n - 1))
    s = score(expected, heard)
    fits = F.lit(True) if wanted is None else F.coalesce(language == wanted, F.lit(False))
    return F.struct(*(s[f].alias(f) for f in ("expected_words", "recognized_words", "matching_words", "match_rate", "word_error_rate")), fits.alias("language_match"), mean.alias("confidence_mean"), F.when(n > 0, p10).alias("confidence_p10"), (fits & (s["match_rate"] >= least)).alias("accepted"))


def reference_accepted(audio_accepted: Column, language: Column, wanted: str, mean: Column, p10: Column, similarity: Column) -> Column:
    """Accepted audio, the wanted language (a blank one counts as it), and confidences and similarity at their limits or above; none counts as 0."""
    spoken = F.coalesce(F.nullif(F.btrim(language), F.lit("")), F.lit(wanted)) == wanted
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return F.coalesce(audio_accepted, F.lit(False)) & spoken & (zero(mean) >= MEAN_LEAST) & (zero(p10) >= P10_LEAST) & (zero(similarity) >= SIMILARITY_LEAST)


def normal_word(word: str) -> str:
    """letters a to z and digits of a word, marks taken off."""
    return re.sub("[^a-z0-9]", "", "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c)))


def normal_words(text: str | None) -> list[str]:
    return [w for w in map(normal_word, (text or "").split()) if w]


def alignment_counts(expected: str | None, heard: str | None) -> dict[str, float]:
    """Substituted, deleted and inserted words of the longest-block alignment, the match rate over the longer text and the error rate."""
    a, b = normal_words(expected), normal_words(heard)
    counts = {"substitutions": 0, "deletions": 0, "insertions": 0, "matches": 0}
    for tag, i, i2, j, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag == "equal":
            counts["matches"] += i2 - i
        else:
            both = min(i2 - i, j2 - j)
            counts["substitutions"] += both
            counts["deletions"] += i2 - i - both
            counts["insertions"] += j2 - j - both
    wrong = counts["substitutions"] + counts["deletions"] + counts["insertions"]
    return counts | {"match_rate": counts["matches"] / max(len(a), len(b)) if a and b else 0.0, "wer": wrong / max(len(a), 1)}


@dataclass(frozen=True)
class Segment:
    start: float
    finish: float
    text: str
    confidences: tuple[float, ...] = ()

    @property
    def ends(self) -> bool:
        return self.text.strip().endswith((".", "?", "!"))

    @property
    def noisy(self) -> bool:
        """The lowest tenth of its confidences is below the limit, or it has none."""
        return (floor_percentile(self.confidences, 0.1) or 0.0) < EDGE_LEAST


def windows(segments: Sequence[Segment]) -> Iterator[list[Segment]]:
    """From the first segment, and from each behind a sentence end: grown until the first sentence end of at least GROWS_FROM seconds;
    none if a segment on the way ends more than GROWS_TO seconds behind its start."""
    for i in range(len(segments)):
        if i and not segments[i - 1].ends:
            continue
        for j in range(i, len(segments)):
            length = segments[j].finish - segments[i].start
            if length > GROWS_TO:
                break
            if length >= GROWS_FROM and segments[j].ends:
                yield list(segments[i : j + 1])
                break


def trimmed(window: Sequence[Segment]) -> list[Segment]:
    """Without noisy segments at either edge; nothing if what is left ends no sentence."""
    clean = [i for i, s in enumerate(window) if not s.noisy]
    kept = list(window[clean[0] : clean[-1] + 1]) if clean else []
    return kept if kept and kept[-1].ends else []


def unique_trigrams(text: str) -> float:
    found = word_list(text)
    grams = list(zip(found, found[1:], found[2:], strict=False))
    return len(set(grams)) / len(grams) if grams else 0.0


def candidates(segments: Sequence[Segment], strict: bool = True) -> list[tuple[float, float, str, float]]:
    """(start, finish, text, confidence) of usable windows of one recording, the most confident first, ties by start; the best five if strict.

    A recording that repeats itself has none. A window must last 4 to 8 seconds, hold 8 to 35 words, and be confident on average and in
    its lowest tenth; its confidence is the product of both.
    """
    if unique_trigrams(" ".join(s.text for s in segments)) < UNIQUE_LEAST:
        return []
    out = []
    for window in windows(segments):
        kept = trimmed(window)
        scores = [c for s in kept for c in s.confidences]
        if not kept or not scores:
            continue
        start, finish = kept[0].start, kept[-1].finish
        text = " ".join(s.text.strip() for s in kept)
        mean, p10 = sum(scores) / len(scores), sorted(scores)[math.floor(len(scores) * 0.1)]
        if SHORTEST <= finish - start <= LONGEST and FEWEST_WORDS <= len(LETTERS.findall(text)) <= MOST_WORDS and mean >= MEAN_LEAST and p10 >= P10_LEAST:
            out.append((start, finish, text, mean * p10))
    out.sort(key=lambda c: (-c[3], c[0]))
    return out[:BEST] if strict else out


def reference_candidates(segments: DataFrame, group: str = "doc_id", ordinal: str = "cue_idx", strict: bool = True) -> DataFrame:
    """W12-W14 over a table of segments (start_s, finish_s, text, confidences): candidates of each recording with their rank. One recording is one
    task's fold; null texts are empty, null confidences none."""
    schema = T.StructType([segments.schema[group], *T.StructType.fromDDL("rank int, start_s double, finish_s double, text string, confidence double")])

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)).sort_by(ordinal)
        rows = zip(*(held.column(c).to_pylist() for c in ("start_s", "finish_s", "text", "confidences")), strict=True)
        done = candidates([Segment(a, b, t or "", tuple(x for x in c or () if x is not None)) for a, b, t, c in rows], strict)
        values = [[key[0].as_py()] * len(done), range(1, len(done) + 1), *([d[i] for d in done] for i in range(4))]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (held.schema.field(group).type, pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.float64()), strict=True)], names=schema.names)

    return segments.select(group, ordinal, F.col("start_s").cast("double").alias("start_s"), F.col("finish_s").cast("double").alias("finish_s"), "text", F.col("confidences").cast("array<double>").alias("confidences")).groupBy(group).applyInArrow(run, schema)


def ranked_candidates(found: DataFrame, signal: DataFrame, group: str = "doc_id") -> DataFrame:
    """Candidates of all recordings by signal score plus a fifth of the confidence; ties by recording and start. signal: group, start_s, signal_score."""
    from cuewright.operators.windows import global_ordinal

    scored = found.join(signal, [group, "start_s"]).withColumn("score", F.col("signal_score") + 0.2 * F.col("confidence"))
    return global_ordinal(scored.withColumn("minus_score", -F.col("score")), ["minus_score", group, "start_s"], "place").drop("minus_score")

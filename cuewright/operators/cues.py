"""Cues as rows with arrays of words: slices, retiming, projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sliced(cues: DataFrame, start: float, finish: float, rebase: bool = True) -> DataFrame:
    """Cues (and their words) that overlap [start, finish), clamped, and moved to begin at 0 if rebased.

    A cue that had words and loses all of them goes. Overlap is half open: a cue that only touches is out.
    """
    move = F.lit(start if rebase else 0.0)
    inside = lambda a, b: (b > start) & (a < finish)
    clamp = lambda x: F.least(F.greatest(x, F.lit(start)), F.lit(finish)) - move
    kept = cues.filter(inside(F.col("start_s"), F.col("finish_s"))).withColumns({"start_s": clamp(F.col("start_s")), "finish_s": clamp(F.col("finish_s"))})
    if "words" not in cues.columns:
        return kept
    words = F.transform(F.filter("words", lambda w: inside(w["start_s"], w["finish_s"])), lambda w: w.withField("start_s", clamp(w["start_s"])).withField("finish_s", clamp(w["finish_s"])))
    return kept.withColumn("_had", F.size("words") > 0).withColumn("words", words).filter(~F.col("_had") | (F.size("words") > 0)).drop("_had")


def retimed(words: Column, old_start: Column, old_finish: Column, new_start: Column, new_finish: Column) -> Column:
    """Words moved along when a span is stretched to another; a span without length puts them at its start."""
    scale = F.coalesce(F.try_divide(new_finish - new_start, old_finish - old_start), F.lit(0.0))
    moved = lambda x: new_start + (x - old_start) * scale
    return F.transform(words, lambda w: w.withField("start_s", moved(w["start_s"])).withField("finish_s", moved(w["finish_s"])))


def timed_parts(parts: Column, start: Column, finish: Column) -> Column:
    """Texts one after another in a span, each with time by its length; the last ends exactly at the finish."""
    total = F.aggregate(parts, F.lit(0), lambda n, p: n + F.length(p))
    upto = lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda n, p: n + F.length(p))
    at = lambda i: start + (finish - start) * F.coalesce(F.try_divide(upto(i), total), F.lit(0.0))
    return F.transform(parts, lambda p, i: F.struct(p.alias("text"), at(i).alias("start_s"), F.when(i + 1 == F.size(parts), finish).otherwise(at(i + 1)).alias("finish_s")))


def projected(tokens: Column, words: Column) -> Column:
    """N tokens over m timed words. With more tokens, each word carries n / m of them, the first ones the rest,
    and shares its time among them; with fewer, each token spans m / n words, the first ones the rest."""
    n, m = F.size(tokens), F.size(words)

    def spread(i: Column) -> Column:  # more tokens: the word and the share of it that token i has
        base, extra = F.floor(n / m).cast("int"), n % m
        edge = extra * (base + 1)
        word = F.when(i < edge, F.floor(i / (base + 1))).otherwise(extra + F.floor((i - edge) / base)).cast("int")
        place = F.when(i < edge, i % (base + 1)).otherwise((i - edge) % base)
        count = F.when(i < edge, base + 1).otherwise(base)
        w = F.get(words, word)
        length = w["finish_s"] - w["start_s"]
        return F.struct(F.get(tokens, i).alias("text"), (w["start_s"] + length * place / count).alias("start_s"), F.when(place + 1 == count, w["finish_s"]).otherwise(w["start_s"] + length * (place + 1) / count).alias("finish_s"))

    def gathered(i: Column) -> Column:  # fewer tokens: from the first to the last of its words
        base, extra = F.floor(m / n).cast("int"), m % n
        first = (i * base + F.least(i, extra)).cast("int")
        size = base + F.when(i < extra, 1).otherwise(0)
        return F.struct(F.get(tokens, i).alias("text"), F.get(words, first)["start_s"].alias("start_s"), F.get(words, first + size - 1)["finish_s"].alias("finish_s"))

    every = F.sequence(F.lit(0), n - 1)
    return F.when((n > 0) & (m > 0), F.when(n >= m, F.transform(every, spread)).otherwise(F.transform(every, gathered)))


def bilingual(source: Column, target: Column) -> Column:
    """Both texts, one under the other, without blanks and repetitions."""
    return F.array_join(F.array_distinct(F.filter(F.array(F.btrim(source), F.btrim(target)), lambda x: x.isNotNull() & (x != ""))), "\n")


def first_seen(df: DataFrame, group: Sequence[str], text: str, order: Sequence[str]) -> DataFrame:
    """Rows whose text does not occur earlier in the group."""
    from cuewright.operators.aggregates import first_of

    return first_of(df, [*group, text], order)


def without_keys(metadata: Column, keys: Sequence[str]) -> Column:
    """A map without some keys."""
    return F.map_filter(metadata, lambda k, v: ~k.isin(*keys))


def merged_maps(left: Column, right: Column) -> Column:
    """Both maps; the right one wins, whatever the session's policy on repeated keys."""
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.array_contains(F.map_keys(right), k)), right)

"""Content-addressed units of documents: masking, registration, restoration, rendering to a fixed point."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.session import settled

MARK = "⟦{}⟧"
MARKED = re.compile(r"⟦(\d+)⟧")


def unit_key(version: str, target: Column | str, source: Column) -> Column:
    """Digest of version, target language and source text."""
    return F.sha2(F.concat_ws("\x1f", F.lit(version), F.lit(target) if isinstance(target, str) else target, source), 256)


def mask(text: str, patterns: list[re.Pattern]) -> tuple[str, dict[str, str]]:
    """Matches of the patterns, in order of the patterns, as numbered marks; equal matches share one. Marks that
    the text has already are masked first, so none is mistaken for ours."""
    tokens: dict[str, str] = {}
    found: dict[str, str] = {}

    def replace(m: re.Match) -> str:
        if m[0] not in found:
            mark = MARK.format(len(tokens))
            found[m[0]], tokens[mark] = mark, m[0]
        return found[m[0]]

    text = MARKED.sub(replace, text)
    for pattern in patterns:
        parts = re.split(r"(⟦\d+⟧)", text)
        text = "".join(p if i % 2 else pattern.sub(replace, p) for i, p in enumerate(parts))
    return text, tokens


def restore(text: str, tokens: dict[str, str]) -> str:
    """Marks back to what they stand for; one that is lost, doubled or unknown is an error."""
    seen = [m[0] for m in MARKED.finditer(text)]
    missing, unknown = set(tokens) - set(seen), set(seen) - set(tokens)
    if missing or unknown:
        raise ValueError(f"missing {sorted(missing)}, unknown {sorted(unknown)}")
    return MARKED.sub(lambda m: tokens[m[0]], text)


def pending(units: DataFrame, cache: DataFrame) -> DataFrame:
    """Units to be worked on, each key once: the first registration of a key, unless the cache has it."""
    from cuewright.operators.aggregates import first_of

    return first_of(units.join(cache.select("key").distinct(), "key", "left_anti"), ["key"], ["doc_id", "ordinal"])


def resolved(links: DataFrame, rounds: int = 40) -> DataFrame:
    """links(node, target) followed to the end: node, root, steps; a node on or before a cycle has a null root.

    Pointers double each round, so `rounds` covers chains of 2 ** rounds links; work per round is one join on the
    node. Each round is checkpointed in the session's shared folder, so plans stay short.
    """
    current = links.select("node", "target", F.lit(1).cast("long").alias("steps")).dropDuplicates(["node"])
    size = current.count()
    for _ in range(min(rounds, max(1, size.bit_length() + 1))):
        ahead = current.select(F.col("node").alias("target"), F.col("target").alias("next"), F.col("steps").alias("more"))
        moved = current.join(ahead, "target", "left").select("node", F.coalesce("next", "target").alias("target"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("open"))
        moved = settled(moved)
        current = moved.drop("open")
        if moved.filter("open").limit(1).count() == 0:
            break
    starts = links.select(F.col("node").alias("target"), F.lit(True).alias("cyclic")).distinct()  # an end that has a link of its own lies on a cycle
    return current.join(starts, "target", "left").select("node", F.when(F.col("cyclic").isNull(), F.col("target")).alias("root"), F.when(F.col("cyclic").isNull(), F.col("steps")).alias("steps"))

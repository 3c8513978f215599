"""One-to-one alignment of timed records (J1, J2) and their comparison (A10)."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-9


@dataclass(frozen=True)
class Cue:
    index: int
    start: float
    finish: float
    text: str


def candidates(left: Cue, ordered: list[Cue], starts: list[float]) -> list[Cue]:
    """Right cues that a left cue may pair with.

    From the first right cue that starts no earlier: back while cues end after the left one starts (the first that
    does not ends the walk), then on while they start before it ends. If there are none, the neighbour before that
    place, or the one at it if nothing stands before.
    """
    at = bisect_left(starts, left.start)
    found, i = [], at - 1
    while i >= 0 and ordered[i].finish > left.start:
        found.append(ordered[i])
        i -= 1
    i = at
    while i < len(ordered) and ordered[i].start < left.finish:
        found.append(ordered[i])
        i += 1
    if not found and ordered:
        found = [ordered[at - 1] if at else ordered[0]]
    return found


def pair_score(left: Cue, right: Cue) -> tuple:
    """Smaller is better: equal text, overlap, intersection over union, gap, difference of lengths, places."""
    overlap = min(left.finish, right.finish) - max(left.start, right.start)
    union = max(left.finish, right.finish) - min(left.start, right.start)
    share = max(overlap, 0.0) / union if union > 0 else 0.0
    return (left.text != right.text, overlap <= 0, -share, max(-overlap, 0.0), abs((left.finish - left.start) - (right.finish - right.start)), left.index, right.index)


def align(lefts: list[Cue], rights: list[Cue]) -> tuple[list[tuple[Cue, Cue]], list[Cue], list[Cue]]:
    """Pairs by rising score, each cue once; and what stays alone on either side."""
    ordered = sorted(rights, key=lambda c: (c.start, c.finish, c.index))
    starts = [c.start for c in ordered]
    options = sorted((pair_score(x, y), i, y.index) for i, x in enumerate(lefts) for y in candidates(x, ordered, starts))
    by_index = {c.index: c for c in rights}
    used_left, used_right, pairs = set(), set(), []
    for _, i, j in options:
        if i not in used_left and j not in used_right:
            used_left.add(i)
            used_right.add(j)
            pairs.append((lefts[i], by_index[j]))
    return sorted(pairs, key=lambda p: p[0].index), [c for i, c in enumerate(lefts) if i not in used_left], [c for c in rights if c.index not in used_right]


def align_words(lefts: list[Cue], rights: list[Cue]) -> list[tuple[Cue, Cue]]:
    """Words of equal text, closest in time first; if both sides have as many words, the rest pair up in order."""
    options = sorted((abs(x.start - y.start) + abs(x.finish - y.finish), abs(x.index - y.index), x.index, y.index) for x in lefts for y in rights if x.text == y.text)
    one, other = {c.index: c for c in lefts}, {c.index: c for c in rights}
    pairs = []
    for *_, i, j in options:
        if i in one and j in other:
            pairs.append((one.pop(i), other.pop(j)))
    if len(lefts) == len(rights):
        pairs += zip([one[k] for k in sorted(one)], [other[k] for k in sorted(other)], strict=True)
    return sorted(pairs, key=lambda p: p[0].index)


def differences(lefts: list[Cue], rights: list[Cue], tolerance: float) -> Iterator[tuple[str, int | None, int | None, float, float]]:
    """(kind, left index, right index, difference of starts, of finishes) of every pair and every cue alone."""
    pairs, removed, added = align(lefts, rights)
    for x, y in pairs:
        start, finish = y.start - x.start, y.finish - x.finish
        moved = max(abs(start), abs(finish)) > tolerance + TOLERANCE
        if x.text != y.text:
            yield "text_changed", x.index, y.index, start, finish
        if moved:
            yield "timing_changed", x.index, y.index, start, finish
        if x.text == y.text and not moved:
            yield "same", x.index, y.index, start, finish
    for x in removed:
        yield "removed", x.index, None, 0.0, 0.0
    for y in added:
        yield "added", None, y.index, 0.0, 0.0


SCHEMA = "doc_id string, kind string, before_idx long, after_idx long, start_delta double, finish_delta double"


def semantic_diff(before: DataFrame, after: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """J1 and A10 on cues(doc_id, cue_idx, start_s, finish_s, text): one row per difference, and per equal pair.

    Both sides of a document meet in one task, as the greedy choice needs all of them; a document is one recording.
    """

    def compare(key: tuple, both: pd.DataFrame) -> pd.DataFrame:
        ordered = both.sort_values("cue_idx")
        side = lambda old: [Cue(int(r.cue_idx), float(r.start_s), float(r.finish_s), " ".join((r.text or "").split())) for r in ordered[ordered.old == old].itertuples()]
        rows = [(key[0], *d) for d in differences(side(True), side(False), tolerance)]
        frame = pd.DataFrame(rows, columns=["doc_id", "kind", "before_idx", "after_idx", "start_delta", "finish_delta"])
        return frame.astype({"before_idx": "Int64", "after_idx": "Int64"})

    columns = ("doc_id", "cue_idx", "start_s", "finish_s", "text")
    sides = before.select(*columns, F.lit(True).alias("old")).unionByName(after.select(*columns, F.lit(False).alias("old")))
    return sides.groupBy("doc_id").applyInPandas(compare, SCHEMA)

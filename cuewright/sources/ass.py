"""SubStation Alpha out of timed words, and WebVTT in normal form."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import regex

# The highlight of the word that is spoken, and what ends it.
HIGHLIGHT, RESET = r"{\c&H00FFFF&}", r"{\c&HFFFFFF&}"


@dataclass(frozen=True)
class TimedWord:
    text: str
    start: float
    finish: float
    group: int | None = None


def ass_time(seconds: float) -> str:
    """H:MM:SS.cc, rounded half up."""
    units = int(seconds * 100 + 0.5)
    return f"{units // 360000}:{units // 6000 % 60:02d}:{units // 100 % 60:02d}.{units % 100:02d}"


def word_groups(words: Sequence[TimedWord]) -> list[tuple[float, float, str]]:
    """neighbours with the same marker group as one."""
    runs: list[list[TimedWord]] = []
    for w in words:
        if runs and runs[-1][-1].group is not None and runs[-1][-1].group == w.group:
            runs[-1].append(w)
        else:
            runs.append([w])
    return [(r[0].start, r[-1].finish, " ".join(w.text.strip() for w in r)) for r in runs]


def events(start: float, finish: float, text: str, words: Sequence[TimedWord] = (), mode: str = "highlight") -> list[tuple[float, float, str]]:
    """K2: a cue as one plain event, as one with karaoke marks, or as one per group with that group highlighted.

    The bounds of highlighted events are the starts of the groups, kept inside the cue and never going back; empty ones are dropped.
    """
    if mode == "plain" or not words:
        return [(start, finish, re.sub(r"\r?\n", r"\\N", text))]
    groups = word_groups(words)
    if mode == "karaoke":
        return [(start, finish, " ".join(f"{{\\k{int((b - a) * 100 + 0.5)}}}{t}" for a, b, t in groups))]
    bounds = [start]
    for t in [*(g[0] for g in groups[1:]), finish]:
        bounds.append(max(bounds[-1], min(max(t, start), finish)))
    return [(a, b, " ".join(f"{HIGHLIGHT}{t}{RESET}" if i == k else t for i, (_, _, t) in enumerate(groups))) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if b > a]


def dialogue(event: tuple[float, float, str], layer: int = 0, style: str = "Default") -> str:
    return f"Dialogue: {layer},{ass_time(event[0])},{ass_time(event[1])},{style},,0,0,0,,{event[2]}"


# A line of timing, a time, and a time inside a cue.
TIME = r"(?:\d+:)?[0-5]?\d:[0-5]\d[.,]\d{3}"
TIMING = re.compile(rf"^\s*{TIME}\s*-->\s*{TIME}")


def canonical_vtt(text: str | bytes) -> str:
    """WebVTT with \\n at line ends, without override tags, and with points in the first two times of a timing line and in times inside cues.
    Bytes that are no UTF-8 are an error, and so is a cue that does not end behind its start."""
    if isinstance(text, bytes):
        text = text.decode("utf-8")
    text = re.sub(r"\r\n?", "\n", text)
    text = re.sub(r"\\[Nn]", "\n", re.sub(r"\\[hHtT]", " ", re.sub(r"\{\\[^}]*\}", "", text)))
    out = []
    for line in text.split("\n"):
        if TIMING.match(line):
            left = [2]

            def point(m: re.Match, left: list[int] = left) -> str:
                left[0] -= 1
                return m[0].replace(",", ".") if left[0] >= 0 else m[0]

            line = re.sub(TIME, point, line)
            a, b = (seconds(x) for x in re.findall(TIME, line)[:2])
            if b <= a:
                raise ValueError("a cue ends before it starts")
        else:
            line = re.sub(rf"<({TIME})>", lambda m: m[0].replace(",", "."), line)
        out.append(line)
    return "\n".join(out)


def seconds(stamp: str) -> float:
    total = 0.0
    for part in stamp.replace(",", ".").split(":"):
        total = total * 60 + float(part)
    return total


def marked_boundaries(text: str, tokens: Sequence[str]) -> list[str]:
    """Tokens of a cue with a space in front where white space stands between them in its text, found from a moving place on."""
    out, at = [], 0
    for token in tokens:
        found = text.find(token, at)
        found = at if found < 0 else found
        out.append((" " if re.search(r"\s", text[at:found]) else "") + token)
        at = found + len(token)
    return out


def tokenised(text: str) -> list[str]:
    """runs of letters (with marks, apostrophes, hyphens) and of digits; other signs go on the token before them."""
    out: list[str] = []
    for m in regex.finditer(r"[\p{L}\p{M}'’-]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]+", text or ""):
        if out and not regex.match(r"[\p{L}\p{M}\p{N}'’-]", m[0]):
            out[-1] += m[0]
        else:
            out.append(m[0])
    return out

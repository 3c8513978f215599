"""Paragraphs from the lines of pages (W22-W26, F10, W30 roles): ordered folds whose state decides each step, run per document.

A line has text, page, font size, style, place and spacing; spacing to its neighbours comes from the window operators. Rules of
fonts come from `FontRoles`, fitted on all lines of a document beforehand.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# What separates headings from text, by size, score and share; spacing and indent that break; words of an overlap.
BODY_BAND, HEADING_SCORE, TITLE_MOST, STYLED_SHARE, CLUSTER_GAP = 1.0, 3.5, 2, 0.4, 1.0
HEADING_ROLES = ("chapter", "heading", "subheading")
SPACING_FACTOR, INDENT_SHARE, PAGE_FONT_SLACK = 1.5, 0.5, 0.6
FINISHED = regex.compile(r"[.!?¡¿;。？！]\"?$")
UNFINISHED = regex.compile(r"[.!?…]\"?\)?$")
NUMBERS_ONLY = regex.compile(r"^\d+$", regex.MULTILINE)
MARKERS = regex.compile(r"^\d+[)\.\]]*(?:\s+\d+[)\.\]]*)*")
INLINE_MARKER = regex.compile(r"([\p{L})\].,;:\"])(\d{1,3})(?=\s|$)")
INLINE_BEFORE_COLON = regex.compile(r"([\p{L})\].,;:\"])(\d{1,3})(?=\s*:)")


@dataclass(frozen=True)
class Line:
    text: str
    page: int = 1
    size: float | None = None
    bold: bool = False
    italic: bool = False
    alignment: str = "left"
    x: float | None = None
    top: float | None = None
    bottom: float | None = None
    language: str | None = None


def quantised(size: float | None) -> float | None:
    """F64: halves of a point; none for a missing or non-positive size. Halves round away from zero."""
    return None if size is None or size <= 0 else np.floor(size * 2 + 0.5) / 2


def upper(text: str) -> bool:
    return bool(regex.search(r"\p{L}", text)) and text == text.upper()


class FontRoles:
    """The body size is that of most lines; other styles are headings if they are prominent enough, the most prominent first."""

    def __init__(self, lines: Sequence[Line]):
        samples = [(quantised(line.size), line) for line in lines if quantised(line.size) is not None]
        self.body: float | None = None
        self.roles: dict[tuple, tuple[str, int | None]] = {}
        self.sizes: dict[float, str] = {}
        if not samples:
            return
        counts = Counter(size for size, _ in samples)
        clusters: list[list[float]] = []
        for size in sorted(counts):
            if clusters and size - clusters[-1][-1] <= CLUSTER_GAP:
                clusters[-1].append(size)
            else:
                clusters.append([size])
        body = max(clusters, key=lambda c: sum(counts[s] for s in c))
        self.body = max(body, key=lambda size: counts[size])  # of sizes that are as frequent, the smallest
        for cluster in clusters:
            role = "body" if any(abs(size - self.body) <= BODY_BAND for size in cluster) else "footnote" if max(cluster) < self.body - BODY_BAND else "heading"
            self.sizes.update(dict.fromkeys(cluster, role))
        groups: dict[tuple, list[Line]] = {}
        for size, line in samples:
            groups.setdefault(self.signature(line), []).append(line)
        headings = [key for key, group in groups.items() if self.heading_group(group, [line for _, line in samples])]
        headings.sort(key=lambda key: (-self.prominence(groups[key][0]), -(quantised(groups[key][0].size) or 0)))
        if len(headings) >= 2 and len(groups[headings[0]]) <= TITLE_MOST:
            self.roles[headings.pop(0)] = ("title", None)
        for i, key in enumerate(headings):
            self.roles[key] = (HEADING_ROLES[min(i, 2)], i + 1)

    @staticmethod
    def signature(line: Line) -> tuple:
        return quantised(line.size), line.bold, line.italic, line.alignment, upper(line.text)

    def prominence(self, line: Line) -> float:
        """F64: three points for each point of size above the body, and more for bold, centred, right and upper-case lines."""
        size = quantised(line.size) or 0.0
        score = (size - self.body) * 3 + 4 * line.bold + {"center": 3, "right": 1}.get(line.alignment, 0) + 2 * upper(line.text)
        return score - (2 if line.italic and not line.bold and size <= self.body else 0)

    def heading_group(self, group: Sequence[Line], every: Sequence[Line]) -> bool:
        best = max(group, key=self.prominence)
        if self.prominence(best) < HEADING_SCORE:
            return False
        size = quantised(best.size)
        if size >= self.body + BODY_BAND:
            return True
        alike = [line for line in every if quantised(line.size) == size]
        styled = [line for line in alike if line.bold or line.alignment == "center" or upper(line.text)]
        return 0 < len(styled) < len(alike) * STYLED_SHARE

    def role(self, line: Line) -> str | None:
        found = self.roles.get(self.signature(line))
        return found[0] if found else self.sizes.get(quantised(line.size))

    def heading(self, line: Line) -> bool:
        """P10: by its role; where fonts say nothing, by its words."""
        role = self.role(line)
        return role in ("title", *HEADING_ROLES) if role else heading_words(line.text)


def heading_words(text: str, share: float = 0.6, short_needs_capital: bool = True) -> bool:
    """P10: up to ten words: three or fewer with no sentence mark at the end (and a capital, for a line; for a paragraph it needs none), or
    more than `share` of them in capitals, or every word with a capital and no sentence mark at the end."""
    if not regex.search(r"\p{L}", text):
        return False
    found = [w for w in regex.split(r"\s+", text) if w]
    if not found or len(found) > 10:
        return False
    open_end = not regex.search(r"[.!?]$", text, regex.MULTILINE)
    if len(found) <= 3 and open_end and (not short_needs_capital or regex.match(r"\s*\p{Lu}", text)):
        return True
    if sum(w == w.upper() and len(w) > 1 for w in found) > share * len(found):
        return True
    return open_end and all("A" <= w[0] <= "Z" for w in found)


def heading_line(text: str) -> bool:
    """P10, the rule for lines of recognised text: over 80 % of the words in capitals, or all of them like This."""
    found = [w for w in regex.split(r"\s+", text) if w]
    return 0 < len(found) <= 10 and (sum(w == w.upper() for w in found) > 0.8 * len(found) or all(re.fullmatch("[A-Z][a-z]+", w) for w in found))


def median(values: Sequence[float]) -> float:
    kept = sorted(v for v in values if v > 0)
    return 0.0 if not kept else float(np.median(kept))


def indent_limit(lines: Sequence[Line]) -> float:
    """Half of the commonest left edge, in steps of ten points; 20 if that is the margin itself."""
    edges = [int(np.floor(line.x / 10 + 0.5)) * 10 for line in lines if line.x and line.x > 0]
    if not edges:
        return 0.0
    common = Counter(edges).most_common(1)[0][0]
    return common * INDENT_SHARE if common > 0 else 20.0


def breaks(last: Line, line: Line, held: str, fonts: FontRoles, spacing: float, indent: float) -> bool:
    """Whether a line begins a new paragraph after the text held so far."""
    both_headings = fonts.heading(last) and fonts.heading(line) and quantised(last.size) == quantised(line.size) and fonts.signature(last)[:4] == fonts.signature(line)[:4]
    sizes = quantised(last.size), quantised(line.size)
    font = None not in sizes and sizes[0] != sizes[1]
    style = not both_headings and not fonts.heading(last) and ((last.bold, last.italic) != (line.bold, line.italic) or (line.alignment in ("center", "right") and line.alignment != last.alignment))
    numbers = bool(NUMBERS_ONLY.search(line.text))
    role = not both_headings and fonts.heading(last) != fonts.heading(line)
    gaps = [g for g in (last.bottom, line.top) if g is not None]
    space = bool(gaps) and max(gaps) > max(spacing, 0.0 if len(gaps) == 2 else spacing)
    pushed = indent > 0 and last.x is not None and line.x is not None and line.x - last.x >= indent
    finished = bool(FINISHED.search(held.strip()))
    capital = bool(regex.match(r"\s*[\"“‘(]?\p{Lu}", line.text))
    new = line.language != last.language or numbers or font or style or role or (finished and capital and not both_headings)
    new = new or ((space or pushed) and finished and not both_headings)
    if new and MARKERS.match(line.text.strip()):
        new = False
    if line.page != last.page and not (finished or font or style or role or numbers or space or pushed):
        new = False
    return new


@dataclass
class Paragraph:
    """A paragraph: its text, the page that it begins on, its role, font size, and the notes that hang on it."""

    text: str
    page: int
    role: str = "text"
    size: float | None = None
    language: str | None = None
    pages: list[int] = field(default_factory=list)
    notes: dict[str, str] = field(default_factory=dict)


def detected(lines: Sequence[Line]) -> list[Paragraph]:
    """Lines as paragraphs: hyphens at line ends are joined, breaks found one line after another, styles split."""
    fonts = FontRoles(lines)
    spacing, indent = median([line.top for line in lines if line.top is not None]) * SPACING_FACTOR, indent_limit(lines)
    out: list[Paragraph] = []
    held: list[Line] = []

    def flush() -> None:
        for group in by_font(held, fonts):
            text = " ".join(line.text.strip() for line in group).strip()
            if text:
                out.append(Paragraph(text, group[0].page, fonts.role(group[0]) or "text", quantised(group[0].size), group[0].language, sorted({line.page for line in group})))

    for line in lines:
        if held and held[-1].text.endswith("-") and regex.match(r"\p{Ll}", line.text):
            held[-1] = replace(held[-1], text=held[-1].text[:-1] + line.text)
            continue
        if held and breaks(held[-1], line, " ".join(x.text for x in held), fonts, spacing, indent):
            flush()
            held = []
        held.append(line)
    flush()
    return out


def by_font(lines: Sequence[Line], fonts: FontRoles) -> list[list[Line]]:
    """The lines of a paragraph in runs of one style; lone numbers are runs of their own."""
    groups: list[list[Line]] = []
    for line in lines:
        last = groups[-1] if groups else None
        sizes = (quantised(last[-1].size), quantised(line.size)) if last else (None, None)
        split = last is None or bool(NUMBERS_ONLY.search(line.text)) or (None not in sizes and sizes[0] != sizes[1]) or fonts.heading(last[0]) != fonts.heading(line)
        split = split or (not fonts.heading(last[0]) and (last[0].bold, last[0].italic) != (line.bold, line.italic))
        if split:
            groups.append([line])
        else:
            last.append(line)
    return groups


def merged_pages(paragraphs: Iterable[Paragraph]) -> list[Paragraph]:
    """A paragraph goes on the one before if fonts are within 0.6 points and the language is the same, and that one is unfinished or this
    one begins with a small letter."""
    out: list[Paragraph] = []
    for p in paragraphs:
        last = out[-1] if out else None
        close = last is not None and (last.size is None or p.size is None or abs(last.size - p.size) < PAGE_FONT_SLACK) and last.language == p.language
        if close and last.role == p.role and (not UNFINISHED.search(last.text.strip()) or regex.match(r"\p{Ll}", p.text.strip())):
            out[-1] = replace(last, text=" ".join(f"{last.text} {p.text}".split()), pages=sorted({*last.pages, *p.pages}), notes=last.notes | p.notes)
        else:
            out.append(p)
    return out


def with_notes(paragraphs: Iterable[Paragraph]) -> list[Paragraph]:
    """Notes to their places, in two passes. Digits glued to a word, and numbers that stand alone, are markers: of the paragraph before
    if that is finished, else of the next. Then paragraphs that begin with a marker's number on its page are its note, and so are
    smaller paragraphs right behind a note."""
    bodies: dict[int, float] = {}
    rows = list(paragraphs)
    for page in {p.page for p in rows}:
        sizes = Counter(p.size for p in rows if p.page == page and p.size is not None)
        if sizes:
            bodies[page] = sizes.most_common(1)[0][0]
    marked: dict[tuple[int, str], Paragraph] = {}
    kept: list[Paragraph] = []
    waiting: list[tuple[int, str]] = []
    for p in rows:
        if (found := MARKERS.fullmatch(p.text.strip())) and not regex.search(r"\p{L}", p.text):
            last = kept[-1] if kept and kept[-1].page == p.page else None
            for number in regex.findall(r"\d+", found[0]):
                if last is not None and UNFINISHED.search(last.text.strip()):
                    marked[p.page, number] = last
                else:
                    waiting.append((p.page, number))
            continue
        text = INLINE_BEFORE_COLON.sub(r"\1", p.text)
        numbers = [m[2] for m in INLINE_MARKER.finditer(text)]
        p = replace(p, text=INLINE_MARKER.sub(r"\1", text), notes=dict(p.notes))
        for key in [(p.page, n) for n in numbers] + [k for k in waiting if k[0] == p.page]:
            marked[key] = p
        waiting = [k for k in waiting if k[0] != p.page]
        kept.append(p)
    out: list[Paragraph] = []
    open_note: tuple[Paragraph, str] | None = None
    for p in kept:
        m = regex.match(r"(\d{1,3})[)\.\]]*\s+(\S.*)", p.text, regex.DOTALL)
        small = p.size is not None and p.page in bodies and p.size < bodies[p.page] - 1.0
        if m and (p.page, m[1]) in marked and marked[p.page, m[1]] is not p:
            open_note = (marked[p.page, m[1]], m[1])
            open_note[0].notes[m[1]] = m[2]
        elif small and open_note is not None:
            open_note[0].notes[open_note[1]] += " " + p.text
        else:
            open_note = None
            out.append(p)
    for (_, number), p in marked.items():
        p.notes.setdefault(number, "")
    return out


def merged_blocks(paragraphs: Iterable[tuple[str, list[int]]]) -> list[tuple[str, list[int], bool, str]]:
    """recognised paragraphs, cut at blank lines and newlines, put together again: a line goes on the text before it unless that ends in a
    mark or is a heading. Returns text, pages, whether anything was merged, kind."""
    clean = lambda s: " ".join(re.sub(r"<[^>]*>", "", s).split())
    out: list[tuple[str, list[int], bool, str]] = []
    for text, pages in paragraphs:
        for line in (x for block in re.split(r"\n{2,}", text or "") for x in map(clean, block.split("\n")) if x):
            if heading_line(line):
                out.append((line, list(pages), False, "heading"))
            elif out and out[-1][3] != "heading" and not regex.search(r"[.!?？¡!;:]\"?\)?$", out[-1][0]):
                last = out[-1]
                out[-1] = (f"{last[0]} {line}", list(dict.fromkeys([*last[1], *pages])), True, "text")
            else:
                out.append((line, list(pages), False, "text"))
    return out


LINE_COLUMNS = ("text", "page", "size", "bold", "italic", "alignment", "x", "top", "bottom", "language")


def paragraphs(lines: DataFrame, group: str, ordinal: str) -> DataFrame:
    """W22, W23, W25, W26 over a table of lines: per document its paragraphs in order, with notes as a map. Columns of LINE_COLUMNS that the
    table lacks take their defaults; null texts are empty lines. One document is one task's fold; documents spread over the cluster."""
    have = [c for c in LINE_COLUMNS if c in lines.columns]
    schema = T.StructType([lines.schema[group], *T.StructType.fromDDL("paragraph long, page int, role string, text string, pages array<int>, notes map<string,string>")])
    out_types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.map_(pa.string(), pa.string()))

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)).sort_by(ordinal)
        columns = {c: held.column(c).to_pylist() for c in have}
        rows = [Line(**{c: v for c, v in zip(have, values, strict=True) if v is not None or c in ("size", "x", "top", "bottom", "language")} | ({"text": ""} if values[have.index("text")] is None else {})) for values in zip(*columns.values(), strict=True)]
        done = with_notes(merged_pages(detected([r for r in rows if r.text.strip()])))
        values = [[key[0].as_py()] * len(done), list(range(len(done))), [p.page for p in done], [p.role for p in done], [p.text for p in done], [p.pages for p in done], [list(p.notes.items()) for p in done]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (held.schema.field(group).type, *out_types), strict=True)], names=schema.names)

    return lines.select(group, ordinal, *have).groupBy(group).applyInArrow(run, schema)

"""Documents as units of translation: G8 splits a document, G9, G18 and G19 prepare a unit, G10 puts a translation back, G11 renders."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cuewright.functions.sentences import split_sentences

# Elements that stay as they are, elements whose content is translated, and tags that end a run of text.
KEPT_ELEMENTS = "script style svg code pre math"
BLOCKS = "p h1 h2 h3 h4 h5 h6 li td th dt dd blockquote caption title div"
STRUCTURAL = re.compile(r"(<(?:br|hr|img)\b[^>]*>)", re.IGNORECASE)
KEPT = re.compile("|".join(rf"<{e}\b[^>]*>.*?</{e}\s*>" for e in KEPT_ELEMENTS.split()) + "|<!--.*?-->", re.IGNORECASE | re.DOTALL)
BLOCK = re.compile(rf"(<({'|'.join(BLOCKS.split())})\b[^>]*>)((?:(?!<(?:{'|'.join(BLOCKS.split())})\b).)*?)(</\2\s*>)", re.IGNORECASE | re.DOTALL)
LOOSE = re.compile(r"(?<=>)[^<>]+(?=<)|^[^<>]+(?=<)|(?<=>)[^<>]+$")
UNIT = re.compile(r"⟦U([0-9a-f]{64})⟧")
PLACEHOLDER = re.compile(r"__P(\d{4})__")
PLACEHOLDER_WHOLE = re.compile(r"__P\d{4}__")
TAG = re.compile(r"<[^>]+>")
#: Around the number of a value while rules still run; private characters, taken out of sources first.
OPEN, SHUT = "\ue000", "\ue001"


@dataclass(frozen=True)
class Unitized:
    """A document with unit markers in the places of its texts, and the texts by key."""

    template: str
    units: dict[str, str]


def unit_key(source: str, version: str, target: str) -> str:
    return hashlib.sha256("\0".join((version, target, source)).encode()).hexdigest()


def unitize(html: str, version: str = "1", target: str = "de", keep: Callable[[str], bool] = lambda text: False) -> Unitized:
    """Sentences of a document's blocks as units, each text once; everything else stays where it was.

    Protected elements and fragments for which `keep` holds are not touched. White space around a sentence, structural tags
    and text without letters stay in the template, so that putting the sources back gives the document again.
    """
    units: dict[str, str] = {}
    kept: list[str] = []

    def protect(m: re.Match) -> str:
        kept.append(m[0])
        return f"⟦P{len(kept) - 1:x}⟧"

    def unit(text: str) -> str:
        core = text.strip()
        if not core or UNIT.search(core) or keep(core) or not re.search(r"[^\W\d_]", PLACEHOLDER.sub("", re.sub(r"⟦P[0-9a-f]+⟧", "", TAG.sub("", core)))):
            return text
        key = unit_key(core, version, target)
        units.setdefault(key, core)
        at = text.index(core)
        return text[:at] + f"⟦U{key}⟧" + text[at + len(core) :]

    def sentences_of(text: str) -> str:
        out, at = [], 0
        for sentence in split_sentences(text):
            begin = text.index(sentence, at)
            out += [text[at:begin], unit(sentence)]
            at = begin + len(sentence)
        return "".join(out) + text[at:]

    def content(text: str) -> str:
        return "".join(part if STRUCTURAL.fullmatch(part) else sentences_of(part) for part in STRUCTURAL.split(text))

    template = KEPT.sub(protect, html)
    template = BLOCK.sub(lambda m: m[1] + content(m[3]) + m[4], template)
    template = LOOSE.sub(lambda m: m[0] if UNIT.search(m[0]) else content(m[0]), template)
    return Unitized(re.sub(r"⟦P([0-9a-f]+)⟧", lambda m: kept[int(m[1], 16)], template), units)


def rendered(template: str, texts: Mapping[str, str], deepest: int = 20) -> str:
    """A template with the texts of its units, those inside texts too; a unit that holds itself is an error."""
    for _ in range(deepest):
        if not UNIT.search(template):
            return template
        template = UNIT.sub(lambda m: texts[m[1]], template)
    raise ValueError("units hold each other")


@dataclass(frozen=True)
class MaskRule:
    """One rule of preparation. kind: plain (a place to keep), gloss (a term to keep and a gloss that becomes a unit of its own), editorial
    (brackets that become tags with their depth). `applies` may decline a match by what stands around it."""

    name: str
    pattern: re.Pattern
    kind: str = "plain"
    applies: Callable[[re.Match], bool] = lambda m: True


# The rules in order. What an earlier rule has masked, later ones do not see.
MASK_RULES = (
    MaskRule("tag", TAG),
    MaskRule("entity", re.compile(r"&(?:#\d+|#x[\da-fA-F]+|[a-zA-Z]\w+);")),
    MaskRule("address", re.compile(r"https?://[^\s<>]+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+")),
    MaskRule("gloss", re.compile(r"(?P<term>[^\W\d_]*[À-ɏḀ-ỿ][^\W\d_]*) \((?P<gloss>[^()]{3,})\)"), "gloss"),
    MaskRule("editorial", re.compile(r"(?P<open>\[+)(?P<inner>[^\[\]]+)(?P<close>\]+)"), "editorial", lambda m: len(m["open"]) == len(m["close"])),
    MaskRule("marked term", re.compile(r"[^\W\d_]*[ĀāĪīŪūṚṛṄṅÑñṬṭḌḍṆṇŚśṢṣḤḥṂṃ][^\W\d_]*"), applies=lambda m: len(m[0]) > 1),
    MaskRule("number", re.compile(r"(?<![\w.])\d+(?:[.,]\d+)+(?![\w.])")),
)


@dataclass(frozen=True)
class Prepared:
    """A masked text, what each placeholder stands for, and nested units by key."""

    text: str
    tokens: dict[str, str]
    nested: dict[str, str]


def prepare_unit(source: str, rules: Sequence[MaskRule] = MASK_RULES, version: str = "1", target: str = "de") -> Prepared:
    """The text of a unit with placeholders, numbered as they stand. Equal values share none: each place is its own.

    A gloss stays in the value of its place as the marker of a nested unit, as do the contents of long or doubled editorial brackets.
    """
    values: list[str] = []
    nested: dict[str, str] = {}

    def place(value: str) -> str:
        values.append(value)
        return f"{OPEN}{len(values) - 1}{SHUT}"  # not a placeholder yet, so that no rule takes it for text

    def nest(text: str) -> str:
        key = unit_key(text, version, target)
        nested[key] = text
        return f"⟦U{key}⟧"

    def masked(rule: MaskRule, m: re.Match) -> str:
        if OPEN in m[0] or not rule.applies(m):
            return m[0]
        if rule.kind == "gloss":
            return place(f"{m['term']} ({nest(m['gloss'])})")
        if rule.kind == "editorial":
            inner = m["inner"]
            if len(m["open"]) > 1 or len(inner) > 80:
                return place(m["open"] + nest(inner) + m["close"])
            return place(m["open"]) + inner + place(m["close"])
        return place(m[0])

    text = source.replace(OPEN, "").replace(SHUT, "")
    for rule in rules:
        text = rule.pattern.sub(lambda m, rule=rule: masked(rule, m), text)
    order = [int(m) for m in re.findall(f"{OPEN}(\\d+){SHUT}", text)]
    number = {old: new for new, old in enumerate(order, 1)}
    text = re.sub(f"{OPEN}(\\d+){SHUT}", lambda m: f"__P{number[int(m[1])]:04d}__", text)
    return coalesced(Prepared(text, {f"__P{number[old]:04d}__": values[old] for old in order}, nested))


def coalesced(unit: Prepared) -> Prepared:
    """Neighbouring places with nothing but blanks, commas or hyphens between them become one, until there are none; then numbered anew."""
    text, tokens = unit.text, dict(unit.tokens)
    joint = re.compile(r"(__P\d{4}__)([ ,-]{1,2})(__P\d{4}__)")
    while m := next((m for m in joint.finditer(text) if not any(TAG.fullmatch(tokens[m[i]]) or tokens[m[i]][:1] in "[]" for i in (1, 3))), None):
        tokens[m[1]] += m[2] + tokens.pop(m[3])
        text = text[: m.start()] + m[1] + text[m.end() :]
    names = {old: f"__P{i:04d}__" for i, old in enumerate(PLACEHOLDER_WHOLE.findall(text), 1)}
    return Prepared(PLACEHOLDER_WHOLE.sub(lambda m: names[m[0]], text), {names[k]: v for k, v in tokens.items()}, unit.nested)


def restored(translated: str, tokens: Mapping[str, str]) -> str:
    """A translation with the values of its places. Distorted placeholders are repaired: case, blanks and a lost underscore; a place
    that is missing at the beginning or end of the text is put back there. Anything else missing, doubled or unknown is an error."""
    text = re.sub(r"_{1,2}\s*[Pp]\s*(\d{4})\s*_{1,2}", r"__P\1__", translated)
    names = list(tokens)
    found = PLACEHOLDER_WHOLE.findall(text)
    if names and names[0] not in found:
        text, found = f"{names[0]} {text}", [names[0], *found]
    if len(names) > 1 and names[-1] not in found:
        text, found = f"{text.rstrip()} {names[-1]}", [*found, names[-1]]
    if sorted(found) != sorted(names):
        raise ValueError(f"places differ: {sorted(set(names) ^ set(found)) or 'repeated'}")
    return PLACEHOLDER_WHOLE.sub(lambda m: tokens[m[0]], text)


def document_units(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """G8 over a table: per document the runs of its template in order (kind gap, text as it stands) and its units (kind unit, key and masked text).

    Null and empty documents have no rows. Joining gaps and sources in order gives the document again. Narrow plan.
    """
    schema = T.StructType([pages.schema[id_col], *T.StructType.fromDDL("ordinal long, kind string, key string, text string, masked string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for name, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                done = unitize(html or "")
                for i, part in enumerate(p for p in re.split(r"(⟦U[0-9a-f]{64}⟧)", done.template) if p):
                    m = UNIT.fullmatch(part)
                    rows.append((name, i, "unit", m[1], done.units[m[1]], prepare_unit(done.units[m[1]]).text) if m else (name, i, "gap", None, part, None))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()), strict=True)], names=schema.names)

    return pages.select(id_col, html_col).mapInArrow(run, schema)

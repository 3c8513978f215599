"""Checks of a translation against its source (P16, F40-F53): each gives an error code, the first in order wins.

Null texts count as empty. What depends on a language is a parameter (`Lexicon`): the tables here are only those of punctuation.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as markup, markers of protected places, and marks that only a transport may hold.
MARKUP = regex.compile(r"<!--.*?-->|<[^>]+>", regex.DOTALL)
MARKER = regex.compile(r"__P\d{4}__|⟦[UP][^⟧]*⟧")
ENTITY = regex.compile(r"&amp;(?=#\d+|#x[\da-f]+|[a-z]\w+)", regex.IGNORECASE)
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*(?:[-'’]\p{L}[\p{L}\p{M}]*)*")
FORMULA = regex.compile(r"(?<![\p{L}\p{M}])[\p{L}\p{M}]+(?:\s*[+=→]\s*[\p{L}\p{M}]+)+(?![\p{L}\p{M}])")
DELIMITER = regex.compile(r"[()\[\]{}]")
EDITORIAL = regex.compile(r"\[\[?|\]\]?")
CLOSES = {")": "(", "]": "[", "}": "{"}
QUOTE = regex.compile(r"&[lr]dquo;|[“”„«»]", regex.IGNORECASE)
EMPTY_QUOTES = regex.compile(r"&ldquo;\s*&rdquo;|&lsquo;\s*&rsquo;|“\s*”|‘\s*’|«\s*»", regex.IGNORECASE)
FOREIGN = regex.compile(r"[\p{Han}\p{Cyrillic}＀-￯]")
LATIN_TARGETS = frozenset("de en es fr pt".split())


@dataclass(frozen=True)
class Lexicon:
    """What is known of a pair of languages. All of it may be empty; then the checks that need it let everything pass."""

    source: str = "en"
    target: str = "de"
    #: Common words of the source language, endings of its words, words that show prose, and words that join it.
    common: frozenset[str] = frozenset()
    suffixes: str = ""
    anchors: frozenset[str] = frozenset()
    connectors: frozenset[str] = frozenset()
    #: Source words that must not stay in the target, also as parts behind a hyphen or attached to a marked stem.
    retained: frozenset[str] = frozenset()
    retained_parts: frozenset[str] = frozenset()
    attached: frozenset[str] = frozenset()
    #: Words between protected places that must not stay, words and phrases both languages share, and source words that may go.
    protected_connectors: frozenset[str] = frozenset()
    shared_words: frozenset[str] = frozenset()
    shared_phrases: tuple[tuple[str, ...], ...] = ()
    omittable: frozenset[str] = frozenset()
    #: Patterns that are wrong in the target language.
    invalid: tuple[str, ...] = ()
    transport: str = r"(?!)"
    extra: Mapping[str, str] = field(default_factory=dict, hash=False)


def visible(text: str | None) -> str:
    """Text without markup and markers, entities resolved, single spaces."""
    return " ".join(html.unescape(MARKER.sub(" ", MARKUP.sub(" ", text or ""))).split())


def words(text: str | None) -> list[str]:
    return WORD.findall(unicodedata.normalize("NFC", visible(text)).lower())


def line_breaks(text: str | None) -> list[str]:
    """F40."""
    return re.findall(r"\r\n|\r|\n", text or "")


def delimiter_tree(text: str) -> list[str] | None:
    """outermost bracketed groups in any order, as far as they nest; None if they don't."""
    groups: list[str] = []
    open_: list[list[str]] = []  # an opening bracket, then the groups inside it
    for mark in DELIMITER.findall(text):
        if mark not in CLOSES:
            open_.append([mark])
            continue
        if not open_ or open_[-1][0] != CLOSES[mark]:
            return None
        done = "".join(open_.pop()) + mark
        (open_[-1] if open_ else groups).append(done)
    return None if open_ else sorted(groups)


def delimiters_changed(source: str, target: str, language: str) -> bool:
    """brackets must keep their order; in Chinese only their nesting."""
    a, b = visible(source), visible(target)
    tree = delimiter_tree(a) if language == "zh" else None
    if (tree != delimiter_tree(b)) if tree is not None else (DELIMITER.findall(a) != DELIMITER.findall(b)):
        return True
    return EDITORIAL.findall(a) != EDITORIAL.findall(b)


def quotes_balanced(text: str) -> bool:
    """every closing double quote has an opening one before it and none is left open. “ closes a German „."""
    open_: list[str] = []
    for mark in QUOTE.findall(text or ""):
        mark = mark.lower()
        if mark == "“" and open_ and open_[-1] == "„":
            open_.pop()
        elif mark in ("“", "«", "&ldquo;", "„"):
            open_.append(mark)
        elif not open_:
            return False
        else:
            open_.pop()
    return not open_


def introduced_script(source: str, target: str) -> str | None:
    """the first Han, Cyrillic or full-width character that the target has more often than the source."""
    left = Counter(FOREIGN.findall(source or ""))
    for c in FOREIGN.findall(target or ""):
        left[c] -= 1
        if left[c] < 0:
            return c
    return None


def protected_pattern(value: str, latin_only: bool = False) -> regex.Pattern:
    """a value that no letter continues on a side where it has a letter itself. In a target of another script only Latin letters continue it."""

    def border(letter: str) -> str:
        return r"\p{Latin}\p{M}" if latin_only and regex.match(r"\p{Latin}", letter) else r"\p{L}\p{M}"

    first, last = regex.match(r"\p{L}", value), regex.search(r"(\p{L})\p{M}*$", value)
    return regex.compile((f"(?<![{border(first[0])}])" if first else "") + regex.escape(value, special_only=True) + (f"(?![{border(last[1])}])" if last else ""))


def protected_counts(source: str, values: Sequence[str]) -> dict[str, int]:
    return {v: len(protected_pattern(v).findall(source)) for v in dict.fromkeys(values)}


def lost_value(source: str, target: str, values: Sequence[str], language: str) -> str | None:
    """the first protected value that stands less often in the target than in the source."""
    for value, n in protected_counts(source, values).items():
        if not MARKER.search(value) and regex.search(r"\p{L}", visible(value)) and len(protected_pattern(value, language not in LATIN_TARGETS).findall(target)) < n:
            return value
    return None


def without_values(text: str, counts: Mapping[str, int], latin_only: bool = False) -> str:
    for value, n in counts.items():
        if n and not MARKER.search(value):
            text = protected_pattern(value, latin_only).sub(" ", text, count=n)
    return text


def kept_connector(source: str, target: str, connectors: frozenset[str]) -> str | None:
    """a joining word that stands between the same two markers in source and target."""
    if not connectors:
        return None
    some = "|".join(map(regex.escape, sorted(connectors)))
    for left, marks, joiner, right in regex.findall(rf"({MARKER.pattern})([.,;]*)\s+({some})\s+({MARKER.pattern})", source or "", regex.IGNORECASE):
        if regex.search(rf"{regex.escape(left)}{regex.escape(marks)}\s+{regex.escape(joiner)}\s+{regex.escape(right)}", target or "", regex.IGNORECASE):
            return joiner.lower()
    return None


def marked_words(text: str) -> int:
    """Words with a mark on a letter, as transliterations have."""
    return sum(bool(regex.search(r"\p{M}", w)) for w in WORD.findall(unicodedata.normalize("NFD", visible(text))))


def shows_prose(found: Sequence[str], lexicon: Lexicon) -> bool:
    """Whether words can only be prose of the source language."""
    anchors = lexicon.anchors | lexicon.retained | lexicon.protected_connectors
    return any(w in anchors for w in found) or (sum(w in lexicon.common for w in found) >= 2 and any(w in lexicon.connectors for w in found))


def protected_fragment(text: str, lexicon: Lexicon) -> bool:
    """four or more words, few of them common ones, and a quarter (at least two) marked: quoted text that stays as it is."""
    found = words(text)
    if len(found) < 4 or shows_prose(found, lexicon) or sum(w in lexicon.common for w in found) > 0.2 * len(found):
        return False
    marked = marked_words(text)
    return marked >= 2 and marked >= 0.25 * len(found)


def protected_inline(text: str, lexicon: Lexicon) -> bool:
    """a single letter, a single marked word, or several words with a mark and none of them common."""
    found, plain = words(text), visible(text)
    if shows_prose(found, lexicon):
        return False
    if len(found) == 1 and (regex.fullmatch(r"\p{L}\p{M}*[,;]?", plain) or (regex.fullmatch(r"(?:\p{L}\p{M}*)+[,;]?", plain) and marked_words(text))):
        return True
    return len(found) >= 2 and not any(w in lexicon.common for w in found) and marked_words(text) > 0


def formula_or_reference(text: str) -> bool:
    plain = visible(text)
    return bool(regex.search(r"[+=→]", plain) or regex.fullmatch(r"\(.+\b[IVX]+,\s*\d+\)", plain, regex.IGNORECASE) or regex.search(r"\b[A-Z]\.\s*(?:[a-z]+\.)?$", plain))


def untranslated(source: str, target: str, lexicon: Lexicon, protected: bool) -> str | None:
    """omitted prose, prose that stayed the same, or a span of 5 to 12 words of it that did."""
    a, b = words(source), words(target)
    if not a:
        return None
    if not b:
        fine = (protected and all(w in lexicon.omittable for w in a)) or protected_fragment(source, lexicon) or formula_or_reference(source)
        return None if fine else "omitted"
    if a == b and len(a) >= 2 and not formula_or_reference(source) and not protected_fragment(source, lexicon):
        endings = sum(bool(lexicon.suffixes and regex.search(f"(?:{lexicon.suffixes})$", w)) for w in a)
        prose = sum(w in lexicon.common for w in a) >= 2 or endings >= 2 or shows_prose(a, lexicon)
        if prose and not all(w in lexicon.shared_words for w in a) and tuple(a) not in lexicon.shared_phrases:
            return "unchanged"
    a, b = (words(FORMULA.sub(" ", visible(x))) for x in (source, target))
    longest = min(len(a), 12)
    for n in range(longest, 4, -1) if b else ():
        there = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
        need = min(max(4, -(-n * 6 // 10)), 8)
        if any(tuple(a[i : i + n]) in there and sum(w in lexicon.common for w in a[i : i + n]) >= need for i in range(len(a) - n + 1)):
            return "retained span"
    return None


def retained_word(source: str, target: str, lexicon: Lexicon) -> str | None:
    """a word that must not stay and stands in both."""

    def candidates(text: str) -> list[str]:
        out = []
        for w in words(text):
            out += [w, *(p for p in w.split("-") if p in lexicon.retained_parts)]
            out += [s for s in sorted(lexicon.attached) if w.endswith(s) and w != s and regex.search(r"\p{M}", unicodedata.normalize("NFD", w[: -len(s)]))]
        return out

    left = Counter(candidates(source)) if lexicon.retained else Counter()
    return next((w for w in candidates(target) if w in lexicon.retained and left[w] > 0), None) if left else None


def repeats(text: str) -> list[int]:
    """how often sentences of four or more words are repeated, largest first."""
    sentences = (" ".join(words(s)) for s in regex.split(r"(?<=[.!?])[”\]]*\s+", visible(text)))
    return sorted((n for s, n in Counter(s for s in sentences if s).items() if n > 1 and len(s.split()) >= 4), reverse=True)


def validate(source: str | None, target: str | None, lexicon: Lexicon, protected: Sequence[str] = ()) -> str | None:
    """The code of the first check that fails, or None."""
    source, target = source or "", target or ""
    more = lambda pattern: len(pattern.findall(target)) > len(pattern.findall(source))
    if line_breaks(source) != line_breaks(target):
        return "line_breaks"
    if delimiters_changed(source, target, lexicon.target):
        return "delimiters"
    if more(ENTITY):
        return "entities"
    if (quotes_balanced(source) and not quotes_balanced(target)) or more(EMPTY_QUOTES):
        return "quotes"
    if more(regex.compile(lexicon.transport, regex.IGNORECASE)):
        return "markers"
    if lexicon.target in LATIN_TARGETS and introduced_script(source, target):
        return "script"
    if lost_value(source, target, protected, lexicon.target):
        return "protected_values"
    if lexicon.source != lexicon.target:
        if kept_connector(source, target, lexicon.protected_connectors):
            return "untranslated"
        counts = protected_counts(source, protected)
        a, b = without_values(source, counts), without_values(target, counts, lexicon.target not in LATIN_TARGETS)
        if untranslated(a, b, lexicon, bool(counts) or bool(MARKER.search(source))) or retained_word(a, b, lexicon):
            return "untranslated"
        if any(regex.search(p, visible(b), regex.IGNORECASE) for p in lexicon.invalid):
            return "target_language"
    before = repeats(source)
    if any(n > (before[i] if i < len(before) else 1) for i, n in enumerate(repeats(target))):
        return "duplicate_sentence"
    return None


def validate_column(lexicon: Lexicon) -> Callable[[Column, Column], Column]:
    """P16 as an Arrow function of source and target columns."""

    @F.arrow_udf("string")
    def check(source: pa.Array, target: pa.Array) -> pa.Array:
        return pa.array([validate(a, b, lexicon) for a, b in zip(source.to_pylist(), target.to_pylist(), strict=True)], pa.string())

    return check


STRUCTURE = regex.compile(r"<!--.*?-->|<[^>]+>", regex.DOTALL)
INLINE = regex.compile(r"<(/?)(i|em)\b[^>]*>", regex.IGNORECASE)


def structure_compatible(source: str, target: str) -> bool:
    """the same tags in order; or inline tags moved among the others, balanced and in the same shape."""
    a, b = STRUCTURE.findall(source or ""), STRUCTURE.findall(target or "")
    if a == b:
        return True
    inline = [[t for t in x if INLINE.fullmatch(t)] for x in (a, b)]
    if [t for t in a if not INLINE.fullmatch(t)] != [t for t in b if not INLINE.fullmatch(t)] or Counter(inline[0]) != Counter(inline[1]):
        return False
    if len(inline[0]) <= 2:
        return inline[0] == inline[1]
    shape = lambda tags: [t.startswith("</") for t in tags]
    return not tags_balanced(inline[0]) or (tags_balanced(inline[1]) and shape(inline[0]) == shape(inline[1]))


def tags_balanced(tags: Sequence[str]) -> bool:
    open_: list[str] = []
    for tag in tags:
        closing, name = INLINE.fullmatch(tag).groups()
        if not closing:
            open_.append(name.lower())
        elif not open_ or open_.pop() != name.lower():
            return False
    return not open_


# Checks that are plain expressions.


def breaks_kept(source: Column, target: Column) -> Column:
    """F40, X6."""
    found = lambda c: F.regexp_extract_all(c, F.lit("\r\n|\r|\n"), 0)
    return found(source) == found(target)


def no_new(source: Column, target: Column, pattern: str) -> Column:
    """a pattern stands no more often in the target than in the source."""
    return F.regexp_count(target, F.lit(pattern)) <= F.regexp_count(source, F.lit(pattern))


def no_new_script(source: Column, target: Column) -> Column:
    """the target holds no Han, Cyrillic or full-width character more often than the source."""
    found = lambda c: F.regexp_extract_all(c, F.lit(r"[\p{IsHan}\p{IsCyrillic}\x{FF00}-\x{FFEF}]"), 0)
    a, b = found(source), found(target)
    return F.forall(F.array_distinct(b), lambda x: F.size(F.filter(b, lambda y: y == x)) <= F.size(F.filter(a, lambda y: y == x)))


def invalid_phrase(target: Column, patterns: Sequence[str]) -> Column:
    """the place of the first pattern that stands in the target, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for i in range(len(patterns), 0, -1):
        out = F.when(target.rlike(f"(?i){patterns[i - 1]}"), i).otherwise(out)
    return out


def single_dashes(source: str, target: str) -> str:
    """a run of the same dash that the source does not have becomes one dash."""
    return regex.sub(r"([-–—])(?:\s*\1)+", lambda m: m[0] if m[0] in (source or "") else m[1], target or "")


# Full-width marks and what stands for them in Latin text.
FULL_WIDTH = str.maketrans("，。：；！？（）", ",.:;!?()")


def latin_marks(target: str, language: str) -> str:
    """full-width punctuation as plain marks, in targets of Latin script."""
    return (target or "").translate(FULL_WIDTH) if language in LATIN_TARGETS else target


def entities_kept(source: str, target: str) -> str:
    """an entity of the source that the target holds as its character is put back, as often as the source has it."""
    out = target or ""
    for entity, n in Counter(regex.findall(r"&(?:#\d+|#x[\da-fA-F]+|[a-zA-Z]\w+);", source or "")).items():
        character = html.unescape(entity)
        lacking = n - out.count(entity)
        if character != entity and lacking > 0 and character not in "&<>":
            out = out.replace(character, entity, lacking)
    return out


def anchors_in_order(source: str, target: str, anchor: str = r"⟦[UP][^⟧]*⟧", movable: str = r"<(/?)(?:i|em)\b[^>]*>") -> bool:
    """fixed anchors keep their order; movable inline pairs may stand elsewhere, but as often."""
    fixed = [regex.findall(anchor, x or "") for x in (source, target)]
    moved = [Counter(m[0] for m in regex.finditer(movable, x or "", regex.IGNORECASE)) for x in (source, target)]
    return fixed[0] == fixed[1] and moved[0] == moved[1]


def editorial_depth(text: str) -> list[int]:
    """how deep editorial brackets are nested at each opening one."""
    depth, out = 0, []
    for mark in regex.findall(r"\[|\]", text or ""):
        if mark == "[":
            depth += 1
            out.append(depth)
        else:
            depth = max(0, depth - 1)
    return out

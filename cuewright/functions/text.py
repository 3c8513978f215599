"""Text functions as column expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_ws(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def present(text: Column) -> Column:
    """Null for a blank text."""
    return F.nullif(norm_ws(text), F.lit(""))


def plain(text: Column) -> Column:
    """without tags, soft hyphens and zero-width characters; Unicode spaces as one space."""
    stripped = F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", ""), r"[\u00ad\u200b\u200c\u200d\u2060\ufeff]", "")
    return F.btrim(F.regexp_replace(stripped, r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " "))


def alphabetic_words(text: Column) -> Column:
    """letter runs in small letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), 0)


def ends_sentence(text: Column) -> Column:
    """whether a text ends in a terminator, closing quotes and brackets aside."""
    return text.rlike(r"[.!?…。！？][\"'”’)\]]*\s*$")


def speakable(text: Column) -> Column:
    """Not blank, and more than punctuation and symbols."""
    return text.rlike(r"[\p{L}\p{N}]")


def noise(text: Column) -> Column:
    """A line of at least four single digits between dots, with white space anywhere between."""
    return F.exists(F.split(text, "\n"), lambda line: line.rlike(r"^\s*[0-9](?:\s*\.\s*[0-9]){3,}\.?\s*$"))


# Schemes of the web, and what a word needs to be an address without one.
WEB = r"(?i)^https?://"
ADDRESS = r"(?i)^(?:https?://)?(?:[a-z0-9-]+\.)+[a-z]{2,}(?::\d+)?(?:[/?#][^\s]*)?$"


def url_normalised(url: Column) -> Column:
    """with https:// in front where no web scheme stands; null for a blank or one without a host."""
    trimmed = F.nullif(F.regexp_replace(url, r"^\s+|\s+$", ""), F.lit(""))
    whole = F.when(trimmed.rlike(WEB), trimmed).otherwise(F.concat(F.lit("https://"), trimmed))
    return F.when(whole.rlike(r"(?i)^https?://[^/?#\s]+"), whole)


def url_display(url: Column) -> Column:
    """the normal form without scheme and www."""
    return F.regexp_replace(F.regexp_replace(url_normalised(url), WEB, ""), r"(?i)^www\.", "")


def url_token(word: Column) -> Column:
    """Whether a word is a web address, with or without a scheme."""
    return F.coalesce(word.rlike(ADDRESS), F.lit(False))


def trailing_urls(text: Column) -> Column:
    """the addresses that stand alone in the last paragraphs of a text, with the blank lines before them."""
    return F.nullif(F.regexp_extract(text, r"(?i)((?:\n\n(?:https?://)?(?:[a-z0-9-]+\.)+[a-z]{2,}(?::\d+)?(?:[/?#][^\s]*)?)+)\z", 1), F.lit(""))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def safe_name(text: Column, longest: int = 80) -> Column:
    """A file name: slashes as commas, no quotes or control characters, cut to a length."""
    return F.left(norm_ws(F.regexp_replace(F.regexp_replace(text, "/", ", "), "[\"'\\x00-\\x1f]", "")), F.lit(longest))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), "^-|-$", "")


def redacted(text: Column) -> Column:
    """without commands on cookies, bot tokens, credentials behind their header names, and queries of web addresses."""
    # What is hidden, in this order.
    out = F.regexp_replace(text, r"(?i)/cookies\b[^\r\n]*", "/cookies [REDACTED]")
    out = F.regexp_replace(out, r"bot[0-9]+:[A-Za-z0-9_-]+", "bot[REDACTED]")
    out = F.regexp_replace(out, r"(?i)\b(authorization|cookie|set-cookie)\s*[:=]\s*[^\r\n]+", "$1: [REDACTED]")
    return F.regexp_replace(out, r"(https?://[^\s?]+)\?[^\s]+", "$1?[REDACTED]")


# Characters that a chat's markup escapes.
FORMAT_MARKS, OTHER_MARKS = "*_`", "#/[]()'\"~+-=|{}.!?<>"


def escaped(text: Column, marks: str = FORMAT_MARKS + OTHER_MARKS) -> Column:
    """a backslash before each of the marks. `#` is escaped twice, as it stands in the list twice."""
    import re

    once = F.regexp_replace(text, "([" + re.escape(marks) + "])", r"\\$1")
    return F.regexp_replace(once, "#", r"\\#") if "#" in marks else once


def html_escaped(text: Column) -> Column:
    """with entities for the five characters of markup; null for a blank."""
    out = text
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return F.when(text.rlike(r"\S"), out)


def unlabelled(text: Column) -> Column:
    """without a label such as "Translation:" in front."""
    # Labels.
    return F.regexp_replace(text, r"(?i)^(?:translation|translated(?:\s+text)?|answer|response)\s*:\s*", "")


MARKED = r"([\p{L})\].,;:\"])([0-9]{1,3})"


def without_markers(text: Column) -> Column:
    """without up to three digits that are glued to a letter or mark, before white space, a colon or the end."""
    return F.regexp_replace(F.regexp_replace(text, MARKED + r"(?=\s*:)", "$1"), MARKED + r"(?=\s|$)", "$1")


def markers(text: Column) -> Column:
    """the digits that were taken away; those before a colon go without being kept."""
    return F.regexp_extract_all(F.regexp_replace(text, MARKED + r"(?=\s*:)", "$1"), F.lit(MARKED + r"(?=\s|$)"), 2)


def packed_entities(text: Column) -> Column:
    """number of escaped entities."""
    return F.regexp_count(text, F.lit(r"&(#[0-9]+|#x[0-9a-fA-F]+|[A-Za-z]+);"))


def line_breaks(text: Column) -> Column:
    """the line breaks of a text, in order."""
    return F.regexp_extract_all(text, F.lit("\r\n|\r|\n"), 0)


def multiset_diff(left: Column, right: Column) -> Column:
    """Elements that left has more often than right, as many times as it has more, in order of value."""
    counts = F.transform(F.array_sort(F.array_distinct(left)), lambda x: F.struct(x.alias("x"), (F.size(F.filter(left, lambda y: y == x)) - F.size(F.filter(right, lambda y: y == x))).alias("n")))
    return F.flatten(F.transform(F.filter(counts, lambda c: c["n"] > 0), lambda c: F.array_repeat(c["x"], c["n"])))


def semantic(text: Column) -> Column:
    """breaks as spaces, without tags, entities resolved, single spaces."""
    import html

    @F.arrow_udf("string")
    def unescape(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else html.unescape(v) for v in values.to_pylist()], pa.string())

    plain_ = F.regexp_replace(F.regexp_replace(text, r"(?i)<br\s*/?\s*>", " "), r"<[^>]*>", "")
    return norm_ws(F.when(plain_.contains("&"), unescape(plain_)).otherwise(plain_))


def sentences_simple(text: Column) -> Column:
    """F8: cut behind a terminator before a capital; only what can be spoken."""
    marked = F.regexp_replace(plain(text), r"([.!?…]\"?)\s+(?=\p{Lu})", "$1\n")
    return F.filter(F.split(marked, r"\n+"), lambda s: speakable(s))


def publication_input(fields: dict[str, Column], sample: Column, filename: Column) -> Column:
    """the name of a file (or that of its source), what is known of the publication, and sample pages, blocks apart by a blank line."""
    known = [k for k in ("title", "author", "pdf_author", "language", "page_count") if k in fields]  # fixed values
    some = lambda c: F.when(c.rlike(r"\S"), c)
    name = F.coalesce(some(F.btrim(filename)), some(fields["source_name"]) if "source_name" in fields else F.lit(None))
    lines = F.concat_ws(", ", *(F.concat(F.lit(f"{k}: "), some(fields[k].cast("string"))) for k in known))
    return F.concat_ws("\n\n", F.concat(F.lit("Filename: "), name), F.concat(F.lit("Metadata:\n"), lines), F.concat(F.lit("Sample pages:\n"), sample))


def voice_option(value: Column) -> Column:
    """a voice's description: underscores as blanks, hyphens before pitch and accent too, medium pitch as moderate, blank parts left out."""
    spaced = F.regexp_replace(F.regexp_replace(F.replace(value, F.lit("_"), F.lit(" ")), r"-pitch\b", " pitch"), r"-accent\b", " accent")
    parts = F.transform(F.split(F.regexp_replace(spaced, r"\bmedium pitch\b", "moderate pitch"), ","), lambda p: F.btrim(p))
    return F.array_join(F.filter(parts, lambda p: p != ""), ", ")


def unfenced(text: Column) -> Column:
    """JSON without the fences of a code block around it."""
    out = F.regexp_replace(F.regexp_replace(F.btrim(text, F.lit(" \t\r\n")), r"(?i)^```json\s*", ""), r"^```\s*", "")
    return F.btrim(F.regexp_replace(out, r"```\s*$", ""), F.lit(" \t\r\n"))


def short_title(text: Column) -> Column:
    """a title, out of JSON where it is that (its title, or the first of a list), without brackets and quotes around it, at most 120 characters."""
    trimmed = F.btrim(text, F.lit(" \t\r\n"))
    parsed = F.coalesce(F.get_json_object(trimmed, "$.title"), F.get_json_object(trimmed, "$[0]"))
    bare = F.regexp_replace(F.coalesce(parsed, trimmed), r"^[\[\"]+|[\]\"]+$", "")
    return F.left(norm_ws(bare), F.lit(120))


def translated_name(original: Column, text: Column) -> Column:
    """a translated name fit for a file; the original where nothing is left of it."""
    return F.coalesce(present(F.regexp_replace(text, r"[/\\\\\u0000]", " ")), original)


def css_rules(size: Column, alignment: Column, bold: Column, italic: Column, color: Column) -> Column:
    """declarations of a style; what is null or false has none."""
    points = F.concat(F.regexp_replace(F.round(size, 1).cast("string"), r"\.0$", ""), F.lit("pt"))
    return F.concat_ws("; ", F.concat(F.lit("font-size: "), points), F.concat(F.lit("text-align: "), alignment), F.when(bold, "font-weight: bold"), F.when(italic, "font-style: italic"), F.concat(F.lit("color: "), color))


def style_json(**attributes: Column) -> Column:
    """a style as JSON, without what is null; `from_json` reads it back."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in attributes.items())))

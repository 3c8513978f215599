"""Captions, tags and targets of messages."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from cuewright.functions import text as t

# A public post's address, and the factor between the number in it and a message id.
POST = r"^https://t\.me/([A-Za-z0-9_]+)/([0-9]+)(?:[?#].*)?$"
MESSAGE_FACTOR = 1_048_576


def post_target(url: Column) -> Column:
    """user name, post number and message id of a public post's address; another address is an error."""
    number = F.regexp_extract(url, POST, 2).cast("long")
    found = F.struct(F.regexp_extract(url, POST, 1).alias("username"), number.alias("post_id"), (number * MESSAGE_FACTOR).alias("message_id"))
    return F.when(url.rlike(POST), found).otherwise(F.raise_error(F.concat(F.lit("not a post: "), url)).cast("struct<username:string,post_id:bigint,message_id:bigint>"))


def shortened(text: Column, size: int = 1024, percent: float | None = 100) -> Column:
    """a text cut to a share of a limit; one that fits stays."""
    most = int(size * percent / 100) if percent is not None else size
    return F.when(F.length(text) > most, F.left(text, F.lit(most))).otherwise(text)


def hashtags(tags: Column) -> Column:
    """F16: tags of one or two words without signs, as #CamelCase, each once, in order."""

    def one(tag: Column) -> Column:
        words = F.split(F.regexp_replace(F.btrim(tag), "^#", ""), r"\s+")
        clean = F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}_]", "")))
        parts = F.split(F.array_join(clean, "_"), "_")
        camel = F.array_join(F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, 2, 1 << 30))), "")
        return F.when((F.size(words) <= 2) & ~F.exists(clean, lambda w: w == ""), F.concat(F.lit("#"), camel))

    return F.array_join(F.array_distinct(F.filter(F.transform(tags, one), lambda x: x.isNotNull())), " ")


def italic(text: Column) -> Column:
    """every run of lines between newlines in underscores, its marks escaped."""
    parts = F.split(F.regexp_replace(text, r"(\n+)", "\u0000$1\u0000"), "\u0000")
    return F.array_join(F.transform(parts, lambda p: F.when((p == "") | p.rlike(r"^\n+$"), p).otherwise(F.concat(F.lit("_"), t.escaped(p), F.lit("_")))), "")


def caption(title: Column, uploader: Column, description: Column, url: Column, tags: Column) -> Column:
    """title and uploader, description, address and tags, blocks apart by a blank line; what is missing or blank is left out."""
    some = lambda c: F.when(c.rlike(r"\S"), c)
    head = F.concat_ws("\n", italic(some(title)), t.escaped(uploader))
    blocks = F.array(F.nullif(head, F.lit("")), italic(F.btrim(some(description))), t.escaped(t.url_display(url)), t.escaped(some(tags)))
    return F.array_join(F.filter(blocks, lambda b: b.isNotNull()), "\n\n")


def unescaped(text: Column, markdown: bool = True) -> Column:
    """an escaped mark that formats nothing as itself."""
    return F.regexp_replace(text, r"\\([" + re.escape(t.OTHER_MARKS) + "])", "$1") if markdown else text


def cut_markdown(text: str, limit: int) -> str:
    """a text cut to a limit that ends neither in an escape nor inside underscores."""
    out = text[:limit]
    if out.endswith("\\"):
        out = out[:-1]
    if len(regex.findall(r"(?<!\\)_", out)) % 2:
        out = (out if len(out) < limit else out[:-1]) + "_"
    return out


URLS = regex.compile(r"(?:\n\n(?:https?://)?(?:[a-z0-9-]+\.)+[a-z]{2,}(?::\d+)?(?:[/?#][^\s]*)?)+$", regex.IGNORECASE)


def cut_album(text: str, limit: int) -> str:
    """as `cut_markdown`, but addresses in the last paragraphs stay, if they leave room."""
    found = URLS.search(text)
    if not found or len(found[0]) >= limit:
        return cut_markdown(text, limit)
    return cut_markdown(text[: found.start()].rstrip(), limit - len(found[0])) + found[0]


def fitted(title: str, render: Callable[[str], str], limit: int) -> str:
    """The caption of the longest beginning of a title that fits, by halving; that of no title if none does."""
    best, low, high = None, 0, len(title)
    while low <= high:
        middle = (low + high) // 2
        text = render(title[:middle])
        if len(text) <= limit:
            best, low = text, middle + 1
        else:
            high = middle - 1
    return render("") if best is None else best


def split_for_translation(text: str) -> tuple[list[list[str]], str]:
    """sentences of each paragraph of a caption (runs of newlines stand alone), and the addresses at its end that stay."""
    urls = re.search(r"(?:\s+https?://\S+)+\s*$", text)
    body = text[: urls.start()].strip() if urls else text
    return [[p] if not p.strip() else re.split(r"(?<=[.!?])\s+", p) for p in re.split(r"(\n{2,})", body) if p], urls[0].strip() if urls else ""


def rejoined(parts: list[list[str]], urls: str) -> str:
    """the caption of translated sentences, with its addresses."""
    return " ".join(x for x in ("".join(" ".join(p) for p in parts), urls) if x)


def cut_column(limit: int, album: bool = False) -> Callable[[Column], Column]:
    """F29 as an Arrow function."""
    cut = cut_album if album else cut_markdown

    @F.arrow_udf("string")
    def shorten(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else cut(x, limit) for x in texts.to_pylist()], pa.string())

    return shorten

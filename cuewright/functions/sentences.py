"""Splitting text into sentences and paragraphs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words whose full stop does not end a sentence, and marks that end one or close a quotation.
HONORIFICS = frozenset("mr mrs ms dr st prof sr jr no vs etc".split())
END = re.compile(r"[.!?…]+[\"'”’)\]]*(?=\s|$)|[。！？]+[”’」』）]*")
SOFT = (re.compile(r"(?<=[;:])\s"), re.compile(r"(?<=,)\s"), re.compile(r"\s"))


def split_sentences(text: str) -> list[str]:
    """Sentences with their marks. CJK marks need no space behind them; an honorific or an initial goes on."""
    out, start = [], 0
    for m in END.finditer(text):
        word = text[start : m.start()].rsplit(None, 1)[-1:] or [""]
        stem = word[0].lower().strip("(\"'“‘")
        if m[0].startswith(".") and len(m[0]) == 1 and (stem in HONORIFICS or (len(stem) == 1 and stem.isalpha() and stem != "i")):
            continue
        out.append(text[start : m.end()].strip())
        start = m.end()
    return [s for s in [*out, text[start:].strip()] if s]


def split_long(sentence: str, longest: int) -> list[str]:
    """Parts of at most `longest` characters: at semicolons and colons, else commas, else spaces, else anywhere."""
    out, rest = [], sentence
    while len(rest) > longest:
        head = rest[: longest + 1]  # a mark's space may stand right behind the last character that fits
        cut = next((c for mark in SOFT if (c := max((m.start() for m in mark.finditer(head)), default=0))), longest)
        out.append(rest[:cut].strip())
        rest = rest[cut:].strip()
    return [x for x in [*out, rest] if x]


def sentence_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int | None = None) -> DataFrame:
    """One row per sentence: id, sentence_idx, text. Narrow plan; null and blank texts have none."""
    schema = T.StructType([docs.schema[id_col], T.StructField("sentence_idx", T.LongType()), T.StructField("text", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(key, i, s) for key, text in zip(f.iloc[:, 0], f.iloc[:, 1], strict=True) for i, s in enumerate(p for x in split_sentences(text or "") for p in (split_long(x, longest) if longest else [x]))]
            yield pd.DataFrame(rows, columns=schema.names)

    return docs.select(id_col, text_col).mapInPandas(run, schema)


def paragraphs(text: Column) -> Column:
    """At blank lines if there are any, else at each newline; without blank ones."""
    unix = F.regexp_replace(text, "\r\n?", "\n")
    parts = F.when(unix.rlike(r"\n[ \t]*\n"), F.split(unix, r"\n[ \t]*\n\s*")).otherwise(F.split(unix, "\n"))
    return F.filter(F.transform(parts, lambda p: F.btrim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")

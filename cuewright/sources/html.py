"""HTML pages as blocks of text (S14): what is not read is dropped, the top-most block elements stay."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Elements that are dropped (with those that only a block drops), that are blocks, that have no end, and sizes of headings in points.
DROPPED = frozenset("script style noscript template nav form button svg sup".split())
BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote pre dt dd figcaption caption th td center".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADING_SIZES = {"h1": 24.0, "h2": 22.0, "h3": 20.0, "h4": 18.0, "h5": 16.0, "h6": 14.0}
BODY_SIZE = 12.0


class Blocks(HTMLParser):
    """Collects (tag, level, font size, language, text) of the blocks, and the title."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str | None]] = []
        self.dropped = 0
        self.block: list[str] | None = None
        self.depth, self.tag = 0, ""
        self.title: list[str] = []
        self.rows: list[tuple[str, int, float, str | None, str]] = []

    def language(self) -> str | None:
        return next((lang for _, lang in reversed(self.stack) if lang), None)

    def flush(self) -> None:
        if self.block is not None:
            text = " ".join("".join(self.block).split())
            if text:
                level = int(self.tag[1]) if self.tag in HEADING_SIZES else 0
                self.rows.append((self.tag, level, HEADING_SIZES.get(self.tag, BODY_SIZE), self.language(), text))
        self.block = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            if tag == "br" and self.block is not None:
                self.block.append(" ")
            return
        self.stack.append((tag, dict(attrs).get("lang")))
        if tag in DROPPED:
            self.dropped += 1
        elif not self.dropped and tag in BLOCKS and self.block is None:
            self.block, self.tag, self.depth = [], tag, len(self.stack)

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            if self.block is not None and len(self.stack) == self.depth:
                self.flush()
            open_tag, _ = self.stack.pop()
            self.dropped -= open_tag in DROPPED
            if open_tag == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.dropped:
            return
        if self.stack and self.stack[-1][0] == "title":
            self.title.append(data)
        elif self.block is not None:
            self.block.append(data)


BLOCK = T.StructType([T.StructField("block_idx", T.LongType()), T.StructField("tag", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("font_size", T.DoubleType()), T.StructField("language", T.StringType()), T.StructField("text", T.StringType())])


def blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per block of each page; pages spread over the cluster, in Arrow batches, without a shuffle."""
    schema = T.StructType([pages.schema[id_col], *BLOCK])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parser = Blocks()
                parser.feed(html or "")
                parser.close()
                parser.flush()
                rows += [(key, i, *r) for i, r in enumerate(parser.rows)]
            columns = list(zip(*rows, strict=True)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return pages.select(id_col, html_col).mapInArrow(run, schema)

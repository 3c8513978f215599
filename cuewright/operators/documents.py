"""Structure of documents from their lines: fonts, headings, alignment, page selection."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Geometry of alignment, and what tells a table of contents from other pages.
CENTRE_SLACK, CENTRE_SIDE, CENTRE_SPAN, RIGHT_EDGE = 0.08, 0.18, 0.55, 0.25
HEADING_WORDS = 10
TOC_LINES, TOC_SHARE, PUBLICATION_SCAN, PUBLICATION_PAGES = 5, 0.3, 40, 5


def quantised(size: Column) -> Column:
    """F64: font sizes in halves of a point; none for a missing or non-positive size."""
    return F.when(size > 0, F.floor(size * 2 + 0.5) / 2)


def alignment(x: Column, x_max: Column, width: Column) -> Column:
    """F64: centre if the middle is within 8 % of the page's and both margins and the span allow it; right if the right margin is less than half
    the left one, which is a quarter of the page at least; else left. Null without a page width."""
    edge = F.when(x_max <= x, x).otherwise(x_max)
    right = width - edge
    middle = F.abs((x + edge) / 2 - width / 2)
    centred = (middle <= width * CENTRE_SLACK) & (x > width * CENTRE_SIDE) & (right > width * CENTRE_SIDE) & (edge - x <= width * CENTRE_SPAN)
    return F.when(width > 0, F.when(centred, "center").when((right + 2 < x * 0.5) & (x > width * RIGHT_EDGE), "right").otherwise("left"))


def font_roles(lines: DataFrame, group: str = "doc_id", ordinal: str = "line_idx") -> DataFrame:
    """Per document the styles of its lines with their roles and levels, by `paragraphs.FontRoles`: group, size, bold, alignment, uppercase, role, level.

    Columns: font_size, bold, italic, alignment, text. Styles are counted first, so what one document brings together are its different styles.
    """
    from cuewright.operators import paragraphs

    upper = F.col("text").rlike(r"\p{L}") & (F.col("text") == F.upper("text"))
    styles = (
        lines.groupBy(group, quantised(F.col("font_size")).alias("size"), "bold", "italic", "alignment", upper.alias("uppercase")).agg(F.count("*").alias("n"), F.min(ordinal).alias("first")).filter("size IS NOT NULL")
    )
    schema = T.StructType([lines.schema[group], *T.StructType.fromDDL("size double, bold boolean, italic boolean, alignment string, uppercase boolean, role string, level int")])

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)).sort_by("first").to_pylist()
        sample = lambda r: paragraphs.Line("A" if r["uppercase"] else "Aa", size=r["size"], bold=bool(r["bold"]), italic=bool(r["italic"]), alignment=r["alignment"] or "left")
        fonts = paragraphs.FontRoles([sample(r) for r in held for _ in range(r["n"])])
        found = [fonts.roles.get(fonts.signature(sample(r))) or (fonts.sizes.get(r["size"]), None) for r in held]
        columns = [[r[c] for r in held] for c in (group, "size", "bold", "italic", "alignment", "uppercase")] + [[role for role, _ in found], [level for _, level in found]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, to_arrow_schema(schema).types, strict=True)], names=schema.names)

    return styles.groupBy(group).applyInArrow(run, schema)


def heading_like(text: Column, short_needs_capital: bool = True) -> Column:
    """P10: up to ten words: three or fewer without a sentence mark at the end (and with a capital, for a line), or over 60 % in capitals, or all with
    a capital and no sentence mark at the end."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    open_end = ~text.rlike(r"(?m)[.!?]$")
    short = (F.size(words) <= 3) & open_end & (text.rlike(r"^\s*\p{Lu}") if short_needs_capital else F.lit(True))
    shouted = F.size(F.filter(words, lambda w: (w == F.upper(w)) & (F.length(w) > 1))) > F.size(words) * 0.6
    capital = F.forall(words, lambda w: w.rlike("^[A-Z]")) & open_end
    return text.rlike(r"\p{L}") & (F.size(words) > 0) & (F.size(words) <= HEADING_WORDS) & (short | shouted | capital)


def heading_line(text: Column) -> Column:
    """P10, for lines of recognised text: up to ten words, over 80 % in capitals or all of them like This."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    shouted = F.size(F.filter(words, lambda w: w == F.upper(w))) > F.size(words) * 0.8
    return (F.size(words) > 0) & (F.size(words) <= HEADING_WORDS) & (shouted | F.forall(words, lambda w: w.rlike("^[A-Z][a-z]+$")))


def contents_pages(lines: DataFrame, group: str = "doc_id") -> DataFrame:
    """Pages that look like a table of contents: five or more lines with dot leaders, and 30 % of them."""
    leader = F.count_if(F.col("text").rlike(r"\.{3,}\s*[0-9ivxlc]+\s*$"))
    pages = lines.groupBy(group, "page").agg(F.count("*").alias("lines"), leader.alias("leaders"))
    return pages.filter((F.col("lines") >= TOC_LINES) & (F.col("leaders") >= TOC_LINES) & (F.col("leaders") >= F.col("lines") * TOC_SHARE)).select(group, "page")


def publication_pages(lines: DataFrame, group: str = "doc_id") -> DataFrame:
    """The first five of the first forty pages that are no contents; if all of them are, the first five."""
    pages = lines.select(group, "page").distinct()
    first = pages.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy("page"))).filter(F.col("_n") <= PUBLICATION_SCAN)
    marked = first.join(contents_pages(lines, group).withColumn("_toc", F.lit(True)), [group, "page"], "left").withColumn("_toc", F.coalesce("_toc", F.lit(False)))
    all_toc = F.min(F.col("_toc").cast("int")).over(Window.partitionBy(group)) == 1
    kept = marked.withColumn("_all", all_toc).filter(~F.col("_toc") | F.col("_all"))
    return kept.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy("page"))).filter(F.col("_k") <= PUBLICATION_PAGES).select(group, "page")

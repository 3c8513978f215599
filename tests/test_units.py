"""Sentences, masking and rendering to a fixed point."""

import re

import pytest
from pyspark.sql import functions as F

from cuewright.functions import sentences
from cuewright.operators import units


def test_sentences():
    assert sentences.split_sentences("Dr. Who came. “Really?” he said! 你好。再见") == ["Dr. Who came.", "“Really?”", "he said!", "你好。", "再见"]
    assert sentences.split_sentences("J. Doe left...  Then 3.5 more") == ["J. Doe left...", "Then 3.5 more"]
    assert sentences.split_sentences("") == []
    parts = sentences.split_long("one two; three four, five six seven", 12)
    assert parts == ["one two;", "three four,", "five six", "seven"] and sentences.split_long("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]


def test_sentence_rows(spark):
    df = spark.createDataFrame([(1, "One. Two."), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r) for r in sentences.sentence_rows(df).orderBy("sentence_idx").collect()] == [(1, 0, "One."), (1, 1, "Two.")]


def test_paragraphs(spark):
    f = lambda x: spark.range(1).select(sentences.paragraphs(F.lit(x))).first()[0]
    assert f("a\nb\r\n\r\nc  d") == ["a b", "c d"] and f("a\n b \n") == ["a", "b"]


def test_masks():
    text, tokens = units.mask("see <b>x</b> and <b>y</b> ⟦0⟧ at 12", [re.compile(r"<[^>]*>"), re.compile(r"\d+")])
    assert "<" not in text and len(tokens) == 4 and units.restore(text, tokens) == "see <b>x</b> and <b>y</b> ⟦0⟧ at 12"
    with pytest.raises(ValueError):
        units.restore("nothing", tokens)


def test_links_to_their_ends(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints")
    chain = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 100), (99, 100)]
    got = {r.node: (r.root, r.steps) for r in units.resolved(spark.createDataFrame(chain, "node long, target long")).collect()}
    assert got == {i: (20, 20 - i) for i in range(20)} | {k: (None, None) for k in (99, 100, 101)}


def test_pending_units(spark):
    rows = spark.createDataFrame([("k1", 1, 0, "a"), ("k1", 0, 3, "b"), ("k2", 0, 0, "c")], "key string, doc_id long, ordinal long, text string")
    cache = spark.createDataFrame([("k2",)], "key string")
    assert [tuple(r) for r in units.pending(rows, cache).collect()] == [("k1", 0, 3, "b")]
    assert spark.range(1).select(units.unit_key("v1", "fr", F.lit("x"))).first()[0] == __import__("hashlib").sha256(b"v1\x1ffr\x1fx").hexdigest()

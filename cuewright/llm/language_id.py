"""Operator 10, language identification: multilingual mixture inference.

A language is a distribution over letter trigrams (of lower-cased words with their edges), counted over
all documents that may be learned from. A text is a mixture of languages: expectation-maximisation
estimates the share of each from the likelihoods of its words, and the set of languages is the one
with the best likelihood less a penalty for every language in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.llm.common import arrow_schema, lean, packets, picked, prepare, released, written
from cuewright.llm.words import words_of

#: Trigrams fall into 2 ** BITS buckets; SMOOTHING is added to each count.
BITS, SMOOTHING = 16, 0.5
#: Steps of EM, and the price of a language in units of log(words) / 2.
STEPS, PENALTY = 12, 2.0
#: Log-likelihood of a trigram under the background model, for which all buckets are alike.
BACKGROUND = -BITS * float(np.log(2))
#: A word says no more for one language against another than this (natural logarithm).
WORD_CAP = 12.0
#: The most languages that may be learned: bounds what the driver gathers and every worker holds.
MOST_LANGUAGES = 512
#: Text judged at a time. A byte may be half a word, and a word takes a few numbers for each language.
PACKET_BYTES = 1 << 20
NO_LETTERS = regex.compile(r"[^\p{L}\p{M}\n]+")
#: Marks that stand on no letter.
LOOSE_MARKS = regex.compile(r"(?<![\p{L}\p{M}])\p{M}+")
UNKNOWN = "und"


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of words, and how many each word has. A word without letters has none."""
    text = LOOSE_MARKS.sub(" ", NO_LETTERS.sub(" ", "\n".join(words).lower()))
    lines = [b" " + b" ".join(line.encode("utf-8").split()) + b" " for line in text.split("\n")]
    joined = np.frombuffer(b"\n".join(lines) + b"\n", dtype=np.uint8)
    codes = joined[:-2].astype(np.uint32) << 16 | joined[1:-1].astype(np.uint32) << 8 | joined[2:] if len(joined) > 2 else np.empty(0, np.uint32)
    codes = (codes * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    sizes = np.fromiter((len(line) for line in lines), dtype=np.int64, count=len(lines))
    starts = np.cumsum(sizes + 1) - sizes - 1
    counts = np.where(sizes > 2, sizes - 2, 0)
    inside = np.zeros(len(joined) + 1, dtype=np.int64)  # trigrams that do not reach over the end of a word
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + counts, -1)
    return codes[np.cumsum(inside)[: len(codes)] > 0], counts


@dataclass(frozen=True)
class Model:
    """Languages in order of their names, and the log-likelihood of each bucket in each."""

    languages: tuple[str, ...]
    scores: np.ndarray


def held_out(id_column: Column) -> Column:
    """True for documents that must not be learned from: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count the trigrams of every row with a text and a language; null in either takes no part.

    Each task sums its own counts first, so what moves is at most languages x buckets numbers per task,
    and the driver gets languages x buckets numbers. No rows with both give a model without languages.
    """
    prepare(docs.sparkSession)
    source = picked(docs, lang=lang_col, text=text_col).filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])
    out_schema = arrow_schema(schema)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in packets(batch, "text", PACKET_BYTES):
                words, chosen, sizes = words_of(part.column("text"))
                if not words:
                    continue
                codes, counts = trigrams(words)
                langs = part.column("lang").dictionary_encode()
                of_word = np.repeat(langs.indices.to_numpy(), sizes)
                for i, lang in enumerate(langs.dictionary.to_pylist()):
                    times = np.bincount(chosen[of_word == i], minlength=len(words)).astype(np.float64)
                    totals.setdefault(lang, np.zeros(1 << BITS))
                    totals[lang] += np.bincount(codes, np.repeat(times, counts), 1 << BITS)
        for lang, total in totals.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], schema=out_schema)

    sums = written(source.mapInArrow(lean(counted), schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    names = sorted(r[0] for r in sums.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages can't be learned")
    table = sums.toArrow()  # at most MOST_LANGUAGES x 2 ** BITS numbers
    counts = np.full((len(names), 1 << BITS), SMOOTHING)
    place = {name: i for i, name in enumerate(names)}
    np.add.at(counts, (np.array([place[x] for x in table.column("lang").to_pylist()], dtype=np.int64), table.column("bucket").to_numpy()), table.column("n").to_numpy())
    return Model(tuple(names), np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32) if names else np.zeros((0, 1 << BITS), np.float32))


class WordScores:
    """Likelihoods of words in each language, relative to the best one, and of the best one against the background."""

    def __init__(self, model: Model):
        self.scores = np.ascontiguousarray(model.scores.T)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word: its relative likelihoods, by how much the best language beats the background, and its trigrams."""
        codes, sizes = trigrams(words) if words else (np.empty(0, np.uint32), np.empty(0, np.int64))
        sums = np.zeros((len(words), self.scores.shape[1]))
        some = np.flatnonzero(sizes)
        if len(some):
            sums[some] = np.add.reduceat(self.scores[codes], (np.cumsum(sizes) - sizes)[some], axis=0, dtype=np.float64)
        best = sums.max(axis=1, initial=-np.inf, keepdims=True) if len(words) else np.zeros((0, 1))
        return np.exp(np.maximum(sums - best, -WORD_CAP)).astype(np.float32), best[:, 0] - BACKGROUND * sizes, sizes


def mixture(likelihoods: np.ndarray, starts: np.ndarray, sizes: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each column for each run of rows, by EM from equal shares, and the log-likelihood they reach."""
    k = likelihoods.shape[1]
    shares = np.full((len(sizes), k), 1.0 / k)
    for _ in range(steps if k > 1 else 0):
        weighted = likelihoods * np.repeat(shares, sizes, axis=0)
        weighted /= weighted.sum(axis=1, keepdims=True)
        shares = np.add.reduceat(weighted, starts, axis=0) / sizes[:, None]
    reached = np.add.reduceat(np.log((likelihoods * np.repeat(shares, sizes, axis=0)).sum(axis=1)), starts)
    return shares, reached


def infer(likelihoods: np.ndarray, sizes: np.ndarray) -> list[tuple[list[int], list[float]]]:
    """For each run of words: the columns of its language set, most of it first, and their shares."""
    starts = np.cumsum(sizes) - sizes
    likelihoods = likelihoods.astype(np.float64)
    shares, _ = mixture(likelihoods, starts, sizes)
    single = np.add.reduceat(np.log(likelihoods), starts, axis=0)
    best = single.argmax(axis=1)
    # The single best language leads each order; the others follow by their shares.
    shares[np.arange(len(sizes)), best] = 2
    order = np.argsort(-shares, axis=1, kind="stable")
    price = PENALTY * 0.5 * np.log(sizes + 1.0)
    value = single.max(axis=1) - price
    results = [(order[i, :1].tolist(), [1.0]) for i in range(len(sizes))]
    open_ = np.arange(len(sizes))
    for k in range(2, order.shape[1] + 1):
        # Only runs that a larger set could still improve: each word's likelihood is at most 1.
        open_ = open_[-price[open_] * k > value[open_]]
        if not len(open_):
            break
        rows = np.repeat(starts[open_], sizes[open_]) + (np.arange(sizes[open_].sum()) - np.repeat(np.cumsum(sizes[open_]) - sizes[open_], sizes[open_]))
        part = np.take_along_axis(likelihoods[rows], np.repeat(order[open_, :k], sizes[open_], axis=0), axis=1)
        found, reached = mixture(part, np.cumsum(sizes[open_]) - sizes[open_], sizes[open_])
        better = reached - price[open_] * k > value[open_]
        for j in np.flatnonzero(better):
            i = open_[j]
            ranked = np.argsort(-found[j], kind="stable")
            results[i] = (order[i, :k][ranked].tolist(), found[j][ranked].tolist())
            value[i] = reached[j] - price[i] * k
    return results


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The languages of every text, judged by its text alone.

    Returns per input row: id_col, lang_pred (the language with the largest share; `und` if the text is null
    or has no letter, or no language was learned), score (its share, 0 to 1; 0 for `und`), evidence (by how much a
    trigram is likelier in the best language of its word than in the background model, as a mean of natural
    logarithms; below 0 for random letters, 0 for `und`), languages (the selected set with shares, largest first; it
    may hold all learned languages). Ties go to the language whose name sorts first.

    Null ids, repeated rows: one row each. Empty table: empty result. Other columns are not read. Narrow
    plan, no shuffle. The model, languages x 65,536 numbers for at most 512 languages, is broadcast.
    """
    spark = docs.sparkSession
    prepare(spark)
    source = picked(docs, **{"id": id_col, "text": text_col})
    share = T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())])
    schema = T.StructType(
        [T.StructField(id_col, source.schema["id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("evidence", T.DoubleType()), T.StructField("languages", T.ArrayType(share))]
    )
    out_schema = arrow_schema(schema)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value.languages
        scores = WordScores(sent.value)
        for batch in batches:
            for part in packets(batch, "text", PACKET_BYTES):
                n = part.num_rows
                # Of a packet, each different word is scored once; nothing is kept for the next.
                words, chosen, counts = words_of(pc.fill_null(part.column("text"), "")) if names else ([], np.empty(0, np.int64), np.zeros(n, np.int64))
                likelihoods, beats, sizes_of = scores.of(words) if names else (np.empty((0, 0)), np.empty(0), np.empty(0))
                kept = sizes_of[chosen] > 0
                owner = np.repeat(np.arange(n), counts)[kept]
                sizes = np.bincount(owner, minlength=n)
                with_words = np.flatnonzero(sizes)
                results = dict(zip(with_words.tolist(), infer(likelihoods[chosen[kept]], sizes[with_words]), strict=True)) if len(with_words) else {}
                found = [results.get(i) for i in range(n)]
                total, trigrams_of = (np.bincount(owner, weights=x[chosen[kept]], minlength=n) for x in (beats, sizes_of))
                evidence = total / np.maximum(trigrams_of, 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array([names[x[0][0]] if x else UNKNOWN for x in found], pa.string()),
                        pa.array([min(1.0, x[1][0]) if x else 0.0 for x in found], pa.float64()),
                        pa.array(evidence, pa.float64()),
                        pa.array([[{"lang": names[a], "share": b} for a, b in zip(*x, strict=True)] if x else [] for x in found], out_schema.field("languages").type),
                    ],
                    schema=out_schema,
                )
            released()

    return source.mapInArrow(lean(run), schema)

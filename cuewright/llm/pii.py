"""Operator 7, personal data: fixed patterns, and contextual extraction bootstrapped from what they find.

Spans of the fixed patterns are seeds. The one or two words before a seed are a lexical pattern. Patterns and the
instances (identifier-like strings) behind them form a graph. Spark scores it for a few rounds: a pattern is as
good as the share of all its occurrences, ordinary words included, that lead to instances believed to be personal
data; an unseen instance is as credible as the good patterns that lead to it. High-confidence patterns then
mark the unseen identifiers behind them. Scores rest on counts over the whole corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.llm.common import arrow_schema, packets, picked, prepare, texts_of, written
from cuewright.llm.secrets import SPAN, Span
from cuewright.llm.words import words_of

PACKET_BYTES = 8 << 20
KINDS = ("email", "ip", "card", "phone", "context")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Distinct believed instances that a pattern needs, the share of its occurrences that makes it trusted, and the rounds.
SUPPORT, TRUSTED, ROUNDS = 5, 0.6, 3
#: Patterns whose occurrences are counted in one scan; more patterns take more scans.
PATTERNS_A_SCAN = 500_000
#: An instance counts as believed from here on.
BELIEVED = 0.5
#: What could be an identifier: a word with a digit, an @ or an underscore in it, and groups of digits behind it. Its context decides.
UNSEEN = re.compile(r"(?<!\S)[^\s0-9@_]*+[0-9@_]\S*+(?:\x20[0-9][0-9-]*+(?=[\s.,;:!?]|$))*+")
WHITE = re.compile("[\x20\x09-\x0D]+")
EDGES = ".,;:!?()[]{}<>\"'"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Matches of the e-mail pattern. Found from their @ signs, since a search from the left tries every suffix of a long word."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append(("email", start, domain.end()))
            free = domain.end()
        at = text.find("@", max(free, at + 1))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns: leftmost and non-overlapping per kind, failing matches dropped."""
    found = emails(text)
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split("."))):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def word(raw: str) -> str:
    """A word as patterns have it: in small letters, without marks at its edges."""
    return raw.lower().strip(EDGES)


def words_before(text: str, start: int) -> list[str]:
    """The last two words before a place, however long they are."""
    width = 64
    while True:
        begin = max(0, start - width)
        parts = [x for x in WHITE.split(text[begin:start]) if x]
        if begin == 0 or len(parts) > 2:
            return parts[-2:]
        width *= 4


def patterns_before(text: str, start: int) -> list[str]:
    """The last word before a place, and the last two. Nothing where no word stands there."""
    before = [w for w in map(word, words_before(text, start)) if w]
    return [" ".join(before[-n:]) for n in (1, 2) if len(before) >= n and not any(c.isdigit() for w in before[-n:] for c in w)]


def unseen(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Identifier-like strings that no fixed pattern covers."""
    out = []
    for m in UNSEEN.finditer(text):
        start, end = m.span()
        while start < end and text[start] in EDGES:
            start += 1
        while end > start and text[end - 1] in EDGES:
            end -= 1
        if start < end and all(end <= s[1] or start >= s[2] for s in base):
            out.append((start, end))
    return out


FOUND = T.StructType([T.StructField("instance", T.StringType()), T.StructField("seed", T.BooleanType()), T.StructField("patterns", T.ArrayType(T.StringType())), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def extracted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: its number, id, spans of the fixed patterns, and every identifier with the patterns before it."""
    source = picked(docs, **{"id": id_col, "text": text_col})
    schema = T.StructType([T.StructField("row", T.LongType()), source.schema["id"], T.StructField("base", T.ArrayType(SPAN)), T.StructField("found", T.ArrayType(FOUND))])
    out_schema = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in packets(batch, "text", PACKET_BYTES):
                bases, founds = [], []
                for text in texts_of(part):
                    base = base_spans(text)
                    bases.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in base])
                    both = [(True, s, e) for _, s, e in base] + [(False, s, e) for s, e in unseen(text, base)]
                    founds.append([{"instance": text[s:e].lower(), "seed": seed, "patterns": patterns_before(text, s), "start": s, "end": e} for seed, s, e in both])
                yield pa.RecordBatch.from_arrays([pa.array(range(number, number + part.num_rows), pa.int64()), part.column("id"), pa.array(bases, out_schema.field("base").type), pa.array(founds, out_schema.field("found").type)], schema=out_schema)
                number += part.num_rows

    return source.mapInArrow(run, schema)


def occurrences(docs: DataFrame, wanted: frozenset[str], text_col: str) -> DataFrame:
    """How often each of the wanted patterns occurs in all texts, whatever follows it. Summed per task first."""
    schema = T.StructType([T.StructField("pattern", T.StringType()), T.StructField("n", T.LongType())])
    out_schema = arrow_schema(schema)
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = sent.value
        last = {p.rsplit(" ", 1)[-1] for p in keep}
        total: Counter[str] = Counter()
        for batch in batches:
            for part in packets(batch, "text", PACKET_BYTES):
                # Of a packet, each different word and each different pair of words is looked at once.
                words, chosen, counts = words_of(pc.fill_null(part.column("text"), ""))
                kinds: dict[str, int] = {}
                kind_of = np.fromiter((kinds.setdefault(word(w), len(kinds)) for w in words), np.int64, len(words))
                names = list(kinds)
                some = np.fromiter((name in last for name in names), bool, len(names))
                real = chosen[np.fromiter((bool(w) for w in words), bool, len(words))[chosen]] if "" in words else chosen
                counts = counts if real is chosen else counts - np.bincount(np.repeat(np.arange(len(counts)), counts)[np.array([not w for w in words])[chosen]], minlength=len(counts))
                run = kind_of[real]
                hit = np.flatnonzero(some[run]) if len(run) else np.empty(0, np.int64)
                for k, n in zip(*(x.tolist() for x in np.unique(run[hit], return_counts=True)), strict=True):
                    total[names[k]] += n
                begins = np.zeros(len(run) + 1, bool)
                begins[np.cumsum(counts) - counts] = True
                second = hit[~begins[hit]]
                for pair, n in zip(*(x.tolist() for x in np.unique(run[second - 1] * len(names) + run[second], return_counts=True)), strict=True):
                    before, after = divmod(pair, len(names))
                    if names[before] and names[after]:
                        total[f"{names[before]} {names[after]}"] += n
                if len(total) > PATTERNS_A_SCAN:
                    total = Counter({p: n for p, n in total.items() if p in keep})
        hits = [(p, n) for p, n in total.items() if p in keep]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in hits], pa.string()), pa.array([n for _, n in hits], pa.int64())], schema=out_schema)

    return picked(docs, text=text_col).mapInArrow(run, schema).groupBy("pattern").agg(F.sum("n").alias("n"))


def trusted_patterns(docs: DataFrame, edges: DataFrame, text_col: str, support: int = SUPPORT, trusted: float = TRUSTED, rounds: int = ROUNDS) -> DataFrame:
    """pattern, score of the patterns that may mark unseen identifiers.

    edges: pattern, instance, seed, times. In each round, a pattern that enough distinct believed instances support is scored by the
    share of all its occurrences that lead to believed instances, and what trusted patterns lead to is believed in
    the next round. So what was discovered supports further patterns. Only patterns with enough distinct instances of any
    kind can ever be supported; their occurrences are counted beforehand, in scans of at most PATTERNS_A_SCAN patterns each.
    """
    spark = docs.sparkSession
    possible = written(edges.groupBy("pattern").agg(F.count("*").alias("instances")).filter(F.col("instances") >= support).select("pattern"), "patterns")
    n = possible.count()
    if n == 0:
        return spark.createDataFrame([], "pattern string, score double")
    groups = -(-n // PATTERNS_A_SCAN)
    counted = None
    for g in range(groups):
        part = frozenset(r[0] for r in possible.filter(F.pmod(F.xxhash64("pattern"), F.lit(groups)) == g).toLocalIterator())
        found = written(occurrences(docs, part, text_col), "occurrences")
        counted = found if counted is None else counted.unionByName(found)
    graph = written(edges.join(counted, "pattern").select("pattern", "instance", "seed", "times", F.col("n").alias("total")), "graph")
    seeds = graph.filter("seed").select("instance", F.lit(1.0).alias("belief")).distinct()
    belief, scores = seeds, None
    for _ in range(rounds):
        supported = (
            graph.join(belief, "instance")
            .groupBy("pattern")
            .agg(F.count_if(F.col("belief") >= BELIEVED).alias("instances"), (F.sum(F.col("times") * F.col("belief")) / F.max("total")).alias("score"))
        )
        scores = written(supported.filter((F.col("instances") >= support) & (F.col("score") >= trusted)).select("pattern", F.least("score", F.lit(1.0)).alias("score")), "scores")
        # An unseen instance is not personal data only if every trusted pattern before it errs.
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("score")))))
        belief = written(graph.join(scores, "pattern").groupBy("instance").agg((1 - doubt).alias("belief")).unionByName(seeds).groupBy("instance").agg(F.max("belief").alias("belief")), "belief")
    return scores


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, trusted: float = TRUSTED, rounds: int = ROUNDS) -> DataFrame:
    """Personal data of every whole text: id_col and spans (array of kind, start, end in code points, end exclusive).

    Kinds email, ip, card and phone are the fixed patterns and always stay; `context` are identifiers behind trusted
    patterns that overlap none of those. Null text: no spans. Null ids, repeated rows: one row each. Empty table:
    empty result. Other columns are not read.

    The texts are scanned twice, for identifiers and for the occurrences of possible patterns; what moves between
    tasks are identifiers, patterns and counts. Edges are summed on the map side, so that a very common
    pattern is one row per task and instance.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = written(extracted(docs, id_col, text_col), "identifiers")
    every = rows.select("row", F.explode("found").alias("f")).select("row", "f.*").withColumn("pattern", F.explode("patterns"))
    edges = written(every.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("times")), "edges")
    good = trusted_patterns(docs, edges, text_col, support, trusted, rounds)
    marked = every.filter("NOT seed").join(good.select("pattern"), "pattern").select("row", F.struct(F.lit("context").alias("kind"), "start", "end").alias("span"))
    more = marked.groupBy("row").agg(F.collect_set("span").alias("more"))  # those of one document
    rank = F.transform(F.array(*(F.lit(k) for k in KINDS)), lambda k, i: F.struct(k.alias("k"), i.alias("i")))
    spans = F.concat("base", F.coalesce("more", F.array().cast(T.ArrayType(SPAN))))
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.filter(rank, lambda r: r["k"] == s["kind"])[0]["i"].alias("b"), s["end"].alias("c"), s.alias("s"))))
    return rows.join(more, "row", "left").select(F.col("id").alias(id_col), F.transform(keyed, lambda x: x["s"]).alias("spans"))


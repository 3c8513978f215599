"""Operator 8, mixing sources to target weights: Poisson replication, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import written

#: Sources up to this many are broadcast with their rates (a few hundred bytes each); beyond, the join is shuffled.
BROADCAST_SOURCES = 5_000
#: exp(-rate) must not vanish: a higher rate is the sum of draws of this rate or less.
HIGHEST_RATE = 500.0
HEX_DIGITS, STEPS = 13, float(1 << 52)


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts: 52 bits, the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, HEX_DIGITS), 16, 10).cast("bigint") / F.lit(STEPS)


def thresholds(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson variable, as far as they differ from 1."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(state: Column, j: Column) -> Column:
        p = state["p"] * rate / j
        return F.struct(p.alias("p"), (state["c"] + p).alias("c"), F.concat(state["all"], F.array(state["c"] + p)).alias("all"))

    length = F.ceil(rate + F.lit(12.0) * F.sqrt(rate)).cast("int") + 40
    return F.aggregate(F.sequence(F.lit(1), length), start, step, lambda state: state["all"])


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, size: int | None = None, seed: str = "0", id_col: str = "doc_id", source_col: str = "source", copy_col: str = "copy", key_col: str = "shuffle_key", text_col: str = "text") -> DataFrame:
    """Repeat documents so that sources have their target shares, and shuffle the result globally.

    weights: relative weight of each source (null is a source too); sources without one go; None weighs all
    sources alike. size: expected rows of the result, by default those of the input. A row of a source with n rows
    and share w is repeated X times, where X is Poisson with mean size * w / n, found by inverting the distribution
    at a number hashed from seed and id: every run and every engine draws alike. A copy number (1, 2, ...) and
    the shuffle key are added, named copy_col and key_col; a column of the input with such a name is replaced. All other
    columns pass through untouched, whatever their names.

    The result is dealt by a hash of its key and sorted by the key within partitions, a random global order. Rows
    that share an id draw the same number, each for itself; a null id draws by the digest of its text (a null text as ""), so rows
    without ids are drawn apart. Null texts are documents like others. Empty table: empty result. The counts of sources are combined on the map side; a source
    with a third of all rows is no hot key, since its rate is broadcast and its copies go by their own keys.
    """
    docs = docs.drop(*(c for c in (copy_col, key_col) if c in docs.columns))
    counts = written(docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.count("*").alias("mix_n")), "sources")
    if weights is None:
        weighed = counts.withColumn("mix_weight", F.lit(1.0))
    else:
        spark = docs.sparkSession
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items() if v > 0] or [], "mix_given string, mix_weight double")
        weighed = counts.join(F.broadcast(given) if len(weights) <= BROADCAST_SOURCES else given, F.col("mix_source").cast("string").eqNullSafe(F.col("mix_given"))).drop("mix_given")
    totals = weighed.agg(F.sum("mix_weight").alias("w"), F.count("*").alias("sources")).first()
    total = size if size is not None else counts.agg(F.sum("mix_n")).first()[0] or 0
    share = F.col("mix_weight") / F.lit(float(totals["w"] or 1.0))
    rate = share * F.lit(float(total)) / F.col("mix_n").cast("double")
    rates = weighed.select("mix_source", rate.alias("mix_rate")).withColumn("mix_draws", F.greatest(F.lit(1), F.ceil(F.col("mix_rate") / HIGHEST_RATE).cast("int")))
    rates = rates.select("mix_source", "mix_draws", thresholds(F.col("mix_rate") / F.col("mix_draws")).alias("mix_thresholds"))
    if totals["sources"] <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)

    identity = F.coalesce(F.col("mix_id"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col("mix_text"), F.lit("")))))
    drawn = lambda i: F.size(F.filter("mix_thresholds", lambda t: t <= uniform(F.lit(seed), F.col("mix_identity"), i.cast("string"))))
    times = F.aggregate(F.sequence(F.lit(1), F.col("mix_draws")), F.lit(0), lambda n, i: n + drawn(i))
    # Rows travel as one struct, so that no name of theirs meets one of these.
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("mix_row"), docs[id_col].cast("string").alias("mix_id"), (docs[text_col].cast("string") if text_col in docs.columns else F.lit(None).cast("string")).alias("mix_text"), docs[source_col].alias("mix_of"))
    copies = (
        rows.select("mix_row", identity.alias("mix_identity"), "mix_of")
        .join(rates, F.col("mix_of").eqNullSafe(F.col("mix_source")))
        .withColumn("mix_times", times)
        .filter("mix_times > 0")
        .select("mix_row", "mix_identity", F.explode(F.sequence(F.lit(1), F.col("mix_times"))).alias("mix_copy"))
    )
    keyed = copies.select("mix_row", "mix_copy", F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.col("mix_identity"), F.col("mix_copy").cast("string"))).alias("mix_key"))
    shuffled = keyed.repartition("mix_key").sortWithinPartitions("mix_key")
    return shuffled.select(*(F.col("mix_row").getField(c).alias(c) for c in docs.columns), F.col("mix_copy").alias(copy_col), F.col("mix_key").alias(key_col))


ORACLE_SQL = """
WITH RECURSIVE sources AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
totals AS (SELECT count(*) AS k, sum(n) AS t FROM sources),
rates AS (SELECT source, (1.0::DOUBLE / k::DOUBLE) * t::DOUBLE / n::DOUBLE AS rate FROM sources, totals),
cdf AS (
  SELECT source, rate, 0 AS j, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, j + 1, p * rate / (j + 1), c + p * rate / (j + 1) FROM cdf
  WHERE j < CAST(ceil(rate + 12.0::DOUBLE * sqrt(rate)) AS INTEGER) + 40
),
named AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, ''))) AS identity FROM documents),
draws AS (
  SELECT DISTINCT identity, source, ('0x' || substr(md5('0|' || identity || '|1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM named
),
times AS (SELECT d.identity, d.source, count(*) AS times FROM draws d JOIN cdf ON cdf.source IS NOT DISTINCT FROM d.source AND cdf.c <= d.u GROUP BY d.identity, d.source)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(copy AS INTEGER) AS copy, md5('0|order|' || d.identity || '|' || copy) AS shuffle_key
FROM named d JOIN times t ON t.identity = d.identity AND t.source IS NOT DISTINCT FROM d.source, LATERAL (SELECT unnest(range(1, times + 1)) AS copy)
"""

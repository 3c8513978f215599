"""Scores, grades and diagnoses of measured records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Grade bands.
GRADES = ((80, "excellent"), (65, "good"), (50, "fair"))
LOWEST_GRADE = "poor"
# Limits of the acoustic diagnosis, as (code, metric, lowest, highest, severity) in the order in which issues are told.
DIAGNOSIS = (
    ("peak_too_high", "peak_db", None, -1.0, "error"),
    ("rms_out_of_range", "rms_db", -35.0, -10.0, "error"),
    ("low_entropy", "entropy", 0.6, None, "error"),
    ("excessive_zero_crossing", "zero_crossing_rate", None, 0.12, "error"),
    ("low_bit_depth", "bit_depth", 14.0, None, "error"),
    ("integrated_loudness_out_of_range", "integrated_lufs", -22.0, -14.0, "error"),
    ("excessive_loudness_range", "loudness_range_lu", None, 6.0, "error"),
    ("true_peak_too_high", "true_peak_db", None, -1.5, "error"),
    ("excessive_silence", "silence_ratio", None, 0.1, "error"),
    ("background_noise", "estimated_noise_floor_db", None, -30.0, "error"),
    ("low_estimated_snr", "estimated_snr_db", 12.0, None, "error"),
    ("active_leading_edge", "leading_rms_db", None, -35.0, "warning"),
    ("active_trailing_edge", "trailing_rms_db", None, -35.0, "warning"),
)
# Metrics that a signal alone must satisfy to be acceptable.
SIGNAL_METRICS = ("peak_db", "rms_db", "entropy", "zero_crossing_rate", "bit_depth")
# Parts of the reference score: (name, metric, poor, good, weight); loudness is centred, with a tolerance.
COMPONENTS = (
    ("estimated_snr", "estimated_snr_db", 8, 30, 30),
    ("noise_floor", "estimated_noise_floor_db", -20, -50, 20),
    ("entropy", "entropy", 0.55, 0.9, 10),
    ("zero_crossing", "zero_crossing_rate", 0.15, 0.02, 5),
    ("bit_depth", "bit_depth", 10, 16, 5),
    ("silence", "silence_ratio", 0.35, 0.02, 10),
    ("loudness", "integrated_lufs", -18, 15, 10),
    ("loudness_range", "loudness_range_lu", 15, 4, 5),
    ("peak_headroom", "true_peak_db", -0.1, -3, 5),
)
CENTRED = ("loudness",)
# Fixed value: the level that stands for digital silence, in dB.
FLOOR_DB = -120.0


def ramp(value: Column, poor: float, good: float, weight: float) -> Column:
    """0 at poor, the weight at good, linear in between, in either direction."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - F.lit(poor)) / F.lit(good - poor))) * F.lit(float(weight))


def centred(value: Column, centre: float, tolerance: float, weight: float) -> Column:
    """The weight at the centre, 0 from the tolerance on."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.abs(value - F.lit(centre)) / F.lit(tolerance))) * F.lit(float(weight))


def grade(score: Column) -> Column:
    """the band of a score."""
    out = F.lit(LOWEST_GRADE)
    for least, name in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def signal_score(entropy: Column, zcr: Column, rms_db: Column) -> Column:
    """Entropy, less twice the zero-crossing rate, less the distance from -20 dB in units of 20 dB."""
    return entropy - 2 * zcr - F.abs(rms_db + 20) / 20


def outside(value: Column, low: float | None, high: float | None) -> Column:
    """Whether a value lies beyond either limit."""
    parts = [p for p in ((value < F.lit(low)) if low is not None else None, (value > F.lit(high)) if high is not None else None) if p is not None]
    return parts[0] if len(parts) == 1 else parts[0] | parts[1]


def issues(metrics: Mapping[str, Column], rules: Sequence[tuple] = DIAGNOSIS) -> Column:
    """The rules that fire, in order, as (code, severity, metric, observed, lowest, highest). A null metric does not fire."""
    rows = [
        F.when(outside(metrics[m], low, high), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(m).alias("metric"), metrics[m].cast("double").alias("observed"), F.lit(low).cast("double").alias("minimum"), F.lit(high).cast("double").alias("maximum")))
        for code, m, low, high, severity in rules
    ]
    return F.filter(F.array(*rows), lambda r: r.isNotNull())


def signal_acceptable(metrics: Mapping[str, Column]) -> Column:
    """P5: peak, level, entropy, zero crossings and bit depth all lie within the limits."""
    out = F.lit(True)
    for _, m, low, high, _ in DIAGNOSIS:
        if m in SIGNAL_METRICS:
            out = out & ~outside(metrics[m], low, high)
    return out


def score_components(metrics: Mapping[str, Column], digits: int | None = 2) -> Column:
    """The nine parts of the reference score, each rounded to `digits` (not with None), as a struct."""
    parts = []
    for name, m, poor, good, weight in COMPONENTS:
        points = centred(metrics[m].cast("double"), poor, good, weight) if name in CENTRED else ramp(metrics[m].cast("double"), poor, good, weight)
        parts.append((F.round(points, digits) if digits is not None else points).alias(name))
    return F.struct(*parts)


def reference_score(components: Column, digits: int | None = 2) -> Column:
    """The sum of the parts, rounded."""
    total = F.lit(0.0)
    for name, *_ in COMPONENTS:
        total = total + components[name]
    return F.round(total, digits) if digits is not None else total


def logged_metric(log: Column, name: str) -> Column:
    """U8: the last number behind a name in the log of an analysis; 0 where it never stands."""
    import re

    found = F.regexp_extract_all(log, F.lit(re.escape(name) + r":\s+(-?\d+(?:\.\d+)?)"), 1)
    return F.coalesce(F.get(found, F.size(found) - 1).cast("double"), F.lit(0.0))


def logged_signal(log: Column) -> Column:
    """U8: peak, level, entropy, zero crossings and bit depth from the log of a signal analysis."""
    depth = F.regexp_extract_all(log, F.lit(r"Bit depth: (\d+)"), 1)
    return F.struct(
        logged_metric(log, "Peak level dB").alias("peak_db"), logged_metric(log, "RMS level dB").alias("rms_db"), logged_metric(log, "Entropy").alias("entropy"),
        logged_metric(log, "Zero crossings rate").alias("zero_crossing_rate"), F.coalesce(F.get(depth, F.size(depth) - 1).cast("int"), F.lit(0)).alias("bit_depth"),
    )


def logged_loudness(log: Column) -> Column:
    """U8: loudness, its range and the true peak from what stands behind the last summary."""
    parts = F.split(log, "Summary:")
    last = F.get(parts, F.size(parts) - 1)
    return F.struct(logged_metric(last, "I").alias("integrated_lufs"), logged_metric(last, "LRA").alias("loudness_range_lu"), logged_metric(last, "Peak").alias("true_peak_db"))


def logged_silence(log: Column) -> Column:
    """U8: seconds of silence in a log."""
    return F.aggregate(F.regexp_extract_all(log, F.lit(r"silence_duration: (\d+(?:\.\d+)?)"), 1), F.lit(0.0), lambda s, x: s + x.cast("double"))


def frame_levels(log: Column) -> Column:
    """U8: levels of the frames in a log, silence as FLOOR_DB; a log without levels is an error."""
    found = F.regexp_extract_all(log, F.lit(r"lavfi\.astats\.Overall\.RMS_level=(-?(?:\d+(?:\.\d+)?|inf))"), 1)
    levels = F.transform(found, lambda x: F.when(x == "-inf", F.lit(FLOOR_DB)).when(x == "inf", F.lit(0.0)).otherwise(x.try_cast("double")))
    return F.when(F.size(levels) > 0, levels).otherwise(F.raise_error(F.lit("no levels in the log")).cast("array<double>"))


def frame_signal(levels: Column) -> Column:
    """U8: quiet and loud levels of the inner frames by nearest rank (10 % and 90 %), their distance, and the levels at both edges."""
    inner = F.array_sort(F.when(F.size(levels) > 2, F.slice(levels, F.lit(2), F.size(levels) - 2)).otherwise(levels))
    rank = lambda p: F.get(inner, F.greatest(F.ceil(F.size(inner) * F.lit(p)).cast("int") - 1, F.lit(0)))
    return F.struct(
        rank(0.1).alias("estimated_noise_floor_db"), rank(0.9).alias("estimated_speech_db"), (rank(0.9) - rank(0.1)).alias("estimated_snr_db"),
        F.get(levels, F.lit(0)).alias("leading_rms_db"), F.get(levels, F.size(levels) - 1).alias("trailing_rms_db"),
    )


def accepted(found: Column) -> Column:
    """No issue is an error."""
    return ~F.exists(found, lambda r: r["severity"] == "error")


def tier(value: Column, tiers: Sequence[tuple[float | None, str]]) -> Column:
    """the first tier whose limit the value does not exceed; a limit of None takes the rest."""
    out: Column = F.lit(None).cast("string")
    for limit, name in reversed(tiers):
        out = F.lit(name) if limit is None else F.when(value <= limit, name).otherwise(out)
    return out


def ranked(df: DataFrame, score: str, tie: str) -> DataFrame:
    """Rank by falling score, ties by name, without one task that sorts all rows."""
    from cuewright.operators.windows import global_ordinal

    return global_ordinal(df.withColumn("_minus", -F.col(score)), ["_minus", tie], "rank").drop("_minus")


def diagnosis(df: DataFrame, metrics: Mapping[str, str]) -> DataFrame:
    """Issues of measured recordings, whether they are accepted, and whether their signal alone would be. metrics: columns by metric."""
    columns = {name: F.col(column).cast("double") for name, column in metrics.items()}
    return df.withColumn("issues", issues(columns)).withColumn("accepted", accepted(F.col("issues"))).withColumn("signal_ok", signal_acceptable(columns))

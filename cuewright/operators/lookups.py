"""Joins against caches, manifests and dimensions, and choices among few candidates."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def validated_cache(units: DataFrame, cache: DataFrame, key: str, valid: Callable[[Column, Column], Column], source: str = "source", target: str = "target") -> DataFrame:
    """Units with the translations that a cache has of them, if they pass a check; others are to be made again.

    units: key and source; cache: key and target, the last record of a key already chosen. A null check fails.
    """
    return units.join(cache.select(key, target), key).filter(F.coalesce(valid(F.col(source), F.col(target)), F.lit(False)))


def by_speaker(sentences: DataFrame, segments: DataFrame, group: Sequence[str], speaker: str = "speaker_id", ordinal: str = "ordinal") -> DataFrame:
    """For every speaker of the sentences, in order of first speech: how many sentences, and the segments of the same speaker (none: 0), with sums of their seconds."""
    own = sentences.groupBy(*group, speaker).agg(F.min(ordinal).alias("first"), F.count("*").alias("sentences"), F.sum(F.col("finish_s") - F.col("start_s")).alias("spoken_s"))
    there = segments.groupBy(*group, speaker).agg(F.count("*").alias("segments"), F.sum(F.col("finish_s") - F.col("start_s")).alias("segment_s"))
    return own.join(there, [*group, speaker], "left").withColumn("segments", F.coalesce("segments", F.lit(0))).withColumn("segment_s", F.coalesce("segment_s", F.lit(0.0)))


def classified(rows: DataFrame, manifest: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with the value that the manifest has for their key; a key that it lacks is an error."""
    joined = rows.join(manifest.select(key, value), key, "left")
    return joined.withColumn(value, F.when(F.col(value).isNotNull(), F.col(value)).otherwise(F.raise_error(F.concat(F.lit("unclassified: "), F.col(key).cast("string"))).cast(manifest.schema[value].dataType)))


def mapped(value: Column, table: Mapping[str, str], fallback: Column | None = None) -> Column:
    """A value through a small table of names (a few hundred entries at most, in the plan); the fallback, or null, where it has none."""
    if not table:
        return fallback if fallback is not None else F.lit(None).cast("string")
    pairs = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    found = F.try_element_at(pairs, value)
    return found if fallback is None else F.coalesce(found, fallback)


def language_code(value: Column, names: Mapping[str, str]) -> Column:
    """The two-letter code of a language tag: its part before - or _, by name or three letters through the table."""
    base = F.lower(F.get(F.split(F.btrim(value), "[-_]"), F.lit(0)))
    return F.when(base.rlike("^[a-z]{2}$"), base).otherwise(mapped(base, names))


def first_match(candidates: Column, tests: Sequence[Callable[[Column], Column]]) -> Column:
    """The first candidate that passes the first test that any passes; the first of all if none does; null without candidates."""
    out = F.get(candidates, F.lit(0))
    for test in reversed(tests):
        passing = F.filter(candidates, test)
        out = F.when(F.size(passing) > 0, F.get(passing, F.lit(0))).otherwise(out)
    return out


def preferred_language(codes: Column, requested: Column, names: Mapping[str, str]) -> Column:
    """The requested code as it stands (case aside), else one of the same language, else English, else the first."""
    wanted = language_code(requested, names)
    return first_match(codes, [lambda c: F.lower(c) == F.lower(requested), lambda c: F.coalesce(language_code(c, names) == wanted, F.lit(False)), lambda c: F.lower(c) == "en"])


def listed_before(items: DataFrame, group: Sequence[str], order: Sequence[str], stop: Column, title: str = "title") -> DataFrame:
    """Items in order up to the one to stop at, numbered, with the number in front of the title. A group that lacks that item is an error."""
    w = Window.partitionBy(*group).orderBy(*order)
    placed = items.withColumn("number", F.row_number().over(w)).withColumn("_stop", stop)
    last = placed.groupBy(*group).agg(F.min(F.when(F.col("_stop"), F.col("number"))).alias("_last"))
    checked = last.withColumn("_last", F.when(F.col("_last").isNotNull(), F.col("_last")).otherwise(F.raise_error(F.lit("the item to stop at is not listed")).cast("int")))
    kept = placed.join(checked, list(group)).filter("number < _last")
    return kept.withColumn(title, F.concat(F.format_string("%02d ", F.col("number")), F.col(title))).drop("_stop", "_last")


def gallery_urls(rows: Column) -> Column:
    """Addresses of a gallery's JSON rows [kind, ...]: kind 3 is an address, kind 2 a folder, others are passed over."""
    parsed = F.from_json(rows, "array<array<string>>")
    return F.transform(F.filter(parsed, lambda r: F.get(r, F.lit(0)) == "3"), lambda r: F.get(r, F.lit(1)))


PROBE = "struct<streams:array<struct<index:int,codec_type:string,codec_name:string,sample_rate:string,channels:int,bit_rate:string,duration:string>>,format:struct<duration:string,bit_rate:string>>"


def audio_format(probe: Column) -> Column:
    """The first audio stream of a probe's JSON, its numbers as numbers; null if there is none."""
    streams = F.from_json(probe, PROBE)["streams"]
    s = F.get(F.filter(streams, lambda x: x["codec_type"] == "audio"), F.lit(0))
    return F.when(s.isNotNull(), F.struct(s["codec_name"].alias("codec_name"), s["sample_rate"].try_cast("int").alias("sample_rate"), s["channels"].alias("channels"), s["bit_rate"].try_cast("int").alias("bit_rate")))


def found_by_name(lists: Sequence[DataFrame], name: str, slug: str = "slug", title: str = "title") -> DataFrame:
    """The first entry over several lists, one after another, whose slug is the name or whose title is, case aside. Lists have a column `ordinal`."""
    every = None
    for i, rows in enumerate(lists):
        rows = rows.withColumn("list", F.lit(i))
        every = rows if every is None else every.unionByName(rows)
    hits = every.filter((F.col(slug) == name) | (F.lower(title) == name.lower()))
    return hits.agg(F.min_by(F.struct(*hits.columns), F.struct("list", "ordinal")).alias("hit")).filter("hit IS NOT NULL").select("hit.*")


def reacts(message: DataFrame, blocked: Sequence[int] = ()) -> Column:
    """Whether a message is for the service: incoming, with text or a file, from nobody blocked; in a group only as a command."""
    ok = ~F.col("outgoing") & (F.col("text").rlike(r"\S") | F.col("has_file"))
    if blocked:
        ok = ok & ~F.col("user_id").isin(*blocked)
    return F.coalesce(ok & (~F.col("in_group") | F.col("text").startswith("/")), F.lit(False))


def reviewed(df: DataFrame, order: Sequence[str], shown: int = 20) -> tuple[DataFrame, DataFrame]:
    """The first rows, and one row with how many more there are."""
    return df.orderBy(*order).limit(shown), df.agg(F.greatest(F.lit(0), F.count("*") - shown).alias("more"))


def cover(images: DataFrame, page: str, area: float = 0.5, stack: float = 0.5) -> DataFrame:
    """Per page the image that covers most of it, and whether images make a cover: one of enough area, or a stack whose areas add up,
    of enough height together.

    Columns: ordinal, width, height, page_width, page_height. Doubles are added in the order of the ordinals (then of share and height), so that a page
    at the edge has one answer, however its rows are dealt over files and tasks.
    """
    share = F.col("width") * F.col("height") / (F.col("page_width") * F.col("page_height"))
    w = Window.partitionBy(page).orderBy("ordinal", "share", "height").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # the images of one page
    each = images.withColumn("share", share).withColumns({"total_share": F.sum("share").over(w), "total_height": F.sum("height").over(w)})
    found = each.groupBy(page).agg(
        F.max_by("ordinal", F.struct("share", -F.col("ordinal"))).alias("largest"), F.max("share").alias("largest_share"), F.max("total_share").alias("total_share"),
        F.max("width").alias("widest"), (F.max("total_height") / F.max("page_height")).alias("stacked"),
    )
    return found.withColumn("is_cover", (F.col("largest_share") >= area) | ((F.col("total_share") >= area) & (F.col("stacked") >= stack)))


def checks_passed(results: DataFrame, keys: Sequence[str], passed: Column) -> DataFrame:
    """Checks that passed, of all, for every model and test."""
    return results.groupBy(*keys).agg(F.count_if(passed).alias("passed"), F.count("*").alias("total"))


def detail_order(kinds: Sequence[str], kind: str = "kind", before: str = "before_idx", after: str = "after_idx") -> list[Column]:
    """Order of differences: by the smaller index, the rank of their kind, the index before, the index after; a missing index comes last."""
    ends = F.lit(float("inf"))
    first, second = (F.coalesce(F.col(c).cast("double"), ends) for c in (before, after))
    return [F.least(first, second), F.coalesce(F.array_position(F.array(*map(F.lit, kinds)), F.col(kind)), F.lit(0)), first, second]


def user_order(df: DataFrame, title: str, tie: str, sort: bool = False, reverse: bool = False, number: bool = False) -> DataFrame:
    """T5: items in their order or by title, turned round if asked, numbered in front of the title if asked. Adds `position`."""
    from cuewright.operators.windows import global_ordinal

    keys = [title, tie] if sort else [tie]
    placed = global_ordinal(df, keys, "position")
    if reverse:
        placed = placed.crossJoin(F.broadcast(df.agg(F.count("*").alias("_n")))).withColumn("position", F.col("_n") + 1 - F.col("position")).drop("_n")  # one row
    return placed.withColumn(title, F.concat(F.format_string("%02d ", F.col("position")), F.col(title))) if number else placed


def mean_or(values: Column, empty: float | None) -> Column:
    """A4: mean of an array without nulls; what an empty one gives is the caller's choice (0.0, null, 0)."""
    kept = F.filter(values, lambda x: x.isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.when(F.size(kept) > 0, total / F.size(kept)).otherwise(F.lit(empty).cast("double"))


def rms_or(values: Column, empty: float | None) -> Column:
    """A4: root of the mean square, with the same rule."""
    return F.sqrt(mean_or(F.transform(values, lambda x: x.cast("double") * x.cast("double")), empty))


def real_time_factor(seconds: Column, duration: Column) -> Column:
    """Seconds of work per second of media over the rows of a group; null without media."""
    return F.try_divide(F.sum(seconds), F.sum(duration))


def ordered_groups(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """Groups with their size, in the order in which their first rows come."""
    return df.groupBy(*keys).agg(F.min(ordinal).alias("first"), F.count("*").alias("rows"))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """seconds that two spans share."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def union_share(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """overlap over the length of the union; 0 where that is not positive."""
    union = (a1 - a0) + (b1 - b0) - overlap(a0, a1, b0, b1)
    return F.when(union > 0, overlap(a0, a1, b0, b1) / union).otherwise(0.0)


def gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """seconds between two spans; 0 if they overlap or touch."""
    return F.greatest(F.lit(0.0), b0 - a1, a0 - b1)


def beyond(before: Column, after: Column, tolerance: float) -> Column:
    """whether two times differ by more than the tolerance, and a hair."""
    return F.abs(before - after) > tolerance + 1e-9


# Networks that are not public.
PRIVATE_NETS = (
    "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 "
    "198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4 ::/128 ::1/128 fc00::/7 fe80::/10 ff00::/8"
).split()


def public_ip(address: Column) -> Column:
    """Whether an address is one, and in none of the private networks; IPv4 in IPv6 counts as IPv4."""
    nets = [ipaddress.ip_network(n) for n in PRIVATE_NETS]

    def judge(value: str | None) -> bool:
        try:
            ip = ipaddress.ip_address(value or "")
        except ValueError:
            return False
        ip = getattr(ip, "ipv4_mapped", None) or ip
        return not any(ip.version == n.version and ip in n for n in nets)

    @F.arrow_udf("boolean")
    def check(values: pa.Array) -> pa.Array:
        seen: dict[str | None, bool] = {}
        return pa.array([seen.setdefault(v, judge(v)) if v not in seen else seen[v] for v in values.to_pylist()], pa.bool_())

    return check(address)


def status_lines(events: DataFrame, keys: Sequence[str], ordinal: str, line: str, gone: Column) -> DataFrame:
    """Q6: the lines of a status as they stand last, in order of their first appearance, one text per key; lines that are gone are left out."""
    last = events.withColumn("_gone", gone).groupBy(*keys, "line_id").agg(F.min(ordinal).alias("first"), F.max_by(F.struct(line, "_gone"), ordinal).alias("last"))
    return last.filter("NOT last._gone").groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", F.col(f"last.{line}").alias("line")))), lambda x: x["line"]), "\n").alias("status"))


def first_valid(candidates: DataFrame, group: Sequence[str], rank: str, valid: Column, most: int = 20) -> DataFrame:
    """T4: of the first `most` candidates of each group, by rank, the first that is valid, with how many were refused before it; groups without one have no row."""
    judged = candidates.filter(F.col(rank) <= most).withColumn("_valid", F.coalesce(valid, F.lit(False)))
    best = judged.groupBy(*group).agg(F.min(F.when(F.col("_valid"), F.col(rank))).alias("_best"))
    return judged.join(best, list(group)).filter(F.col(rank) == F.col("_best")).withColumn("refused", F.col(rank) - 1).drop("_valid", "_best")


def resumed(entries: DataFrame, manifest: DataFrame, key: str, order: str, digest: str, done: Column) -> DataFrame:
    """Q8: entries that are still to be worked on: without a record in the manifest, or whose last record is not done or of another digest."""
    last = manifest.groupBy(key).agg(F.max_by(F.struct(F.col(digest).alias("d"), done.alias("ok")), order).alias("last"))
    joined = entries.join(last, key, "left")
    return joined.filter(F.col("last").isNull() | ~F.coalesce(F.col("last.ok"), F.lit(False)) | ~F.col("last.d").eqNullSafe(F.col(digest))).drop("last")


def compacted(manifest: DataFrame, live: DataFrame, key: str, order: str) -> DataFrame:
    """K6, Q8: the last record of every key that is still alive."""
    rest = [c for c in manifest.columns if c != key]
    return manifest.join(live.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def outlined(rows: DataFrame, group: Sequence[str], order: str, opens: Column, item: Column) -> DataFrame:
    """Rows under the last opening row before them: group, head (its order) and the items below it in order. Rows before any opening have none."""
    from cuewright.operators.windows import forward_fill

    filled = forward_fill(rows.withColumn("_item", item), group, [order], F.when(opens, F.col(order)), "head").filter("head IS NOT NULL")
    below = F.collect_list(F.when(~opens, F.struct(F.col(order).alias("at"), F.col("_item").alias("item"))))
    return filled.groupBy(*group, "head").agg(F.transform(F.array_sort(below), lambda x: x["item"]).alias("items"))


def replies(rows: DataFrame, target: str, key: str, of_kind: Column, to_kind: Column) -> DataFrame:
    """Rows of a kind that reply to rows of another: each with the key of the row that it replies to."""
    asked = rows.filter(to_kind).select(F.col(key).alias("_asked"))
    return rows.filter(of_kind).join(asked, F.col(target) == F.col("_asked")).withColumn("asked", F.col("_asked")).drop("_asked")


def matrix(cases: DataFrame, repeats: int) -> DataFrame:
    """Every case as often as it is to be run, numbered from 1. A failure is a column of its row, never a missing row."""
    return cases.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))


def longest_of(df: DataFrame, group: Sequence[str], text: str, tie: str) -> DataFrame:
    """The row with the longest text of each group; of several the first."""
    rest = [c for c in df.columns if c not in group]
    return df.groupBy(*group).agg(F.max_by(F.struct(*rest), F.struct(F.length(text), -F.col(tie))).alias("_r")).select(*group, "_r.*")


def same_signature(df: DataFrame, group: Sequence[str], signature: Sequence[str]) -> DataFrame:
    """Whether all rows of a group have the same signature and none lacks a part of it."""
    whole = F.lit(True)
    for c in signature:
        whole = whole & F.col(c).isNotNull()
    return df.groupBy(*group).agg(((F.count_distinct(F.struct(*signature)) == 1) & F.bool_and(whole)).alias("same"))

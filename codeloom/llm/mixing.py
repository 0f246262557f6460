"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

A mix is a number of blocks of BLOCK words.  Blocks are allotted to sources by highest quotients, then a source's
blocks to its shards in the same way.  A shard's blocks are cut from its documents' words, in seeded order, and the
first ones are used once more than the others, so all documents but one of a shard are taken a whole number of times.
Sources may be any number: the driver knows sums over them alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, raw_texts, slices, stored

BLOCK, SHARD_WORDS, SEED = 128, 2_000_000, 17
#: Most shards of a source, which one task apportions; beyond, shards grow.
SHARDS = 4096
WEIGHTS = (5, 2, 1)
#: Share of all words that the mix has, and most uses of a word.
SHARE, REPEATS = 1.5, 2
#: Divisors tried at once, and copies of a row written by one step.
TRIED, COPIES = 24, 10_000


def sainte_lague(votes: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by highest quotients votes / (2 k + 1), none above its cap; ties go to the earlier entry.

    A divisor is bisected for so that the seats can be counted at once; the last few go one by one.
    """
    votes, caps = np.asarray(votes, float), np.asarray(caps, np.int64)
    seats = int(min(seats, caps[votes > 0].sum()))
    given = np.zeros(len(votes), np.int64)
    if seats <= 0:
        return given

    def at(divisor: float) -> np.ndarray:  # entries with quotient votes / (2 k + 1) >= divisor
        return np.minimum(caps, np.floor((votes / divisor + 1) / 2).astype(np.int64))

    low, high = votes[votes > 0].min() / (2.0 * caps.max() + 2), votes.max() * 2.0
    for _ in range(200):
        mid = (low + high) / 2
        if at(mid).sum() > seats:
            low = mid
        else:
            high = mid
    given = at(high)
    while (left := seats - int(given.sum())) > 0:
        quotient = np.where(given < caps, votes / (2 * given + 1), -1)
        given[np.argsort(-quotient, kind="stable")[:1]] += 1
        if left > 10 * len(votes):
            raise AssertionError("the divisor was not found")
    return given


def numbered(sources: DataFrame) -> DataFrame:
    """sources (source, size) with sid: 0, 1, 2, ... by code points, null last.  The driver learns one number a partition."""
    ordered = stored(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    counts = sorted(tuple(r) for r in ordered.groupBy(part.alias("part")).count().collect())
    before = np.cumsum([0, *(n for _, n in counts)]).tolist()
    offset = F.create_map(*[F.lit(x) for (k, _), n in zip(counts, before) for x in (k, n)]) if counts else F.create_map(F.lit(0), F.lit(0))
    return ordered.select("source", "size", (F.element_at(offset, part) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias("sid"))


def with_targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """sources (source, size, sid) with target, the words of each: by weight, but at most `repeats` times its size; what is
    above is shared anew by weight, until none is."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    cap = F.col("size") * float(repeats)
    rows = sources.withColumn("weight", weight).withColumn("cap", cap)
    size, rest_weight, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0)), F.count("*")).first()
    total, rest, full = share * size, share * size, 0
    while True:
        want = F.lit(float(rest)) * F.col("weight") / F.lit(float(rest_weight or 1.0))
        over = want > F.col("cap")
        capped, free, count = rows.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.count_if(over)).first()
        if count == full or count == n:
            return rows.withColumn("target", F.when(over, F.col("cap")).otherwise(want)).drop("weight", "cap")
        rest, rest_weight, full = total - capped, free, count


def with_seats(sources: DataFrame, seats: int, votes: str = "target", caps: str = "caps") -> DataFrame:
    """sources with `seats` shared out by highest quotients votes / (2 k + 1), none above its cap; ties go to the smaller sid.

    A divisor is sought for which the seats can be counted at once, many tried in one pass; what ties leave over goes
    to the next highest quotients.
    """
    v, cap = F.col(votes), F.col(caps)
    at = lambda d: F.when(v > 0, F.least(cap, F.floor((v / F.lit(d) + 1) / 2))).otherwise(F.lit(0).cast("long"))
    room, least, most, top, every, n = sources.agg(F.sum(F.when(v > 0, cap)), F.min(F.when(v > 0, v)), F.max(cap), F.max(v), F.sum(v), F.count_if(v > 0)).first()
    seats = min(seats, room or 0)
    if seats <= 0:
        return sources.withColumn("seats", F.lit(0).cast("long"))
    low, high, given = least / (2.0 * most + 2), top * 2.0, 0
    guess = every / max(1.0, 2.0 * seats - n)  # without caps, about half a seat a source is rounded away
    near = [guess * (1 + s * 10.0**-k) for k in range(1, 7) for s in (-1, 1)]
    while given < seats:
        tried = sorted(x for x in {*np.geomspace(low, high, TRIED + 2).tolist(), *near} if low < x < high)
        near = []
        if not tried:
            break
        for d, n in zip(tried, sources.agg(*[F.sum(at(d)) for d in tried]).first()):
            if n > seats:
                low = d
            else:
                high, given = d, n
                break
    out = sources.withColumn("seats", at(high))
    left = seats - (out.agg(F.sum("seats")).first()[0] or 0)
    if left <= 0:
        return out
    more = out.where(F.col("seats") < cap).orderBy(F.desc(v / (2 * F.col("seats") + 1)), "sid").limit(left).select(F.col("sid").alias("more"))
    return out.join(more, F.col("sid") == F.col("more"), "left").withColumn("seats", F.col("seats") + F.col("more").isNotNull().cast("long")).drop("more")


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            size = [len(t.split()) for t in raw_texts(part.column("text"))]
            yield pa.record_batch([part.column("doc_id"), part.column("source"), part.column("tie"), pa.array(size, pa.int64())], names=["doc_id", "source", "tie", "size"])


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row.

    Weights go to sources in order of code points, null last, over and over.  A null text has size zero, of which
    nothing is taken; texts of any length are counted whole.  Order and choice hang on doc_id, text and seed alone, so
    reruns agree; rows that agree in source, doc_id and text are counted together and stand next to each other.  A null
    doc_id is a value like others, dealt to shards by its text.  Other columns are not read; an empty table gives an
    empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("tie"))
    sized = rows.mapInArrow(_sized, "doc_id long, source string, tie long, size long")
    units = stored(sized.groupBy("source", "doc_id", "size", "tie").agg(F.count("*").alias("copies")), "units")
    sources = with_targets(numbered(units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"))), weights, share, repeats)
    sources = stored(sources.withColumn("caps", F.ceil(F.col("size") / F.lit(block)) * repeats), "targets")
    wanted = sources.agg(F.sum("target")).first()[0] or 0.0
    number = F.least(F.greatest(F.ceil(F.col("size") / F.lit(shard_words)), F.lit(1)), F.lit(shards)).cast("long")
    names = with_seats(sources, round(wanted / block)).select("sid", F.col("source").alias("name"), F.col("size").alias("source_size"), "target", "seats", number.alias("shards"))
    # Spark broadcasts the names if they are small enough, else splits the hot ones.
    known = units.join(names, units["source"].eqNullSafe(names["name"])).drop("name")
    hashed = lambda n: F.xxhash64(F.lit(seed + n), "doc_id", "size", "tie")
    order = Window.partitionBy("sid", "shard").orderBy(hashed(1), "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = known.where("size > 0").withColumn("shard", F.pmod(hashed(0), F.col("shards"))).withColumn("words", F.col("size") * F.col("copies"))
    placed = stored(placed.withColumn("end", F.sum("words").over(order)).select("sid", "shard", "seats", "doc_id", "size", "copies", "source_size", "target", "words", "end"), "placed")

    def quotas(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("shard")
        blocks = -(-frame["words"] // block)
        got = sainte_lague(frame["words"].to_numpy(), int(frame["seats"].iloc[0]), (repeats * blocks).to_numpy())
        return pd.DataFrame({"sid": frame["sid"], "shard": frame["shard"], "blocks": blocks, "quota": got})

    words = placed.groupBy("sid", "shard").agg(F.max("end").alias("words"), F.max("seats").alias("seats"))
    quota = words.groupBy("sid").applyInPandas(quotas, "sid long, shard long, blocks long, quota long")  # SHARDS rows at most
    # Each block is used quota / blocks times, rounded down, and the first ones once more: as documents stand in seeded
    # order, at most one of a shard is cut in two by that, and all others are taken a whole number of times.
    begin, more = F.col("end") - F.col("words"), F.col("quota") % F.col("blocks") * block
    again = F.least(F.greatest(more - begin, F.lit(0)), F.col("words"))
    taken = placed.join(quota, ["sid", "shard"]).select("doc_id", "size", "copies", "source_size", "target", F.floor(F.col("quota") / F.col("blocks")).alias("uses"), again.alias("again"))
    first = taken.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))).alias("first"))
    each = first.select("*", F.explode(F.sequence("first", F.least(F.col("first") + COPIES, "copies") - 1)).alias("k"))
    own = F.least(F.greatest(F.col("again") - F.col("k") * F.col("size"), F.lit(0)), F.col("size"))
    empty = known.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("uses") + own).cast("long").alias("taken")).unionByName(empty)


def mixed_rows(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """docs with each document as often as the mix takes it: its taken words over its size, rounded half up.

    At most one document of a shard is rounded at all, so a source's words miss its target by at most half of a
    document a shard, and the last block.  Documents of one id are taken alike, as often as the one of them that is
    taken most.  Documents without words, so null and empty texts, are left out; a null doc_id is a value like others.
    Columns of docs may have any names; an empty table stays empty.
    """
    mixed_id, count, each = fresh(docs, "mixed_id", "uses", "use")
    mix = mixed(docs, **options).where("taken > 0").select(F.col("doc_id").alias(mixed_id), F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias(count))
    mix = mix.groupBy(mixed_id).agg(F.max(count).alias(count)).where(F.col(count) > 0)
    joined = docs.join(mix, F.col("doc_id").eqNullSafe(F.col(mixed_id))).where(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), count)).alias(each)).drop(each)

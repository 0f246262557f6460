"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared in tiles with exclusive-or and bit counts in numpy.  A tile holds fingerprints whose
four (or, over many rows, eight) equal segments have the same population counts.  Two fingerprints at distance r
have count vectors at distance r or less, so only neighbouring tiles are paired; all others are skipped unread.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, fresh, raw_texts, slices, stored

SHINGLE_WORDS = 3
RADIUS = 2
#: Most fingerprints in a tile, on average; a fuller cell is dealt to more tiles by hash and all their pairs compared.
TILE = 1024
#: From so many distinct fingerprints on, eight segments are counted in place of four.  The links stay the same.
FINE_FROM = 2_000_000


def fingerprints_of(texts: list[bytes], size: int = SHINGLE_WORDS) -> np.ndarray:
    """The 64-bit fingerprint of each UTF-8 text, as uint64; zero for a text without words."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    count = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= size:
            hashes.append(digest(joined, 42))
            count[k] = 1
            continue
        length = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(length + 1) - 1
        begin = end - length
        hashes += [digest(joined[s:e], 42) for s, e in zip(begin[: 1 - size].tolist(), end[size - 1 :].tolist())]
        count[k] = len(words) - size + 1
    out = np.zeros(len(texts), np.uint64)
    full = count > 0
    if not full.any():
        return out
    values = np.array(hashes, np.uint64)
    ends = np.cumsum(count[full])
    ones = np.zeros((len(ends), 64), np.int64)
    row = np.repeat(np.arange(len(ends)), count[full])
    for begin in range(0, len(values), 1 << 17):  # bits of so many hashes at once
        part = values[begin : begin + (1 << 17)]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        at = row[begin : begin + len(part)]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        ones[at[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    set_bits = (2 * ones > count[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(set_bits, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str | None = None) -> DataFrame:
    """(id, fp) of each row, and its column `keep`, a long, if one is named; fp is the fingerprint as a signed long.

    A null text counts as empty.
    """
    more = [keep] if keep else []

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                prints = fingerprints_of(raw_texts(part.column("text")))
                yield pa.record_batch([part.column("id"), pa.array(prints.view(np.int64)), *(part.column(c) for c in more)], names=["id", "fp", *more])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), *more)
    return rows.mapInArrow(kernel, ", ".join(["id long, fp long", *(f"{c} long" for c in more)]))


def near_offsets(segments: int, radius: int, width: int) -> list[int]:
    """Packed differences of count vectors at most `radius` apart, one of each pair of opposites, and zero."""
    steps = [sign << (width * k) if sign > 0 else -(1 << (width * k)) for k in range(segments) for sign in (1, -1)]
    found = {0}
    for n in range(1, radius + 1):
        found |= {sum(x) for x in itertools.combinations_with_replacement(steps, n)}
    return sorted(x for x in found if x >= 0)


def _linked(radius: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            lists = [batch.column(c) for c in ("left", "right")]
            flat = [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in lists]
            offs = [x.offsets.to_numpy() for x in lists]
            for k in range(batch.num_rows):
                a, b = (flat[s][offs[s][k] : offs[s][k + 1]] for s in (0, 1))
                i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
                x, y = a[i], b[j]
                differs = x != y
                if differs.any():
                    u, v = forest(x[differs], y[differs])
                    left.append(u)
                    right.append(v)
            if left:
                yield pa.record_batch([pa.array(np.concatenate(s).view(np.int64)) for s in (left, right)], names=["a", "b"])

    return kernel


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE, segments: int | None = None) -> DataFrame:
    """Edges (a, b) between fingerprints at most `radius` bits apart, thinned to a forest within each pair of tiles.

    prints: column fp, distinct.  The components of the edges are those of all links.  Null fingerprints are ignored.
    """
    prints = prints.where(F.col("fp").isNotNull()).select("fp")
    segments = segments or (4 if prints.count() < FINE_FROM else 8)
    bits, width = 64 // segments, 8
    if radius >= 1 << (width - 1):
        raise ValueError("radius too large")
    mask = (1 << bits) - 1
    cell = F.lit(0).cast("long")
    for k in range(segments):
        count = F.bit_count(F.shiftrightunsigned("fp", bits * k).bitwiseAND(F.lit(mask)))
        cell = cell + F.shiftleft(count.cast("long"), width * k)
    cells = prints.select("fp", cell.alias("cell"))
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(tile)).cast("long").alias("tiles"))
    dealt = cells.join(sizes, "cell").select("fp", "cell", F.pmod(F.xxhash64("fp"), F.col("tiles")).alias("tile"))
    tiles = stored(dealt.groupBy("cell", "tile").agg(F.collect_list("fp").alias("fps")), "tiles")
    # Pairs of tiles are found without what is in them; each is a row of its own, so no task has all of a full cell.
    offsets = F.array([F.lit(x).cast("long") for x in near_offsets(segments, radius, width)])
    near = tiles.select(F.col("cell").alias("cell_a"), F.col("tile").alias("tile_a"), F.explode(offsets).alias("by")).withColumn("cell_b", F.col("cell_a") + F.col("by"))
    near = near.join(sizes.select(F.col("cell").alias("cell_b"), "tiles"), "cell_b")
    first = F.when(F.col("by") == 0, F.col("tile_a")).otherwise(F.lit(0))
    pairs = near.select("cell_a", "tile_a", "cell_b", F.explode(F.sequence(first, F.col("tiles") - 1)).alias("tile_b"))
    left = tiles.select(F.col("cell").alias("cell_a"), F.col("tile").alias("tile_a"), F.col("fps").alias("left"))
    right = tiles.select(F.col("cell").alias("cell_b"), F.col("tile").alias("tile_b"), F.col("fps").alias("right"))
    met = pairs.join(left, ["cell_a", "tile_a"]).join(right, ["cell_b", "tile_b"])
    return met.select("left", "right").mapInArrow(_linked(radius), "a long, b long")


def _rooted(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, low, root) of the distinct fingerprints of prints (id, fp): low is the smallest id, root names the component."""
    classes = prints.groupBy("fp").agg(F.min("id").alias("low"))
    roots = components(links(classes, radius))
    return classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row; component_id is the smallest id that links reach, its own included.

    Null or empty texts have fingerprint zero and are linked like any other.  A null id never names a component;
    a component of nothing but null ids has a null component_id.  Repeated rows give repeated results.  Other
    columns of docs are not read.  An empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    rooted = _rooted(prints, radius)
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    known = rooted.join(named, "root").select(F.col("fp").alias("key"), "component_id")
    return prints.join(known, prints["fp"] == known["key"]).select(F.col("id").alias("doc_id"), "fp", "component_id")


def deduplicated(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each group: that with the smallest id, of these that with the smallest hash of its text.

    Groups are of fingerprints, so rows of one id whose texts are unlike are in groups of their own and each may stay;
    of rows that agree in id and text one stays, whatever else they differ in.  Rows without an id have no part in
    groups and are kept as they are.  Null and empty texts are one group.  Columns of docs may have any names and
    stay as they are; an empty table stays empty.
    """
    (key,) = fresh(docs, "text_key")
    named = docs.where(F.col("doc_id").isNotNull()).withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    prints = stored(fingerprints(named.select("doc_id", "text", F.col(key).alias("own_key")), keep="own_key"), "fingerprints")
    kept = prints.join(_rooted(prints, radius).select(F.col("fp").alias("of"), "root"), F.col("fp") == F.col("of"))
    kept = kept.groupBy("root").agg(F.min(F.struct("id", "own_key")).alias("one")).select(F.col("one.id").alias("kept_id"), F.col("one.own_key").alias("kept_key"))
    if prints.groupBy("id", "own_key").count().where("count > 1").head(1):  # copies of a row: else texts needn't be sorted
        named = named.dropDuplicates(["doc_id", key])
    rows = named.join(kept, (named["doc_id"] == kept["kept_id"]) & (named[key] == kept["kept_key"]), "left_semi").drop(key)
    return rows.unionByName(docs.where(F.col("doc_id").isNull()))

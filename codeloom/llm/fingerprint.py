"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs (pieces between line breaks).  Each paragraph hashes to a wide vector and
a text's fingerprint is the sum of its paragraphs' vectors, each lane modulo a power of two.  So order doesn't
matter, and paragraphs are added or removed by adding or subtracting their fingerprints.  Two kinds of lanes:

* WIDE lanes modulo 2**64, pseudo-random for each paragraph: equality of multisets;
* LANES lanes modulo 2**16, a signed count sketch of the paragraph's word shingles: likeness.  The squared norm of
  a difference of two texts estimates how many shingles differ, with a relative error of about sqrt(2 / LANES).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .wordhash import mix, pieces, prefix, words

WIDE, LANES, SHINGLE_WORDS = 4, 256, 3
#: Rows of a bucket of neighbouring ids, about.
BUCKET_ROWS = 4096
ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]


def vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(wide: texts x WIDE uint64, sketch: texts x LANES uint16) of UTF-8 texts, each the sum over its paragraphs."""
    n = len(texts)
    wide, sketch = np.zeros((n, WIDE), np.uint64), np.zeros((n, LANES), np.uint16)
    if not n:
        return wide, sketch
    raw = b"\n".join(texts) + b"\n"
    data = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(data == 10)  # of paragraphs
    doc = np.searchsorted(np.cumsum(np.fromiter(map(len, texts), np.int64, n) + 1), ends, "right")
    doc[np.r_[doc[1:] != doc[:-1], True]] = np.arange(n)  # the break after a text belongs to it
    first = np.fromiter(map(xxhash.xxh3_64_intdigest, paragraphs := raw.split(b"\n")[:-1]), np.uint64, len(ends))
    second = np.fromiter(map(xxhash.xxh64_intdigest, paragraphs), np.uint64, len(ends))
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    for k in range(WIDE):
        wide[:, k] = np.add.reduceat(mix(first * np.uint64(ODD[0] + 2 * k) + (second ^ np.uint64(k + 1)) * np.uint64(ODD[1])), starts)
    start, end = words(data)
    if not len(start):
        return wide, sketch
    h = pieces(prefix(data), start, end)
    paragraph = np.searchsorted(ends, start)
    # A shingle is up to SHINGLE_WORDS words from each word on, within the paragraph.
    gram = mix(h)
    for k in range(1, SHINGLE_WORDS):
        gram = mix(gram)
        gram[: max(0, len(h) - k)] += np.where(paragraph[k:] == paragraph[: len(h) - k], h[k:], np.uint64(k))
        gram[max(0, len(h) - k) :] += np.uint64(k)
    gram = mix(gram)
    lane = (gram & np.uint64(LANES - 1)).astype(np.int64)
    sign = np.where(gram >> np.uint64(63), 1.0, -1.0)
    total = np.bincount(doc[paragraph] * LANES + lane, weights=sign, minlength=n * LANES)
    return wide, total.astype(np.int64).astype(np.uint16).reshape(n, LANES)


def text_of(wide: np.ndarray, sketch: np.ndarray) -> list[str]:
    """Fingerprints as hexadecimal strings: the wide lanes, then the sketch, big-endian."""
    rows = np.concatenate([wide.astype(">u8").view(np.uint8).reshape(len(wide), -1), sketch.astype(">u2").view(np.uint8).reshape(len(wide), -1)], axis=1)
    return [r.tobytes().hex() for r in rows]


def parsed(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(fingerprint)
    return np.frombuffer(raw[: 8 * WIDE], ">u8").astype(np.uint64), np.frombuffer(raw[8 * WIDE :], ">u2").astype(np.uint16)


def combined(first: str, second: str, sign: int = 1) -> str:
    """The fingerprint after the paragraphs of `second` are added to those of `first` (sign 1) or removed (-1)."""
    (a, b), (c, d) = parsed(first), parsed(second)
    with np.errstate(over="ignore"):
        return text_of((a + c if sign > 0 else a - c)[None], (b + d if sign > 0 else b - d)[None])[0]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 to 1 for each row: 1 if the wide lanes are equal, else the estimated share of shingles in common (Dice)."""
    x, y = a[1].view(np.int16).astype(np.float64), b[1].view(np.int16).astype(np.float64)
    apart = (a[1] - b[1]).view(np.int16).astype(np.float64)
    both = (x**2).sum(1) + (y**2).sum(1)
    share = np.clip(1 - (apart**2).sum(1) / np.maximum(both, 1), 0, 1)
    return np.where((a[0] == b[0]).all(1), 1.0, np.where(both > 0, share, 0.0))


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of each row.

    A null text counts as empty, which is one empty paragraph; texts of any length are read whole.  Equal texts have
    equal fingerprints, so repeated rows give repeated results; a null id stays null; other columns, of any names, are
    not read; an empty table gives an empty result.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [x or b"" for x in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("id"), pa.array(text_of(*vectors(texts)))], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(kernel, "doc_id long, fingerprint string")


def _compared(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    """rows: (id, text, text of the next)."""
    own = [t.encode() for _, t, _ in rows]
    edited = [(t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode() for _, t, nxt in rows]
    following = [nxt.encode() for _, _, nxt in rows]
    n = len(rows)
    chain = n > 1 and all(following[k] == own[k + 1] for k in range(n - 1))
    wide, sketch = vectors(own + edited + (following[-1:] if chain else following))
    a, b = (wide[:n], sketch[:n]), (wide[n : 2 * n], sketch[n : 2 * n])
    c = (np.r_[wide[1:n], wide[2 * n :]], np.r_[sketch[1:n], sketch[2 * n :]]) if chain else (wide[2 * n :], sketch[2 * n :])
    columns = [
        pa.array([i for i, _, _ in rows], pa.int64()), pa.array([len(t) for _, t, _ in rows], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in edited]),
        pa.array(text_of(*a)), pa.array(text_of(*b)), pa.array(likeness(a, b)), pa.array(likeness(a, c)),
    ]
    return pa.record_batch(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, in the order of the chain; a bucket's guest, its last, is what follows the bucket.

    Of `copies` equal rows each but the last is followed by the next of them.
    """
    waiting: list[tuple[int | None, str, str]] = []
    held, size = None, 0
    for batch in batches:
        for part in slices(batch, "text"):
            for bucket, guest, doc_id, text, copies in zip(*(part.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text", "copies"))):
                if held and held[0] == bucket:
                    for k in range(held[3], 0, -1):
                        waiting.append((held[1], held[2], text if k == 1 else held[2]))
                        size += len(held[2])
                        if size > 1 << 19 or len(waiting) > 1 << 14:
                            yield _compared(waiting)
                            waiting, size = [], 0
                held = None if guest else (bucket, doc_id, text, copies)
    if waiting:
        yield _compared(waiting)


def below(x: F.Column, edges: list[int]) -> F.Column:
    """How many of the sorted edges are less than x: among every s-th edge first, then among the s behind the last of these."""
    if not edges:
        return F.lit(0)
    array = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    s = max(1, round(len(edges) ** 0.5))
    coarse = F.size(F.filter(array(edges[::s]), lambda e: e < x))
    fine = F.slice(array(edges), (F.greatest(coarse, F.lit(1)) - 1) * s + 1, F.lit(s))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * s + F.size(F.filter(fine, lambda e: e < x)))


def edited_and_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Each row with its fingerprint, its edited text's, and their likeness to each other and to the next row's.

    The next row is the one with the next smaller doc_id, after the last the first; rows of one id follow each
    other by text, and null ids come last.  The edited text has its last floor(n_chars / 2) code points replaced
    by the next text's first as many, or all.  A null text counts as empty; a lone row is its own next.  Other
    columns are not read; an empty table gives an empty result.

    Rows are dealt to buckets by ranges of ids, whose cuts are quantiles.  The only extra rows that a bucket needs
    are its guest, the first row of the bucket below, so texts are shuffled once.  The driver learns one id for
    each bucket.  An id with many rows, or the rows without one, are dealt to buckets by ranges of their texts'
    hashes, copies counted first.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    count = ids.count()
    buckets = max(1, min(count // bucket_rows, 100_000))
    tie = F.xxhash64("text")
    cuts: set[int] = set()
    heavy: dict[int | None, int] = {}  # parts of ids with more rows than two buckets; there are fewer such ids than buckets
    if buckets > 1:
        share = [k / buckets for k in range(1, buckets)]
        cuts = set(ids.agg(F.percentile_approx("doc_id", share, 10 * buckets)).first()[0] or [])
        most = 2 * max(bucket_rows, count // buckets)
        heavy = {r["doc_id"]: -(-r["count"] // bucket_rows) for r in ids.groupBy("doc_id").count().where(F.col("count") > most).collect()}
        cuts |= {x for v in heavy if v is not None for x in (v - 1, v) if x >= -(1 << 63)}
    edges, width = sorted(cuts), max(heavy.values(), default=1)
    rows = rows.withColumn("copies", F.lit(1).cast("long"))
    if heavy:
        known = F.coalesce(F.col("doc_id").isin([v for v in heavy if v is not None]), F.lit(None in heavy))
        many = rows.where(known).groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
        rows = rows.where(~known).unionByName(many)

    def placed(df: DataFrame, texts: bool) -> DataFrame:
        at = ((below(F.col("doc_id"), edges) + 1) * width).cast("long")
        bucket = F.when(F.col("doc_id").isNotNull(), at).otherwise(F.lit(0).cast("long"))
        if texts:  # the share of all hashes below the row's own, in parts; the chain's first part has the largest number
            place = F.shiftrightunsigned(tie.bitwiseXOR(F.lit(-(1 << 63))), 33)
            for v, parts in heavy.items():
                bucket = bucket + F.when(F.col("doc_id").eqNullSafe(F.lit(v).cast("long")), parts - 1 - F.shiftright(place * parts, 31)).otherwise(F.lit(0))
        return df.withColumn("bucket", bucket)

    # The first row of each bucket in the order of the chain: largest id, then smallest text hash and text.
    tops = placed(rows if heavy else ids, bool(heavy)).groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()
    present = sorted((r["bucket"] for r in tops), reverse=True)  # the order of the chain
    top = {r["bucket"]: r["top"] for r in tops}
    host = {b: present[k - 1] for k, b in enumerate(present)}  # whose guest is b's first row
    base = placed(rows, bool(heavy)).withColumn("guest", F.lit(False))
    if present:
        table = spark.createDataFrame([(top[b], b, host[b]) for b in present], "top long, of long, host long")
        firsts = rows.join(F.broadcast(table.select("top").distinct()), rows["doc_id"].eqNullSafe(F.col("top"))).drop("top")
        firsts = placed(firsts, bool(heavy)).join(F.broadcast(table), (F.col("bucket") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("top")))
        firsts = firsts.groupBy("of", "host", "doc_id").agg(F.min(F.struct(tie.alias("h"), "text")).alias("x"))
        guests = firsts.select("doc_id", F.col("x.text").alias("text"), F.lit(1).cast("long").alias("copies"), F.col("host").alias("bucket"), F.lit(True).alias("guest"))
        base = base.unionByName(guests)
    partitions = max(1, min(len(present), max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(present) // 8)))
    dealt = base.repartition(partitions, "bucket").sortWithinPartitions(F.desc("bucket"), "guest", F.desc_nulls_last("doc_id"), tie, "text")
    return dealt.select("bucket", "guest", "doc_id", "text", "copies").mapInArrow(
        _chained, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )

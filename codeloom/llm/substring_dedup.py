"""Substring deduplication by paragraph MinHash banding.

Paragraphs are cut by content, not by lines: a cut is made before a word whose hash, with the next word's, is the
least within REACH words on both sides, or one of several least.  So a passage that stands in two documents is cut
alike in both, but for its ends, whatever surrounds it.  Paragraphs that agree in a band of MinHashes of their word
shingles meet; unequal ones are verified by exact Jaccard similarity of the shingles; components of links are clusters.
Of a cluster, the occurrence with the smallest document and place stays, and neighbouring repeats are joined to
passages, which are extended word by word at both ends as far as any other document goes on alike.
"""

from __future__ import annotations

import bisect
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, discard, forest, fresh, raw_texts, slices, stored
from .wordhash import mix, pieces, prefix, words

#: Words between two cuts: more than REACH, unless word pairs recur within it.
REACH = 6
#: Most words by which an end is extended.  A longer stretch has a cut of its own, as no cut for so long takes hashes
#: that fall or rise nearly all the way.
FLANK = 40
#: Bytes of a word's hash in a context.
SHORT = 2
SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: MinHashes of a band, and the share of pairs at SIMILARITY that shall meet in one band at least.
ROWS, RECALL = 1, 0.95
#: Least words of a passage that repeats.
PASSAGE_WORDS = 20
#: Most paragraphs compared with each other at once; a fuller bucket is dealt to more tiles, all pairs of which meet.
TILE = 256
#: Shingles that a comparison of two tiles looks at in one step.
COLUMNS = 8192
#: Contexts that one task sorts, about.
CONTEXTS = 100_000
#: A cluster with over this part of all places is hot.
HOT = 1000
#: Bytes before a context's words: its cluster and side.
HEADER = 13


def tuned(similarity: float, recall: float = RECALL, rows: int = ROWS) -> tuple[int, int]:
    """(bands, few): the fewest bands of `rows` MinHashes for which that share of pairs at the similarity meet in one, and
    the most shingles of a set that no other set is alike enough to, so that equal ones alone need meet.

    A pair agrees in a band with a chance of similarity ** rows; a set of n shingles shares at most n / (n + 1) with another.
    """
    chance = similarity**rows
    bands = 1 if chance >= recall else math.ceil(math.log(1 - recall) / math.log(1 - chance) - 1e-9)
    few = 0
    while (few + 1) / (few + 2) < similarity - 1e-9:
        few += 1
    return bands, few


def paragraphs(data: np.ndarray, size_of: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, first word, end word, hash, gram hashes, gram paragraph, word starts, word ends) of joined texts.

    data: the texts' bytes, each with one more, a line break; size_of: their lengths with it.  Hashes ignore how
    words are spaced.  A gram is SHINGLE_WORDS words, or all of a shorter paragraph.
    """
    start, end = words(data)
    doc = np.searchsorted(np.cumsum(size_of), start, "right")
    n = len(start)
    if not n:
        empty = np.zeros(0, np.int64)
        return (empty,) * 3 + (np.zeros(0, np.uint64),) * 2 + (empty,) * 3
    h = pieces(prefix(data), start, end)
    same = doc[1:] == doc[:-1]
    pair = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    pair[:-1][same] = mix(h[:-1] * np.uint64(3) + h[1:])[same]
    low = np.ones(n, bool)
    for k in range(1, REACH + 1):
        if n > k:
            near = doc[k:] == doc[:-k]
            low[:-k] &= ~near | (pair[:-k] <= pair[k:])
            low[k:] &= ~near | (pair[k:] <= pair[:-k])
    low &= np.r_[False, same]
    cut = low | np.r_[True, ~same]
    first = np.flatnonzero(cut)
    last = np.r_[first[1:], n]
    owner = np.cumsum(cut) - 1
    # Grams: chains of up to SHINGLE_WORDS words within the paragraph.
    gram = mix(h)
    room = last[owner] - np.arange(n)
    for k in range(1, SHINGLE_WORDS):
        ahead = np.zeros(n, np.uint64)
        ahead[: max(0, n - k)] = h[k:]
        gram = np.where(room > k, mix(gram + ahead), gram)
    whole = (room >= SHINGLE_WORDS) | (np.arange(n) == first[owner])
    size = last - first
    place = (np.arange(n) - first[owner]).astype(np.uint64)
    total = np.add.reduceat(mix(h ^ mix(place + np.uint64(7))), first)
    return doc[first], first, last, mix(total + size.astype(np.uint64)), gram[whole], owner[whole], start, end


def keys_of(gram: np.ndarray, owner: np.ndarray, bands: int, few: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, keys of each paragraph): hashes of the band's number and its MinHashes, `bands` a paragraph.

    Of at most `few` shingles no other set but an equal one is alike enough, so these have one key, for equal sets.
    """
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    short = np.diff(np.r_[starts, len(owner)]) <= few
    out = []
    for band in range(bands):
        key = np.full(len(starts), band + 1, np.uint64)
        for row in range(ROWS):
            hashed = mix(gram ^ mix(np.uint64(1000 + band * ROWS + row).reshape(1)))
            key = mix(key + np.minimum.reduceat(hashed, starts))
            if not band and not row:
                equal = mix(mix(np.minimum.reduceat(hashed, starts)) + np.maximum.reduceat(hashed, starts))
        out.append(key)
    keys = np.stack(out, axis=1)
    keys[short, 0] = equal[short]
    used = np.ones(keys.shape, bool)
    used[short, 1:] = False
    return keys[used], used.sum(axis=1)


def _cut_batches(similarity: float):  # noqa: ANN202
    bands, few = tuned(similarity)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = raw_texts(part.column("text"))
                data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
                size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
                doc, first, last, h, gram, owner, start, end = paragraphs(data, size)
                if not len(doc):
                    continue
                own = pieces(prefix(data, 1), start, end)  # a second hash, of other values
                check = mix(np.add.reduceat(mix(own + mix(np.arange(len(own), dtype=np.uint64) - np.repeat(first, last - first).astype(np.uint64))), first))
                points = np.cumsum((data & 0xC0) != 0x80)  # code points up to and with each byte
                base = np.r_[0, points[np.cumsum(size) - 1]][doc]
                first_of_doc = np.searchsorted(doc, doc)
                keys, count = keys_of(gram, owner, bands, few)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), pa.array(keys.view(np.int64)))
                columns = [
                    part.column("doc_id").take(pa.array(doc)), pa.array(first - first[first_of_doc]), pa.array(last - first), pa.array(points[start[first]] - 1 - base), pa.array(points[end[last - 1] - 1] - base),
                    pa.array(h.view(np.int64)), pa.array((check >> np.uint64(32)).astype(np.uint32).view(np.int32)), lists,
                ]
                yield pa.record_batch(columns, names=CUT_NAMES)

    return kernel


CUT_NAMES = ["doc_id", "word", "n_words", "start", "end", "h", "check", "keys"]
CUT = "doc_id long, word long, n_words long, start long, end long, h long, check int, keys array<long>"


def cut(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The paragraphs of every text: first word's number, words, code points (end exclusive), two hashes and band keys.

    A null or empty text has none.  Other columns than doc_id and text are not read.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_cut_batches(similarity), CUT)


def _grams_of(wanted: str):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = raw_texts(part.column("text"))
                data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
                doc, _, _, h, gram, owner, _, _ = paragraphs(data, np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
                asked = [np.array(x, np.int64).view(np.uint64) for x in part.column(wanted).to_pylist()]
                edge = np.searchsorted(owner, np.arange(len(h) + 1))
                ids, lists = [], []
                bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
                for k, ask in enumerate(asked):
                    a, b = bounds[k], bounds[k + 1]
                    for p in a + np.flatnonzero(np.isin(h[a:b], ask)):
                        ids.append(int(h[p : p + 1].view(np.int64)[0]))
                        lists.append(np.unique(gram[edge[p] : edge[p + 1]]).view(np.int64))
                if ids:
                    sizes = np.cumsum([0, *map(len, lists)])
                    yield pa.record_batch([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(lists)))], names=["h", "grams"])

    return kernel


def _flank_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stands before (side -1) or from (side 1) each asked word on: its context, and for ends of runs where each word ends.

    A context is the cluster and the side, then short hashes of the words from the paragraph outwards.
    """
    for batch in batches:
        for part in slices(batch, "text"):
            ids, at, side, contexts, points = [], [], [], [], []
            for doc, text, asked in zip(part.column("doc_id").to_pylist(), raw_texts(part.column("text")), part.column("asked").to_pylist()):
                data = np.frombuffer(text + b"\n", np.uint8)
                start, end = words(data)
                if not len(start):
                    continue
                h = (pieces(prefix(data), start, end) >> np.uint64(48)).astype(np.uint16)
                count = np.r_[0, np.cumsum((data & 0xC0) != 0x80)].astype(np.int32)
                begin, stop = count[start], count[end]
                for ask in asked:
                    w, turn = ask["at"], -1 if ask["side"] < 0 else 1
                    span = slice(max(0, w - FLANK), w) if turn < 0 else slice(w, w + FLANK)
                    if w < 0 or w > len(h) or not len(h[span]):  # rows of one id may differ in their texts
                        continue
                    ids.append(doc)
                    at.append(w)
                    side.append(ask["side"])
                    contexts.append(struct.pack("<qi", ask["id"], ask["check"]) + (b"b" if turn < 0 else b"a") + h[span][::turn].tobytes())
                    points.append((begin if turn < 0 else stop)[span][::turn].tobytes() if ask["own"] else None)
            if ids:
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(at, pa.int64()), pa.array(side, pa.int32()), pa.array(contexts, pa.binary()), pa.array(points, pa.binary())], names=["f_id", "f_at", "f_side", "context", "points"])


def alike(contexts: list[bytes]) -> list[int]:
    """Words that each context but the first shares with the one before; none if their clusters or sides differ."""
    if len(contexts) < 2:
        return []
    wide = HEADER + SHORT * FLANK + 1  # and one byte that never agrees
    m = np.frombuffer(b"".join(c.ljust(wide, b"\0") for c in contexts), np.uint8).reshape(-1, wide)
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    differs = m[1:] != m[:-1]
    differs[:, -1] = True
    same = np.minimum(differs.argmax(axis=1), np.minimum(size[1:], size[:-1]))
    return (np.maximum(0, same - HEADER) // SHORT).tolist()


def neighbours(contexts: list[bytes], lows: list[int], highs: list[int]) -> tuple[list[int], list[int]]:
    """For each of the sorted contexts, of which the smallest and largest document are given: words it shares with a
    context of another document, and with one of a document smaller than its own smallest.

    In sorted order, what two contexts share is the least that neighbours between them share.  So of those that
    qualify, the nearest on either side shares most.
    """
    most, n = FLANK, len(contexts)
    step = [0, *alike(contexts), 0]  # step[k]: shared with the one before
    others, smaller = [0] * n, [0] * n
    for turn in (range(n), range(n - 1, -1, -1)):
        # The last row passed, and the last one of another document than that: [document, None if several, words shared].
        last, before = [None, 0], [None, 0]
        # Rows passed whose documents fall from the top down, each with the words shared with what was passed next.
        stack: list[list[int]] = []
        for k in turn:
            low, high = lows[k], highs[k]
            own, now = low if low == high else None, step[k] if turn.step > 0 else step[k + 1]
            last[1], before[1] = min(last[1], now), min(before[1], now)
            if stack:
                stack[-1][1] = min(stack[-1][1], now)
            while stack and stack[-1][0] >= low:
                gone = stack.pop()[1]
                if stack:
                    stack[-1][1] = min(stack[-1][1], gone)
            smaller[k] = max(smaller[k], stack[-1][1] if stack else 0)
            others[k] = most if own is None else max(others[k], before[1] if last[0] == own else last[1])
            if own is None or own != last[0]:
                before = last
            last = [own, most]
            stack.append([low, most])
    return others, smaller


def _compared(guests: dict[int, list[tuple[bytes, int, int]]]):
    """Contexts come by bucket, sorted; a bucket's guests are the last context below it and the first above."""

    def told(bucket: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = [[x for p in parts for x in p.column(c).to_pylist()] for c in ("context", "low", "high")]
        before = [g for g in guests.get(bucket, []) if g[0] < rows[0][0]]
        after = [g for g in guests.get(bucket, []) if g[0] > rows[0][-1]]
        every = [[*(g[c] for g in before), *rows[c], *(g[c] for g in after)] for c in range(3)]
        shared = [x[len(before) : len(x) - len(after)] for x in neighbours(*every)]
        columns = [pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.int64()), *(pa.array(x, pa.int32()) for x in shared)]
        return pa.record_batch(columns, names=["c_context", "low", "others", "smaller"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = None, []
        for batch in batches:
            bucket = batch.column("bucket").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for a, b in zip(edges, edges[1:]):
                if b > a and bucket[a] != held and parts:
                    yield told(held, parts)
                    parts = []
                if b > a:
                    held = int(bucket[a])
                    parts.append(batch.slice(a, b - a))
        if parts:
            yield told(held, parts)

    return kernel


def _shared(contexts: DataFrame, most: int = CONTEXTS) -> DataFrame:
    """(c_context, low, others, smaller) of distinct contexts (context, low, high): see `neighbours`.

    Contexts are dealt to buckets by ranges, of about `most` each, so a cluster of any size is split where its words
    differ.  The driver learns sixteen contexts a bucket for the cuts, and two for the neighbours across them.
    """
    buckets = max(1, contexts.count() // most)
    edges: list[bytes] = []
    if buckets > 1:
        sample = contexts.where(F.pmod(F.xxhash64("context"), F.lit(max(1, most // 16))) == 0).select("context").collect()
        edges = sorted(bytes(r["context"]) for r in sample)[15::16]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("bucket", pa.array([bisect.bisect_right(edges, c) for c in batch.column("context").to_pylist()], pa.int32()))

    at = contexts.mapInArrow(placed, "context binary, low long, high long, bucket int")
    guests: dict[int, list[tuple[bytes, int, int]]] = {}
    if edges:
        row = F.struct("context", "low", "high")
        ends = sorted(at.groupBy("bucket").agg(F.min(row).alias("first"), F.max(row).alias("last")).collect())
        plain = lambda x: (bytes(x["context"]), x["low"], x["high"])
        for below, above in zip(ends, ends[1:]):
            guests.setdefault(above["bucket"], []).append(plain(below["last"]))
            guests.setdefault(below["bucket"], []).append(plain(above["first"]))
    dealt = at.repartition(len(edges) + 1, "bucket").sortWithinPartitions("bucket", "context")
    return dealt.mapInArrow(_compared(guests), "c_context binary, low long, others int, smaller int")


def _extended(found: DataFrame, insides: DataFrame, docs: DataFrame, contexts_a_task: int) -> DataFrame:
    """found with its runs extended at both ends by the words that any other document shares there.

    insides: (cluster, side, first, last), the first and last place (doc_id, at) where a cluster is followed on that
    side by the same other one.

    Of the words added, those go that a document smaller than the run's own shares; so the smallest document that has
    them keeps them.
    """
    side = lambda end, n: found.select("doc_id", "run", F.lit(n).alias("side"), (F.col(f"{end}.word") + (F.col(f"{end}.n_words") if n > 0 else 0)).alias("at"), F.col(f"{end}.cluster").alias("cluster"))
    sides = side("head", -1).union(side("tail", 1))
    wanted = sides.select("cluster", "side").distinct()
    # What follows a paragraph within a run is a paragraph too: of all places where the same two meet, two will do.
    own = sides.select("doc_id", "at", "side", "cluster", F.lit(True).alias("own"))
    inner = insides.join(wanted, ["cluster", "side"]).select(F.inline(F.array_distinct(F.array("first", "last"))), "side", "cluster", F.lit(False).alias("own"))
    asked = own.union(inner).groupBy(F.col("doc_id").alias("asked_id")).agg(F.collect_list(F.struct("at", "side", F.col("cluster.id").alias("id"), F.col("cluster.check").alias("check"), "own")).alias("asked"))  # no more than two a paragraph
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(asked.hint("shuffle_hash"), F.col("doc_id") == F.col("asked_id"))  # texts needn't be sorted
    flanks = stored(texts.select("doc_id", "text", "asked").mapInArrow(_flank_batches, "f_id long, f_at long, f_side int, context binary, points binary"), "flanks")
    contexts = stored(flanks.groupBy("context").agg(F.min("f_id").alias("low"), F.max("f_id").alias("high")), "contexts")
    shared = _shared(contexts, contexts_a_task)
    ends = flanks.where("points is not null").dropDuplicates(["f_id", "f_at", "f_side"])
    met = ends.join(shared, F.col("context") == F.col("c_context"))
    whole = F.floor((F.length("context") - HEADER) / SHORT).cast("int")
    met = met.select("f_id", "f_at", "f_side", F.least("others", whole).alias("more"), F.when(F.col("f_id") > F.col("low"), whole).otherwise(F.col("smaller")).alias("less"), "points")
    told = sides.join(met, (F.col("doc_id") == F.col("f_id")) & (F.col("at") == F.col("f_at")) & (F.col("side") == F.col("f_side")))
    of = lambda n: F.max(F.when(F.col("side") == n, F.struct("more", "less", "points")))
    more = told.groupBy(F.col("doc_id").alias("e_id"), F.col("run").alias("e_run")).agg(of(-1).alias("before"), of(1).alias("after"))
    rows = found.join(more, (F.col("doc_id") == F.col("e_id")) & (F.col("run") == F.col("e_run")), "left")
    # Two runs may reach for the same words between them: the earlier one has them.
    order = Window.partitionBy("doc_id").orderBy("run")
    rows = rows.withColumn("after_words", F.coalesce("after.more", F.lit(0)))
    free = F.col("head.word") - F.coalesce(F.lag(F.col("tail.word") + F.col("tail.n_words") + F.col("after_words")).over(order), F.lit(0))
    ahead = F.coalesce(F.lead("head.word").over(order) - F.col("tail.word") - F.col("tail.n_words"), F.lit(FLANK))
    rows = rows.withColumn("after_words", F.least("after_words", F.greatest(ahead, F.lit(0))).cast("int")).withColumn("free", F.greatest(free, F.lit(0)))
    rows = rows.withColumn("before_words", F.least(F.coalesce("before.more", F.lit(0)), "free").cast("int"))
    rows = rows.withColumn("before_gone", F.least(F.coalesce("before.less", F.lit(0)), "before_words")).withColumn("after_gone", F.least(F.coalesce("after.less", F.lit(0)), "after_words"))

    def place(end: str, n: str, none: str):  # noqa: ANN202
        """The code point of the n-th word outwards, from its four bytes; of no word, the end itself."""
        raw = F.substring(F.col(f"{end}.points"), (F.col(n) - 1) * 4 + 1, F.lit(4))
        digits = F.concat(*[F.substring(F.hex(raw), 7 - 2 * k, 2) for k in range(4)])  # the last byte is the highest
        return F.when(F.col(n) > 0, F.conv(digits, 16, 10).cast("long")).otherwise(F.col(none))

    gone = F.array(F.when(F.col("before_gone") > 0, F.struct(place("before", "before_gone", "start").alias("start"), F.col("start").alias("end"))), F.when(F.col("after_gone") > 0, F.struct(F.col("end").alias("start"), place("after", "after_gone", "end").alias("end"))))
    removed = F.sort_array(F.concat("removed", F.array_compact(gone)))
    return rows.select(
        "doc_id", place("before", "before_words", "start").alias("start"), place("after", "after_words", "end").alias("end"), (F.col("n_words") + F.col("before_words") + F.col("after_words")).alias("n_words"),
        (F.col("n_removed") + F.col("before_gone") + F.col("after_gone")).alias("n_removed"), "kept_doc_id", removed.alias("removed"),
    )


def shared_grams(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of a has in common with each of b, by products of 0-1 matrices, COLUMNS shingles at a time."""
    flat = np.concatenate([*a, *b])
    _, code = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    out = np.zeros((len(a), len(b)), np.float32)
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        lo, hi = np.searchsorted(code, [at, at + COLUMNS])
        m = np.zeros((len(a) + len(b), min(COLUMNS, int(code[-1]) + 1 - at)), np.float32)
        m[row[lo:hi], code[lo:hi] - at] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out


def _verified(similarity: float):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for a, ga, b, gb in zip(*(batch.column(c).to_pylist() for c in ("ha", "ga", "hb", "gb"))):
                u, v = [np.array(x, np.int64) for x in ga], [np.array(x, np.int64) for x in gb]
                shared = shared_grams(u, v)
                union = np.array([len(x) for x in u])[:, None] + np.array([len(x) for x in v])[None] - shared
                i, j = np.nonzero(shared >= similarity * union - 1e-6)
                x, y = np.array(a, np.int64)[i], np.array(b, np.int64)[j]
                if (x != y).any():
                    x, y = forest(x[x != y], y[x != y])
                    left.append(x)
                    right.append(y)
            if left:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in (left, right)], names=["a", "b"])

    return kernel


def verified_links(buckets: DataFrame, grams: DataFrame, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that join all paragraphs of a bucket with a Jaccard similarity of `similarity` or more; exact.

    buckets (key, h), grams (h, grams).  Two sets that alike share one of their first n - ceil(similarity * n) + 1
    shingles in any common order, so a bucket is split by those, the rarest in the bucket first: what a bucket has in
    common by chance comes last.  In each part all are held against one; those that link to it need no comparison
    with each other.  What is left meets all of the part in tiles, each pair of tiles a row of its own.
    """
    every = buckets.join(grams, "h").select("key", "h", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    often = every.groupBy("key", "gram").agg(F.count("*").alias("often")).where("often > 1")
    listed = every.join(often, ["key", "gram"]).groupBy("key", "h", "n").agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("known"))  # a paragraph's shingles
    # shingles that are alone in the bucket are the rarest: they take places of the first ones, but no other has them
    first = F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1 - (F.col("n") - F.size("known"))
    parts = listed.where(first > 0).select("h", "key", F.explode(F.slice("known", F.lit(1), first.cast("int"))).alias("by"))
    parts = stored(parts.select(F.xxhash64("key", "by.gram").alias("part"), "h").join(grams, "h"), "parts")
    pivots = parts.groupBy("part").agg(F.min(F.struct("h", "grams")).alias("pivot"), F.count("*").alias("members")).where("members > 1")
    shared = F.size(F.array_intersect("grams", "pivot.grams"))
    near = shared >= similarity * (F.size("grams") + F.size("pivot.grams") - shared) - 1e-9
    held = stored(parts.join(pivots, "part").where(F.col("h") != F.col("pivot.h")).select("part", "h", "grams", F.col("pivot.h").alias("pivot"), near.alias("near")), "held")
    sizes = held.groupBy("part").agg(F.ceil(F.count_if("near") / F.lit(tile)).alias("near_tiles"), F.ceil(F.count_if(~F.col("near")) / F.lit(tile)).alias("far_tiles"))
    rest = held.join(sizes.where("far_tiles > 0"), "part")
    number = F.pmod(F.xxhash64("h"), F.when(F.col("near"), F.col("near_tiles")).otherwise(F.col("far_tiles")))
    tiles = rest.groupBy("part", "near", number.alias("tile"), "far_tiles").agg(F.collect_list("h").alias("h"), F.collect_list("grams").alias("g"))
    tiles = stored(tiles, "tiles")
    far = tiles.where("not near").select("part", F.col("tile").alias("to"), F.col("h").alias("ha"), F.col("g").alias("ga"))
    # a tile of linked paragraphs meets all tiles of the others, one of the others itself and those after it
    ask = tiles.select("part", F.explode(F.sequence(F.when(F.col("near"), F.lit(0)).otherwise(F.col("tile")), F.col("far_tiles") - 1)).alias("to"), F.col("h").alias("hb"), F.col("g").alias("gb"))
    pairs = far.join(ask, ["part", "to"]).select("ha", "ga", "hb", "gb")
    return pairs.mapInArrow(_verified(similarity), "a long, b long").union(held.where("near").select(F.col("pivot").alias("a"), F.col("h").alias("b")))


def repeats(docs: DataFrame, similarity: float = SIMILARITY, passage_words: int = PASSAGE_WORDS, contexts_a_task: int = CONTEXTS) -> DataFrame:
    """Passages that stand in more than one document: one row each, with what of it is to go.

    Columns: doc_id, start, end (code points, end exclusive), n_words, n_removed (words of it whose kept occurrence is
    elsewhere), kept_doc_id (the smallest document that has one of its paragraphs), removed (a list of the (start, end)
    to delete).  A passage is a run of neighbouring paragraphs that repeat, extended at both ends by the words that
    another document shares, of passage_words words at least then.  Ties: of equal paragraphs the one in the
    smallest document, then of the smallest place, stays.  A document without an id has no part in it; a null or
    empty text has no paragraphs; texts of any length are cut whole.  Rows of one id count as one document.  Other
    columns are not read; an empty table gives an empty result.  Paragraphs are one if two hashes of 64 bits are equal.
    """
    docs = docs.where(F.col("doc_id").isNotNull())
    banded = cut(docs, similarity).select("*", F.posexplode("keys").alias("band", "key")).drop("keys")
    met = banded.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("h").alias("h_low"), F.max("h").alias("h_high"))
    met = stored(met.where("low < high").select(F.col("key").alias("met_key"), (F.col("h_low") != F.col("h_high")).alias("differ")), "met")
    # The keys that meet are few, so they are hashed, and the paragraphs of all texts needn't be sorted.
    members = stored(banded.join(met.hint("shuffle_hash"), banded["key"] == met["met_key"]).drop("met_key"), "members")
    discard(met)
    # Unequal paragraphs in a bucket: one place of each is looked up again for its shingles.
    unequal = members.where("differ").groupBy("h").agg(F.min(F.struct("doc_id", "word", "check")).alias("at"))
    asked = unequal.groupBy(F.col("at.doc_id").alias("asked_id")).agg(F.collect_set("h").alias("asked"))  # no more than the document's paragraphs
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(asked.hint("shuffle_hash"), F.col("doc_id") == F.col("asked_id"))
    grams = stored(texts.select("text", "asked").mapInArrow(_grams_of("asked"), "h long, grams array<long>").groupBy("h").agg(F.min("grams").alias("grams")), "grams")
    edges = verified_links(members.where("differ").select("key", "h").distinct(), grams, similarity)
    roots = components(edges).select(F.col("node").alias("linked"), "root")
    roots = roots.join(unequal.select("h", F.col("at.check").alias("linked_check")), F.col("linked") == F.col("h")).drop("h")
    # Equal paragraphs meet in every band, so of those that link to no other one band is enough.
    places = members.select("doc_id", "word", "n_words", "start", "end", "h", "check", "band")
    own = F.when(F.col("root").isNull(), F.struct(F.col("h").alias("id"), "check")).otherwise(F.struct(F.col("root").alias("id"), F.lit(0).alias("check")))
    classed = places.join(roots, (places["h"] == roots["linked"]) & (places["check"] == roots["linked_check"]), "left").where("band = 0 or root is not null").select("doc_id", "word", "n_words", "start", "end", own.alias("cluster"))
    classed = stored(classed, "classed")
    discard(members, grams)
    clusters = classed.groupBy("cluster").agg(F.min(F.struct("doc_id", "word")).alias("keep"), F.max("doc_id").alias("high"), F.count("*").alias("places"))
    clusters = stored(clusters.where("keep.doc_id < high").select(F.col("cluster").alias("known"), "keep", "places"), "clusters")
    # A cluster with over a HOT-th of all places is sent to every task: there are fewer than HOT of them.
    is_hot = F.col("places") * HOT > classed.count()
    hot = F.broadcast(clusters.where(is_hot).drop("places"))
    cold = clusters.where(~is_hot).drop("places").hint("shuffle_hash")
    rest = classed.join(hot, F.col("cluster") == F.col("known"), "left_anti").join(cold, F.col("cluster") == F.col("known"))
    again = stored(classed.join(hot, F.col("cluster") == F.col("known")).unionByName(rest).drop("known"), "again")
    discard(classed, clusters)
    # Rows of one id, and bands, may give a place again.
    order = Window.partitionBy("doc_id").orderBy("word", "n_words")
    again = again.withColumn("seen", F.lag(F.struct("word", "n_words")).over(order)).where(~F.col("seen").eqNullSafe(F.struct("word", "n_words"))).drop("seen")
    # In the document that has the kept occurrence, a short line said again and again stays whole.
    goes_on = (F.lag("cluster").over(order) == F.col("cluster")) & (F.lag(F.col("word") + F.col("n_words")).over(order) == F.col("word"))
    stays = (F.col("doc_id") == F.col("keep.doc_id")) & ((F.col("word") == F.col("keep.word")) | F.coalesce(goes_on, F.lit(False)))
    ends = F.struct("word", "n_words", "cluster")
    begins = (F.col("word") != F.coalesce(F.lag(F.col("word") + F.col("n_words")).over(order), F.lit(-1))).cast("long")
    runs = again.withColumn("goes", ~stays).withColumn("begins", begins).withColumn("run", F.sum("begins").over(order))
    gone = F.when(F.col("goes"), F.struct("start", "end"))
    found = runs.groupBy("doc_id", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_words").alias("n_words"), F.sum(F.when(F.col("goes"), F.col("n_words")).otherwise(0)).alias("n_removed"),
        F.min("keep.doc_id").alias("kept_doc_id"), F.sort_array(F.collect_list(gone)).alias("removed"), F.min(ends).alias("head"), F.max(ends).alias("tail"),
    )
    # Two neighbours within a run, seen from the one and from the other.
    after = F.lead(F.struct("cluster", "word")).over(order).alias("after")
    met = again.select("doc_id", "word", "n_words", "cluster", after).where(F.col("after.word") == F.col("word") + F.col("n_words"))
    seen = lambda n, cluster, other, at: F.struct(F.lit(n).alias("side"), cluster.alias("cluster"), other.alias("other"), at.alias("at"))
    sides = F.array(seen(1, F.col("cluster"), F.col("after.cluster"), F.col("after.word")), seen(-1, F.col("after.cluster"), F.col("cluster"), F.col("after.word")))
    place = F.struct("doc_id", "at")
    insides = met.select("doc_id", F.inline(sides)).groupBy("cluster", "side", "other").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    return _extended(stored(found, "runs"), insides, docs, contexts_a_task).where(F.col("n_words") >= passage_words)


def without_repeats(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """docs with what `repeats` removes cut from text; its other columns, of any names, stay as they are.

    A row without an id, or with a null or empty text, is kept as it is; rows of one id are cut alike; an empty table
    stays empty.  Texts of any length are cut whole.
    """
    cut_id, cuts = fresh(docs, "cut_id", "cuts")
    gone = repeats(docs, **options).where("n_removed > 0").groupBy(F.col("doc_id").alias(cut_id)).agg(F.sort_array(F.flatten(F.collect_list("removed"))).alias(cuts))
    joined = docs.join(gone, F.col("doc_id") == F.col(cut_id), "left")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(cuts, lambda c: c["end"]))
    begins = F.concat(F.transform(cuts, lambda c: c["start"]), F.array(F.length("text").cast("long")))
    kept = F.transform(F.arrays_zip(ends.alias("a"), begins.alias("b")), lambda x: F.substring(F.col("text"), (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")))
    text = F.when(F.col(cuts).isNull(), F.col("text")).otherwise(F.array_join(kept, ""))
    return joined.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])

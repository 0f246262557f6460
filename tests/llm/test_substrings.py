"""Substring deduplication against brute force: neighbours, links of paragraphs, and what is found of all that repeats."""

import duckdb
import numpy as np
import pytest
from codeloom.llm import substring_dedup as dedup
from codeloom.llm.wordhash import mix, pieces, prefix, words
from pyspark.sql import functions as F


@pytest.mark.parametrize("seed", range(4))
def test_neighbours(seed):
    rng = np.random.default_rng(seed)
    contexts = sorted({bytes(dedup.HEADER - 1) + bytes([rng.integers(2)]) + rng.integers(0, 3, int(rng.integers(0, 6))).astype(np.uint16).tobytes() for _ in range(60)})
    rows = [(c, int(a), int(max(a, b))) for c, a, b in zip(contexts, rng.integers(0, 6, len(contexts)), rng.integers(0, 3, len(contexts)))]
    share = lambda a, b: dedup.alike([min(a, b), max(a, b)])[0]
    for (c, low, high), others, smaller in zip(rows, *dedup.neighbours(*map(list, zip(*rows)))):
        whole = (len(c) - dedup.HEADER) // dedup.SHORT
        want = max([share(c, d) for d, x, y in rows if d != c and (x, y) != (low, low)], default=0) if low == high else whole
        assert min(others, whole) == want
        assert smaller == max([share(c, d) for d, x, _ in rows if x < low], default=0)


@pytest.mark.parametrize("tile", [2, 256])
def test_links_within_buckets(spark, tile):
    rng = np.random.default_rng(tile)
    sets = []
    for family in range(12):  # families that share most, all of one hot bucket
        core = rng.integers(0, 10**6, int(rng.integers(4, 12))).tolist()
        for _ in range(12):
            one = set(core) - {core[int(k)] for k in rng.integers(0, len(core), int(rng.integers(0, 2)))}
            sets.append(sorted(one | set(rng.integers(0, 10**6, int(rng.integers(0, 2))).tolist()) | {7}))
    sets = [list(x) for x in dict.fromkeys(map(tuple, sets))]
    buckets = spark.createDataFrame([(k % 2, h) for h in range(len(sets)) for k in ((0,) if h % 3 else (0, 1))], "key long, h long")
    grams = spark.createDataFrame(list(enumerate(sets)), "h long, grams array<long>")
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    edges = dedup.verified_links(buckets, grams, tile=tile).collect()
    likeness = lambda a, b: len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]})
    for e in edges:
        root[find(e.a)] = find(e.b)
    alike = [(a, b) for a in range(len(sets)) for b in range(a) if likeness(a, b) >= 0.8 - 1e-9]
    assert alike and all(find(a) == find(b) for a, b in alike)
    plain = list(range(len(sets)))
    for _ in range(len(sets)):
        for a, b in alike:
            plain[a] = plain[b] = min(plain[a], plain[b])
    assert all((find(a) == find(b)) == (plain[a] == plain[b]) for a in range(len(sets)) for b in range(a))


def test_bands_are_tuned():
    assert dedup.tuned(0.8) == (2, 3) and dedup.tuned(0.8, 0.99) == (3, 3) and dedup.tuned(0.8, 0.95, 2) == (3, 3) and dedup.tuned(0.5)[1] == 0


@pytest.mark.parametrize(("sf", "a_task"), [("sf0.001", 50), ("sf0.01", dedup.CONTEXTS)])
def test_recall(spark, sf, a_task):
    """Of all words in runs of 20 words that stand in another document, 0.95 are reported, and 0.98 of the documents."""
    path = f"/root/testdata/{sf}/documents.parquet"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{path}' ORDER BY doc_id").fetchall()
    texts = [t.encode() for _, t in rows]
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    start, end = words(data)
    doc, h, n = np.searchsorted(np.cumsum(size), start, "right"), pieces(prefix(data), start, end), 20
    gram = mix(h[: len(h) - n + 1])
    for k in range(1, n):
        gram = mix(gram + h[k : len(h) - n + 1 + k])
    whole = np.flatnonzero(doc[: len(gram)] == doc[n - 1 :])
    of, inverse = np.unique(gram[whole], return_inverse=True)
    low, high = np.full(len(of), 1 << 60), np.full(len(of), -1)
    np.minimum.at(low, inverse, doc[whole])
    np.maximum.at(high, inverse, doc[whole])
    at = whole[(low < high)[inverse]]
    mark = np.zeros(len(h) + 1, np.int64)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + n, -1)
    repeats = np.cumsum(mark[:-1]) > 0
    points = np.cumsum((data & 0xC0) != 0x80)
    begin = points[start] - 1 - np.r_[0, points[np.cumsum(size) - 1]][doc]
    spans = {}
    for r in dedup.repeats(spark.read.parquet(path), contexts_a_task=a_task).collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.end))
    ids = np.array([i for i, _ in rows])
    found = np.array([any(a <= p < b for a, b in spans.get(int(ids[d]), ())) for d, p in zip(doc, begin.tolist())])
    asked = {*ids[doc[repeats]].tolist()}
    assert len(asked & {*spans}) >= 0.98 * len(asked)
    assert found[repeats].mean() >= 0.95
    assert (found & ~repeats).sum() <= 0.02 * repeats.sum()


def test_words_go_that_a_smaller_document_keeps(spark):
    some = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    shared, wide = some("s", 60), some("w", 12)
    rows = [(1, f"{some('a', 30)} {shared} {some('b', 30)}"), (2, f"{some('c', 30)} {wide} {shared} {some('d', 30)}"), (3, f"{some('e', 30)} {wide} {shared} {some('f', 30)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cuts", F.lit("x")).withColumn("CUT_ID", F.lit(1))
    got = {r.doc_id: r for r in dedup.repeats(docs).collect()}
    texts = dict(rows)
    assert [texts[k][got[k].start : got[k].end] for k in (1, 2, 3)] == [shared, f"{wide} {shared}", f"{wide} {shared}"]
    assert [got[k].n_words for k in (1, 2, 3)] == [60, 72, 72] and (got[1].n_removed, got[3].n_removed) == (0, 72)
    # a paragraph across the border of what only two share stays in the first of these, whole
    assert 45 <= got[2].n_removed <= 60 and all(texts[2][a:b].strip() in shared for a, b in got[2].removed)
    left = {r.doc_id: r.text.split() for r in dedup.without_repeats(docs).collect()}
    assert left[1] == texts[1].split() and " ".join(left[3]) == f"{some('e', 30)} {some('f', 30)}"
    assert {*f"{some('c', 30)} {wide} {some('d', 30)}".split()} <= {*left[2]} and len(left[2]) == 132 - got[2].n_removed

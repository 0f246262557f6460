"""Extra columns with the operators' own names, repeated rows and nulls change no operator's rows."""

import pytest
from codeloom.llm import fingerprint, html_extract, line_crf, mixing, pii, quality, sentencepieces, simhash, substring_dedup, warc
from pyspark.sql import functions as F

NAMES = ["id", "fp", "key", "y", "row", "sid", "shard", "block", "size", "source_size", "target", "taken", "first", "payload", "n", "node", "root", "a", "b", "low", "component_id", "kept_id", "known", "score", "text_", "start", "end", "word", "ids", "bucket", "position", "next", "para", "band", "gram", "hash", "count", "rank", "last", "name", "value", "doc", "raw", "begin", "piece", "owner", "m", "x", "uses", "use", "cuts", "cut_id", "text2", "keep", "context", "asked", "words"]
TEXT = "A quiet line about the harbour, with gulls and ropes and tar, where boats wait for the tide every morning of the week. "
DOCS = [(1, TEXT * 2, "en", "a", 5), (2, TEXT * 2, None, None, None), (2, TEXT * 2, None, None, None), (None, None, None, None, None), (3, "", "en", "a", 0), (4, "mail x@y.org " + "z " * 40000, "en", "b", 1), (5, "a\0b é🙂", "en", "b", 1)]
PAGES = [(1, "http://x/1", "<p>Some text, long enough, to be kept.</p>"), (2, None, None), (2, None, None), (None, "http://x/\r\n3", "<p>Some text, long enough, to be kept.</p>"), (3, "u", "<div>" * 3000 + "deep"), (4, "v", "<!-- " * 1000)]

OPERATORS = {
    "line_crf": lambda d: line_crf.judged(d, None), "line_crf_kept": lambda d: line_crf.kept_rows(d, None).select("doc_id", "text"),
    "simhash": simhash.near_groups, "simhash_kept": lambda d: simhash.deduplicated(d).select("doc_id", "text"), "pii": pii.found_in, "pii_redacted": lambda d: pii.redacted(d).select("doc_id", "text", "n_chars"),
    "mixing": mixing.mixed, "mixed_rows": lambda d: mixing.mixed_rows(d).select("doc_id", "text"), "sentencepieces": sentencepieces.encoded, "substrings": substring_dedup.repeats,
    "without_repeats": lambda d: substring_dedup.without_repeats(d).select("doc_id", "text"), "fingerprint": fingerprint.fingerprinted, "fingerprint_next": fingerprint.edited_and_next,
    "quality": lambda d: quality.scored(d, quality.Additive()),
}


def rows(df):
    return sorted(map(repr, df.collect()))


def widened(df):
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(NAMES) if c not in df.columns])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(docs, name):
    run = OPERATORS[name]
    plain = rows(run(docs))
    assert rows(run(widened(docs))) == plain
    assert rows(run(docs.limit(0))) == [] == rows(run(widened(docs).limit(0)))
    if name not in ("line_crf_kept", "simhash_kept", "mixed_rows", "substrings"):
        assert len(plain) == len(DOCS)


def test_pages(pages):
    plain = rows(html_extract.extracted(pages))
    assert rows(html_extract.extracted(widened(pages))) == plain and len(plain) == len(PAGES)
    keep = ["page_id", "payload_digest", "record_type", "refers_to", "url", "block"]
    plain = rows(warc.archived(pages).select(keep))
    assert rows(warc.archived(widened(pages)).select(keep)) == plain and len(plain) == len(PAGES)


def test_training_on_odd_tables(docs):
    labels = docs.sparkSession.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, 0), (2, 1, 0), (3, 0, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    for l in (labels, widened(labels), labels.limit(0), labels.where("quality = 1")):
        scores = [r.score for r in quality.scored(docs, quality.train(widened(docs), l)).collect()]
        assert len(scores) == len(DOCS) and all(0 <= s <= 1 for s in scores)
        assert line_crf.judged(docs, line_crf.train(widened(docs), l)).count() == len(DOCS)


def test_groups_of_repeated_and_null_rows(docs):
    group = {(r.doc_id): r.component_id for r in simhash.near_groups(docs).collect()}
    assert group[1] == group[2] == 1 and group[None] == group[3] == 3 and group[5] == 5
    assert sorted((r.doc_id for r in simhash.deduplicated(docs).collect()), key=repr) == [1, 3, 4, 5, None]


def test_unlike_texts_of_one_id_all_stay(spark):
    a, b = TEXT * 3, "Something else entirely stands here, of trains and their tables and the tea that is sold at stations, number nine. " * 3
    docs = spark.createDataFrame([(5, a, "x"), (5, b, "x"), (5, b, "x"), (6, b, "y"), (None, a, "z")], "doc_id long, text string, text_key string")
    assert sorted((r.doc_id or 0, r.text == a) for r in simhash.deduplicated(docs).collect()) == [(0, True), (5, False), (5, True)]


def test_sample_is_bounded_in_rows(spark):
    from codeloom.llm.common import labelled_sample

    docs = spark.createDataFrame([(1, f"text {k}") for k in range(300)] + [(3, "x"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in (1, 1, 3, 4, 5)], "doc_id long, quality int")
    for rows in (1, 2, 9):
        got = labelled_sample(docs, labels, "quality", rows).collect()
        assert len(got) <= rows and len({r.doc_id for r in got}) == len(got)


@pytest.mark.parametrize("segments", [4, 8])
def test_links_of_real_documents(spark, segments):
    """Both numbers of segments, over a table, against all pairs."""
    prints = simhash.fingerprints(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("fp").distinct()
    fps = [r.fp & (2**64 - 1) for r in prints.collect()]
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in simhash.links(prints, segments=segments, tile=64).collect():
        root[find(e.a & (2**64 - 1))] = find(e.b & (2**64 - 1))
    for i, a in enumerate(fps):
        for b in fps[:i]:
            assert (a ^ b).bit_count() > 2 or find(a) == find(b)


@pytest.mark.parametrize("bucket_rows", [3, 4096])
def test_chain_of_null_and_repeated_ids(spark, bucket_rows):
    """Many rows without an id, many of one id and a row again and again: the same as the plain chain."""
    import hashlib

    import xxhash

    texts = [f"text {k} " * (k % 5) + "end" for k in range(40)]
    rows = [(None, t) for t in texts[:20]] + [(7, t) for t in texts[10:40]] + [(7, "again and again")] * 25 + [(None, "")] * 9 + [(k, t) for k, t in enumerate(texts[:12])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    signed = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(t.encode(), 42))
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1]), r[1]))
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), t == after))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.near_next == 1.0 and r.fingerprint == r.fingerprint) for r in fingerprint.edited_and_next(df, bucket_rows).collect()]
    assert sorted(x[:3] for x in got if x[0] is not None) == sorted(x[:3] for x in want if x[0] is not None)
    assert sorted(x[1:3] for x in got if x[0] is None) == sorted(x[1:3] for x in want if x[0] is None)


def test_likeness_against_brute_force():
    """The sketch estimates the Dice share of word shingles, paragraph by paragraph."""
    import numpy as np

    rng = np.random.default_rng(6)
    for kept in (0.2, 0.5, 0.9):
        a = [f"w{x}" for x in rng.integers(0, 10**6, 2000)]
        b = a[: int(kept * 2000)] + [f"w{x}" for x in rng.integers(0, 10**6, 2000 - int(kept * 2000))]
        (wide, sketch) = fingerprint.vectors([" ".join(x).encode() for x in (a, b)])
        near = fingerprint.likeness((wide[:1], sketch[:1]), (wide[1:], sketch[1:]))[0]
        grams = [{tuple(x[i : i + 3]) for i in range(1998)} for x in (a, b)]
        assert abs(near - 2 * len(grams[0] & grams[1]) / (len(grams[0]) + len(grams[1]))) < 0.2


def test_buckets_by_edges(spark):
    from bisect import bisect_left

    edges = sorted({(k * 37) % 1000 - 300 for k in range(150)} | {-(1 << 63), (1 << 63) - 1})
    for cuts in ([], [5], edges):
        xs = [-(1 << 63), -300, -1, 0, 5, 6, 77, 699, 700, (1 << 63) - 1]
        got = spark.createDataFrame([(x,) for x in xs], "x long").select("x", fingerprint.below(F.col("x"), cuts).alias("n")).collect()
        assert all(r.n == bisect_left(cuts, r.x) for r in got)

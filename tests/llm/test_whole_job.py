"""What reviews found cut short: mixes, passages, near copies and the like, each to its full extent."""

import numpy as np
from codeloom.llm import mixing, substring_dedup


def test_mix_of_whole_documents_meets_its_targets(spark):
    size = lambda k: 200 + 37 * (k % 23)
    rows = [(k, "w " * size(k), "abcdefgh"[k % 8] if k % 2 else "a") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source = {k: s for k, _, s in rows}
    goal, words, got = {}, {}, {}
    for r in mixing.mixed(docs).collect():
        s = source[r.doc_id]
        goal[s], words[s] = r.target, words.get(s, 0) + r.taken
    for r in mixing.mixed_rows(docs).groupBy("doc_id").count().collect():
        got[source[r.doc_id]] = got.get(source[r.doc_id], 0) + r["count"] * size(r.doc_id)
    longest = max(map(size, range(600)))
    for s, target in goal.items():
        assert abs(words[s] - target) <= 2 * mixing.BLOCK and abs(got[s] - target) <= longest / 2 + 2 * mixing.BLOCK, s


def test_short_and_periodic_passages(spark):
    rng = np.random.default_rng(3)
    some = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    rows, passages = [], []
    for k in range(150):
        passage = some(51) if k < 120 else (some(1 + k % 8) * 60)[: (60, 120, 300)[k % 3]]
        for doc in (2 * k, 2 * k + 1):
            rows.append((doc, " ".join(some(40) + passage + some(45))))
        passages.append(" ".join(passage))
    got = {}
    for r in substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append(r)
    exact = 0
    for doc, text in rows:
        (r,) = got[doc]
        begin, n = text.index(passages[doc // 2]), len(passages[doc // 2].split())
        exact += (r.start, r.end, r.n_words) == (begin, begin + len(passages[doc // 2]), n)
        # paragraphs that are alike but not equal may carry an end a few words off
        assert abs(r.n_words - n) <= 5 and r.kept_doc_id == doc // 2 * 2 and r.n_removed == (r.n_words if doc % 2 else 0)
    assert exact >= 0.9 * len(rows)
    cut = substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id % 2 = 1")
    assert all(abs(len(r.text.split()) - 85) <= 5 for r in cut.collect())

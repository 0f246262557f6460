"""The pipeline's stages against brute force, on rows with nulls, copies, extra columns and odd texts."""

import corpus_pipeline
import pytest
import sentencepiece
from codeloom.llm import line_crf, mixing, pii, sentencepieces, simhash
from pyspark.sql import functions as F

GOOD = "The committee met on Tuesday to review the plans for the new library, and the members agreed that work should begin in spring. Number {}."
ROWS = [
    (1, GOOD.format("one") + " More of it follows, in another sentence about the river and the bridge over it.", "en", "a", 1),
    (2, GOOD.format("one") + " More of it follows, in another sentence about the river and the bridge over it.", "en", "b", 1),
    (3, "Write to jo.doe@example.org or call +1 555 123 4567 about the old house near the station, which stands empty now.", None, None, None),
    (4, None, "en", "a", 1), (5, "", "en", "a", 1), (6, "too short", "en", "a", 1),
    (7, "buy now " * 200, "en", "b", 1),
    (None, "A row without an id is kept as it is by the stage that looks for copies, whatever it may say.", "en", "a", 1),
    (8, " ".join(f"word{k} and w{k} then v{k}," for k in range(8000)), "en", "c", 1),
    (8, " ".join(f"word{k} and w{k} then v{k}," for k in range(8000)), "en", "c", 1),
]
EXTRA = {"uses": 9, "mixed_id": "x", "kept_id": "y", "taken": 1, "size": 2, "__use": 3, "id": 4, "fp": 5, "y": 6}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")


def labels(spark, path, rows=()):
    spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def counted(rows):
    out = {}
    for r in rows:
        out[tuple(r)] = out.get(tuple(r), 0) + 1
    return out


def check_stages(docs, sf_dir):
    """Every stage's rows, from what its input holds and the operators' own verdicts; returns the last stage's rows."""
    spark, names = docs.sparkSession, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near-duplicates", "personal data", "mix of sources", "token ids"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.stored(stage(spark, docs, sf_dir), f"test-{k}")
        before, after = [tuple(r) for r in docs.collect()], [tuple(r) for r in out.collect()]
        at = {c: i for i, c in enumerate(docs.columns)}
        i, t = at["doc_id"], at["text"]
        if k < 4:
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        if k == 0:
            field = line_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            verdict = {r.doc_id: r.kept for r in line_crf.judged(docs, field).collect()}
            assert counted(after) == counted(r for r in before if verdict[r[i]])
        elif k == 1:
            prints = {r[i]: int(simhash.fingerprints_of([(r[t] or "").encode()])[0]) & (2**64 - 1) for r in before if r[i] is not None}
            group = {d: d for d in prints}
            for _ in prints:
                for a in prints:
                    for b in prints:
                        if (prints[a] ^ prints[b]).bit_count() <= 2:
                            group[a] = group[b] = min(group[a], group[b])
            want = {d for d in prints if group[d] == d}
            assert sorted(r[i] for r in after if r[i] is not None) == sorted(want)
            assert sum(r[i] is None for r in after) == sum(r[i] is None for r in before) and set(after) <= set(before)
        elif k == 2:
            forest = pii.fit()

            def redacted(row):
                row = list(row)
                ((base, added),) = pii.spans_of([row[t] or ""], forest)
                row[t] = None if row[t] is None else pii.redacted_text(row[t], base + added)
                row[at["n_chars"]] = None if row[t] is None else len(row[t])
                return tuple(row)

            assert counted(after) == counted(map(redacted, before))
        elif k == 3:
            uses = {(r.doc_id): int(r.taken / r.size + 0.5) for r in mixing.mixed(docs).collect() if r.size}
            assert counted(after) == counted(r for r in before for _ in range(uses.get(r[i], 0)))
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
            assert out.columns[:3] == ["doc_id", "n_tokens", "ids"]
            assert counted((r.doc_id, tuple(r.ids)) for r in out.collect()) == counted((r[i], tuple(library.encode(r[t] or ""))) for r in before)
        docs = out
    return docs


def test_stages(docs, tmp_path):
    assert check_stages(docs, labels(docs.sparkSession, tmp_path)).count() > 0


def test_decisions_take_effect(docs, tmp_path):
    spark, sf_dir = docs.sparkSession, labels(docs.sparkSession, tmp_path)
    kept = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 2, 3, 8, 8, None]
    kept = corpus_pipeline.near_duplicates(spark, kept, sf_dir)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 3, 8, None]
    (row,) = corpus_pipeline.personal_data(spark, kept, sf_dir).where("doc_id = 3").collect()
    assert row.text == "Write to [EMAIL] or call [PHONE] about the old house near the station, which stands empty now." and row.n_chars == len(row.text)


def test_extra_columns(docs, tmp_path):
    check_stages(docs.select("*", *[F.lit(v).alias(c) for c, v in EXTRA.items()]), labels(docs.sparkSession, tmp_path))


def test_empty(docs, tmp_path):
    assert check_stages(docs.limit(0), labels(docs.sparkSession, tmp_path)).count() == 0


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    got, docs = corpus_pipeline.run(spark, sf_dir), spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = check_stages(docs, sf_dir)
    row = lambda df: counted((r.doc_id, tuple(r.ids)) for r in df.collect())
    assert row(got) == row(want) and got.count() > 0

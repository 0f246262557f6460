"""Each operator against brute force, and its defined results in odd cases."""

import base64
import hashlib
import re

import numpy as np
import pytest
import xxhash
from codeloom.llm import fingerprint, html_extract, line_crf, mixing, pii, quality, sentencepieces, simhash, substring_dedup, textstats, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string"
PASSAGE = " ".join(f"shared{k}" for k in range(60)) + "."
TEXTS = [
    None, "", "Ein Wort", "a b c d e f g h i j k l.\nsecond line, with words here and there", "A b C d e f g h i j k l.\nsecond line, with words here and there",
    "x " * 3000, "\n\n \t\n", "mail me: a.b@c.example.org or +1 (555) 123-4567, card 4111 1111 1111 1111, ip 10.0.0.256 and 10.0.0.25",
    "one two three four. " + PASSAGE + " five six seven", "eight nine ten\n" + PASSAGE + "\neleven twelve", "é🙂 ▁ \x00 z", "w" * 50000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k != 6 else None, t, "en", None if k % 3 == 0 else f"s{k % 2}", 1, "clash") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [rows[3]], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_empty(spark, docs):
    none = docs.limit(0)
    assert simhash.near_groups(none).count() == 0 and fingerprint.edited_and_next(none).count() == 0 and mixing.mixed(none).count() == 0
    assert pii.found_in(none).count() == 0 and substring_dedup.repeats(none).count() == 0 and sentencepieces.encoded(none).count() == 0
    assert line_crf.judged(none, None).count() == 0 and quality.scored(none, quality.Additive()).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived(pages).count() == 0 and html_extract.extracted(pages).count() == 0


def test_counts(docs):
    for r in line_crf.judged(docs, None).collect():
        if r.doc_id is None:
            continue
        t = TEXTS[r.doc_id] or ""
        w, lines = words(t), t.split("\n")
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)} if len(w) < 500 else set(range(len(w)))
        dup = sum(bool(words(x)) and x in lines[:k] for k, x in enumerate(lines))
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), dup, len(inside))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    field = line_crf.Field(rng.normal(size=(3, 2)), rng.normal(size=(2, 2)))
    x, doc = rng.normal(size=(9, 3)), np.array([0, 0, 0, 0, 1, 2, 2, 2, 2])
    got = line_crf.viterbi(field, x, doc)
    for d in range(3):
        own = x[doc == d] @ field.weights
        paths = [[(m >> k) & 1 for k in range(len(own))] for m in range(1 << len(own))]
        value = lambda p: sum(own[k, s] for k, s in enumerate(p)) + sum(field.pairs[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        assert list(got[doc == d]) == max(paths, key=value)


def test_simhash(docs):
    def brute(t):
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    rows = simhash.near_groups(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    fps = [(r.doc_id, r.fp & (2**64 - 1)) for r in rows]
    assert all(f == brute(TEXTS[i]) for i, f in fps if i is not None)
    group = {i: i for i, _ in fps if i is not None}
    for _ in fps:
        for i, f in fps:
            for j, g in fps:
                if None not in (i, j) and (f ^ g).bit_count() <= 2:
                    group[i] = group[j] = min(group[i], group[j])
    assert all(r.component_id == group[r.doc_id] for r in rows if r.doc_id is not None)


@pytest.mark.parametrize("segments", [4, 8])
def test_tiles_lose_no_link(spark, segments):
    rng = np.random.default_rng(segments)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near])).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), segments=segments, tile=3).collect()
    root = {f: f for f in fps}
    for _ in range(8):
        for e in edges:
            root[e.a] = root[e.b] = min(root[e.a], root[e.b])
    assert all(((a ^ b) & (2**64 - 1)).bit_count() > 2 or root[a] == root[b] for a in fps for b in fps)


def test_fingerprints(docs):
    rows = {r.doc_id: r for r in fingerprint.edited_and_next(docs.dropDuplicates(["doc_id"]), 3).collect()}
    order = sorted((i for i in rows if i is not None), reverse=True) + [None]
    text = lambda i: (TEXTS[6 if i is None else i]) or ""
    for k, i in enumerate(order):
        t, nxt = text(i), text(order[(k + 1) % len(order)])
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[i].near_edited <= 1 and (edited != t or rows[i].near_edited == 1)


def test_fingerprint_is_a_homomorphism():
    of = lambda t: fingerprint.text_of(*fingerprint.vectors([t.encode()]))[0]
    assert of("p one two\nq three\nr") == of("r\np one two\nq three") == fingerprint.combined(of("q three\nr"), of("p one two"))
    assert fingerprint.combined(of("p one two\nq three"), of("q three"), -1) == of("p one two") != of("p one")


def test_pii(docs):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for r in pii.found_in(docs).collect():
        t, want = (TEXTS[r.doc_id] or "") if r.doc_id is not None else TEXTS[6], []
        for kind, p in patterns.items():
            for m in re.finditer(p, t):
                d = re.sub(r"[^0-9]", "", m[0])
                ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and pii.luhn(d or "1"), "phone": 9 <= len(d) <= 15}[kind]
                want += [f"{kind}:{m.start()}:{m.end()}"] * bool(ok)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(","))
    assert {r.n_email + r.n_phone + r.n_card + r.n_ip for r in pii.found_in(docs).where("doc_id = 7").collect()} == {4}


def test_added_spans():
    forest = pii.fit()
    found = [[k for k, _, _ in added] for _, added in pii.spans_of(['x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y', "my ssn 123-45-6789 ok", "plain words at noon. More words", "commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff"], forest)]
    assert found == [["secret"], ["ssn"], [], []]


def test_mixing(docs):
    rows = mixing.mixed(docs, block=4).collect()
    assert len(rows) == len(TEXTS) + 1 and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mixed(docs, block=4).collect()), key=repr)
    by = {}
    for r in rows:
        by.setdefault(r.target, []).append(r.taken)
    assert all(abs(sum(v) - t) <= max(8, 0.01 * t) for t, v in by.items())


def test_sainte_lague_gives_the_highest_quotients():
    rng = np.random.default_rng(1)
    for _ in range(50):
        votes, caps, seats = rng.random(6) * 100, rng.integers(1, 12, 6), int(rng.integers(1, 30))
        given = np.zeros(6, int)
        for _ in range(min(seats, caps.sum())):
            given[np.argmax(np.where(given < caps, votes / (2 * given + 1), -1))] += 1
        assert (mixing.sainte_lague(votes, seats, caps) == given).all()


def test_sentencepiece_equals_the_library(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    rows = sentencepieces.encoded(docs).where("doc_id is not null").collect()
    assert all(list(r.ids) == library.encode(TEXTS[r.doc_id] or "") for r in rows)
    assert all(r.round_trip == ("▁" not in (TEXTS[r.doc_id] or "")) for r in rows)
    assert sentencepieces.decoded(sentencepieces.encoded(docs)).where("doc_id = 3").first().text == TEXTS[3]


def test_unigram_path_is_the_best():
    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.1, "▁a": -3.2, "ba": -2.2, "aba": -7.0}
    ids = {p: k for k, p in enumerate(scores)}
    vocab = sentencepieces.Vocabulary(ids, scores, [p.encode() for p in ids], [], 99, unigram=True)

    def best(s):
        return max(((scores[s[:k]] + best(s[k:])[0], [s[:k], *best(s[k:])[1]]) for k in range(1, len(s) + 1) if s[:k] in scores), default=(0.0, [])) if s else (0.0, [])

    for t in ("abab", "baba", "aab", "b"):
        assert vocab.encode([t])[0].tolist() == [ids[p] for p in best("▁" + t)[1]]


def test_warc(spark, tmp_path):
    pages = [(3, "http://a/1", "<p>é</p>"), (1, "http://a/2", "<p>é</p>"), (2, None, None), (9, "http://a/3", ""), (5, "http://b", "x" * 3_000_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    index = warc.write(df, str(tmp_path / "w"), frame_bytes=1000)
    rows = {r.page_id: r for r in warc.read(spark, str(tmp_path / "w")).collect()}
    for i, url, html in pages:
        raw = (html or "").encode()
        assert (rows[i].payload_bytes, rows[i].payload_digest, rows[i].url) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), url)
    assert {i: r.refers_to for i, r in rows.items()} == {3: 1, 1: None, 2: None, 9: 2, 5: None}
    for r in index.collect():
        got = warc.read_record(f"file://{tmp_path}/w/bundles/{r.bundle}", r.frame, r.frame_offset)
        assert got.headers["WARC-Record-ID"] == r.record_id == warc.record_id(r.page_id)


def test_html():
    page = '<html><head><title>t</title></head><body><nav><a href=x>Menu</a></nav><article class="post"><h1>Head &amp; line</h1><p>First,  long\nparagraph, with commas, and more<p>Second <b>one</b>, as long as, the first.</p><div class="comments"><p>Reader, says, things, at, length</p></div></article><footer>foot</footer>'
    assert html_extract.main_blocks(page) == ["Head & line", "First, long paragraph, with commas, and more", "Second one, as long as, the first."]
    assert html_extract.main_blocks("") == []


def test_html_wrappers():
    line = "A paragraph of some length, with commas, that is the main text."
    main, side = f"<p>{line}</p>" * 2, "<p>A line of some length, with commas, at the side.</p>"
    for page in (
        f"<html><head><title>t</title><body>{main}",  # no end of head
        f"<head><meta charset=x>{main}",
        f'<body><div class="has-sidebar no-footer"><div>{main}</div><div class="sidebar">{side}</div></div>',  # words of layout
        f"<body><form><nav>{side}</nav><article>{main}</article>{side}</form>",  # a page in a form
        f'<body><div class="menu"><main>{main}</main></div>',
        f'<body><article>{main}</article><form>{side}</form><div id="comments"><article>{side}</article></div><aside><article>{side}</article></aside>',
    ):
        assert html_extract.main_blocks(page) == [line, line], page
    assert html_extract.main_blocks(f"<body><nav>{side}</nav><form>{side}</form>") == []


def test_substrings(docs):
    rows = substring_dedup.repeats(docs).collect()
    assert {r.doc_id for r in rows} == {8, 9}  # 3 and 4 share 17 words, 4 of them in other letters
    assert all(r.kept_doc_id == 8 for r in rows if r.doc_id == 9) and all("shared30" in TEXTS[r.doc_id][r.start : r.end] for r in rows if r.doc_id > 7)
    cut = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs).collect()}
    assert cut[8] == TEXTS[8] and "shared30" not in cut[9] and cut[9].startswith("eight nine ten")


def test_quality_held_out(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.scored(d, quality.train(d, labels)).join(labels, "doc_id").where("held_out")
    right, rows = scored.selectExpr("sum(int(predicted = quality))", "count(*)").first()
    assert rows > 50 and right >= 0.9 * rows
    judged = line_crf.judged(d, line_crf.train(d, labels)).join(labels, "doc_id")
    kept, good = judged.where("quality = 1").selectExpr("sum(int(kept))", "count(*)").first()
    assert kept >= 0.95 * good


def test_analyse_of_slices_agrees():
    raw = [(t or "").encode() for t in TEXTS]
    whole = textstats.analyse(raw)
    for k, t in enumerate(raw):
        one = textstats.analyse([t])
        assert (one.words[0], one.points[0], one.symbols[0]) == (whole.words[k], whole.points[k], whole.symbols[k]) and one.points[0] == len(t.decode())


def test_few_words_remembered():
    texts = ["one two three one", "two four two", "", "five one six seven", "one two three four five"]
    want = [list(sentencepieces.vocabulary().encode([t])[0]) for t in texts]
    for remembered in (0, 2, 6):
        vocab = sentencepieces.vocabulary()
        vocab.remembered = remembered
        assert [list(vocab.encode([t])[0]) for t in texts * 2] == want * 2


def test_values_behind_names_are_secrets():
    key = "Zk3vT9qLw2XbN7mR5cYd8HsJ"
    ((_, added),) = pii.spans_of([f"set api_key={key} in the file"], pii.fit())
    assert added == [("secret", 12, 12 + len(key))]


def test_taken_spans_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(30):
        base = [(int(a), int(a + n)) for a, n in zip(rng.integers(0, 200, 8), rng.integers(1, 20, 8))]
        taken, plain = pii.Taken(base), list(base)
        for a, n in zip(rng.integers(0, 220, 60).tolist(), rng.integers(1, 12, 60).tolist()):
            free = not any(x < a + n and a < y for x, y in plain)
            assert taken.add(a, a + n) == free
            plain += [(a, a + n)] * free


def test_many_numbers_in_one_text_take_time_in_proportion():
    import time

    def took(n):
        began = time.process_time()
        pii.spans_of(["call 555-123-4567 now. " * n], forest)
        return time.process_time() - began

    forest = pii.fit()
    took(50)
    assert took(8000) <= 12 * took(1000) + 0.5


def test_field_is_the_likeliest():
    """Of the penalised likelihood, by all labellings of short texts, the fit is a maximum."""
    import itertools

    rng = np.random.default_rng(4)
    doc = np.repeat(np.arange(12), 4)
    x, y = np.c_[np.ones(48), rng.normal(size=(48, 2))], (rng.random(48) < 0.6).astype(int)
    field = line_crf.fit(x, y, doc, rounds=1500, penalty=0.05)

    def value(weights, pairs):
        total = 0.0
        for d in range(12):
            own = x[doc == d] @ weights
            score = lambda p: sum(own[k, s] for k, s in enumerate(p)) + sum(pairs[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
            total += score(y[doc == d].tolist()) - np.log(sum(np.exp(score(p)) for p in itertools.product((0, 1), repeat=4)))
        return total / 12 - 0.025 * (weights**2).sum() - 0.05 * (pairs**2).sum()

    best = value(field.weights, field.pairs)
    for _ in range(20):
        assert value(field.weights + rng.normal(size=(3, 2)) * 0.05, field.pairs + rng.normal(size=(2, 2)) * 0.05) < best + 1e-4


def test_labels_change_within_texts():
    rng = np.random.default_rng(5)
    doc, n = np.repeat(np.arange(40), 6), 240
    x = np.zeros((n, line_crf.FEATURES))
    x[:, 0], x[:, 1] = 1, 0.8 + 0.1 * rng.random(n)
    y = (doc % 2).astype(int)
    x[y == 0, 3] = 1
    x[5::60, 3] = 0  # a line of content in some bad documents
    line = np.arange(n, dtype=np.uint64)
    line[6::12], x[6::12, 2] = 10**6, 1  # a first line that all good documents have
    got = line_crf.line_labels(x, y, doc, line)
    assert (got[6::12] == 0).all() and (got[5::60] == 1).all() and (got[7::12] == 1).all() and (got[0::12] == 0).all()


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, repeats=2):
    out, open_ = [None] * len(sizes), set(range(len(sizes)))
    rest = share * sum(sizes)
    while open_:
        w = sum(weights[k % 3] for k in open_)
        over = {k for k in open_ if rest * weights[k % 3] / w > repeats * sizes[k]}
        if not over:
            for k in open_:
                out[k] = rest * weights[k % 3] / w
            break
        for k in over:
            out[k] = float(repeats * sizes[k])
        rest, open_ = rest - sum(repeats * sizes[k] for k in over), open_ - over
    return out


@pytest.mark.parametrize("seed", range(3))
def test_sources_against_brute_force(spark, seed):
    """Targets and seats of many sources, hot and tiny ones and ties among them."""
    rng = np.random.default_rng(seed)
    sizes = [0, 5, 5, 5, 5, 100_000, *rng.integers(1, 3000, 40).tolist()]
    names = sorted({f"s{x}" for x in rng.integers(0, 10**6, len(sizes) * 2)})[: len(sizes) - 1]
    sources = mixing.numbered(spark.createDataFrame(list(zip([*names, None], sizes)), "source string, size long").repartition(4))
    got = mixing.with_targets(sources).collect()
    order = {n: k for k, n in enumerate(names)} | {None: len(names)}
    assert all(r.sid == order[r.source] for r in got)
    want = plain_targets(sizes)
    assert all(r.target == pytest.approx(want[r.sid], rel=1e-12) for r in got)
    seats = round(sum(want) / 128)
    caps = [2 * -(-n // 128) for n in sizes]
    given = [0] * len(sizes)
    for _ in range(min(seats, sum(c for c, w in zip(caps, want) if w > 0))):
        k = max((k for k in range(len(sizes)) if given[k] < caps[k] and want[k] > 0), key=lambda k: (want[k] / (2 * given[k] + 1), -k))
        given[k] += 1
    table = spark.createDataFrame([(k, want[k], caps[k]) for k in range(len(sizes))], "sid long, target double, caps long")
    assert [r.seats for r in mixing.with_seats(table, seats).orderBy("sid").collect()] == given
    assert mixing.with_seats(table, 0).agg({"seats": "sum"}).first()[0] == 0


def test_mix_of_one_row_again_and_again(spark):
    rows = [(None, "a b c", "x")] * 500 + [(1, "d e f g", "x")] * 3 + [(k, "w " * (k % 40), "y") for k in range(200)] + [(None, None, None)] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixing.mixed(df, block=4, shard_words=700).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    again = mixing.mixed(df.repartition(3), block=4, shard_words=700).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    for size, target in {(r.source_size, r.target) for r in got}:
        assert abs(sum(r.taken for r in got if r.source_size == size) - target) <= 4 * 8

"""Quality rules by line labels: a linear-chain conditional random field marks lines as content or boilerplate.

The field is fitted on lines of a bounded sample of labelled documents.  There are labels of documents alone, so a
line's label starts as its document's and is mended: a line that stands in several documents is boilerplate, and one
that a first field is sure to be of the other kind, by the line alone, takes that kind.  So labels change within texts.
Viterbi decoding labels every line of every text; the share of words in content lines decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, raw_texts, slices
from .textstats import BAR, DIGIT, LOWER, SHOUT, SPACE, START, STOP, SYMBOL, UPPER, Stats, analyse
from .wordhash import mix

#: Documents in the sample and lines in a row of each, from a place that hangs on its id; neither bounds what is scored.
SAMPLE_DOCS, SAMPLE_LINES = 3000, 400
#: Least share of words in content lines for a document to be kept.
CONTENT_SHARE = 0.5
#: Base rules: fewest words, and most words in repeated windows per 100 words.
LEAST_WORDS, MOST_REPEATED = 10, 20
FEATURES = 12
#: Documents of the sample that a line stands in to be boilerplate, and how sure a first field must be of a line's kind.
COMMON, SURE = 3, 0.9


@dataclass
class Field:
    """weights: features x 2, pairs: 2 x 2 transitions; state 1 is content."""

    weights: np.ndarray
    pairs: np.ndarray


def line_features(s: Stats) -> np.ndarray:
    """Shares and logarithms per line, all about 0 to 1; the first is constant."""
    c = s.counts
    solid = np.maximum(1, c[:, START] - c[:, SPACE])
    words = np.maximum(1, c[:, 9])
    x = np.empty((len(c), FEATURES))
    x[:, 0] = 1
    x[:, 1] = np.minimum(1, np.log1p(c[:, 9]) / 5)
    x[:, 2] = np.minimum(1, c[:, SYMBOL] / words)
    x[:, 3] = np.minimum(1, c[:, BAR] / words * 2)
    x[:, 4] = np.minimum(1, c[:, SHOUT] / words)
    x[:, 5] = c[:, UPPER] / np.maximum(1, c[:, UPPER] + c[:, LOWER])
    x[:, 6] = np.minimum(1, c[:, DIGIT] / solid * 2)
    x[:, 7] = np.minimum(1, c[:, STOP] / words * 3)
    x[:, 8] = s.dup
    x[:, 9] = s.repeats / words
    x[:, 10] = np.minimum(1, solid / words / 20)
    x[:, 11] = c[:, 9] == 0
    return x


def _steps(doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For t = 0, 1, ...: (rows of the t-th lines, which of the previous step's rows go on), longest texts first."""
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, int)
    length = np.diff(np.r_[first, len(doc)])
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    for t in range(int(length[0]) if len(length) else 0):
        yield first[: np.searchsorted(-length, -t, "left")] + t


def fit(x: np.ndarray, y: np.ndarray, doc: np.ndarray, rounds: int = 120, penalty: float = 1e-3) -> Field:
    """Maximum conditional likelihood by Adam on all sequences; the gradient is by forward-backward."""
    weights, pairs = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    steps, docs = list(_steps(doc)), max(1, len(np.unique(doc)))
    theta = [weights, pairs]
    m, v = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
    truth = np.zeros((len(y), 2))
    truth[np.arange(len(y)), y] = 1
    true_pairs = np.zeros((2, 2))
    joined = doc[1:] == doc[:-1]
    np.add.at(true_pairs, (y[:-1][joined], y[1:][joined]), 1)
    for r in range(1, rounds + 1):
        score = x @ theta[0]
        score -= score.max(axis=1, keepdims=True)
        local, move = np.exp(score), np.exp(theta[1] - theta[1].max())
        alpha, beta = np.empty_like(local), np.ones_like(local)
        for t, rows in enumerate(steps):
            a = local[rows] if t == 0 else (alpha[rows - 1] @ move) * local[rows]
            alpha[rows] = a / a.sum(axis=1, keepdims=True)
        expected = np.zeros((2, 2))
        for t in range(len(steps) - 1, 0, -1):
            rows = steps[t]
            ahead = local[rows] * beta[rows]
            both = alpha[rows - 1][:, :, None] * move[None] * ahead[:, None, :]
            expected += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b = ahead @ move.T
            beta[rows - 1] = b / b.sum(axis=1, keepdims=True)
        gamma = alpha * beta
        gamma /= gamma.sum(axis=1, keepdims=True)
        grads = [x.T @ (truth - gamma) / docs - penalty * theta[0], (true_pairs - expected) / docs - 0.1 * theta[1]]
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            theta[k] = theta[k] + 0.1 * (m[k] / (1 - 0.9**r)) / (np.sqrt(v[k] / (1 - 0.99**r)) + 1e-8)
    return Field(*theta)


def viterbi(field: Field, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The likeliest labels of the lines, all texts at once, one step for each line of the longest; ties to content."""
    score = x @ field.weights
    best, back = score.copy(), np.zeros(score.shape, np.int8)
    steps = list(_steps(doc))
    for rows in steps[1:]:
        ways = best[rows - 1][:, :, None] + field.pairs[None]
        choice = (ways[:, 1] >= ways[:, 0]).astype(np.int8)
        back[rows] = choice
        best[rows] += np.maximum(ways[:, 0], ways[:, 1])
    label = (best[:, 1] >= best[:, 0]).astype(np.int8)
    last = np.r_[doc[1:] != doc[:-1], True] if len(doc) else np.zeros(0, bool)
    for rows in steps[:0:-1]:
        label[rows - 1] = np.where(last[rows - 1], label[rows - 1], back[rows, label[rows]])
    return label


def content_share(field: Field, s: Stats, x: np.ndarray) -> np.ndarray:
    """Share of each text's words that are in content lines; 1 for a text without words."""
    content = viterbi(field, x, s.doc)
    n = len(s.words)
    inside = np.bincount(s.doc, weights=content * s.counts[:, 9], minlength=n)
    return np.where(s.words > 0, inside / np.maximum(1, s.words), 1.0)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            s = analyse(raw_texts(part.column("text")))
            x = line_features(s).astype(np.float32)
            edge = np.searchsorted(s.doc, np.arange(part.num_rows + 1))
            runs = []
            for doc_id, a, b in zip(part.column("doc_id").to_pylist(), edge[:-1].tolist(), edge[1:].tolist()):
                spare = max(0, b - a - SAMPLE_LINES)
                a += int(mix(np.array([doc_id], np.int64).view(np.uint64))[0]) % (spare + 1)
                runs.append(slice(a, min(b, a + SAMPLE_LINES)))
            columns = [part.column("doc_id"), part.column("y"), pa.array([x[r].tobytes() for r in runs], pa.binary()), pa.array([s.line[r].tobytes() for r in runs], pa.binary())]
            yield pa.record_batch(columns, names=["doc_id", "y", "x", "line"])


def line_labels(x: np.ndarray, y: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The label of each line from its document's, y; line: hashes of the lines."""
    pairs = np.unique(np.stack([line, doc.astype(np.uint64)], axis=1), axis=0)
    names, docs = np.unique(pairs[:, 0], return_counts=True)
    common = (docs[np.searchsorted(names, line)] >= COMMON) & (x[:, 11] == 0)
    truth = np.where(common, 0, y)
    if len(np.unique(truth)) < 2:
        return truth
    margin = x @ fit(x, truth, np.arange(len(x)), rounds=60).weights  # each line a text of its own
    content = 1 / (1 + np.exp(margin[:, 0] - margin[:, 1]))
    return np.where(common, 0, np.where(content >= SURE, 1, np.where(content <= 1 - SURE, 0, truth)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_DOCS) -> Field | None:
    """Fit on at most `rows` labelled documents, and SAMPLE_LINES lines in a row of each at most.

    None if the sample lacks one of the two labels: then nothing can be learned, and every line counts as content.
    Null ids and labels are left out, null and empty texts are one empty line; of several rows of an id one is
    taken (`labelled_sample`); other columns are not read; empty tables give None.
    """
    sample = labelled_sample(docs, labels, label, rows).select("doc_id", F.col("text").cast("binary").alias("text"), "y")
    got = sample.mapInArrow(_sampled, "doc_id long, y int, x binary, line binary").toPandas().sort_values("doc_id")  # `rows` rows at most
    if got["y"].nunique() < 2:
        return None
    xs = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in got["x"]]
    count = np.array([len(x) for x in xs])
    y = (got["y"].to_numpy() > 0).astype(np.int64)
    x, doc = np.concatenate(xs).astype(float), np.repeat(np.arange(len(xs)), count)
    line = np.concatenate([np.frombuffer(b, np.uint64) for b in got["line"]])
    return fit(x, line_labels(x, np.repeat(y, count), doc, line), doc)


def judged(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base counts and the verdict of each row.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept.
    A null text counts as empty: no words, so base_failed.  Repeated rows give repeated results; other columns of
    docs are not read; an empty table gives an empty result.  Every line of every text is labelled.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s = analyse(raw_texts(part.column("text")))
                share = content_share(field, s, line_features(s)) if field else np.ones(part.num_rows)
                failed = (s.words < LEAST_WORDS) | (100 * s.repeat_words > MOST_REPEATED * s.words)
                kept = ~failed & (share >= CONTENT_SHARE)
                columns = [part.column("id"), *map(pa.array, (s.words, s.nonspace, s.symbols, s.dup_lines, s.repeat_words, failed, share, kept))]
                yield pa.record_batch(columns, names=names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]
    types = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(kernel, types)


def kept_rows(docs: DataFrame, field: Field | None) -> DataFrame:
    """The rows of docs that are kept, with all their columns, in one pass over the texts.

    A null or empty text fails the base rules and goes; texts of any length are labelled whole; repeated rows are
    judged alike; columns may have any names; an empty table stays empty.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s = analyse(raw_texts(part.column("text")))
                share = content_share(field, s, line_features(s)) if field else np.ones(part.num_rows)
                good = (s.words >= LEAST_WORDS) & (100 * s.repeat_words <= MOST_REPEATED * s.words) & (share >= CONTENT_SHARE)
                yield part.filter(pa.array(good))

    return docs.mapInArrow(kernel, docs.schema)

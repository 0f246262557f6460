"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted cyclically, one feature at a time, and summed to a lookup table for each feature, then
to one for each of the strongest pairs.  A score is the logistic of a sum of table entries, added up by numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SAMPLE_ROWS, in_fold, labelled_sample, raw_texts, slices
from .textstats import BAR, DIGIT, LOWER, SHOUT, SPACE, START, STOP, SYMBOL, UPPER, Stats, analyse

NAMES = ["words", "word_length", "symbols", "bars", "shouts", "capitals", "digits", "stops", "dup_lines", "repeats", "distinct", "longest", "line_words", "foreign", "symbol_lines", "capital_lines"]
BINS, PAIR_BINS, PAIRS = 32, 8, 6


def features(s: Stats) -> np.ndarray:
    """One row for each text, by NAMES; a text without words gives zeros but for the shares of lines."""
    n, c = len(s.words), s.counts
    total = np.stack([np.bincount(s.doc, weights=c[:, k], minlength=n) for k in range(10)], axis=1)
    lines = np.bincount(s.doc, minlength=n)
    words, solid = np.maximum(1, s.words), np.maximum(1, s.nonspace)
    letters = total[:, UPPER] + total[:, LOWER]
    share = lambda mask: np.bincount(s.doc, weights=mask * c[:, 9], minlength=n) / words
    foreign = s.nonspace - letters - total[:, DIGIT] - total[:, STOP] - total[:, SYMBOL] - total[:, SHOUT]
    return np.stack([
        np.log1p(s.words), s.nonspace / words, total[:, SYMBOL] / words, total[:, BAR] / words, total[:, SHOUT] / words, total[:, UPPER] / np.maximum(1, letters),
        total[:, DIGIT] / solid, total[:, STOP] / words, s.dup_lines / lines, s.repeat_words / words, s.distinct_words / words, s.longest_word.astype(float), s.words / lines,
        foreign / solid, share(c[:, SYMBOL] > 0.3 * np.maximum(1, c[:, 9])), share(c[:, UPPER] > c[:, LOWER]),
    ], axis=1)


@dataclass
class Additive:
    """edges: bin edges of each feature; tables: one a feature; pairs: (i, j, edges of i, edges of j, table)."""

    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, k], "right")]
        for i, j, a, b, table in self.pairs:
            total += table[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
        return 1 / (1 + np.exp(-total))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _split(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, int]:
    """Best gain and place of one cut of the bins."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gt, ht = g.sum(), h.sum()
    if not len(gl):
        return 0.0, 0
    gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
    gain[(hl < 1) | (ht - hl < 1)] = 0
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, penalty: float, depth: int = 2) -> np.ndarray:
    """A tree of `depth` cuts over the bins, as a table of leaf values."""
    gain, at = _split(g, h, penalty) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + penalty))
    return np.r_[_tree(g[:at], h[:at], penalty, depth - 1), _tree(g[at:], h[at:], penalty, depth - 1)]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, rate: float = 0.15, penalty: float = 2.0) -> Additive:
    """Boost one tree for each feature in turn, then for each chosen pair in turn."""
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Additive(bias=float(np.log(prior / (1 - prior))))
    model.edges = [_edges(x[:, k], BINS) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.edges)]
    total = np.full(len(y), model.bias)
    for _ in range(rounds):
        for k, b in enumerate(bins):
            p = 1 / (1 + np.exp(-total))
            size = len(model.tables[k])
            step = rate * _tree(np.bincount(b, y - p, size), np.bincount(b, p * (1 - p), size), penalty)
            model.tables[k] += step
            total += step[b]
    coarse = [_edges(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    grid = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(coarse)]
    p = 1 / (1 + np.exp(-total))
    gains = []
    for i in range(x.shape[1]):
        for j in range(i):
            size = (len(coarse[i]) + 1) * (len(coarse[j]) + 1)
            cell = grid[i] * (len(coarse[j]) + 1) + grid[j]
            g, h = np.bincount(cell, y - p, size), np.bincount(cell, p * (1 - p), size)
            gains.append((float((g**2 / (h + penalty)).sum()), i, j))
    chosen = [(i, j) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    tables = {q: np.zeros((len(coarse[q[0]]) + 1, len(coarse[q[1]]) + 1)) for q in chosen}
    for _ in range(rounds // 2):
        for i, j in chosen:
            p = 1 / (1 + np.exp(-total))
            shape = tables[i, j].shape
            cell = grid[i] * shape[1] + grid[j]
            g = np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape)
            h = np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape)
            gain, at = _split(g.sum(1), h.sum(1), penalty)
            at = at if gain > 1e-9 else shape[0]
            halves = [np.tile(_tree(g[s].sum(0), h[s].sum(0), penalty, 1), (len(g[s]), 1)) for s in (slice(0, at), slice(at, None)) if len(g[s])]
            step = rate * np.concatenate(halves)
            tables[i, j] += step
            total += step[grid[i], grid[j]]
    model.pairs = [(i, j, coarse[i], coarse[j], tables[i, j]) for i, j in chosen]
    return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            x = features(analyse(raw_texts(part.column("text"))))
            yield pa.record_batch([part.column("doc_id"), part.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Additive:
    """Fit on at most `rows` labelled documents outside the held-out fold (`labelled_sample`).

    Where the sample has one label only, or none, every score is that label's smoothed share, or one half.  Null ids and
    labels are left out; null and empty texts count as empty ones, texts of any length whole; of several rows of an id
    one is taken, and of its labels the smallest.  Other columns are not read.
    """
    sample = labelled_sample(docs, labels, label, rows).select("doc_id", F.col("text").cast("binary").alias("text"), "y")
    got = sample.mapInArrow(_featured, "doc_id long, y int, x binary").toPandas().sort_values("doc_id")
    y = (got["y"].to_numpy() > 0).astype(float)
    if len(np.unique(y)) < 2:
        prior = (y.sum() + 1) / (len(y) + 2)
        return Additive(bias=float(np.log(prior / (1 - prior))))
    return fit(np.stack([np.frombuffer(b) for b in got["x"]]), y)


def scored(docs: DataFrame, model: Additive, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row; score is 0 to 1.

    A null text scores as an empty one; a null id is not held out.  Repeated rows give repeated results; other
    columns are not read; an empty table gives an empty result.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                score = model.score(features(analyse(raw_texts(part.column("text")))))
                yield pa.record_batch([part.column("id"), pa.array(score)], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    out = rows.mapInArrow(kernel, "doc_id long, score double")
    return out.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

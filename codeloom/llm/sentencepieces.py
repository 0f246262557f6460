"""SentencePiece encoding and decoding with a given vocabulary, by a forward pass over shared prefixes.

Text is marked (a blank becomes the mark, one more is put in front) and cut to marked words.  The distinct words
of a slice are sorted, which is the depth-first order of their trie; the forward state of a prefix is computed once
and reused by every word that shares it.  A state is the last piece on the best path to that prefix.

* unigram vocabularies: the best path has the largest sum of scores (Viterbi);
* bpe vocabularies: a path is admissible if each pair of neighbouring pieces is what merging their text gives.
  Exactly one path is, and it is what merging the whole word gives.  So the same pass applies, with admissibility
  in place of scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words whose ids, and pairs whose admissibility, a worker remembers.  Of words, the half not used lately is forgotten.
REMEMBERED = 1_000_000
#: Characters of the longest word that is remembered, so that what is remembered is bounded in bytes; no tokens hang on it.
LONGEST = 64
UNKNOWN_PENALTY = 10.0
#: The lengths of pieces to try are looked up by so many last characters.
TAIL = 3


@dataclass
class Vocabulary:
    """ids and scores of ordinary pieces; raw: what each id decodes to; bytes_: ids of the 256 byte pieces, if any."""

    ids: dict[str, int]
    scores: dict[str, float]
    raw: list[bytes]
    bytes_: list[int]
    unknown: int
    unigram: bool = False
    remembered: int = REMEMBERED
    words: dict[str, bytes] = field(default_factory=dict)
    older: dict[str, bytes] = field(default_factory=dict)
    stable: dict[tuple[str, str], bool] = field(default_factory=dict)

    def __post_init__(self) -> None:
        by_tail: dict[str, set[int]] = {}
        for p in self.ids:
            by_tail.setdefault(p[-TAIL:], set()).add(len(p))
        self.short = tuple(range(TAIL - 1, 0, -1))
        self.lengths = {t: (*sorted(n - set(self.short), reverse=True), *self.short) for t, n in by_tail.items() if len(t) == TAIL}
        self.floor = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        inner = any(MARK in p.lstrip(MARK) for p in self.ids)
        split = not any("\n" in p for p in self.ids)
        # Words may be cut before marks if no piece has a mark after another character, and at line breaks if none has one.
        self.pattern = re.compile("(?s).+" if inner else rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if split else rf"{MARK}*[^{MARK}]+|{MARK}+")

    def merged(self, text: str) -> list[str]:
        """The pieces after merging, again and again, the neighbours whose union scores highest; ties to the left."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def admissible(self, left: str, right: str) -> bool:
        known = self.stable.get((left, right))
        if known is None:
            if len(self.stable) > self.remembered:
                self.stable.clear()
            known = self.stable[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def learn(self, words: list[str]) -> None:
        """Put the ids of the words, which must be sorted, into `words`."""
        last: list[str] = [""]  # last[n]: the last piece of the best path to the prefix of n characters
        total: list[float] = [0.0]
        before = ""
        ids, scores, stable, unigram, lengths, short = self.ids, self.scores, self.stable, self.unigram, self.lengths, self.short
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], total[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                piece, best = "", -np.inf
                for size in lengths.get(word[end - TAIL : end], short) if end >= TAIL else short:
                    if size > end:
                        continue
                    part, left = word[end - size : end], last[end - size]
                    if part in ids:
                        if unigram:
                            score = total[end - size] + scores[part]
                            if score > best:
                                piece, best = part, score
                        elif stable.get((left, part)) or ((left, part) not in stable and self.admissible(left, part)):
                            piece = part
                            break
                    elif size == 1 and (not piece or unigram and total[end - 1] + self.floor > best):
                        piece, best = part, total[end - 1] + self.floor  # an unknown character is a piece of its own
                if not piece:
                    raise ValueError(f"no admissible path in {word!r}")
                last.append(piece)
                total.append(best)
            before, at, path = word, len(word), []
            while at:
                path.append(last[at])
                at -= len(last[at])
            self.words[word] = np.array([i for p in reversed(path) for i in self.ids_of(p)], np.int32).tobytes()

    def ids_of(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.bytes_[b] for b in piece.encode()] if self.bytes_ else [self.unknown]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; none for an empty one."""
        cut = [self.pattern.findall((MARK + t).replace(" ", MARK)) if t else [] for t in texts]
        distinct = set().union(*cut)
        new = distinct - self.words.keys()
        if len(self.words) + len(new) > self.remembered // 2:
            self.older, self.words, new = self.words, {}, distinct
        again = new & self.older.keys()
        self.words.update((w, self.older[w]) for w in again)
        self.learn(sorted(new - again))
        out = [np.frombuffer(b"".join(map(self.words.__getitem__, c)), np.int32) for c in cut]
        for w in new - again:
            if len(w) > LONGEST:
                del self.words[w]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, without the mark put in front; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").removeprefix(" ")


def vocabulary(model: str = MODEL) -> Vocabulary:
    """Read a model file on the driver.  Its normalisation must be the identity, with one blank put in front."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    probe = " a  ﬁ\t\nB "
    if sp.normalize(probe) != (MARK + probe).replace(" ", MARK):
        raise ValueError(f"{model} normalises text; only identity models are supported")
    pieces = [sp.id_to_piece(k) for k in range(sp.vocab_size())]
    plain = [k for k in range(len(pieces)) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k))]
    byte = [k for k in range(len(pieces)) if sp.is_byte(k)]
    raw = [p.replace(MARK, " ").encode() for p in pieces]
    for b, k in enumerate(byte):
        raw[k] = bytes([b])
    for k in range(len(pieces)):
        if sp.is_control(k):
            raw[k] = b""
        elif sp.is_unknown(k):
            raw[k] = " ⁇ ".encode()
    return Vocabulary({pieces[k]: k for k in plain}, {pieces[k]: sp.get_score(k) for k in plain}, raw, byte, sp.unk_id(), unigram=_is_unigram(sp))


def _is_unigram(sp) -> bool:  # noqa: ANN001
    """Merging vocabularies score by rank, in whole numbers; unigram ones by logarithms of frequencies."""
    return any(sp.get_score(k) % 1 for k in range(sp.vocab_size()))


def encoded(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) of each row; round_trip: decoding the ids gives the text back.

    A null or empty text has no ids and makes the round trip.  A text that has the mark character itself decodes
    to a blank in its place, so it doesn't.  Repeated rows give repeated results; other columns are not read; an
    empty table gives an empty result.  The vocabulary, of fixed size, is broadcast.  remembered bounds what a worker
    keeps of words it has met; fewer take less memory and more time, with the same ids.
    """
    given = vocabulary(model)
    given.remembered = remembered
    shared = docs.sparkSession.sparkContext.broadcast(given)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = vocab.encode(texts)
                same = [vocab.decode(i) == t for i, t in zip(ids, texts)]
                count = np.array([len(i) for i in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), pa.array(np.concatenate(ids) if ids else [], pa.int32()))
                yield pa.record_batch([part.column("id"), pa.array(count), lists, pa.array(same)], names=["doc_id", "n_tokens", "ids", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(kernel, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decoded(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids count as none."""
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary(model))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shared.value.decode(np.array(i or [], np.int64)) for i in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(kernel, "doc_id long, text string")

"""Counts over whole texts and their lines, for a list of UTF-8 texts at a time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .wordhash import mix, pieces, prefix, words

SPACE, SYMBOL, UPPER, LOWER, DIGIT, STOP, SHOUT, BAR, START = range(9)


SETS = [b" \t\n\x0b\x0c\r", b"#*$%&|<>", bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b".,;:?\"'()-", b"!", b"|", bytes(c for c in range(256) if c & 0xC0 != 0x80)]
#: Classes that many bytes are in are counted by sums over all bytes, two at a time; the rest where they occur.
DENSE, RARE = [(SPACE, START), (LOWER, STOP)], [SYMBOL, UPPER, DIGIT, SHOUT, BAR]
PACKED = {(a, b): np.array([(c in SETS[a]) + ((c in SETS[b]) << 32) for c in range(256)], np.uint64) for a, b in DENSE}
RARE_BITS = np.array([sum((c in SETS[k]) << i for i, k in enumerate(RARE)) for c in range(256)], np.uint8)
WINDOW = 5


@dataclass
class Stats:
    """Per text: words, points (code points), nonspace, symbols, dup_lines, repeat_words, distinct_words, longest_word.

    Per line: doc (index of its text) and counts (lines x classes, the last the number of words), dup (1 if the
    line has a word and equals an earlier line of its text), repeats (words in repeated windows), line (a hash of it).
    """

    words: np.ndarray
    points: np.ndarray
    nonspace: np.ndarray
    symbols: np.ndarray
    dup_lines: np.ndarray
    repeat_words: np.ndarray
    distinct_words: np.ndarray
    longest_word: np.ndarray
    doc: np.ndarray
    counts: np.ndarray
    dup: np.ndarray
    repeats: np.ndarray
    line: np.ndarray


def repeated_words(h: np.ndarray, doc: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """True for words in windows of `size` words that their text has at least twice; h: 64-bit hashes of the words."""
    n = len(h) - size + 1
    if n < 1:
        return np.zeros(len(h), bool)
    gram = mix(h[:n])
    for k in range(1, size):
        gram = mix(gram + h[k : k + n])
    key = mix(gram ^ mix(doc[:n].astype(np.uint64) + np.uint64(1)))
    whole = doc[:n] == doc[size - 1 :]
    ordered = np.sort(key[whole])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    mark = np.zeros(len(h) + 1, np.int64)
    if len(twice):
        near = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
        again = np.flatnonzero((twice[near] == key) & whole)
        mark[again] += 1
        mark[again + size] -= 1
    return np.cumsum(mark[:-1]) > 0


def analyse(texts: list[bytes]) -> Stats:
    n = len(texts)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)  # counts don't change, and words of two texts never touch
    begin = np.cumsum(np.fromiter(map(len, texts), np.int64, n) + 1)
    edge = np.r_[0, np.flatnonzero(data == 10) + 1]  # line k is data[edge[k] : edge[k + 1] - 1]
    lines = len(edge) - 1
    doc = np.searchsorted(begin, edge[:-1], "right")
    counts = np.zeros((lines, 10), np.int64)
    for pair in DENSE:
        both = np.add.reduceat(PACKED[pair][data], edge[:-1]) if n else np.zeros(0, np.uint64)
        counts[:, pair[0]], counts[:, pair[1]] = both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)
    counts[:, [SPACE, START]] -= 1  # the line break itself
    classes = RARE_BITS[data]
    at = np.flatnonzero(classes)
    line_of_byte = np.searchsorted(edge, at, "right") - 1
    for k in RARE:
        counts[:, k] = np.bincount(line_of_byte[(classes[at] >> RARE.index(k)) & 1 == 1], minlength=lines)
    start, end = words(data)
    line_of_word = np.searchsorted(edge, start, "right") - 1
    doc_of_word = doc[line_of_word]
    counts[:, 9] = np.bincount(line_of_word, minlength=lines)
    sums = prefix(data)
    h = pieces(sums, start, end)
    inside = repeated_words(h, doc_of_word)
    line = pieces(sums, edge[:-1], edge[1:] - 1)
    own = line ^ mix(doc.astype(np.uint64) + np.uint64(1))
    dup = np.ones(lines, np.int64)
    dup[np.unique(own, return_index=True)[1]] = 0
    dup *= counts[:, 9] > 0
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc_of_word, end - start)
    pairs = np.sort((doc_of_word.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
    by_doc = lambda x: np.bincount(doc, weights=x, minlength=n).astype(np.int64)
    return Stats(
        words=by_doc(counts[:, 9]), points=by_doc(counts[:, START]) + np.bincount(doc, minlength=n) - 1, nonspace=by_doc(counts[:, START] - counts[:, SPACE]),
        symbols=by_doc(counts[:, SYMBOL]), dup_lines=by_doc(dup), repeat_words=np.bincount(doc_of_word, weights=inside, minlength=n).astype(np.int64),
        distinct_words=np.bincount((pairs >> np.uint64(40)).astype(np.int64), minlength=n), longest_word=longest, doc=doc, counts=counts, dup=dup,
        repeats=np.bincount(line_of_word, weights=inside, minlength=lines).astype(np.int64), line=line,
    )

"""Personal data by candidate gradient boosting.

Fixed rules find base spans, which always stay.  High-recall generators propose further, overlapping spans of other
formats; boosted trees score each by its format and context; a calibrated threshold for each kind selects, and the
best-scored of overlapping candidates is taken.  The trees are fitted here, on made-up candidates in made-up text.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

Span = tuple[str, int, int]
KINDS = ["email", "ip", "card", "phone", "iban", "secret", "ssn"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can start at the first digit of a run only: from a later one it would fail as well, or start inside a match.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed rules, by kind as listed, then start; ends are exclusive, in code points."""
    out: list[Span] = []
    at, low = text.find("@"), 0
    while at >= 0:
        found, start = DOMAIN.match(text, at), at
        if found:
            while start > low and text[start - 1] in LOCAL:
                start -= 1
        if found and start < at:
            out.append(("email", start, found.end()))
            low = found.end()
        at = text.find("@", max(at + 1, low))
    lines = list(lines_with_digits(text))
    for a, line in lines:
        out += [("ip", a + m.start(), a + m.end()) for m in IP.finditer(line) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for a, line in lines:
        for m in CARD.finditer(line):
            if m.end() - m.start() >= 13:
                digits = re.sub("[^0-9]", "", m[0])
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", a + m.start(), a + m.end()))
    for a, line in lines:
        out += [("phone", a + m.start(), a + m.end()) for m in PHONE.finditer(line) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def lines_with_digits(text: str) -> Iterator[tuple[int, str]]:
    """(start, line) of lines with a digit; all patterns for them stay within a line."""
    found = DIGIT.search(text)
    while found:
        begin, end = text.rfind("\n", 0, found.start()) + 1, text.find("\n", found.end())
        end = len(text) if end < 0 else end
        yield begin, text[begin:end]
        found = DIGIT.search(text, end)


#: Generators of candidates in lines with digits.
GENERATORS: list[tuple[str, re.Pattern]] = [
    ("phone", re.compile(r"(?<![\w+.(-])(?:\(?[0-9]{2,5}\)?[\x20./-]{1,2}){1,4}[0-9]{2,5}(?![\w-])")),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?!\w)")),
    ("ip", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){3,7}(?::?[0-9A-Fa-f]{1,4})(?![\w:])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{20,}(?![A-Za-z0-9_/+=-])")),
]
#: What follows the local part of a disguised address.
AT = re.compile(r"(?:\(at\)|\[at\]|\{at\}|\x20at\x20)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)\s?[A-Za-z0-9-]{2,63}|\.[A-Za-z0-9-]{2,63})+")
GOOD = re.compile(r"token|key|secret|passw|bearer|api|auth|credential|phone|tel|call|fax|mobile|cell|ssn|social|iban|account|bank|mail|contact|write|reach|address|host|server", re.I)
BAD = re.compile(r"order|invoice|ref|version|release|isbn|sku|sha|md5|commit|checksum|digest|page|chapter|table|date|article|item|lot|batch|model|part|score|http|www|path|file", re.I)
CONTEXT = 28


def candidates(text: str) -> list[Span]:
    """Spans that may be personal data, overlapping ones included."""
    out: list[Span] = []
    for m in AT.finditer(text):
        end = start = m.start() - (text[m.start() - 1 : m.start()].isspace() and m.start() > 0)
        while start > 0 and text[start - 1] in LOCAL:
            start -= 1
        if start < end:
            out.append(("email", start, m.end()))
    for a, line in lines_with_digits(text):
        for kind, pattern in GENERATORS:
            for m in pattern.finditer(line):
                if kind != "secret":
                    out.append((kind, a + m.start(), a + m.end()))
                    continue
                # of name=value the value alone too; signs of equality at the end are part of it
                cut = m[0].rstrip("=").rfind("=") + 1
                for skip in {0, cut}:
                    if m.end() - m.start() - skip >= 20 and DIGIT.search(m[0], skip) and LETTER.search(m[0], skip):
                        out.append((kind, a + m.start() + skip, a + m.end()))
    return out


def _iban_ok(raw: str) -> bool:
    code = raw.replace(" ", "")
    turned = "".join(str(int(c, 36)) for c in code[4:] + code[:4])
    return 15 <= len(code) <= 34 and int(turned) % 97 == 1


def features(text: str, span: Span) -> list[float]:
    kind, a, b = span
    raw = text[a:b]
    n = b - a
    digits = sum(c.isdigit() for c in raw)
    letters = sum(c.isalpha() for c in raw)
    upper = sum(c.isupper() for c in raw)
    groups = re.findall("[0-9]+", raw) or [""]
    count = np.unique(np.frombuffer(raw.encode("utf-32-le"), np.uint32), return_counts=True)[1] / n
    before, after = text[max(0, a - CONTEXT) : a], text[b : b + 12]
    changes = sum(x.isdigit() != y.isdigit() for x, y in zip(raw, raw[1:]))
    return [
        KINDS.index(kind), n, digits, letters, upper, n - digits - letters, len(groups), len(groups[0]), len(groups[-1]), max(map(len, groups)), float(-(count * np.log2(count)).sum()), len(count) / n,
        all(c in "0123456789abcdefABCDEF" for c in raw), kind == "iban" and _iban_ok(raw), bool(GOOD.search(before)), bool(BAD.search(before)), before[-1:].isalnum(), before[-1:] in ("=", ":", '"', "'"), after[:1].isalnum(),
        raw[:1] == "(", "at" in raw, "dot" in raw or "[" in raw or "(" in raw, changes / n, len(groups) == 3 and [len(g) for g in groups] == [3, 3, 4], "/" in raw, raw[:1] == "0",
    ]


@dataclass
class Forest:
    """Boosted trees of depth three as arrays: feature, cut and leaf; then logistic calibration and thresholds."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    slope: float
    shift: float
    least: dict[str, float]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of each row."""
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(3):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - 7]
        return total


def _made_up(seed: int, rows: int) -> list[tuple[str, Span, int]]:
    """Candidates of known truth in made-up sentences: (text, span, 1 if personal)."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    chars = lambda n, pool: "".join(pool[int(k)] for k in rng.integers(0, len(pool), n))
    word = lambda: chars(int(rng.integers(2, 9)), "etaoinshrdlucmfwypvbgk")
    low, hexa = "abcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"
    mixed = low + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def iban(valid: bool) -> str:
        body, land = digits(18), pick(["DE", "FR", "ES", "GB", "NL"])
        check = 98 - int(body + "".join(str(int(c, 36)) for c in land) + "00") % 97
        return f"{land}{(check if valid else (check + 7) % 97):02d}" + " ".join([body[:2]] + [body[k : k + 4] for k in range(2, 18, 4)]).replace(" ", pick(["", ""]))

    personal = [
        (["write to ", "mail ", "contact ", ""], lambda: f"{word()}{pick(['.', ''])}{word()} {pick(['(at)', '[at]', '{at}', 'at'])} {word()} {pick(['(dot)', '[dot]', '{dot}', 'dot'])} {pick(['com', 'org', 'net', 'de'])}"),
        (["call ", "phone: ", "tel ", "mobile ", ""], lambda: pick([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{pick('23456789')}{digits(2)}-{digits(3)}-{digits(4)}", f"{pick('23456789')}{digits(2)}.{digits(3)}.{digits(4)}", f"0{digits(2)} {digits(4)} {digits(4)}"])),
        (["ssn ", "social security ", "number ", ""], lambda: f"{digits(3)}-{digits(2)}-{digits(4)}"),
        (["iban ", "account ", "bank ", ""], lambda: iban(True)),
        (["host ", "from ", "address ", ""], lambda: ":".join(chars(int(rng.integers(1, 5)), hexa) for _ in range(8))),
        (['token = "', "api_key=", "secret: ", 'password="', "bearer "], lambda: pick([chars(40, hexa), chars(32, hexa), chars(int(rng.integers(24, 48)), mixed)])),
    ]
    harmless = [
        (["", "met ", "look "], lambda: f"{word()} at {word()}.{word()}"),
        (["order ", "table ", "date ", "score ", "", "page "], lambda: pick([f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}/{digits(2)}/{digits(4)}", f"{digits(2)} {digits(3)}", f"{digits(3)} {digits(3)} {digits(3)}", f"{digits(2)}.{digits(2)}", f"{digits(4)} {digits(4)}", f"978-{digits(1)}-{digits(4)}-{digits(4)}"])),
        (["order ", "item ", "part ", "lot "], lambda: f"{digits(3)}-{digits(2)}-{digits(4)}"),
        (["model ", "ref ", ""], lambda: iban(False)),
        (["at ", "time ", ""], lambda: ":".join(digits(2) for _ in range(4))),
        (["commit ", "sha ", "checksum ", "path ", "see ", "file "], lambda: pick([chars(40, hexa), chars(64, hexa), "-".join([word() for _ in range(6)] + [digits(2)]), "/".join([word() for _ in range(6)] + [digits(4)]), "_" * 18 + digits(2) + "ab", "-".join(word() for _ in range(5)) + "-2024"])),
    ]
    out = []
    while len(out) < rows:
        truth = int(rng.integers(2))
        lead, make = pick(personal if truth else harmless)
        head, tail = " ".join(word() for _ in range(6)), " ".join(word() for _ in range(5))
        lead, core = pick(lead), make()
        text = f"{head} {lead}{core}{pick(['', '.', ',', '\"'])} {tail}"
        begin = len(head) + 1 + len(lead)
        for span in candidates(text):
            if span[1] < begin + len(core) and span[2] > begin:
                whole = abs(span[1] - begin) <= 1 and abs(span[2] - begin - len(core)) <= 1
                out.append((text, span, int(truth and whole and (span[0] != "phone" or len(core) >= 10))))
    return out


def fit(seed: int = 7, rows: int = 6000, trees: int = 60, rate: float = 0.2) -> Forest:
    """Boost on two thirds of the made-up candidates; calibrate and set thresholds on the rest.

    The threshold of a kind is the lowest score from which on at least 99 in 100 are personal data, 0.5 at least.
    """
    data = _made_up(seed, rows)
    x = np.array([features(t, s) for t, s, _ in data], float)
    y = np.array([z for _, _, z in data], float)
    held = np.arange(len(y)) % 3 == 0
    u, v = x[~held], y[~held]
    cuts = [np.unique(np.quantile(u[:, k], np.linspace(0.03, 0.97, 24))) for k in range(x.shape[1])]
    bins = [np.searchsorted(c, u[:, k], "left") for k, c in enumerate(cuts)]
    total, built = np.zeros(len(v)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = v - p, p * (1 - p)
        feature, cut, leaf = np.zeros(7, int), np.full(7, np.inf), np.zeros(8)
        node = np.zeros(len(v), int)
        for k in range(7):
            at = np.flatnonzero(node == k)
            best = 1e-6
            for f, b in enumerate(bins):
                gs, hs = np.bincount(b[at], g[at], len(cuts[f]) + 1), np.bincount(b[at], h[at], len(cuts[f]) + 1)
                gl, hl, gt, ht = np.cumsum(gs)[:-1], np.cumsum(hs)[:-1], gs.sum(), hs.sum()
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                if len(gain) and gain.max() > best:
                    best, feature[k], cut[k] = gain.max(), f, cuts[f][gain.argmax()]
            node[at] = 2 * k + 1 + (u[at, feature[k]] > cut[k])
        for k in range(8):
            at = node == k + 7
            leaf[k] = rate * g[at].sum() / (h[at].sum() + 1)
        total += leaf[node - 7]
        built.append((feature, cut, leaf))
    forest = Forest(built, 1.0, 0.0, {})
    raw, truth = forest.raw(x[held]), y[held]
    for _ in range(50):  # logistic calibration by Newton steps
        p = 1 / (1 + np.exp(-(forest.slope * raw + forest.shift)))
        w, e = p * (1 - p) + 1e-6, truth - p
        hess = np.array([[(w * raw * raw).sum() + 1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1]])
        forest.slope, forest.shift = np.array([forest.slope, forest.shift]) + np.linalg.solve(hess, [(e * raw).sum(), e.sum()])
    score = forest.score(x[held])
    for k, kind in enumerate(KINDS):
        own = x[held][:, 0] == k
        order = np.argsort(-score[own], kind="stable")
        exact = np.cumsum(truth[own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(exact >= 0.99)
        forest.least[kind] = max(0.5, float(score[own][order][good[-1]])) if len(good) else 1.1
    return forest


class Taken:
    """Spans that may not be overlapped, as disjoint ones in order, so that one is looked up by bisection."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def add(self, a: int, b: int) -> bool:
        """Takes the span too if it overlaps none."""
        k = bisect.bisect_left(self.starts, b)
        if k and self.ends[k - 1] > a:
            return False
        self.starts.insert(k, a)
        self.ends.insert(k, b)
        return True


def spans_of(texts: list[str], forest: Forest) -> list[tuple[list[Span], list[Span]]]:
    """For each text (base spans, spans that the method adds).  Added spans overlap neither base nor each other."""
    found = [(k, s) for k, t in enumerate(texts) for s in candidates(t)]
    out: list[tuple[list[Span], list[Span]]] = [(base_spans(t), []) for t in texts]
    if not found:
        return out
    score = forest.score(np.array([features(texts[k], s) for k, s in found], float))
    taken = {k: Taken([(a, b) for _, a, b in out[k][0]]) for k, _ in found}
    for i in sorted(range(len(found)), key=lambda i: (-score[i], found[i][0], found[i][1][1], -found[i][1][2])):
        k, (kind, a, b) = found[i]
        if score[i] >= forest.least[kind] and taken[k].add(a, b):
            out[k][1].append((kind, a, b))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def redacted_text(text: str, spans: list[Span]) -> str:
    """Each span replaced by its kind in brackets; of overlapping ones the earlier start, then the longer, rules."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def found_in(docs: DataFrame, forest: Forest | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spans of each row: doc_id, n_email, n_ip, n_card, n_phone (of the base), base_sha256, spans, n_added.

    A null text counts as empty.  Repeated rows give repeated results; other columns are not read; an empty table
    gives an empty result.
    """
    forest = forest or fit()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for base, added in spans_of([t or "" for t in part.column("text").to_pylist()], forest):
                    count = [sum(k == kind for k, _, _ in base) for kind in KINDS[:4]]
                    rows.append((*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added)))
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()])]
                yield pa.record_batch([part.column("id"), *columns], names=names)

    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(kernel, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(docs: DataFrame, forest: Forest | None = None) -> DataFrame:
    """docs with every span of `text` replaced, base and added, and n_chars, where there is one, counted anew.

    Each row gives one row: a null text stays null, an empty one empty, and texts of any length are read whole.
    Repeated rows are redacted alike; other columns, of any names, stay as they are; an empty table stays empty.
    """
    forest = forest or fit()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                spans = spans_of([t or "" for t in texts], forest)
                texts = [None if t is None else redacted_text(t, base + added) for t, (base, added) in zip(texts, spans)]
                at = part.schema.get_field_index("text")
                yield part.set_column(at, part.schema.field("text"), pa.array(texts, part.schema.field("text").type))

    out = docs.mapInArrow(kernel, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out

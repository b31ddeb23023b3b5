"""Personal data: high-recall span generators, gradient-boosted trees on format and context, calibrated thresholds.

Base spans (email, ip, card, phone) come from fixed patterns and always stay. Generators propose further overlapping
spans: obfuscated addresses, phones and cards in other formats, account and identity numbers, keys and passwords.
Boosted trees, trained here on generated examples, score each proposal by its format and its context; scores are
calibrated on held-out examples and a threshold for each kind, set for precision, selects spans. Overlaps among
selected proposals go to the higher score; a proposal that overlaps a base span is dropped.

Cases: null text is empty and has no spans; repeated rows give equal results; other columns are ignored; an empty table
gives an empty result. Work is linear in the text: no pattern is tried again inside a run where it has failed,
and no run is too long for one.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that the model adds, after the base ones in order.
ADDED_KINDS = ("email_obfuscated", "phone_local", "iban", "identity", "secret")
KINDS = BASE_KINDS + ADDED_KINDS
PRECISION = 0.98

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT, NOT_DIGIT = re.compile(r"[0-9]"), re.compile(r"[^0-9]+")
#: The shortest key or password that is looked for.
SECRET = 16


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the email pattern: from each @, the run before it and the domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            end = m.end()
        else:
            end = max(end, at + 1)  # no match spans this @
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed."""
    found = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(own := part.lstrip("0")) < 4 and int(own or "0") <= 255 for part in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], BASE_KINDS.index(s[2]), s[1]))


#: An obfuscated address from its "at" on, and what stands before it.
AT = re.compile(r"(?:@|\bat\b)[\])}>]? ?[\w-]{1,63}+ ?[\[({<]?(?:\bdot\b|\.)[\])}>]? ?[a-z]{2,24}\b", re.I | re.A)
BEFORE_AT = re.compile(r"(?<![\w.+-])[\w.+-]{1,64}+ ?[\[({<]?\Z", re.A)
# Generators: wide patterns, anchored so that each run is tried once.
GENERATORS = {
    "phone_local": re.compile(r"(?<![\w+.-])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[ ./-][0-9]{2,5}){2,4}(?![\w-])", re.A),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.A),
    "identity": re.compile(r"(?<![\w.-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![\w-])", re.A),
    "secret": re.compile(r"(?<![A-Za-z0-9/+_=-])[A-Za-z0-9/+_=-]{16,}+", re.A),
}
# Words that stand near personal data, by kind.
CUES = {
    "email_obfuscated": ("mail", "contact", "write", "reach"),
    "phone_local": ("phone", "tel", "call", "fax", "mobile", "cell", "dial", "whatsapp"),
    "iban": ("iban", "account", "bank", "transfer", "konto", "compte", "cuenta"),
    "identity": ("ssn", "social", "security", "identity", "passport", "tax"),
    "secret": ("key", "token", "secret", "password", "passwd", "pwd", "auth", "credential", "bearer", "api"),
}
NEGATIVE_CUES = ("version", "order", "invoice", "isbn", "commit", "page", "figure", "table", "id", "price", "http", "www", "file", "sha", "build", "part", "date", "class", "def", "import")
WINDOW = 32


def propose(text: str) -> list[tuple[int, int, str]]:
    """Overlapping proposals of all generators; one is skipped only where what it needs is missing: a digit, or a word of a
    secret's length."""
    found = []
    for m in AT.finditer(text):
        if before := BEFORE_AT.search(text, max(0, m.start() - 67), m.start()):
            found.append((before.start(), m.end(), "email_obfuscated"))
    digits, long = DIGIT.search(text) is not None, any(len(word) >= SECRET for word in text.split())
    for kind, pattern in GENERATORS.items():
        if long if kind == "secret" else digits:
            found += [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    return found


def iban_valid(value: str) -> bool:
    value = value.replace(" ", "").upper()
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def entropy(value: str) -> float:
    counts = [value.count(c) for c in set(value)]
    return -sum(n / len(value) * math.log2(n / len(value)) for n in counts)


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format features of the span and context features of the window around it."""
    span = text[start:end]
    before, after = text[max(0, start - WINDOW) : start].lower(), text[end : end + WINDOW].lower()
    near = before + " " + span.lower() + " " + after
    digits = sum(c.isdigit() for c in span)
    letters = sum(c.isalpha() for c in span)
    upper = sum(c.isupper() for c in span)
    compact = NOT_DIGIT.sub("", span)
    value = span.rpartition("=")[2] if kind == "secret" else span
    return [
        float(KINDS.index(kind)), float(len(span)), digits / len(span), letters / len(span), upper / len(span),
        float(len(compact)), float(sum(not c.isalnum() for c in span)), entropy(value) if value else 0.0,
        float(sum(a.isdigit() != b.isdigit() for a, b in zip(value, value[1:]))) / max(1, len(value) - 1),
        float(any(c in before for c in CUES[kind])), float(any(c in near for c in CUES[kind])),
        float(any(c in before.split()[-3:] for c in NEGATIVE_CUES) or any(before.rstrip(" :#").endswith(c) for c in NEGATIVE_CUES)),
        float(kind == "iban" and len(span) < 50 and iban_valid(span)),
        float(kind == "identity" and span[:3] not in ("000", "666") and span[0] != "9" and span[-4:] != "0000"),
        float(bool(re.search(r"[\[({<]|\b(?:at|dot)\b", span, re.I))), float("@" in span),
        float(span.startswith(("AKIA", "ghp_", "sk-", "xox", "eyJ"))), float("=" in span.rstrip("=")),
        float("-" in span), float("/" in span), float(before.endswith((" ", "\n")) or not before),
        float(bool(re.fullmatch(r"[0-9a-f]+", value))), float(bool(re.search(r"[0-9]", value)) and bool(re.search(r"[a-z]", value)) and bool(re.search(r"[A-Z]", value))),
    ]


def examples(count: int, seed: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Generated labelled proposals: personal data in cues, and look-alikes (versions, dates, hashes, file names)."""
    rng = random.Random(seed)
    pick = rng.choice
    words = ["the", "of", "and", "to", "in", "anre", "thor", "ering", "de", "la", "der", "und", "que", "est", "with", "value", "for", "on"]
    filler = lambda n: " ".join(pick(words) for _ in range(n))
    name = lambda: "".join(pick("abcdefghiklmnoprstuvw") for _ in range(rng.randint(3, 9)))
    number = lambda n: "".join(pick("0123456789") for _ in range(n))
    coded = lambda n, a: "".join(pick(a) for _ in range(n))
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def iban() -> str:
        body, land = number(18), pick(["DE", "FR", "ES", "GB"])
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        value = f"{land}{check:02d}{body}"
        return value if rng.random() < 0.5 else " ".join(value[i : i + 4] for i in range(0, len(value), 4))

    def one(kind: str, positive: bool) -> str:
        if kind == "email_obfuscated":
            if positive:
                at, dot = pick([(" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), (" [at] ", " [dot] "), (" at ", ".")])
                return f"{pick(['mail', 'contact', 'write to', 'reach me:', 'e-mail'])} {name()}.{name()}{at}{name()}{dot}{pick(['com', 'org', 'net', 'de', 'fr'])}"
            return pick([f"look at {name()}. {name().title()}", f"met at {name()} dot {name()}", f"{name()} at {name()}.{name()}", f"sat at {name()}.Com"])
        if kind == "phone_local":
            if positive:
                return f"{pick(['phone', 'tel.', 'call', 'mobile:', 'fax', 'dial'])} {pick([f'({number(3)}) {number(3)}-{number(4)}', f'{number(3)}-{number(3)}-{number(4)}', f'{number(3)}.{number(3)}.{number(4)}', f'{number(2)} {number(2)} {number(2)} {number(2)} {number(2)}'])}"
            return pick([f"{pick(['date', 'on', 'from', 'version', 'order', 'part', 'page'])} {pick([f'20{number(2)}-0{rng.randint(1, 9)}-{number(2)}', f'{number(2)}/{number(2)}/20{number(2)}', f'{number(2)}.{number(2)}.{number(4)}', f'{number(3)}-{number(3)}-{number(3)}', f'{number(2)} {number(2)} {number(3)}'])}"])
        if kind == "iban":
            if positive:
                return f"{pick(['iban', 'account', 'bank transfer to', 'konto'])} {iban()}"
            return f"{pick(['part', 'order', 'id', 'build', 'model'])} {pick(['AB', 'XK', 'QR', 'ZT'])}{number(2)}{number(rng.choice([8, 12, 16]))}"
        if kind == "identity":
            value = f"{number(3)}-{number(2)}-{number(4)}"
            return f"{pick(['ssn', 'social security number', 'tax identity', 'passport'])} {value}" if positive else f"{pick(['order', 'part', 'invoice', 'id', 'page', 'the'])} {value}"
        if positive:
            return pick([
                f"{pick(['', 'key ', 'aws '])}AKIA{coded(16, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')}", f"password={coded(rng.randint(12, 24), '0123456789abcdef')}",
                f'{pick(["token", "secret", "api_key", "auth", "key"])} = "{coded(rng.choice([32, 40, 64]), "0123456789abcdef")}"', f"{pick(['token', 'bearer', 'api key', 'secret'])}: {coded(rng.randint(24, 48), alnum)}",
                f"ghp_{coded(36, alnum)}", f"sk-{coded(40, alnum)}", f"pwd={coded(rng.randint(14, 20), alnum)}",
                f"{pick(['token', 'bearer', 'secret'])}: {coded(rng.randint(130, 400), alnum + '_-')}", f"eyJ{coded(rng.randint(30, 300), alnum)}",
                f"{pick(['password', 'passwd', 'secret'])}={coded(rng.randint(12, 24), alnum[26:52])}",
            ])
        return pick([
            f"{name()}-{name()}-{name()}-{name()}", f"{name()}_{name()}_{name()}{number(1)}", f"{name()}/{name()}/{name()}/{name()}", name() + name() + name() + name(),
            f"{pick(['order', 'part', 'id', 'number'])} {number(rng.randint(16, 22))}", f"{pick(['commit', 'sha', 'build', 'file'])} {coded(40, '0123456789abcdef')}", "=" * rng.randint(16, 40), "-" * rng.randint(16, 60),
            f"{name().title()}{name().title()}{name().title()}{number(2)}x", f"{number(4)}-{number(4)}-{number(4)}-{number(4)}", f"{number(20)}",
            "/".join(name() for _ in range(rng.randint(6, 40))), "-".join(name() for _ in range(rng.randint(6, 40))), pick("-=_") * rng.randint(80, 300), number(rng.randint(60, 300)),
        ])

    rows, labels, kinds = [], [], []
    while len(rows) < count:
        kind, positive = pick(ADDED_KINDS), rng.random() < 0.5
        text = f"{filler(rng.randint(0, 6))} {one(kind, positive)} {filler(rng.randint(0, 6))}".strip()
        for start, end, found in propose(text):
            if found == kind:
                rows.append(features(text, start, end, kind))
                labels.append(float(positive))
                kinds.append(kind)
    return np.array(rows), np.array(labels), kinds


class Boosted:
    """Logistic gradient boosting of depth-limited trees over quantile bins."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, penalty: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.penalty = rounds, depth, rate, bins, penalty
        self.trees: list[list[tuple[int, float, float]]] = []  # heaps of (feature or -1, cut, value)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1], method="lower")) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
        score = np.zeros(len(y))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, np.maximum(p * (1 - p), 1e-6)
            tree: list[tuple[int, float, float]] = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
            node = np.zeros(len(y), dtype=np.int64)
            for at in range(len(tree)):
                rows = np.flatnonzero(node == at)
                if not len(rows):
                    continue
                g, h = gradient[rows].sum(), weight[rows].sum()
                tree[at] = (-1, 0.0, float(self.rate * g / (h + self.penalty)))
                if at >= 2**self.depth - 1:
                    continue
                best = (1e-6, -1, 0)
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gs = np.cumsum(np.bincount(binned[rows, j], gradient[rows], len(c) + 1))[:-1]
                    hs = np.cumsum(np.bincount(binned[rows, j], weight[rows], len(c) + 1))[:-1]
                    gain = gs**2 / (hs + self.penalty) + (g - gs) ** 2 / (h - hs + self.penalty) - g * g / (h + self.penalty)
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (float(gain[i]), j, i)
                if best[1] >= 0:
                    j, cut = best[1], float(cuts[best[1]][best[2]])
                    tree[at] = (j, cut, tree[at][2])
                    node[rows] = np.where(x[rows, j] <= cut, 2 * at + 1, 2 * at + 2)
            self.trees.append(tree)
            score += self._tree(tree, x)
        return self

    @staticmethod
    def _tree(tree: list[tuple[int, float, float]], x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        feature, cut, value = (np.array(c) for c in zip(*tree))
        while (inner := feature[node] >= 0).any():
            rows = np.flatnonzero(inner)
            at = node[rows]
            node[rows] = np.where(x[rows, feature[at]] <= cut[at], 2 * at + 1, 2 * at + 2)
        return value[node]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sum((self._tree(t, x) for t in self.trees), np.zeros(len(x)))


def platt(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic calibration, by Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * scores + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - y) * scores).sum() + 1e-3 * a, (p - y).sum() + 1e-3 * b])
        h = np.array([[(w * scores**2).sum() + 1e-3, (w * scores).sum()], [(w * scores).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


@lru_cache(maxsize=2)
def model(count: int = 4000, seed: int = 7, precision: float = PRECISION) -> tuple[Boosted, tuple[float, float], dict[str, float]]:
    """Trees fitted on generated examples, calibration and each kind's threshold from held-out ones."""
    x, y, _ = examples(count, seed)
    trees = Boosted().fit(x, y)
    held, truth, kinds = examples(count // 2, seed + 1)
    raw = trees.score(held)
    a, b = platt(raw, truth)
    p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
    thresholds = {}
    for kind in ADDED_KINDS:
        own = np.array([k == kind for k in kinds])
        order = np.sort(np.unique(p[own]))
        good = [i for i, t in enumerate(order) if truth[own][p[own] >= t].mean() >= precision]
        # halfway to the next lower score, so that the threshold doesn't sit on one example
        thresholds[kind] = max(0.5, float(order[good[0]] + (order[good[0] - 1] if good[0] else 0.0)) / 2) if good else 1.1
    return trees, (a, b), thresholds


def select(text: str, base: list[tuple[int, int, str]], fitted) -> list[tuple[int, int, str]]:
    """The proposals that the calibrated model keeps and that overlap no base span and no better proposal."""
    trees, (a, b), thresholds = fitted
    proposals = []
    i = 0
    for start, end, kind in sorted(propose(text)):
        while i < len(base) and base[i][1] <= start:
            i += 1
        if i == len(base) or base[i][0] >= end:  # base[i] is the first that ends beyond the start
            proposals.append((start, end, kind))
    if not proposals:
        return []
    raw = trees.score(np.array([features(text, *p) for p in proposals]))
    p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
    ranked = sorted((-v, *span) for v, span in zip(p, proposals) if v >= thresholds[span[2]])
    kept: list[tuple[int, int, str]] = []  # in order and disjoint
    for _, start, end, kind in ranked:
        at = bisect.bisect_left(kept, (start,))
        if (at == 0 or kept[at - 1][1] <= start) and (at == len(kept) or kept[at][0] >= end):
            kept.insert(at, (start, end, kind))
    return kept


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def find(docs: DataFrame, fitted=None) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, base>>, redacted text) of every document."""
    fitted = docs.sparkSession.sparkContext.broadcast(fitted or model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                spans, redacted = [], []
                for text in part.column(1).to_pylist():
                    text = text or ""
                    base = base_spans(text)
                    every = [(*s, True) for s in base] + [(*s, False) for s in select(text, base, fitted.value)]
                    every.sort(key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
                    spans.append([{"kind": k, "start": a, "end": b, "base": own} for a, b, k, own in every])
                    out, done = [], 0
                    for a, b, k, _ in every:
                        if a >= done:
                            out += [text[done:a], f"<{k}>"]
                        done = max(done, b)
                    redacted.append("".join([*out, text[done:]]) if every else text)
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind), pa.array(redacted, pa.string())], names=["doc_id", "spans", "redacted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>, redacted string")


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, the checksum of the base spans, the numbers of added and of all spans, and the list of all."""
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE_KINDS]
    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), added, F.size("spans").cast("long").alias("n_spans"), shown(F.col("spans")).alias("spans"))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()

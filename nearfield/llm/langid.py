"""Language identification with error-correcting output codes.

Every language has a codeword; a binary character n-gram classifier predicts each bit as a log-odds margin, and
loss-weighted decoding picks the codeword with the least loss, each bit weighed by how well it separates. A text whose
two best codewords are close is flagged ambiguous; one with more 3-grams that its language doesn't have than texts of
that language have is flagged foreign. That bound is calibrated for each language on labelled texts of its own.

Classifiers are fitted on a bounded sample of labelled rows: of each language those whose id's hash is below a limit set
for PER_LANGUAGE rows (rows of one id come together). Nothing else is shuffled; the sample's n-gram counts are combined
before they are dealt, and languages x 2^BITS counts and one row a calibration text reach the driver. Prediction reads
whole texts, in slices, so that memory does not follow a text's length.

Cases: null text, or one without a letter, is 'und' with score 0, ambiguous and foreign; null labels and null ids don't
train; without any label every text is 'und'; repeated rows give equal results; ties go to the language first in
code-point order; kept columns may have any name, those named like a result are replaced; others are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, quoted, sliced

#: Labelled rows of a language in the sample; one in CALIBRATION of them isn't fitted on, but sets the language's bound.
PER_LANGUAGE = 1500
CALIBRATION = 5
BITS = 15
SIZE = 1 << BITS
SMOOTHING = 0.5
SLICE = 1 << 18
UNKNOWN = "und"
#: A margin between the two best codewords' scores below this is ambiguous.
CLOSE = 0.1
#: A text is foreign if its share of unknown 3-grams is above MARGIN times the share that all but one in a thousand of
#: its language's calibration texts stay below, at least LEAST, and so many standard errors of its length more.
MARGIN = 2.0
LEAST = 0.1
ERRORS = 3.0
RESULTS = ("lang_pred", "score", "ambiguous", "foreign", "margins")

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTERS[0]


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of +1/-1: the exhaustive code up to 6 languages, else a dense random code that keeps rows far apart."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.int8)
    if n <= 6:
        columns = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(columns, dtype=np.int8).T
    width = int(np.ceil(10 * np.log2(n)))
    rng = np.random.default_rng(seed)
    best, apart = None, -1
    for _ in range(20):
        code = rng.choice(np.array([1, -1], dtype=np.int8), size=(n, width))
        code = code[:, (code.min(0) < code.max(0))]
        distance = (code.shape[1] - code.astype(int) @ code.T.astype(int)) // 2 + 10**6 * np.eye(n, dtype=int)
        if distance.min() > apart:
            best, apart = code, distance.min()
    return best


def grams(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed 1-, 2- and 3-grams of a text's letters, and the 3-grams alone, in slices; other characters are one space."""
    for at in range(0, len(text), SLICE):
        part = text[max(0, at - 2) : at + SLICE].lower()
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = letters()[code]
        code = np.where(letter, code, 32).astype(np.uint64)
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        code = code[keep]
        if not letter.any():
            continue
        mix = np.uint64(0x9E3779B97F4A7C15)
        one = (code + np.uint64(1)) * mix
        two = (one[:-1] ^ (one[1:] >> np.uint64(7))) * mix
        three = (two[:-1] ^ (one[2:] >> np.uint64(11))) * mix
        every = np.concatenate([(g >> np.uint64(64 - BITS)).astype(np.int32) for g in (one, two, three)])
        yield every, every[len(every) - len(three) :]


@dataclass
class Model:
    """languages; code (languages x bits); weights (SIZE x bits, log-odds); importance of bits; known (languages x SIZE):
    which n-grams a language has; bound: the usual share of unknown 3-grams in a language's texts, at most."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    importance: np.ndarray
    known: np.ndarray
    bound: np.ndarray

    def unknown(self, parts: Iterator[tuple[np.ndarray, np.ndarray]], language: int) -> tuple[int, int]:
        """(3-grams that the language doesn't have, 3-grams)."""
        own, missed, n = self.known[language], 0, 0
        for _, three in parts:
            n += len(three)
            missed += len(three) - int(np.count_nonzero(own[three]))
        return missed, n

    def predict(self, text: str | None) -> tuple[str, float, bool, bool, list[float]]:
        """(language, score, ambiguous, foreign, bit margins)."""
        total, n, part = np.zeros(self.code.shape[1] if len(self.languages) else 1), 0, None
        for part in grams(text or ""):
            n += len(part[0])
            if self.languages:
                total += self.weights[part[0]].sum(0, dtype=np.float64)
        if not n or not self.languages:
            return UNKNOWN, 0.0, True, True, []
        margin = total / np.sqrt(n)
        loss = (np.logaddexp(0.0, -self.code * margin) * self.importance).sum(1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        order = np.argsort(loss, kind="stable")
        close = len(order) > 1 and p[order[0]] - p[order[1]] < CLOSE
        # a text of one slice is at hand still
        missed, threes = self.unknown(iter([part]) if len(text) <= SLICE else grams(text), order[0])
        limit = max(LEAST, MARGIN * self.bound[order[0]])
        foreign = missed > limit * threes + ERRORS * np.sqrt(threes) / 2
        return self.languages[order[0]], float(p[order[0]]), bool(close), bool(foreign), [round(float(m), 6) for m in margin]


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sampled(docs: DataFrame, per_language: int) -> DataFrame:
    """(lang, text, part): about per_language labelled rows of each language that aren't held out."""
    # ids' hashes are spread evenly, so that a limit on them takes as many as wanted; part says what a row is used for
    key = F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string"))
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    # counted without looking at texts: null ones lessen the sample a little
    counted = labelled.groupBy("lang").agg(F.count("*").alias("rows"))
    share = F.lit(float(per_language)) / F.col("rows")
    limits = counted.select("lang", F.when(share >= 1, 2**63 - 1).otherwise((F.lit(float(2**64)) * share - F.lit(float(2**63))).cast("long")).alias("limit"))
    rows = labelled.where("text is not null").select("lang", "text", key.alias("key"))
    return rows.join(F.broadcast(limits), "lang").where("key <= limit").select("lang", "text", F.pmod(F.shiftright("key", 3), F.lit(CALIBRATION)).cast("int").alias("part"))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model of the labelled rows that aren't held out, from about per_language of each language."""
    sample = cut(sampled(docs, per_language))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = counts.setdefault(lang, np.zeros(SIZE, np.int64))
                for every, _ in grams(text):
                    own += np.bincount(every, minlength=SIZE)
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], names=["lang", "gram", "n"])

    fitted = sample.where("part > 0").select("lang", "text").mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    for r in fitted.collect():
        counts.setdefault(r["lang"], np.zeros(SIZE, np.int64))[r["gram"]] = r["n"]
    model = train(counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], []]
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang in shared.value.languages:
                    for to, value in zip(rows, (lang, *shared.value.unknown(grams(text), shared.value.languages.index(lang)))):
                        to.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64())], names=["lang", "missed", "n"])

    held = sample.where("part = 0").select("lang", "text").mapInArrow(measure, "lang string, missed long, n long").collect()
    return calibrated(model, [(r["lang"], r["missed"], r["n"]) for r in held])


def calibrated(model: Model, texts: list[tuple[str, int, int]]) -> Model:
    """The model with each language's bound from (language, unknown 3-grams, 3-grams) of texts that it wasn't fitted on.

    Of short texts the part beyond chance counts. A language without such texts takes the greatest of the others' bounds.
    """
    for i, lang in enumerate(model.languages):
        shares = [max(0.0, m - ERRORS * np.sqrt(n) / 2) / n for own, m, n in texts if own == lang and n]
        model.bound[i] = np.quantile(shares, 0.999) if shares else np.nan
    whole = 1.0 if np.isnan(model.bound).all() else np.nanmax(model.bound)
    model.bound[np.isnan(model.bound)] = whole
    return model


def train(counts: dict[str, np.ndarray]) -> Model:
    """Bit classifiers from each language's n-gram counts; languages count alike, whatever their numbers of rows. Bounds
    are left at 1, which nothing exceeds."""
    languages = sorted(lang for lang, c in counts.items() if c.sum())
    code = codewords(len(languages))
    if not languages:
        return Model([], code, np.zeros((SIZE, 1), np.float32), np.ones(1), np.zeros((0, SIZE), bool), np.zeros(0))
    p = np.stack([(counts[lang] + SMOOTHING) / (counts[lang].sum() + SMOOTHING * SIZE) for lang in languages])
    weights, importance = [], []
    for bit in code.T:
        if (bit > 0).all():
            weights.append(np.zeros(SIZE))
            importance.append(1.0)
            continue
        w = np.log(p[bit > 0].mean(0)) - np.log(p[bit < 0].mean(0))
        weights.append(w)
        importance.append(float(max(1e-3, (bit * (p @ w)).min())))  # the mean margin of the language it serves least
    importance = np.array(importance)
    known = np.stack([counts[lang] > 0 for lang in languages])
    return Model(languages, code, np.stack(weights, 1).astype(np.float32), importance / importance.mean(), known, np.ones(len(languages)))


def identify(docs: DataFrame, model: Model | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred, score, ambiguous, foreign and margins (a bit classifier's each) of every document."""
    keep = tuple(c for c in keep if c not in RESULTS)
    return _identified(docs, model, keep).select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"_{c}").alias(c) for c in RESULTS])


def known_only(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of docs, whatever their columns' names, whose text is in one of the model's languages."""
    found = _identified(docs, model, tuple(docs.columns)).where((F.col("_lang_pred") != UNKNOWN) & ~F.col("_foreign"))
    return found.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])


def _identified(docs: DataFrame, model: Model | None, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns as _0, _1, ... and the results as _lang_pred, _score, ..."""
    model = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.float64(), pa.bool_(), pa.bool_(), pa.list_(pa.float64()))
        for part in sliced(batches, 512):
            own = list(zip(*(model.value.predict(t) for t in part.column(place).to_pylist())))
            names = [*(f"_{i}" for i in range(len(keep))), *(f"_{c}" for c in RESULTS)]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(pa.array(list(v), t) for v, t in zip(own, types))], names=names)

    # a text that isn't among the kept columns comes last
    place = keep.index("text") if "text" in keep else len(keep)
    own = docs.select(*[quoted(c).alias(f"_{i}") for i, c in enumerate(keep)], *([F.col("text").alias("_text")] if place == len(keep) else []))
    types = (T.StringType(), T.DoubleType(), T.BooleanType(), T.BooleanType(), T.ArrayType(T.DoubleType()))
    return own.mapInArrow(run, T.StructType([*own.schema.fields[: len(keep)], *(T.StructField(f"_{c}", t) for c, t in zip(RESULTS, types))]))

"""Toxic passages: maximum-scoring segments over token log-odds, with extreme-value calibration.

Learning.  On a bounded sample of labelled texts, each unit (a word, and its prefixes of 3 to 6
letters, as insults are inflected) has a rate of toxic texts among those that contain it, with
a Dirichlet prior centred on the next shorter unit's rate, down to the overall rate.  A unit's
score is its log-odds against the overall rate, where that is significant.

Scoring.  A word scores as its longest known unit, less a drift, so that words of clean texts
score below zero on average.  A linear scan finds all maximal-scoring segments of a text.  By
extreme-value theory a clean text of n words has K n exp(-lambda S) segments of score S or
more; lambda and K come from clean held-back texts of the sample.  Segments of which less than
``E_VALUE`` are expected are significant.  A text's evidence is the smallest Poisson tail over
its best, two best, ... significant segments, and a two-parameter logistic curve,
fitted on the held-back texts, turns it into a score between 0 and 1.

The model is a few thousand units; scoring is one narrow pass over whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, slices, utf8
from .language import letters_of

#: Labelled rows to learn from at most, in expectation.
SAMPLE_ROWS = 30_000
PREFIXES = (3, 4, 5, 6)
PRIOR = 5.0
SIGNIFICANT = 4.0
LEAST = 0.7
DRIFT = 0.5
E_VALUE = 0.05


def words_of(text: bytes) -> list[bytes]:
    return letters_of(text).split()


def units_of(word: bytes) -> list[str]:
    """Units of a word, the longest first; the whole word ends in a space."""
    w = word.decode("utf-8", "replace")
    return [w + " ", *(w[:n] for n in reversed(PREFIXES) if len(w) >= n)]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 1.0
    intercept: float = -4.0
    slope: float = 1.0

    def weight(self, word: bytes) -> float:
        for u in units_of(word):
            if u in self.weights:
                return self.weights[u]
        return 0.0


class Scorer(dict):
    """Word weights by word, filled as words come; bounded."""

    def __init__(self, model: Model, entries: int = 200_000):
        self.model, self.entries = model, entries

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.entries:
            self.clear()
        w = self[word] = self.model.weight(word)
        return w

    def segments(self, words: list[bytes]) -> list[tuple[float, int, int]]:
        """All maximal-scoring segments ``(score, first word, end)``, the best first.

        The linear-time algorithm of Ruzzo and Tompa on the running sum; only words that score
        above zero can begin or end a segment, so only they are visited.
        """
        weights = np.fromiter(map(self.__getitem__, words), np.float64, len(words))
        upto = np.concatenate([[0.0], np.cumsum(weights - DRIFT)]).tolist()
        left: list[float] = []
        right: list[float] = []
        spans: list[tuple[int, int]] = []
        for i in np.flatnonzero(weights > DRIFT).tolist():
            low, total = upto[i], upto[i + 1]
            first = i
            while True:
                j = len(left) - 1
                while j >= 0 and left[j] >= low:
                    j -= 1
                if j < 0 or right[j] >= total:
                    break
                low, first = left[j], spans[j][0]
                del left[j:], right[j:], spans[j:]
            left.append(low)
            right.append(total)
            spans.append((first, i + 1))
        return sorted(((r - m, a, b) for m, r, (a, b) in zip(left, right, spans)), reverse=True)

    def evidence(self, words: list[bytes]) -> tuple[float, list[tuple[float, int, int]]]:
        """Minus log of the smallest Poisson tail over the k best segments, and the segments."""
        found = self.segments(words)
        best = 0.0
        for k, (score, _, _) in enumerate(found, 1):
            mean = self.model.k * len(words) * math.exp(-self.model.lam * score)
            if mean > E_VALUE:  # significant passages alone count
                break
            best = max(best, _poisson_tail(k, mean))
        return best, found

    def score(self, text: bytes) -> tuple[float, list[tuple[float, int, int, float]]]:
        """Score between 0 and 1, and the significant passages with their E-values, the best first."""
        words = words_of(text)
        evidence, found = self.evidence(words)
        m = self.model
        passages = [(s, a, b, m.k * len(words) * math.exp(-m.lam * s)) for s, a, b in found]
        return _logistic(m.intercept + m.slope * math.log1p(evidence)), [p for p in passages if p[3] <= E_VALUE]


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _poisson_tail(k: int, mean: float) -> float:
    """-log P(N >= k) for a Poisson N."""
    if mean <= 0:
        return 700.0
    if mean > k:
        return 0.0
    log_term = -mean + k * math.log(mean) - math.lgamma(k + 1)
    rest, term, j = 1.0, 1.0, k
    while term > 1e-12 * rest:
        j += 1
        term *= mean / j
        rest += term
    return max(0.0, min(700.0, -(log_term + math.log(rest))))


def fit_weights(counts: dict[str, tuple[int, int]], texts: int, toxic: int) -> dict[str, float]:
    """Significant log-odds by unit from ``{unit: (texts, toxic texts)}``."""
    if not toxic or toxic == texts:
        return {}
    base = toxic / texts
    rates: dict[str, float] = {"": base}
    out: dict[str, float] = {}
    for unit in sorted(counts, key=lambda u: (len(u.rstrip(" ")), u)):
        n, t = counts[unit]
        word = unit.rstrip(" ")
        longest = len(word) if unit.endswith(" ") else len(word) - 1
        parent = next((word[:p] for p in reversed(PREFIXES) if p <= longest and word[:p] in rates), "")
        prior = PRIOR * rates[parent]
        rate = rates[unit] = (t + prior) / (n + PRIOR)
        odds = math.log(rate / (1 - rate)) - math.log(base / (1 - base))
        error = math.sqrt(1 / (t + prior) + 1 / (n - t + PRIOR - prior))
        if odds >= LEAST and odds / error >= SIGNIFICANT:
            out[unit] = odds
        elif parent in out or (parent and out.get(parent, 0) > 0):
            out[unit] = max(0.0, odds)
    return out


def fit_calibration(weights: dict[str, float], texts: list[tuple[bytes, int]]) -> Model:
    """Extreme-value parameters and the logistic curve from held-back ``(text, label)`` pairs."""
    model = Model(weights)
    scorer = Scorer(model)
    rows = [(words_of(t), y) for t, y in texts]
    clean = [w for w, y in rows if not y and w]
    scores: dict[float, int] = {}
    for words in clean:
        values, counts = np.unique(np.fromiter(map(scorer.__getitem__, words), np.float64, len(words)) - DRIFT, return_counts=True)
        for v, c in zip(values.tolist(), counts.tolist()):
            scores[v] = scores.get(v, 0) + c
    total = sum(scores.values())
    if total and max(scores) > 0 and sum(v * c for v, c in scores.items()) < 0:
        low, high = 1e-6, 50.0
        for _ in range(80):
            mid = (low + high) / 2
            value = sum(c * math.exp(min(700.0, mid * v)) for v, c in scores.items()) / total
            low, high = (mid, high) if value < 1 else (low, mid)
        model.lam = low
        best = [(len(w), (scorer.segments(w) or [(0.0, 0, 0)])[0][0]) for w in clean]
        # maximum likelihood of K in a Gumbel law of known lambda
        model.k = len(best) / sum(n * math.exp(-model.lam * s) for n, s in best)
    x = np.array([math.log1p(scorer.evidence(w)[0]) for w, _ in rows] or [0.0])
    y = np.array([1.0 * (label > 0) for _, label in rows] or [0.0])
    model.intercept, model.slope = _fit_logistic(x, y)
    return model


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Damped Newton steps, with a weak prior that keeps separable data finite; the slope is 0 at least."""
    design, theta = np.stack([np.ones_like(x), x]), np.array([-2.0, 1.0])

    def loss(t):
        z = t @ design
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + 0.005 * (t @ t))

    now = loss(theta)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(theta @ design, -30, 30)))
        gradient = design @ (p - y) + 0.01 * theta
        step = np.linalg.solve((design * (p * (1 - p))) @ design.T + 0.01 * np.eye(2), gradient)
        rate = 1.0
        while (new := loss(theta - rate * step)) > now and rate > 1e-6:
            rate /= 2
        if now - new < 1e-9:
            break
        theta, now = theta - rate * step, new
    return float(theta[0]), max(0.0, float(theta[1]))


def learn(labelled: DataFrame, label_col: str = "toxic", text_col: str = "text", rows: int = SAMPLE_ROWS, hash_col: str | None = None) -> Model:
    """Fit on about ``rows`` labelled rows: a sample by hash of the text; of equal texts with the same label one counts.

    Copies are those of the same hash of the whole text; the least text stays, should hashes collide.
    ``hash_col`` may hold the texts' ``xxhash64``, so that distinct rows are counted without moving texts.

    Three quarters of the sample give counts, which Spark sums; the held-back quarter's texts
    (``rows / 4`` of them) go to the driver for calibration.  The sample is written to the shared folder once.
    Null texts and labels teach nothing; without any labelled row every score is the lowest.
    """
    known = labelled.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(text_col).alias("text"), (F.col(label_col) > 0).cast("int").alias("y"), (F.col(hash_col) if hash_col else F.xxhash64(text_col)).alias("h")
    )
    n = known.select("h", "y").distinct().count()
    share = min(1.0, rows / max(1, n))
    sample = materialise(known.where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).groupBy("h", "y").agg(F.min("text").alias("text")), "toxic-sample")
    fold = F.pmod(F.shiftright("h", 32), F.lit(4))

    def count(batches) -> Iterator:
        import pyarrow as pa

        for part in slices(batches, 256, 0):
            seen: dict[str, list[int]] = {}
            for text, y in zip(utf8(part.column(0)), part.column(1).to_pylist()):
                for u in {"", *(u for w in set(words_of(text)) for u in units_of(w))}:
                    c = seen.setdefault(u, [0, 0])
                    c[0] += 1
                    c[1] += y
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([c[0] for c in seen.values()]), pa.array([c[1] for c in seen.values()])], names=["unit", "n", "t"])

    units = sample.where(fold != 0).select("text", "y").mapInArrow(count, "unit string, n long, t long").groupBy("unit").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    # a unit that was never in a toxic text cannot get a positive score, nor can longer units that begin with it
    counts = {r["unit"]: (r["n"], r["t"]) for r in units.where("t > 0 or unit = ''").toLocalIterator()}
    texts, toxic = counts.pop("", (0, 0))
    held = [(r["text"].encode(), r["y"]) for r in sample.where(fold == 0).select("text", "y").orderBy("text", "y").toLocalIterator()]
    return fit_calibration(fit_weights(counts, texts, toxic), held)


def score_toxicity(df: DataFrame, model: Model, text_col: str = "text", passages: bool = True, prefix: str = "toxic_") -> DataFrame:
    """All columns of ``df``, then ``<prefix>score`` and, if asked for, ``<prefix>passages``.

    A passage has its words, their places (word numbers), score and E-value; the best come
    first, every one with an E-value up to ``E_VALUE`` is there.  Null, empty and wordless texts
    have no passage and the lowest score.  Repeated rows score alike; an empty table gives no
    rows.  A clash with an input column is an error: choose another ``prefix``.
    """
    new = [prefix + "score", prefix + "passages"][: 1 + passages]
    if set(new) & set(df.columns):
        raise ValueError(f"columns {new} are taken")
    at = df.columns.index(text_col)
    held: list[Scorer] = []
    passage = T.StructType([T.StructField("words", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("e_value", T.DoubleType())])

    def score(batches) -> Iterator:
        import pyarrow as pa

        if not held:
            held.append(Scorer(model))
        kind = pa.list_(pa.struct([("words", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))
        for part in slices(batches, 512, at):
            texts = utf8(part.column(at))
            found = [held[0].score(t) for t in texts]
            columns = [pa.array([s for s, _ in found], pa.float64())]
            if passages:
                rows = []
                for text, (_, segments) in zip(texts, found):
                    words = words_of(text) if segments else []
                    rows.append([{"words": b" ".join(words[a:b]).decode("utf-8", "replace"), "start": a, "end": b, "score": s, "e_value": e} for s, a, b, e in segments])
                columns.append(pa.array(rows, kind))
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *new])

    fields = [T.StructField(new[0], T.DoubleType()), T.StructField(prefix + "passages", T.ArrayType(passage))][: 1 + passages]
    return df.mapInArrow(score, T.StructType([*df.schema.fields, *fields]))

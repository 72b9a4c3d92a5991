"""Toxicity by cumulative-link ordinal regression.

Grades 0 < 1 < ... < K share one weight vector over sparse text features; each
boundary between grades has its own threshold, and
``P(grade >= k) = logistic(x . w - threshold_k)`` with rising thresholds. The
severity put out is the expected grade.

Features are the words of a text and the beginnings of words, and one for its
length: what stands out in a short text can be chance in a long one. The labels
say only toxic or not. The training texts are halved, and the grade of a toxic
one is how much it uses words that tell toxic texts from others in the other
half, in equal shares; so no text's grade is made of what it teaches itself.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, id_crc, map_texts
from .sampling import sample_labelled

GRADES = 3
PREFIXES = (4, 5, 6, 7)
#: Labelled documents read on the driver, of each label.
PER_LABEL = 3000
#: Features that are kept, and documents in which one must occur.
MAX_FEATURES, MIN_DOCS = 6000, 3
#: Share of flagged training texts that must be toxic, as the labels are mixed.
PRECISION = 0.98
#: The feature that counts all words; no word has its name.
LENGTH = " length"
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def tokens(text: str) -> list[str]:
    """Words of a text in lower case, without signs at their edges."""
    return [w for w in (w.strip(_EDGES) for w in text.lower().split()) if w]


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class OrdinalModel:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=lambda: [8.0] * GRADES)
    flag: float = 0.5
    by_word: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def present(self, words: list[str]) -> Counter:
        """Kept features and how many of the words have them."""
        out: Counter = Counter()
        known, weights = self.by_word, self.weights
        for word, n in Counter(words).items():
            own = known.get(word)
            if own is None:
                own = tuple(f for f in word_features(word) if f in weights)
                if len(known) < 200_000:
                    known[word] = own
            for f in own:
                out[f] += n
            out[LENGTH] += n
        return out

    def at_least(self, text: str) -> np.ndarray:
        """P(grade >= k) for k = 1 to K, of the whole text."""
        x = sum(self.weights.get(f, 0.0) * math.log1p(n) for f, n in self.present(tokens(text)).items())
        return _sigmoid(x - np.array(self.thresholds))


def _unlike(samples: list[tuple[bool, list[str]]]) -> list[tuple[bool, list[str]]]:
    """Samples without those that resemble an earlier one of their label.

    Words that only copies share would pass for signs of their label.
    """
    seen: set[tuple] = set()
    kept = []
    for toxic, words in samples:
        runs = [" ".join(words[i : i + 3]).encode() for i in range(max(1, len(words) - 2))]
        marks = {(toxic, salt, min(zlib.crc32(r, salt) for r in runs)) for salt in (1, 77, 4242, 99991)}
        if not marks & seen:
            kept.append((toxic, words))
        seen |= marks
    return kept


def _select(texts: list[tuple[bool, list[str]]]) -> list[str]:
    """Features of toxic training texts that chance would not put there."""
    counts = {True: Counter(), False: Counter()}
    for toxic, words in texts:
        counts[toxic].update({f for w in set(words) for f in word_features(w)})
    n1, n0 = sum(t for t, _ in texts), sum(not t for t, _ in texts)
    often = {f: c for f, c in counts[True].items() if c + counts[False][f] >= MIN_DOCS}
    base = n1 / (n1 + n0)
    bar = math.log(max(2, len(often)))  # no feature is expected to pass by chance
    scored = []
    for f, c1 in often.items():
        c = c1 + counts[False][f]
        share = c1 / c
        if share <= base:
            continue
        gain = c1 * math.log(share / base) + ((c - c1) * math.log((1 - share) / (1 - base)) if c > c1 else 0.0)
        if gain > bar:
            scored.append((-gain, f))
    return [f for _, f in sorted(scored)[:MAX_FEATURES]]


def _grades(split: list[tuple[bool, list[str]]], grades: int) -> np.ndarray:
    """0 for texts that aren't toxic; 1 to ``grades`` by their use of the other half's toxic words."""
    toxic = np.array([t for t, _ in split])
    half = np.cumsum(toxic) % 2  # so that both halves have toxic texts, if there are two
    amount = np.zeros(len(split))
    for own in (0, 1):
        other = [x for x, h in zip(split, half) if h != own]
        if any(t for t, _ in other) and not all(t for t, _ in other):
            judge = OrdinalModel({f: 1.0 for f in _select(other)})
            for i in np.flatnonzero((half == own) & toxic):
                amount[i] = sum(math.log1p(c) for f, c in judge.present(split[i][1]).items() if f != LENGTH)
    bars = np.quantile(amount[toxic], np.linspace(0, 1, grades + 1)[1:-1])
    return np.where(toxic, 1 + np.searchsorted(bars, amount, "right"), 0)


def fit_ordinal(samples: list[tuple[bool, str]], grades: int = GRADES, steps: int = 600, seed: int = 10) -> OrdinalModel:
    """Weights and thresholds by Adam on the cumulative-link likelihood.

    With texts of one sort only there is nothing to tell: no feature has a
    weight, and all texts have the same, low, severity.
    """
    split = _unlike([(toxic, tokens(text)) for toxic, text in samples])
    if not any(t for t, _ in split) or all(t for t, _ in split):
        return OrdinalModel(thresholds=[8.0] * grades)
    y = _grades(split, grades)
    kept = [LENGTH, *_select(split)]
    model = OrdinalModel({f: 1.0 for f in kept})
    place = {f: i for i, f in enumerate(kept)}
    sparse = [model.present(words) for _, words in split]
    rows = np.concatenate([np.full(len(x), i) for i, x in enumerate(sparse)] or [np.zeros(0)]).astype(int)
    cols = np.array([place[f] for x in sparse for f in x], dtype=int)
    vals = np.array([math.log1p(c) for x in sparse for c in x.values()])
    w = np.zeros(len(kept))
    first, gaps = 2.0, np.full(grades - 1, 1.0)  # thresholds: first, then rising by exp(gap)
    reached = (y[:, None] >= np.arange(1, grades + 1)[None, :]).astype(float)
    params = np.concatenate([w, [first], gaps])
    m = v = np.zeros_like(params)
    for t in range(1, steps + 1):
        w, first, gaps = params[: len(kept)], params[len(kept)], params[len(kept) + 1 :]
        cuts = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        x = np.bincount(rows, vals * w[cols], minlength=len(y)) if len(cols) else np.zeros(len(y))
        p = _sigmoid(x[:, None] - cuts[None, :])
        # P(y = k) = p_k - p_{k+1}; its derivative by x and by the cuts.
        full = np.concatenate([np.ones((len(y), 1)), p, np.zeros((len(y), 1))], 1)
        slope = full * (1 - full)
        like = np.maximum(full[np.arange(len(y)), y] - full[np.arange(len(y)), y + 1], 1e-9)
        gx = (slope[np.arange(len(y)), y] - slope[np.arange(len(y)), y + 1]) / like
        gc = np.zeros_like(p)
        low = y > 0
        gc[np.flatnonzero(low), y[low] - 1] -= (slope[np.arange(len(y)), y] / like)[low]
        high = y < grades
        gc[np.flatnonzero(high), y[high]] += (slope[np.arange(len(y)), y + 1] / like)[high]
        gw = (np.bincount(cols, vals * gx[rows], minlength=len(kept)) if len(cols) else np.zeros(len(kept))) / len(y) - 2e-5 * w
        gcut = gc.sum(0) / len(y)
        ggap = np.array([gcut[k:].sum() * math.exp(gaps[k - 1]) for k in range(1, grades)])
        g = np.concatenate([gw, [gcut.sum()], ggap])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params + 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    w, first, gaps = params[: len(kept)], params[len(kept)], params[len(kept) + 1 :]
    cuts = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
    return OrdinalModel({f: float(a) for f, a in zip(kept, w, strict=True) if abs(a) > 1e-4}, [float(c) for c in cuts])


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, seed: int = 10) -> OrdinalModel:
    """Fit on at most ``per_label`` whole documents of each label; null labels are none.

    Documents whose crc32(doc_id) mod 5 is 0 teach nothing; those where it is 1
    set the flag's bar, the others the weights. Labels of one value only leave
    a model without weights.
    """
    rest = id_crc(F.col("doc_id")) % 5
    labelled = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("string").alias("label")).filter(F.col("label").isin("0", "1") & (rest != 0))
    sample = sample_labelled(documents(docs), labelled, per_label, 2 * per_label, seed)
    bars = {i for i, _, _ in sample if zlib.crc32(str(i).encode()) % 5 == 1}
    teach = [(label == "1", text) for i, label, text in sample if i not in bars]
    model = fit_ordinal(teach)
    # The sample has the labels in other shares than the table.
    n = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    drawn = Counter(label for _, label, _ in sample)
    taught = Counter(toxic for toxic, _ in teach)
    if len(taught) == 2 and len(drawn) == 2:
        shift = math.log(n["0"] / n["1"]) - math.log(taught[False] / taught[True])
        model.thresholds = [t + shift for t in model.thresholds]
        judged = [(label == "1", model.at_least(text)[0]) for i, label, text in sample if i in bars]
        toxic, p = np.array([t for t, _ in judged], bool), np.array([q for _, q in judged])
        weight = np.where(toxic, n["1"] / drawn["1"], n["0"] / drawn["0"])
        right = lambda t: (weight * toxic)[p >= t].sum() / weight[p >= t].sum()
        model.flag = next((float(t) for t in np.unique(p[toxic]) if right(t) >= PRECISION), 0.5)
    return model


def score_toxicity(docs: DataFrame, model: OrdinalModel, flag: float | None = None) -> DataFrame:
    """Per row: doc_id, held_out, severity, grade, p_toxic, toxic.

    ``severity`` is the expected grade, 0 to K; ``grade`` the likeliest;
    ``toxic`` says P(grade >= 1) reaches ``flag``, by default the lowest bar
    that keeps the precision on texts kept for it. ``held_out`` says that
    crc32(doc_id) mod 5 is 0. Of equally likely grades the lowest is taken.
    Null and empty texts have no features. Whole texts are read; rows that repeat are scored each; an
    empty table gives an empty one.
    """

    bar = model.flag if flag is None else flag

    def score(texts: list[str | None]) -> dict[str, list]:
        p = [model.at_least(t or "") for t in texts]
        likeliest = [int(np.argmax(-np.diff(np.concatenate([[1.0], q, [0.0]])))) for q in p]
        return {"severity": [float(q.sum()) for q in p], "grade": likeliest, "p_toxic": [float(q[0]) for q in p], "toxic": [bool(q[0] >= bar) for q in p]}

    rows = documents(docs).select("doc_id", (id_crc(F.col("doc_id")) % 5 == 0).alias("held_out"), "text")
    return map_texts(rows, score, "severity double, grade int, p_toxic double, toxic boolean")

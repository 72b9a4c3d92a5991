"""Language identification by a byte convolutional network.

Filters of several widths slide over the bytes of fixed-length windows; each
filter keeps its largest response in a window, and a softmax over these names
the language. The network is trained here in numpy. Inputs are one-hot bytes,
so a filter is a table of 256 rows for each of its places; for prediction two
neighbouring tables are added up beforehand for all 65,536 byte pairs and
rounded to 8 bits, and a response is one or two look-ups.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, id_crc, map_texts
from .sampling import sample_labelled

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Windows that are looked at together.
BATCH = 256
#: Labelled documents read on the driver, whole: of one language, and in all.
PER_LANGUAGE, SAMPLE_LIMIT = 400, 12_000
EPOCHS = 4
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def windows(raw: bytes) -> np.ndarray:
    """All of a text's bytes in rows of ``WINDOW``, the last filled up with 0."""
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, WINDOW)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class ByteCNN:
    languages: list[str]
    tables: dict[int, np.ndarray] = field(default_factory=dict)  # width -> (width, 256, FILTERS)
    bias: np.ndarray | None = None
    weights: np.ndarray | None = None
    offsets: np.ndarray | None = None

    def start(self, rng: np.random.Generator) -> None:
        self.tables = {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        n = FILTERS * len(WIDTHS)
        self.bias = np.zeros(n, np.float32)
        self.weights = rng.normal(0, 0.2, (n, len(self.languages))).astype(np.float32)
        self.offsets = np.zeros(len(self.languages), np.float32)

    def _responses(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest responses (rows, filters) and where they are."""
        best, where = [], []
        for w in WIDTHS:
            r = sum(self.tables[w][k][x[:, k : WINDOW - w + 1 + k]] for k in range(w))
            at = r.argmax(1)
            best.append(np.take_along_axis(r, at[:, None, :], 1)[:, 0])
            where.append(at)
        return np.concatenate(best, 1), np.concatenate(where, 1)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 4, rate: float = 0.02) -> None:
        """Adam on the cross-entropy; the pool passes a gradient only to its winner."""
        rng = np.random.default_rng(seed)
        self.start(rng)
        state: dict = {}
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 64):
                pick = order[at : at + 64]
                xb, yb = x[pick], y[pick]
                pooled, where = self._responses(xb)
                h = np.maximum(pooled + self.bias, 0)
                p = _softmax(h @ self.weights + self.offsets)
                p[np.arange(len(yb)), yb] -= 1
                p /= len(yb)
                dh = (p @ self.weights.T) * (h > 0)
                grads = {("weights",): h.T @ p, ("offsets",): p.sum(0), ("bias",): dh.sum(0)}
                f = np.arange(FILTERS)[None, :]
                for i, w in enumerate(WIDTHS):
                    part, at_w = dh[:, i * FILTERS : (i + 1) * FILTERS], where[:, i * FILTERS : (i + 1) * FILTERS]
                    g = np.zeros_like(self.tables[w])
                    for k in range(w):
                        np.add.at(g[k], (np.take_along_axis(xb, at_w + k, 1), f), part)
                    grads["tables", w] = g
                t += 1
                for key, g in grads.items():
                    m, v = state.get(key, (0.0, 0.0))
                    m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                    state[key] = m, v
                    step = (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
                    if key[0] == "tables":
                        self.tables[key[1]] -= step
                    else:
                        setattr(self, key[0], getattr(self, key[0]) - step)

    def packed(self) -> PackedCNN:
        return PackedCNN(self)


class PackedCNN:
    """The network with 8-bit byte-pair tables, for prediction only."""

    def __init__(self, net: ByteCNN) -> None:
        self.languages, self.bias, self.weights, self.offsets = net.languages, net.bias, net.weights, net.offsets
        self.parts, self.scale = {}, {}
        for w, t in net.tables.items():
            pairs = [(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, w - 1, 2)]
            single = [t[w - 1]] if w % 2 else []
            reach = sum(np.abs(p).max() for p in [*pairs, *single])
            self.scale[w] = np.float32(reach / 126.0)
            # Sixteen 8-bit responses lie in one 16-byte number, taken at once.
            self.parts[w] = [np.round(p / self.scale[w]).astype(np.int8).view(np.complex128).ravel() for p in [*pairs, *single]]

    def pooled(self, x: np.ndarray) -> np.ndarray:
        pair = (x[:, :-1].astype(np.uint16) << 8) | x[:, 1:]
        out = []
        for w, parts in self.parts.items():
            n = WINDOW - w + 1
            r = None
            for i, table in enumerate(parts):
                at = x[:, 2 * i :] if len(table) == 256 else pair[:, 2 * i :]
                got = table.take(at[:, :n]).view(np.int8).reshape(len(x), n, FILTERS)
                r = got if r is None else np.add(r, got, out=r)
            while r.shape[1] > 1:
                half = r.shape[1] // 2
                top = np.maximum(r[:, :half], r[:, half : 2 * half])
                if r.shape[1] % 2:
                    np.maximum(top[:, :1], r[:, -1:], out=top[:, :1])
                r = top
            out.append(r[:, 0].astype(np.float32) * self.scale[w])
        return np.concatenate(out, 1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each language, for each window."""
        z = [np.maximum(self.pooled(x[at : at + BATCH]) + self.bias, 0) @ self.weights + self.offsets for at in range(0, len(x), BATCH)]
        return _softmax(np.concatenate(z))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its mean probability over a text's bytes, for each text.

        Texts are taken together until they fill a batch of windows, so the
        memory needed is that of the batch and of the longest text. Of equally
        likely languages the first by name is taken.
        """
        out: list[tuple[str, float] | None] = [None] * len(texts)
        held: list[tuple[int, np.ndarray, int]] = []

        def flush() -> None:
            p = self.probabilities(np.concatenate([x for _, x, _ in held]))
            at = 0
            for i, x, n_bytes in held:
                weight = np.full(len(x), float(WINDOW))
                weight[-1] = n_bytes - WINDOW * (len(x) - 1)
                mean = weight @ p[at : at + len(x)] / weight.sum()
                at += len(x)
                k = int(mean.argmax())
                out[i] = self.languages[k], float(min(1.0, mean[k]))
            held.clear()

        full = 0
        for i, text in enumerate(texts):
            if not text or not self.languages or not has_letter(text):
                out[i] = UNKNOWN, 0.0
                continue
            raw = text.encode()
            held.append((i, windows(raw), len(raw)))
            full += len(held[-1][1])
            if full >= BATCH:
                flush()
                full = 0
        if held:
            flush()
        return out


def fit_languages(docs: DataFrame, seed: int = 4, per_language: int = PER_LANGUAGE, limit: int = SAMPLE_LIMIT) -> PackedCNN:
    """Train on all windows of a bounded sample of documents with a language.

    Only documents whose crc32(doc_id) mod 3 is not 1 teach, and of them only
    text and lang are read. Without any, every text is ``und``.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("label")).filter(id_crc(F.col("doc_id")) % 3 != 1)
    sample = sample_labelled(documents(docs).filter(id_crc(F.col("doc_id")) % 3 != 1), rows, per_language, limit, seed)
    languages = sorted({lang for _, lang, _ in sample})
    net = ByteCNN(languages)
    x, y = [], []
    for _, lang, text in sample:
        if has_letter(text):
            x.append(windows(text.encode()))
            y += [languages.index(lang)] * len(x[-1])
    if not x:
        net.languages = []
        net.start(np.random.default_rng(seed))
    else:
        net.fit(np.concatenate(x), np.array(y))
    return net.packed()


def identify_language(docs: DataFrame, model: PackedCNN) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (0 to 1).

    ``und`` with score 0 where the text is null or has no letter. Whole texts
    are read, in windows. Rows that repeat are predicted each; lang, source
    and doc_id play no part; an empty table gives an empty one.
    """

    def predicted(texts: list[str | None]) -> dict[str, list]:
        found = model.predict(texts)
        return {"lang_pred": [x for x, _ in found], "score": [s for _, s in found]}

    rows = documents(docs).select("doc_id", (id_crc(F.col("doc_id")) % 3 == 1).alias("held_out"), "text")
    return map_texts(rows, predicted, "lang_pred string, score double")

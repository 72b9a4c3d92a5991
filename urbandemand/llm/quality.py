"""Quality classifier by compression against labelled dictionaries.

Two zstandard dictionaries are built, one from good and one from bad labelled
text. A text is compressed in short blocks with each; the difference of the two
sizes, divided by the text's own size, says which of them it resembles. A rising
curve, fitted on other labelled rows, turns it into a probability; how much the
text says against the labels' base rate grows with its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, id_crc, map_texts
from .sampling import sample_labelled

DICTIONARY_BYTES = 32 << 10
LEVEL = 3
BLOCK_BYTES = 512
#: Size of a text that counts as much as the labels' base rate.
PRIOR_BYTES = 48
THRESHOLD = 0.3
#: Labelled documents read on the driver: for each dictionary, and for the curve.
PER_DICTIONARY, FOR_CURVE = 600, 3000


def _dictionary(texts: list[str]) -> bytes:
    samples = [t.encode() for t in texts if t]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to select from: the text itself serves
        return b"\n".join(samples)[:DICTIONARY_BYTES]


@dataclass
class CompressionClassifier:
    """Fitted dictionaries, the curve's points and the base rate."""

    good: bytes
    bad: bytes
    at: tuple[float, ...] = (-0.05, 0.05)
    rate: tuple[float, ...] = (0.05, 0.95)
    base: float = 0.5

    def __post_init__(self) -> None:
        self._made = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, _made=None)

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        if self._made is None:
            self._made = []
            for raw in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(raw)
                d.precompute_compress(level=LEVEL)
                self._made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return self._made

    def difference(self, text: str) -> float:
        """Compressed size with the bad less that with the good dictionary, by the text's size."""
        raw = text.encode()
        good, bad = self._compressors()
        more = 0
        for at in range(0, len(raw), BLOCK_BYTES):
            block = raw[at : at + BLOCK_BYTES]
            more += len(bad.compress(block)) - len(good.compress(block))
        return more / max(1, len(raw))

    def score(self, text: str | None) -> float:
        text = text or ""
        size = len(text.encode())
        rate = float(np.interp(self.difference(text), self.at, self.rate))
        return min(1.0, (size * rate + PRIOR_BYTES * self.base) / (size + PRIOR_BYTES))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """The rising step function nearest to y, by pooling neighbours that fall, through its steps' middles.

    Each step counts one more row of the base rate, so that none is quite sure.
    """
    order = np.argsort(x, kind="stable")
    steps: list[list[float]] = []  # rows, sum of y, sum of x
    at = 0
    while at < len(order):  # equal differences belong to one step
        same = order[at : at + np.searchsorted(x[order[at:]], x[order[at]], "right")]
        steps.append([len(same), y[same].sum(), x[same].sum()])
        at += len(same)
        while len(steps) > 1 and steps[-2][1] / steps[-2][0] >= steps[-1][1] / steps[-1][0]:
            last = steps.pop()
            steps[-1] = [a + b for a, b in zip(steps[-1], last)]
    base = y.mean()
    rate = np.maximum.accumulate([(good + base) / (n + 1) for n, good, _ in steps])
    return tuple(total / n for n, _, total in steps), tuple(float(r) for r in rate)


def fit_quality(docs: DataFrame, labels: DataFrame, seed: int = 6, per_dictionary: int = PER_DICTIONARY, for_curve: int = FOR_CURVE) -> CompressionClassifier:
    """Fit on at most 2 * per_dictionary + for_curve labelled documents, read whole.

    Only labels of documents whose crc32(doc_id) mod 5 is not 0 are read: 1
    and 2 make the dictionaries, 3 and 4 the curve. A null label is none. With
    a class missing every text scores by the difference alone.
    """
    rest = id_crc(F.col("doc_id")) % 5
    labelled = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("string").alias("label"), rest.alias("rest")).filter(F.col("label").isin("0", "1"))
    docs = documents(docs)
    for_dict = sample_labelled(docs, labelled.filter("rest in (1, 2)"), per_dictionary, 2 * per_dictionary, seed)
    good = [t for _, q, t in for_dict if q == "1"]
    bad = [t for _, q, t in for_dict if q == "0"]
    model = CompressionClassifier(_dictionary(good), _dictionary(bad))
    # The curve needs the classes as they are mixed in the labels: all are one class to the sample.
    drawn = labelled.filter("rest in (3, 4)").select("doc_id", F.lit("any").alias("label"), F.col("label").alias("quality"))
    curve = sample_labelled(docs, drawn, for_curve, for_curve, seed)
    ids = docs.sparkSession.createDataFrame([(i,) for i, _, _ in curve], "doc_id long")
    quality = {r["doc_id"]: float(r["quality"]) for r in drawn.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("quality").alias("quality")).collect()}
    if len(set(quality.values())) == 2:
        y = np.array([quality[i] for i, _, _ in curve])
        model.base = float(y.mean())
        model.at, model.rate = _curve(np.array([model.difference(t) for _, _, t in curve]), y)
    return model


def score_quality(docs: DataFrame, model: CompressionClassifier, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (1 from ``threshold``).

    Null and empty texts score the labels' base rate; whole texts are compressed, however long. Rows that repeat are scored
    each. Other columns are not read; an empty table gives an empty one.
    """
    rows = documents(docs).select("doc_id", (id_crc(F.col("doc_id")) % 5 == 0).alias("held_out"), "text")
    out = map_texts(rows, lambda texts: {"score": [model.score(t) for t in texts]}, "score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_rejected(docs: DataFrame, model: CompressionClassifier, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``."""
    place = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                yield b.filter(pa.array([model.score(t) >= threshold for t in b.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)

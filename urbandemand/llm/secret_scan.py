"""Secret scans: fixed formats, and a battery of randomness tests.

Three base formats are found by pattern. Every other token of 20 or more
characters of the secret alphabet, with "=" as trailing padding only, is put to
a battery of tests for the encoding that its characters suggest:

- chi-squared uniformity, over classes of signs whose shares are known (cases,
  digits, vowels, common consonants), as a short token has less than one draw a
  sign, and over pairs of equal signs;
- a runs test of these classes;
- serial correlation of neighbours, and equal signs at every lag up to ``LAGS``;
- likeness to words: how much oftener a token's pairs of neighbours stand in the
  documents than by chance, against the mean and variance of that in random
  tokens. The pairs of letters of all documents are counted for this.

Fisher's method joins them. A secret passes as random; words do not. How
random a token must be is settled for each length from the corpus: all letters
of every document outside of what is itself under test (long tokens and base
spans), strung together to tokens of that length back to back, give
the share of ordinary text that looks as random, and the bar is put where the expected
share of such tokens among those reported stays below ``rate``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import Remembered, documents, dropped, map_texts, scratch, stored
from .spans import Span, apart, digest, joined

# The base formats.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
KINDS = {"assign": 0, "access": 1, "hex": 2, "random": 3}

#: A token with its padding; an "=" before more of the alphabet ends it and may begin another.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_=-]{20})[A-Za-z0-9+/_-]+(?:=+(?![A-Za-z0-9+/_=-]))?")
#: Shortest token of each length class, and classes of the joint p-value: -2 log2 p.
LENGTHS = (20, 24, 32, 40, 64, 128)
LEVELS = 64
#: Expected share of ordinary text among the added spans.
RATE = 0.05
#: Letters of reference tokens that are put to the battery at once.
CHUNK = 1 << 17
#: Lags at which equal signs are counted, up to half a token.
LAGS = 32
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_VOWELS, _COMMON = "aeiouAEIOU", "tnshrdlTNSHRDL"


@dataclass(frozen=True)
class Encoding:
    """An alphabet, its size, and the classes of its signs by name.

    ``kinds`` are the classes of the chi-squared test, ``turns`` of the runs test.
    """

    signs: str
    size: int
    kinds: Callable[[str], str]
    turns: Callable[[str], str]

    def table(self, of: Callable[[str], str]) -> tuple[np.ndarray, np.ndarray]:
        """By byte: number of its class; and each class's share of the alphabet."""
        names = sorted({of(c) for c in self.signs})
        number = np.zeros(256, np.uint8)
        share = np.zeros(len(names))
        for c in self.signs:
            number[ord(c)] = names.index(of(c))
            share[names.index(of(c))] += 1
        return number, share / share.sum()


def _letter(c: str) -> str:
    return "vowel" if c in _VOWELS else "common" if c in _COMMON else "rare" if c.isalpha() else "digit"


def _written(c: str) -> str:
    return ("upper" if c.isupper() else "common" if c in _VOWELS + _COMMON else "rare") if c.isalpha() else "digit"


def _case(c: str) -> str:
    return ("upper" if c.isupper() else "lower") if c.isalpha() else "digit"


def _vowel(c: str) -> str:
    return "digit" if not c.isalpha() else "vowel" if c in _VOWELS else "other"


#: Encodings from the narrowest; a token is taken to be of the first that holds it.
ENCODINGS = (
    Encoding(_DIGITS, 10, lambda c: str(int(c) // 2), lambda c: "high" if c >= "5" else "low"),
    Encoding(_DIGITS + "abcdef", 16, lambda c: str(int(c, 16) // 4), lambda c: "letter" if c.isalpha() else "digit"),
    Encoding(_DIGITS + "ABCDEF", 16, lambda c: str(int(c, 16) // 4), lambda c: "letter" if c.isalpha() else "digit"),
    Encoding(_LOWER, 26, _letter, _vowel),
    Encoding(_UPPER, 26, _letter, _vowel),
    Encoding(_UPPER + "234567", 32, _letter, _vowel),
    Encoding(_DIGITS + _LOWER, 36, _letter, _vowel),
    Encoding(_DIGITS + _UPPER, 36, _letter, _vowel),
    Encoding(_LOWER + _UPPER, 52, _written, _case),
    Encoding(_LOWER + _UPPER + _DIGITS + "+/-_", 64, _written, _case),
)
_IN = np.array([sum((chr(c) in e.signs) << k for k, e in enumerate(ENCODINGS)) for c in range(256)], dtype=np.uint16)
_PLACE = [np.array([max(0, e.signs.find(chr(c))) for c in range(256)], dtype=np.uint8) for e in ENCODINGS]
_KIND = [e.table(e.kinds) for e in ENCODINGS]
_TURN = [e.table(e.turns)[0] for e in ENCODINGS]
_LEAST_LOG = math.log(1e-300)

#: Log P(|N(0,1)| >= z) by z * STEPS.
STEPS = 256
_NORMAL = np.log(np.maximum([math.erfc(z / STEPS / math.sqrt(2)) for z in range(37 * STEPS)], 1e-300))


def _two_sided(z: np.ndarray) -> np.ndarray:
    return _NORMAL[np.minimum(np.abs(z) * STEPS, len(_NORMAL) - 1).astype(np.int64)]


def _chi_log(x: np.ndarray, free: int) -> np.ndarray:
    """Log of the chi-squared tail with 1 to 4 degrees of freedom."""
    half = np.minimum(x / 2, 650.0)
    if free == 1:
        return _two_sided(np.sqrt(x))
    if free == 2:
        return -half
    if free == 3:
        return np.log(np.exp(_two_sided(np.sqrt(x))) + np.sqrt(4 * half / math.pi) * np.exp(-half))
    return -half + np.log1p(half)


@Remembered
def _poisson_logs(mean: float) -> np.ndarray:
    """Log P(N >= k) for k from 0 far into the tail of a Poisson distribution."""
    last = int(mean + 40 * math.sqrt(mean) + 40)
    each = np.array([k * math.log(mean) - mean - math.lgamma(k + 1) for k in range(last + 1)])
    return np.maximum(np.logaddexp.accumulate(each[::-1])[::-1], _LEAST_LOG)


def _at_least(k: np.ndarray, mean: float) -> np.ndarray:
    """Log P(N >= k); of large means by the normal distribution, which needs no table."""
    if mean > 1000:
        return np.where(k > mean, _two_sided((k - mean) / math.sqrt(mean)) - math.log(2), 0.0)
    logs = _poisson_logs(mean)
    return np.minimum(0.0, logs[np.minimum(k, len(logs) - 1)])


def _either(*logs: np.ndarray) -> np.ndarray:
    """Log p of the least of several tests, for their number."""
    return np.minimum(0.0, np.minimum.reduce(logs) + math.log(len(logs)))


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of true values down the columns."""
    return x.view(np.uint8).sum(axis=0, dtype=np.int64 if len(x) > 65_000 else np.uint16).astype(np.int64)


@dataclass
class Pairs:
    """How much likelier than by chance pairs of neighbours are in text, and the mean and variance of a token's sum by encoding."""

    log_ratio: np.ndarray  # by sign class
    mean: list[float]
    var: list[float]
    beside: list[float]  # covariance of pairs that share a sign

    @classmethod
    def of(cls, counts: np.ndarray) -> Pairs:
        """From the counts of pairs of sign classes: 26 letters, and all else."""
        ratio = np.log((counts + 0.5) / (counts.sum() + 0.5 * counts.size) * counts.size)
        mean, var, beside = [], [], []
        for e in ENCODINGS:
            of = np.array([_SIGN[ord(c)] for c in e.signs])
            own = ratio[np.ix_(of, of)]
            mean.append(float(own.mean()))
            var.append(float(own.var()))
            beside.append(float((own.mean(axis=0) * own.mean(axis=1)).mean() - own.mean() ** 2))
        return cls(ratio, mean, var, beside)

    def log_p(self, tokens: np.ndarray, k: int) -> np.ndarray | None:
        """Log p of being as word-like as the columns are; None for an encoding without letters."""
        n = len(tokens)
        var = (n - 1) * self.var[k] + 2 * (n - 2) * self.beside[k]
        if var <= 1e-9:
            return None
        of = _SIGN[tokens]
        z = (self.log_ratio[of[:-1], of[1:]].sum(axis=0) - (n - 1) * self.mean[k]) / math.sqrt(var)
        half = _two_sided(z) - math.log(2)
        return np.where(z > 0, half, np.log1p(-np.exp(half)))


_SIGN = np.array([chr(c).lower() in _LOWER and _LOWER.index(chr(c).lower()) if c < 128 and chr(c).isalpha() else 26 for c in range(256)], dtype=np.int64)


def pair_counts(texts: list[str]) -> np.ndarray:
    """Counts of neighbouring sign classes in the texts, of pairs with a letter."""
    out = np.zeros(27 * 27, np.int64)
    for t in texts:
        of = _SIGN[np.frombuffer(t.encode("ascii", "replace"), np.uint8)]
        out += np.bincount(of[:-1] * 27 + of[1:], minlength=27 * 27)
    out[-1] = 0
    return out.reshape(27, 27)


def fit_pairs(docs: DataFrame) -> Pairs:
    """``Pairs`` over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((27, 27), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                total += pair_counts([t or "" for t in b.column(0).slice(at, 256).to_pylist()])
        yield pa.RecordBatch.from_pydict({"pair": np.arange(total.size), "n": total.ravel()})

    rows = documents(docs).select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # 729 rows
    counts = np.zeros(27 * 27)
    for r in rows:
        counts[r["pair"]] = r["n"]
    return Pairs.of(counts.reshape(27, 27))


def _battery_logs(tokens: np.ndarray, k: int, pairs_of: Pairs | None = None) -> np.ndarray:
    """Log of the joint p of tokens of encoding ``k``, the columns of a byte matrix."""
    n, m = tokens.shape
    size = ENCODINGS[k].size
    kinds, shares = _KIND[k]
    kind = kinds[tokens]
    chi = sum((_sums(kind == c) - n * share) ** 2 / (n * share) for c, share in enumerate(shares))
    x = _PLACE[k][tokens]
    wide = len(ENCODINGS[k].signs)
    counts = np.bincount((x + np.arange(m, dtype=np.int64) * wide).ravel(), minlength=m * wide).reshape(m, wide)
    pairs = np.einsum("ij,ij->i", counts, counts) - n >> 1
    uneven = _either(_chi_log(chi, len(shares) - 1), _at_least(pairs, n * (n - 1) / 2 / size))
    # Changes of class, against their mean and variance when the signs are put in any order.
    turn = _TURN[k][tokens]
    of = np.stack([_sums(turn == c) for c in range(int(_TURN[k].max()) + 1)]).astype(float)
    square, cube = (of**2).sum(axis=0), (of**3).sum(axis=0)
    mean = (n * n - square) / n
    var = (square * (square + n * (n + 1.0)) - 2.0 * n * cube - float(n) ** 3) / (float(n) * n * (n - 1))
    changes = _sums(turn[1:] != turn[:-1])
    several = mean > 1e-9
    z = np.divide(np.maximum(np.abs(changes - mean) - 0.5, 0.0), np.sqrt(np.maximum(var, 1e-9)), out=np.zeros(m), where=several)
    runs = np.where(several, _two_sided(z), 0.0)  # one class only: the chi-squared test has said so
    f = x.astype(np.float32 if n <= 4096 else np.float64)  # whole numbers below 2 ** 24, so sums are exact
    total, both, serial = (v.astype(np.float64) for v in (f.sum(axis=0), (f * f).sum(axis=0), (f[1:] * f[:-1]).sum(axis=0)))
    spread = n * both - total * total
    cov = n * serial - total * (2 * total - f[0] - f[-1]) + (n - 1) / n * total * total
    z = np.divide(cov, spread, out=np.full(m, math.inf), where=spread > 0) * math.sqrt(n)
    lags = range(1, min(LAGS, n // 2) + 1)
    again = [_at_least(_sums(x[lag:] == x[:-lag]), (n - lag) / size) for lag in lags]
    beside = _either(_two_sided(z), _either(*again))
    words = pairs_of.log_p(tokens, k) if pairs_of else None
    logs = np.maximum(uneven + runs + beside + (0 if words is None else words), -690.0)
    # Fisher: chi-squared with twice as many degrees of freedom as tests.
    return logs + np.log(1 - logs + logs * logs / 2 - (0 if words is None else logs**3 / 6))


def joint_logs(tokens: np.ndarray, pairs: Pairs | None = None) -> np.ndarray:
    """Log p of "uniformly random in its encoding" of the tokens in the rows of a byte matrix; without ``pairs`` by three tests."""
    fits = np.bitwise_and.reduce(_IN[tokens], axis=1)
    out = np.full(len(tokens), _LEAST_LOG)
    if tokens.shape[1] < 8:
        return out
    first = fits & -fits.astype(np.int32)  # the lowest bit: the narrowest encoding that fits
    for k in range(len(ENCODINGS)):
        at = np.flatnonzero(first == 1 << k)
        if len(at):
            out[at] = _battery_logs(np.ascontiguousarray(tokens[at].T), k, pairs)
    return out


def battery(token: str, pairs: Pairs | None = None) -> float:
    """Joint p-value of a token under "uniformly random in its encoding"."""
    body = token.rstrip("=").encode("ascii", "replace")
    return float(np.exp(min(0.0, joint_logs(np.frombuffer(body, np.uint8).reshape(1, -1), pairs)[0]))) if body else 0.0


def level(p: float) -> int:
    """Class of a joint p-value: -2 log2 p, at most the last."""
    return min(LEVELS - 1, int(-2 * math.log2(max(p, 1e-30))))


def levels(tokens: np.ndarray, pairs: Pairs | None = None) -> np.ndarray:
    """``level(battery(token))`` of the tokens in the rows of a byte matrix."""
    p = np.exp(np.minimum(joint_logs(tokens, pairs), 0.0))
    return np.minimum(LEVELS - 1, (-2 * np.log2(np.maximum(p, 1e-30))).astype(int))


def length_class(n: int) -> int:
    return max(0, sum(n >= x for x in LENGTHS) - 1)


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base format that pass its check."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX_LONG.finditer(text)]
    return out


def tokens_of(text: str) -> list[tuple[int, int]]:
    """Where tokens of the least length or more are."""
    return [m.span() for m in TOKEN.finditer(text) if m.end() - m.start() >= LENGTHS[0]]


def judged(tokens: list[str], pairs: Pairs | None = None) -> list[int]:
    """The level of each token; those of one length are put to the battery together."""
    bodies = [t.rstrip("=").encode() for t in tokens]
    by_length: dict[int, list[int]] = {}
    for i, b in enumerate(bodies):
        by_length.setdefault(len(b), []).append(i)
    out = [LEVELS - 1] * len(tokens)
    for n, of in by_length.items():
        step = max(1, CHUNK // max(1, n))
        for at in range(0, len(of), step):
            part = of[at : at + step]
            rows = np.frombuffer(b"".join(bodies[i] for i in part), np.uint8).reshape(len(part), n)
            for i, v in zip(part, levels(rows, pairs).tolist()):
                out[i] = v
    return out


def candidates(text: str, pairs: Pairs | None = None) -> list[tuple[int, int, int, int]]:
    """Tokens of the least length or more: start, end, length class, level."""
    at = tokens_of(text)
    return [(s, e, length_class(e - s), v) for (s, e), v in zip(at, judged([text[s:e] for s, e in at], pairs))]


_NOT_LETTERS = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122))


def ordinary(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without spans, which may overlap; what stood beside them doesn't meet."""
    out, at = [], 0
    for start, stop in sorted(spans):
        if start > at:
            out.append(text[at:start])
        at = max(at, stop)
    return " ".join([*out, text[at:]])


def references(texts: list[str], pairs: Pairs | None = None) -> dict[int, int]:
    """Counts by class * LEVELS + level of the texts' letters strung to each length.

    Tokens of one length follow each other without a gap and do not cross
    texts; only letters too few for a last token are in none of that length.
    """
    letters = [t.encode("ascii", "ignore").translate(None, _NOT_LETTERS) for t in texts]
    out: dict[int, int] = {}
    for n in LENGTHS:
        whole = np.frombuffer(b"".join(x[: len(x) // n * n] for x in letters), dtype=np.uint8).reshape(-1, n)
        for at in range(0, len(whole), CHUNK // n):
            for v, count in enumerate(np.bincount(levels(whole[at : at + CHUNK // n], pairs), minlength=LEVELS).tolist()):
                if count:
                    out[length_class(n) * LEVELS + v] = out.get(length_class(n) * LEVELS + v, 0) + count
    return out


@dataclass
class Bars:
    """The highest level that counts as random, by length class; -1: none does."""

    highest: list[int]


def bars(null: dict[int, int], seen: dict[int, int], rate: float = RATE) -> Bars:
    """Bars from the counts by class * LEVELS + level of text and of candidates."""
    out = []
    for k in range(len(LENGTHS)):
        n_null = sum(null.get(k * LEVELS + v, 0) for v in range(LEVELS))
        n_seen = sum(seen.get(k * LEVELS + v, 0) for v in range(LEVELS))
        best, as_null, as_seen = -1, 0, 0
        for v in range(LEVELS):
            as_null += null.get(k * LEVELS + v, 0)
            as_seen += seen.get(k * LEVELS + v, 0)
            if as_seen and (as_null + 1) / (n_null + 1) * n_seen <= rate * as_seen:
                best = v
        out.append(best)
    return Bars(out)


_SCANNED = "base array<struct<start:int,stop:int,kind:string>>, token array<struct<start:int,stop:int,length_class:int,level:int>>, reference array<struct<at:int,n:long>>"


def _judged(docs: DataFrame, rate: float) -> tuple[DataFrame, list[int]]:
    """All texts' base spans and tokens with their levels, stored, and the bars."""
    pairs = fit_pairs(docs)

    def scan(texts: list[str | None]) -> dict[str, list]:
        out: dict[str, list] = {"base": [], "token": [], "reference": []}
        texts = [t or "" for t in texts]
        at = [tokens_of(t) for t in texts]
        found = iter(judged([t[s:e] for t, of in zip(texts, at) for s, e in of], pairs))
        plain = []
        for t, of in zip(texts, at):
            base = base_spans(t)
            plain.append(ordinary(t, [*of, *((s, e) for s, e, _ in base)]) if of or base else t)
            out["base"].append([{"start": s, "stop": e, "kind": k} for s, e, k in base])
            out["token"].append([{"start": s, "stop": e, "length_class": length_class(e - s), "level": next(found)} for s, e in of])
        null = [{"at": at, "n": n} for at, n in references(plain, pairs).items()]
        out["reference"] = [null if k == 0 else [] for k in range(len(texts))]  # of the slice, at its first row
        return out

    found = stored(map_texts(documents(docs), scan, _SCANNED), "scanned")

    def counts(column) -> dict[int, int]:
        rows = found.select(F.explode(column).alias("x")).groupBy("x.at").agg(F.sum("x.n").alias("n")).collect()  # at most LENGTHS x LEVELS rows
        return {r["at"]: r["n"] for r in rows}

    seen = F.transform("token", lambda c: F.struct((c["length_class"] * LEVELS + c["level"]).alias("at"), F.lit(1).cast("long").alias("n")))
    return found, bars(counts(F.col("reference")), counts(seen), rate).highest


def bars_of(docs: DataFrame, rate: float = RATE) -> tuple[Pairs, list[int]]:
    """What the tests take from the corpus, and the highest level that counts as random by length class."""
    with scratch():
        return fit_pairs(docs), _judged(docs, rate)[1]


def scan_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    ``spans`` has the base spans and, of kind ``random``, tokens that pass the
    battery and meet none of them. Offsets are code points, ends exclusive.
    Null counts as empty; whole texts are scanned; rows that repeat are
    scanned each; with no rows there is no reference and no result.
    """

    found, bar = _judged(docs, rate)

    def spans_of(base: list, token: list) -> tuple:
        own = [(b["start"], b["stop"], b["kind"]) for b in base]
        more = apart([(c["start"], c["stop"], "random") for c in token if c["level"] <= bar[c["length_class"]]], own)
        n = [sum(k == kind for _, _, k in own) for kind in ("assign", "access", "hex")]
        return *n, digest(joined(own, KINDS)), joined(own + more, KINDS), len(more)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    target = to_arrow_schema(StructType.fromDDL(schema))
    empty = spans_of([], [])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [spans_of(base, token) if base or token else empty for base, token in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            columns = list(zip(*rows)) if rows else [()] * len(empty)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t.type) for c, t in zip(columns, list(target)[1:]))], schema=target)

    with scratch() as keep:
        out = keep(stored(found.select("doc_id", "base", "token").mapInArrow(finish, schema), "secrets"))
    dropped(found)
    return out

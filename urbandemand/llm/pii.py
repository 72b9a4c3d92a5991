"""Personal data: candidate spans, judged by gradient-boosted trees.

Generators with high recall propose spans that may overlap: written-out mail
addresses, groups of digits, IPv6 addresses, account numbers. Boosted trees
score each by its format and its context, and a threshold for each kind,
calibrated on examples that the trees have not seen, selects. Spans of the four
base formats are always kept, and judged by the trees as well; selected spans
that meet none of them are added. Every span comes with its probability.

The tables hold no labelled spans, so the trees learn from examples planted
into texts of the corpus: of each format some are personal data and some are
not, as often as the words beside them suggest. Formats without telling words
are of both sorts, which is what the thresholds are for.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, insort
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import documents, map_texts
from .spans import Span, digest, joined

# The base formats. A match of each can only begin where a run of
# its signs does, or where the match before it ended, so each is sought there alone.
MAIL_SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
BASE = ("email", "ip", "card", "phone")
ADDED = ("mail_words", "phone_local", "national_id", "account", "ip6")
KINDS = {k: i for i, k in enumerate(BASE + ADDED)}
#: Share of selected spans that must be right when a threshold is calibrated.
PRECISION = 0.95
#: Texts that examples are planted into, and examples for the trees and for the thresholds.
TEXTS, EXAMPLES = 400, 5000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[Span]:
    """Leftmost matches of mail signs, ``@`` and a domain, in time linear in the text."""
    out: list[Span] = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(MAIL_SIGNS))
        free = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), "email"))
            free = m.end()
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base format that pass its check."""
    out = _emails(text)
    if not _DIGIT.search(text):
        return out
    # A part is at most 255 by value, however many zeros lead it.
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# High-recall generators of the added kinds.
_GENERATORS = (
    ("mail_words", re.compile(r"[A-Za-z0-9._-]{2,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{2,64}(?:(?: ?(?:\(dot\)|\[dot\]| dot ) ?|\.)[A-Za-z]{2,12})+")),
    ("phone_local", re.compile(r"(?<![\w.+-])\(?[0-9]{2,5}\)?[ ./-]?[0-9]{2,4}(?:[ ./-][0-9]{2,4}){1,3}(?![\w-])")),
    ("national_id", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("account", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ip6", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){3,7}:?(?:[0-9A-Fa-f]{1,4})(?![\w:])")),
)
_AT = re.compile(r"\(at\)|\[at\]| at ")
_GROUPED = re.compile(r"[0-9]{2}[ )./-]|[0-9A-Fa-f]:|[A-Z]{2}[0-9]{2}")


def candidates(text: str) -> list[Span]:
    """All proposed spans; they may overlap."""
    wanted = {"mail_words"} if _AT.search(text) else set()
    if _GROUPED.search(text):
        wanted |= set(ADDED[1:])
    return [(m.start(), m.end(), kind) for kind, pattern in _GENERATORS if kind in wanted for m in pattern.finditer(text)]


_CUES = ("mail", "phone", "tel", "call", "mobile", "fax", "contact", "ssn", "social", "passport", "iban", "account", "address", "reach", "id", "host", "card")
_ANTI = ("version", "page", "price", "date", "order", "total", "room", "chapter", "isbn", "score", "year", "ratio", "at", "release", "example", "part")
#: Mail addresses that no person reads.
_ROLES = ("noreply", "no-reply", "donotreply", "mailer-daemon")


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    span = text[start:end]
    before = re.findall(r"[a-z]+", text[max(0, start - 40) : start].lower())[-5:]
    digits = _digits(span)
    groups = re.findall(r"[0-9]+", span)
    left, right = text[start - 1 : start] or " ", text[end : end + 1] or " "
    iban = 0
    if kind == "account":
        bare = span.replace(" ", "")
        iban = int(int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1)
    return [
        float(KINDS[kind]), float(len(span)), float(len(digits)), float(len(groups)),
        float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float("-" in span), float("." in span), float("/" in span), float(" " in span), float("(" in span or "[" in span),
        float(any(w.startswith(c) for w in before for c in _CUES)), float(any(w == c for w in before[-2:] for c in _ANTI)),
        float(left in "$€£#"), float(right in "%$€£"), float(iban), float(luhn(digits)) if digits else 0.0,
        float(sum(c in "abcdefABCDEF" for c in span)), float(len(set(digits))), float(len(groups) == 3 and 1900 <= int(groups[0][:4] or 0) <= 2100),
        float(span.lower().startswith(_ROLES)), float(left.isalnum()),
    ]


def _iban(rng: random.Random) -> str:
    body = "".join(rng.choice("0123456789") for _ in range(18))
    check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
    raw = f"DE{check:02d}{body}"
    return " ".join(raw[i : i + 4] for i in range(0, len(raw), 4)) if rng.random() < 0.5 else raw


def _card(rng: random.Random) -> str:
    body = "".join(rng.choice("0123456789") for _ in range(15))
    raw = next(body + c for c in "0123456789" if luhn(body + c))
    return " ".join(raw[i : i + 4] for i in range(0, 16, 4)) if rng.random() < 0.5 else raw


def _patterns(rng: random.Random) -> tuple[tuple[tuple[str, ...], Callable[[], str], float], ...]:
    """Words before a span ("" for none), its format, and how often such a span is personal data."""
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abdefghilmnorstuv") for _ in range(rng.randint(2, 9)))
    year = lambda: str(rng.randint(1950, 2030))
    return (
        (("mail", "contact", "write to", ""), lambda: f"{word()}.{word()}@{word()}.com", 0.97),
        (("example", "order", ""), lambda: f"noreply@{word()}.com", 0.05),
        (("host", "address", "from"), lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), 0.95),
        (("version", "release", "chapter"), lambda: ".".join(str(rng.randrange(20)) for _ in range(4)), 0.03),
        (("",), lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), 0.85),
        (("card", "account", ""), lambda: _card(rng), 0.95),
        (("order", "isbn", "part"), lambda: _card(rng), 0.1),
        (("call", "phone:", "tel", "reach me under", ""), lambda: f"+{rng.randrange(1, 99)} ({num(3)}) {num(3)}-{num(4)}", 0.98),
        (("score", "total", "price"), lambda: f"+{num(3)} {num(3)} {num(3)}", 0.05),
        (("mail me", "contact", "write to", ""), lambda: f"{word()}.{word()} (at) {word()} (dot) com", 0.98),
        (("mail", "reach me under", "address"), lambda: f"{word()} [at] {word()} [dot] org", 0.98),
        (("reach me under", "contact"), lambda: f"{word()} at {word()} dot net", 0.97),
        (("look", "arrive", "we met", ""), lambda: f"{word()} at {word()}.{word()[:4]}", 0.02),
        (("stand", ""), lambda: f"{word()} at {word()} dot {word()}", 0.3),
        (("call", "phone:", "tel", "mobile", "fax"), lambda: f"({num(3)}) {num(3)}-{num(4)}", 0.99),
        (("call", "phone:", "tel", "contact"), lambda: f"{num(3)}-{num(3)}-{num(4)}", 0.98),
        (("tel", "phone", "call"), lambda: f"0{num(2)} {num(4)} {num(4)}", 0.97),
        (("", "and"), lambda: f"({num(3)}) {num(3)}-{num(4)}", 0.9),
        (("", "and"), lambda: f"{num(3)}-{num(3)}-{num(4)}", 0.6),
        (("order", "part", "version", "total"), lambda: f"{num(3)}-{num(3)}-{num(4)}", 0.03),
        (("SSN", "social", "id"), lambda: f"{num(3)}-{num(2)}-{num(4)}", 0.98),
        (("", "and"), lambda: f"{num(3)}-{num(2)}-{num(4)}", 0.7),
        (("ISBN", "order", "score"), lambda: f"{num(3)}-{num(2)}-{num(4)}", 0.03),
        (("IBAN", "account", ""), lambda: _iban(rng), 0.98),
        (("part", "order", ""), lambda: f"AB{num(2)} {num(4)} {num(4)} {num(4)}", 0.03),
        (("part", "order"), lambda: f"XK{num(14)}", 0.03),
        (("host", "address", ""), lambda: ":".join(f"{rng.randrange(65536):x}" for _ in range(8)), 0.95),
        (("at", "time", ""), lambda: f"{num(2)}:{num(2)}:{num(2)}:{num(2)}", 0.02),
        (("ratio", "time"), lambda: f"{num(2)}:{num(2)}:{num(2)}:{num(3)}", 0.02),
        (("date", "since", ""), lambda: f"{year()}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", 0.02),
        (("since", "on", ""), lambda: f"{rng.randint(10, 28)}.{rng.randint(10, 12)}.{year()}", 0.02),
        (("on", ""), lambda: f"{rng.randint(10, 12)}/{rng.randint(10, 28)}/{year()}", 0.02),
        (("version", ""), lambda: f"{num(2)}.{num(2)}.{num(2)}", 0.02),
        (("price", "total", ""), lambda: f"{num(2)} {num(3)} {num(3)}", 0.05),
        (("", "page"), lambda: f"{num(3)} {num(3)} {num(3)}", 0.15),
        (("years", ""), lambda: f"{year()}-{rng.randint(10, 99)} {num(2)}", 0.02),
        (("order", "number"), lambda: f"{num(4)}-{num(4)}-{num(4)}", 0.05),
    )


def examples(n: int, seed: int, texts: list[str]) -> list[tuple[str, int, int, bool]]:
    """Passages of ``texts`` with a span planted in each: passage, start, end, whether it is personal data.

    A span stands between words anywhere in a text; without texts it stands alone.
    """
    rng = random.Random(seed)
    patterns = _patterns(rng)
    cut = [w for t in texts if (w := t.split())]
    out = []
    for _ in range(n):
        cues, made, share = rng.choice(patterns)
        before, after = "", ""
        if cut:
            words = rng.choice(cut)
            at = rng.randint(0, len(words))
            before, after = " ".join(words[max(0, at - 8) : at]), " ".join(words[at : at + 8])
        before = " ".join(x for x in (before, rng.choice(cues)) if x)
        before += " " * bool(before)
        span = made()
        out.append((f"{before}{span}{rng.choice(('', '.', ','))} {after}", len(before), len(before) + len(span), rng.random() < share))
    return out


@dataclass
class PersonalDataModel:
    trees: BoostedTrees
    thresholds: dict[str, float]

    def judged(self, texts: list[str]) -> list[tuple[list[Span], list[Span], dict[Span, float]]]:
        """Of each text the base spans, the selected candidates that meet none of them, and the probability of both.

        Of selected ones that overlap the likeliest stays; of equally likely
        ones the first, then the longest, then the first kind.
        """
        bases = [base_spans(t) for t in texts]
        proposed = [_outside(candidates(t), base) for t, base in zip(texts, bases)]
        rows = [features(t, *c) for t, base, found in zip(texts, bases, proposed) for c in base + found]
        p = iter(self.trees.probability(np.array(rows)).tolist() if rows else [])
        return [self._selected(base, found, {c: next(p) for c in base + found}) for base, found in zip(bases, proposed)]

    def _selected(self, base: list[Span], found: list[Span], p: dict[Span, float]) -> tuple[list[Span], list[Span], dict[Span, float]]:
        order = {k: i for i, k in enumerate(ADDED)}
        chosen = sorted((-p[c], c[0], -c[1], order[c[2]], c) for c in found if p[c] >= self.thresholds[c[2]])
        taken = _merged(base)
        kept: list[Span] = []
        for *_, c in chosen:
            i = bisect_left(taken, (c[1],))  # those before i begin before this one's end
            if i == 0 or taken[i - 1][1] <= c[0]:
                kept.append(c)
                insort(taken, c[:2])
        return base, sorted(kept), p

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and the selected candidates that meet none of them."""
        return self.judged([text])[0][:2]


def _merged(spans: list[Span]) -> list[tuple[int, int]]:
    """The places that spans cover, as sorted intervals apart from each other."""
    out: list[tuple[int, int]] = []
    for start, end, _ in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def _outside(found: list[Span], base: list[Span]) -> list[Span]:
    """Candidates that meet no base span, the only ones that may be added."""
    taken = _merged(base)

    def free(c: Span) -> bool:
        i = bisect_left(taken, (c[1],))  # those before i begin before this one's end
        return i == 0 or taken[i - 1][1] <= c[0]

    return [c for c in found if free(c)] if taken else found


def _table(planted: list[tuple[str, int, int, bool]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Features, marks and kinds of all candidates and base spans that meet a planted span."""
    rows, marks, kinds = [], [], []
    for text, start, end, good in planted:
        base = base_spans(text)
        for c in base + _outside(candidates(text), base):
            if c[0] < end and c[1] > start:
                exact = abs(c[0] - start) <= 1 and abs(c[1] - end) <= 1
                rows.append(features(text, *c))
                marks.append(float(good and exact))
                kinds.append(c[2])
    return np.array(rows), np.array(marks), kinds


def fitted(texts: list[str], seed: int = 9, n: int = EXAMPLES) -> PersonalDataModel:
    """Trees from ``n`` examples planted in ``texts``, thresholds from ``n`` others.

    A kind's threshold is the lowest at which ``PRECISION`` of the candidates
    from there up are personal data; a kind that never reaches it adds none.
    """
    x, y, _ = _table(examples(n, seed, texts[::2]))
    trees = BoostedTrees(rounds=40).fit(x, y)
    x, y, kinds = _table(examples(n, seed + 1, texts[1::2]))
    p = trees.probability(x)
    thresholds = {}
    for kind in ADDED:
        of = np.array([k == kind for k in kinds])
        order = np.argsort(-p[of], kind="stable")
        score, right = p[of][order], np.cumsum(y[of][order]) / np.arange(1, of.sum() + 1)
        last = np.append(score[1:] < score[:-1], True) if len(score) else np.zeros(0, bool)  # of equal scores
        good = np.flatnonzero((right >= PRECISION) & last)
        thresholds[kind] = float(score[good[-1]]) if len(good) else 2.0
    return PersonalDataModel(trees, thresholds)


def fit_personal_data(docs: DataFrame, texts: int = TEXTS, n: int = EXAMPLES, seed: int = 9) -> PersonalDataModel:
    """``fitted`` on at most ``texts`` whole texts of the corpus, those with the smallest hashes of their ids."""
    by = F.xxhash64(F.lit(seed), "doc_id")
    ids = [r["doc_id"] for r in documents(docs).filter("doc_id is not null").select("doc_id", by.alias("by")).distinct().orderBy("by", "doc_id").limit(texts).collect()]
    if not ids:
        return fitted([], seed, n)
    few = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")
    rows = documents(docs).join(F.broadcast(few), "doc_id").collect()
    return fitted([t for _, t in sorted((r["doc_id"], r["text"] or "") for r in rows)], seed, n)


def find_personal_data(docs: DataFrame, model: PersonalDataModel | None = None) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, probabilities, n_unlikely.

    ``spans`` has the base spans and those the trees select; ``probabilities``
    are the trees' for each of them, in the same order, and ``n_unlikely``
    counts the base spans below one half. Offsets are code
    points, ends exclusive. Null counts as empty; whole texts are scanned;
    rows that repeat are scanned each; an empty table gives an empty one.
    """
    model = model or fit_personal_data(docs)

    def scan(texts: list[str | None]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "probabilities", "n_unlikely")}
        for base, more, p in model.judged([t or "" for t in texts]):
            for kind in BASE:
                out[f"n_{kind}"].append(sum(k == kind for _, _, k in base))
            out["base_sha256"].append(digest(joined(base, KINDS)))
            out["spans"].append(joined(base + more, KINDS))
            out["n_added"].append(len(more))
            out["probabilities"].append(",".join(f"{p[c]:.4f}" for c in sorted(base + more, key=lambda c: (c[0], KINDS[c[2]], c[1]))))
            out["n_unlikely"].append(sum(p[c] < 0.5 for c in base))
        return out

    return map_texts(documents(docs), scan, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, probabilities string, n_unlikely long")

"""Language-model scoring by Katz backoff.

    P(w | h) = d(c) * c(h w) / c(h) * f(h)   where c = c(h w) > 0
             = a(h) * P(w | h')              otherwise, h' being h without its first word

c counts the training documents; d is the Good-Turing discount of counts up to
``LARGEST``, for each order; P(w) is the discounted unigram model, with what the
discount leaves for all words not in training together; a(h) makes each history
sum to one exactly. f(h) is 1 but for histories all of whose followers are too
frequent to be discounted, where it is c(h) / (c(h) + 1), so that a(h) stays
above zero.

All tables are partitioned and packed. A chunk of documents holds its tokens as
places in its own list of word hashes. Its distinct grams of each order
are sorted by a hash, and go in stretches of it, so no gram is hot: a chunk
sends each partition every gram once, with its count.

1. ``chunks``: tokens of some documents, about ``CHUNK_TOKENS`` together.
2. Counts: partitions of the grams' hashes sum them up and answer each chunk,
   name one chunk the owner of each gram in training, and say which grams
   several chunks have, and which a document outside training has.
3. Weights: what is kept of a history's seen followers after the discount, and
   what the lower order gives them, is summed over the owned grams. As the
   lower order's f is the same for all followers of a history, this needs the
   counts alone, for all orders at once. A history that occurs in one chunk is
   summed there; others go by way of the partitions of the histories' hashes,
   if any chunk has to know: for a follower that training has not, or one that
   is not discounted.
4. Each chunk looks its grams up, from the lowest order to the highest.

A chunk sends 2 ** ``FAN_BITS`` messages at most. Where that makes partitions too
large, messages of one stretch are merged in groups of bounded size, which send
on like chunks, and answers come back the same way; so messages grow with the
input, not with its square.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, documents, dropped, id_crc, scratch, small, stored

ORDER = 3
CHUNK_TOKENS = 1_600_000
#: Keys that come together in one partition, before equal ones are merged.
PARTITION_KEYS = 2_400_000
#: Partitions that one chunk, or group of messages, sends to: two to this power.
FAN_BITS = 8
#: Parts of the second exchange that run one after the other, so that their shuffle files aren't there at once.
ROUNDS = 4
#: Parts of the chunks that meet their answers one after the other, for the same reason.
TURNS = 2
#: Largest count that is discounted.
LARGEST = 5
#: A text's end; no word has a blank.
END = b" end"
#: Low bits of a gram's name, which hold its order.
ORDER_BITS = 3
_MASK = np.uint64((1 << ORDER_BITS) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Hashes of the history before a text's first word, by its length.
_BEFORE = [np.uint64(xxhash.xxh3_64_intdigest(b" before %d" % k)) for k in range(1 << ORDER_BITS)]


@Remembered
def _trimmer() -> Callable[[int], int]:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library: memory is given back when it likes
        return lambda _: 0


def _given_back() -> None:
    """Memory of arrays that are gone goes back to the system, which workers kept for the next task would hold."""
    _trimmer()(0)


@Remembered
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _packed(x: np.ndarray) -> bytes:
    return _zstd()[0].compress(np.ascontiguousarray(x).data if x.size else b"")


def _unpacked(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(_zstd()[1].decompress(raw), kind)


def _keys_packed(x: np.ndarray) -> bytes:
    """64-bit keys in rising stretches, by the bytes of their differences."""
    step = np.diff(x, prepend=x.dtype.type(0))
    return _packed(step.view(np.uint8).reshape(-1, 8).T)


def _keys_unpacked(raw: bytes) -> np.ndarray:
    step = np.ascontiguousarray(_unpacked(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(step, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _named(h: np.ndarray, order: int) -> np.ndarray:
    return (h & ~_MASK) | np.uint64(order)


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes in rising order, and the hashes in it.

    Plain sorting is much faster than sorting places, so places are sorted in
    the low bits of the hashes; the few that this leaves out of order are put right.
    """
    low = np.uint64((1 << max(1, len(keys).bit_length())) - 1)
    packed = (keys & ~low) | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    turn = (packed & low).astype(np.int64)
    ordered = keys[turn]
    packed &= ~low
    for i in np.flatnonzero(ordered[1:] < ordered[:-1]):
        same = slice(np.searchsorted(packed, packed[i], "left"), np.searchsorted(packed, packed[i], "right"))
        turn[same] = turn[same][np.argsort(ordered[same], kind="stable")]
        ordered[same] = keys[turn[same]]
    return turn, ordered


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes in rising order, a place of each, and each key's place among them."""
    turn, ordered = _sorted(keys)
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    of = np.empty(len(ordered), np.int32)
    of[turn] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], turn[new], of


class _Codes(dict):
    """Each word's place among the distinct words, as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _chunks(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    """chunk, held, lengths, words (hashes), codes (places in words), ids, and sizes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        code, ids, held, arrays, size = _Codes(), [], [], [], 0

        def flush() -> pa.RecordBatch:
            words = np.fromiter(map(xxhash.xxh3_64_intdigest, code), np.uint64, len(code))
            codes = np.concatenate(arrays)
            often = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")  # frequent words get small codes
            rank = np.empty(len(words), np.int32)
            rank[often] = np.arange(len(words), dtype=np.int32)
            words, codes = words[often], rank[codes]
            lengths = np.array([len(a) for a in arrays], np.int32)
            row = [
                [(part << 33) + n], [_packed(np.array(held, np.bool_))], [_packed(lengths)], [words.tobytes()],
                [_packed(codes.view(np.uint8).reshape(-1, 4).T)], [ids], [len(words)], [len(codes)], [len(held) - sum(held)],
            ]
            kinds = [pa.int64(), *[pa.binary()] * 4, pa.list_(pa.int64()), *[pa.int64()] * 3]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names=["chunk", "held", "lengths", "words", "codes", "ids", "n_words", "n_tokens", "n_train"])

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                for i, h, t in zip(*(b.column(k).to_pylist() for k in range(3))):
                    own = (t or "").encode().lower().split()
                    own.append(END)
                    ids.append(i)
                    held.append(h)
                    arrays.append(np.fromiter(map(code.__getitem__, own), np.int32, len(own)))
                    size += len(own)
                    if size >= chunk_tokens:
                        yield flush()
                        code, n, ids, held, arrays, size = _Codes(), n + 1, [], [], [], 0
                        _given_back()
        if arrays:
            yield flush()
        del code, arrays
        _given_back()

    rows = docs.select("doc_id", (id_crc(F.col("doc_id")) % 5 == 1).alias("held_out"), "text")
    return rows.mapInArrow(make, "chunk long, held binary, lengths binary, words binary, codes binary, ids array<long>, n_words long, n_tokens long, n_train long")


@dataclass
class _Grams:
    """The distinct k-grams of a chunk, sorted by name.

    ``count`` is their training count here, ``sought`` whether a text outside
    training has them; ``of`` is each token's gram, the
    one that ends with it; ``lower`` is a gram without its first word, and
    ``before`` its history, as places among the (k-1)-grams; a place past the
    end is the history before a text's first word.
    """

    names: np.ndarray
    of: np.ndarray
    count: np.ndarray
    sought: np.ndarray
    lower: np.ndarray
    before: np.ndarray


class _Chunk:
    """A chunk's tokens and grams up to an order; with ``only``, names and counts of the grams of those orders alone."""

    def __init__(self, held: bytes, lengths: bytes, words: bytes, codes: bytes, order: int, only: list[int] | None = None) -> None:
        self.held, self.lengths = _unpacked(held, np.bool_), _unpacked(lengths, np.int32)
        flat = np.ascontiguousarray(_unpacked(codes, np.uint8).reshape(4, -1).T).view(np.int32).ravel()
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        held = np.repeat(self.held, self.lengths)
        held = np.flatnonzero(held)
        first = np.zeros(len(flat), bool)
        first[self.starts] = True
        self.grams: list[_Grams] = []
        for k in range(1, order + 1):
            if k == 1:
                hashes = _mixed(np.frombuffer(words, np.uint64))
                whole = word = hashes[flat]
                if only is not None and k not in only:
                    continue
                distinct, _, place = _distinct(_named(hashes, 1))
                of = place[flat]
                lower = before = np.zeros(0, np.int64)
            else:  # the history's hash and the word's
                history = np.empty_like(whole)
                history[1:] = whole[:-1]
                history[self.starts] = _BEFORE[k - 1]
                whole = _mixed(history * _ODD + word)
                del history
                if only is not None and k not in only:
                    continue
                distinct, example, of = _distinct(_named(whole, k))
                if only is None:
                    below = self.grams[-1]
                    lower = below.of[example]
                    before = np.where(first[example], np.int32(len(below.names)), below.of[example - 1])
                else:
                    lower = before = np.zeros(0, np.int64)
            outside = np.bincount(of[held], minlength=len(distinct))
            count = np.bincount(of, minlength=len(distinct)) - outside
            self.grams.append(_Grams(distinct, of, count.astype(np.int32), (outside > 0).astype(np.uint8), lower, before))


def _cut(keys: np.ndarray, bits: int, skip: int = 0) -> np.ndarray:
    """Bounds of the stretches of sorted keys that share their bits from ``skip`` on, ``bits`` of them."""
    if not bits:
        return np.array([0, len(keys)])
    place = (keys << np.uint64(skip)) >> np.uint64(64 - bits) if skip else keys >> np.uint64(64 - bits)
    return np.searchsorted(place, np.arange((1 << bits) + 1, dtype=np.uint64))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of each key, the first column, of batches sorted by it."""
    key, held = None, []
    for b in batches:
        for i in range(b.num_rows):
            row = tuple(b.column(k)[i].as_py() for k in range(b.num_columns))
            if row[0] != key:
                if held:
                    yield key, held
                key, held = row[0], []
            held.append(row[1:])
    if held:
        yield key, held


def _dealt(df: DataFrame, key: str, parts: int) -> DataFrame:
    return df.repartition(max(1, min(parts, 200_000)), key).sortWithinPartitions(key)


#: part: the stretch of keys, by its leading bits; sender: who wants the answer; n: keys.
#: a, b: training counts and whether sought; or sums of weights, and c: whether an answer is wanted.
_SENT = pa.schema([("part", pa.int64()), ("sender", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_SENT_SQL = "part long, sender long, n long, keys binary, a binary, b binary, c binary"
#: An answer is in the order of a message's keys. Without a sender: a class of counts, and n.
_SAID = pa.schema([("sender", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
_SAID_SQL = "sender long, part long, n long, a binary, b binary"
#: Marks of a sender's key: it owns it; other senders have it too; some text outside training has it.
OWNED, SHARED, SOUGHT = np.uint8(1), np.uint8(2), np.uint8(4)
#: Classes of counts, for each order: keys with counts 1 to LARGEST + 1, all keys, and the sum of counts.
_CLASSES = LARGEST + 3


def _values_packed(x: np.ndarray) -> bytes:
    """Numbers by their bytes, as most of them are small or alike."""
    return _packed(x.view(np.uint8).reshape(-1, x.itemsize).T)


def _values_unpacked(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(_unpacked(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


@dataclass
class _Merged:
    """Messages of one stretch with equal keys put together."""

    rows: list[tuple]  # sender, n, keys, a, b, c
    counting: bool
    keys: np.ndarray = field(init=False)
    place: np.ndarray = field(init=False)
    sums: list[np.ndarray] = field(init=False)
    owner: np.ndarray | None = field(init=False, default=None)
    asked: np.ndarray | None = field(init=False, default=None)

    def __post_init__(self) -> None:
        every = np.concatenate([_keys_unpacked(r[2]) for r in self.rows])
        self.keys, _, self.place = _distinct(every)
        kinds = (np.int64, np.uint8) if self.counting else (np.float64, np.float64)
        values = [np.concatenate([_values_unpacked(r[3 + k], kind) for r in self.rows]) for k, kind in enumerate(kinds)]
        self.sums = [np.bincount(self.place, v, minlength=len(self.keys)) for v in values]
        if self.counting:
            self.sums = [self.sums[0].astype(np.int64), (self.sums[1] > 0).astype(np.uint8)]
            seen = np.flatnonzero(values[0] > 0)[::-1]  # the first message with an occurrence in training owns the key
            self.owner = np.full(len(self.keys), -1)
            self.owner[self.place[seen]] = seen
        else:
            self.asked = np.concatenate([_values_unpacked(r[5], np.uint8) for r in self.rows])

    def onward(self) -> list[np.ndarray]:
        """What goes on for the merged keys: their sums, and whether any sender wants an answer."""
        if self.counting:
            return self.sums
        return [*self.sums, (np.bincount(self.place, self.asked, minlength=len(self.keys)) > 0).astype(np.uint8)]

    def answers(self, part: int, totals: list[np.ndarray], marks: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """To each sender the totals of the keys it asks for; with counts the marks.

        ``marks`` are those that these messages together have from above.
        """
        at = 0
        if self.counting:
            all_of = (np.bincount(self.place, minlength=len(self.keys)) > 1) * SHARED
            all_of |= totals[1] * SOUGHT if marks is None else marks & (SHARED | SOUGHT)
        for sender, n, *_ in self.rows:
            place = self.place[at : at + n]
            if self.counting:
                own = (self.owner[place] == np.arange(at, at + n)) * OWNED
                if marks is not None:
                    own &= marks[place]
                yield _batch([(sender, part, n, _values_packed(totals[0][place]), _values_packed(own | all_of[place]))], _SAID)
            else:
                place = place[self.asked[at : at + n] > 0]
                if len(place):
                    yield _batch([(sender, part, len(place), _values_packed(totals[0][place]), _values_packed(totals[1][place]))], _SAID)
            at += n


def _spectrum(keys: np.ndarray, totals: np.ndarray) -> list[tuple]:
    """Numbers of keys by order and count, in rows without a sender."""
    out = []
    for order in np.unique(keys & _MASK).tolist():
        own = totals[((keys & _MASK) == np.uint64(order)) & (totals > 0)]
        numbers = [*np.bincount(np.minimum(own, LARGEST + 2), minlength=LARGEST + 3)[1 : LARGEST + 2], len(own), own.sum()]
        out += [(None, int(order) * _CLASSES + i, int(n), None, None) for i, n in enumerate(numbers)]
    return out


def _answered(sent: DataFrame, counting: bool, done: int, needed: int, fan_bits: int, partition_keys: int) -> DataFrame:
    """Answers to messages whose stretches share ``done`` leading bits of ``needed``."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _grouped(batches):
            m = _Merged(rows, counting)
            yield from m.answers(part, m.sums)
            if counting:
                yield _batch(_spectrum(m.keys, m.sums[0]), _SAID)
            del m, rows
            _given_back()

    if done >= needed:
        return _dealt(sent, "part", 1 << done).mapInArrow(merge, _SAID_SQL)

    # Too much for one partition each: groups of messages are merged and send on.
    bits = min(fan_bits, needed - done)
    sent = stored(sent, "messages")
    groups = stored(sent.groupBy("part").agg(F.ceil(F.sum("n") / partition_keys).alias("groups")), "groups")
    number = F.pmod(F.xxhash64("sender"), F.col("groups"))
    grouped = sent.join(small(groups), "part").select(F.xxhash64("part", number).alias("middle"), "sender", "n", "keys", "a", "b", "c", "part")
    n_groups = int(groups.agg(F.sum("groups")).first()[0] or 1)

    def send_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for middle, rows in _grouped(batches):
            m, part = _Merged(rows, counting), rows[0][6]
            yield from _messages(middle, [m.keys], m.onward(), bits, done, part)

    onward = _dealt(grouped, "middle", n_groups).mapInArrow(send_on, _SENT_SQL)
    above = stored(_answered(onward, counting, done + bits, needed, fan_bits, partition_keys), "answers")
    own = grouped.select("middle", F.lit(0).alias("kind"), "sender", "part", "n", "keys", "a", "b", "c")
    none = [F.lit(None).cast("binary").alias(c) for c in ("keys", "c")]
    back = above.filter("sender is not null").select(F.col("sender").alias("middle"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("sender"), "part", "n", none[0], "a", "b", none[1])

    def pass_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (np.int64, np.uint8) if counting else (np.float64, np.float64)
        for _, rows in _grouped(batches):
            mine = [r for r in rows if r[0] == 0]
            m = _Merged([(r[1], *r[3:8]) for r in mine], counting)
            said = sorted((r for r in rows if r[0] == 1), key=lambda r: r[2])
            first, second = (np.concatenate([np.zeros(0, kind), *(_values_unpacked(r[k], kind) for r in said)]) for k, kind in zip((5, 6), kinds))
            if counting:
                yield from m.answers(mine[0][2], [first], second)
            else:  # answers to the keys that were asked for
                totals = [np.zeros(len(m.keys)), np.zeros(len(m.keys))]
                wanted = m.onward()[2] > 0
                totals[0][wanted], totals[1][wanted] = first, second
                yield from m.answers(mine[0][2], totals)

    down = _dealt(own.unionByName(back), "middle", n_groups).mapInArrow(pass_down, _SAID_SQL)
    return down.unionByName(above.filter("sender is null"))


def _messages(sender: int, keys: list[np.ndarray], sums: list[np.ndarray], bits: int, skip: int = 0, part: int = 0) -> Iterator[pa.RecordBatch]:
    """Sorted arrays of keys with arrays of values for all of them together, cut into stretches."""
    at = [_cut(k, bits, skip) for k in keys]
    first = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    for i in range(1 << bits):
        cuts = [slice(a[i], a[i + 1]) for a in at]
        n = sum(s.stop - s.start for s in cuts)
        if n:
            value = [_values_packed(np.concatenate([v[f + s.start : f + s.stop] for f, s in zip(first, cuts)])) for v in sums]
            yield _batch([((part << bits) | i, sender, n, _keys_packed(np.concatenate([k[s] for k, s in zip(keys, cuts)])), value[0], value[1], value[2] if len(value) > 2 else None)], _SENT)


def _collated(rows: list[tuple], keys: list[np.ndarray], bits: int, kinds: tuple[type, type]) -> list[list[np.ndarray]]:
    """Both arrays of a chunk's answers (part, a, b), for each of its arrays of keys."""
    at = [_cut(k, bits) for k in keys]
    out = [[np.zeros(len(k), kind) for k in keys] for kind in kinds]
    for part, *raw in rows:
        for into, data, kind in zip(out, raw, kinds):
            values, done = _values_unpacked(data, kind), 0
            for array, a in zip(into, at):
                n = a[part + 1] - a[part]
                array[a[part] : a[part + 1]] = values[done : done + n]
                done += n
    return out


def discounts(spectrum: np.ndarray) -> np.ndarray:
    """Good-Turing factors of the counts 1 to LARGEST, and 1 for larger ones.

    Katz's form, which leaves what single keys stand for. Where the counts of
    counts are too few to give rising factors between 0 and 1, half an
    occurrence is taken from each count instead.
    """
    n = spectrum.astype(float)
    r = np.arange(1, LARGEST + 1)
    if (n > 0).all():
        common = (LARGEST + 1) * n[LARGEST] / n[0]
        if common < 1:
            d = ((r + 1) * n[1:] / (r * n[:-1]) - common) / (1 - common)
            if ((d > 0) & (d < 1)).all():
                return np.append(d, 1.0)
    return np.append((r - 0.5) / r, 1.0)


@dataclass
class Model:
    """What all partitions share: a few numbers. Lists are by order, from 1."""

    total: int
    distinct: int
    texts: int
    discount: list[np.ndarray]
    unseen: float
    seen_scale: float

    @classmethod
    def of(cls, spectra: list[np.ndarray], texts: int) -> Model:
        words, distinct, total = spectra[0][: LARGEST + 1], int(spectra[0][LARGEST + 1]), int(spectra[0][LARGEST + 2])
        discount = [discounts(s[: LARGEST + 1]) for s in spectra]
        r = np.arange(1, LARGEST + 1)
        lost = float(((1 - discount[0][:-1]) * r * words[:LARGEST]).sum()) / max(total, 1)
        unseen = max(lost, 1 / (total + 1))  # at least one in total + 1
        return cls(total, distinct, texts, discount, unseen, (1 - unseen) / (1 - lost) if lost < 1 else 1.0)

    def kept(self, order: int, count: np.ndarray) -> np.ndarray:
        """The discounted count."""
        return self.discount[order - 1][np.minimum(np.maximum(count, 1), LARGEST + 1) - 1] * count

    def unigram(self, count: np.ndarray) -> np.ndarray:
        """P of a word with this training count; of 0: of all unseen words together."""
        if not self.total:
            return np.ones(len(count))
        return np.where(count > 0, self.kept(1, count) * self.seen_scale / self.total, self.unseen)

    def weights(self, c: np.ndarray, kept: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """f and a of histories: their counts, and of their seen followers the discounted counts and the lower order's P."""
        safe = np.maximum(c, 1)
        share = kept / safe
        none_left = share > 1 - 1e-12
        f = np.where(none_left, safe / (safe + 1), 1.0)
        left = np.where(none_left, 1 / (safe + 1), 1 - share)
        return np.where(c > 0, f, 1.0), np.where(c > 0, left / np.maximum(1 - lower, 1e-300), 1.0)


@dataclass
class _Histories:
    """The (k-1)-grams of a chunk as histories of its k-grams, and last the history before a first word.

    ``kept`` and ``lower`` are sums over the owned grams. ``sent`` are the
    places of the histories whose sums here others may need, or whose sums are
    needed from others (``asked``), in the order of their ``names``.
    """

    count: np.ndarray
    kept: np.ndarray
    lower: np.ndarray
    sent: np.ndarray
    names: np.ndarray
    asked: np.ndarray


class _Scorer:
    """A chunk with the answers to it."""

    def __init__(self, chunk: _Chunk, model: Model, counts: list[tuple[list[int], list[tuple]]], bits: int) -> None:
        self.chunk, self.model, self.bits = chunk, model, bits
        self.total, self.marks = ([np.zeros(0)] * len(chunk.grams) for _ in range(2))
        for orders, rows in counts:
            for k, total, marks in zip(orders, *_collated(rows, [chunk.grams[k - 1].names for k in orders], bits, (np.int64, np.uint8))):
                self.total[k - 1], self.marks[k - 1] = total.astype(np.int32) if total.max(initial=0) < 1 << 31 else total, marks

    def histories(self, k: int) -> _Histories:
        g, below = self.chunk.grams[k - 1], self.chunk.grams[k - 2]
        total, model = self.total[k - 1], self.model
        count = np.append(self.total[k - 2], model.texts)
        marks = np.append(self.marks[k - 2], SHARED | SOUGHT)
        size = len(count)
        mine = np.flatnonzero(self.marks[k - 1] & OWNED)
        own = g.before[mine]
        kept = np.bincount(own, model.kept(k, total[mine]), minlength=size).astype(float)  # of no grams it counts in whole numbers
        # The lower order's P of a gram that training has, but for its history's f.
        low = g.lower[mine]
        if k == 2:
            p = model.unigram(self.total[0][low])
        else:
            history = self.chunk.grams[k - 2].before[low]
            p = model.kept(k - 1, self.total[k - 2][low]) / np.append(self.total[k - 3], model.texts)[history]
        lower = np.bincount(own, p, minlength=size).astype(float)
        gives, asks = np.zeros(size, bool), np.zeros(size, bool)
        gives[own] = True
        # f is 1 where a follower here is discounted; a is needed where one is not in training.
        asks[g.before[total > LARGEST]] = True
        asks[g.before[(total > 0) & (total <= LARGEST)]] = False
        asks[g.before[total == 0]] = True
        shared = (marks & SHARED > 0) & (count > 0)
        asks &= shared
        gives &= shared & ((marks & SOUGHT > 0) | (count > LARGEST))
        sent = np.flatnonzero(gives | asks)
        names = np.where(sent < size - 1, below.names[np.minimum(sent, size - 2)], _named(_BEFORE[k - 1][None], 0))
        order = np.argsort(names)
        sent, names = sent[order], names[order]
        return _Histories(count, kept, lower, sent, names, asks[sent])

    def probabilities(self, partial: list[tuple]) -> np.ndarray:
        """P of each gram of the highest order; ``partial`` are the answers to ``histories``."""
        model, order = self.model, len(self.chunk.grams)
        of = [self.histories(k) for k in range(2, order + 1)]
        kept, lower = _collated(partial, [h.names[h.asked] for h in of], self.bits, (np.float64, np.float64))
        partial.clear()
        p = model.unigram(self.total[0])
        f = np.ones(0)
        for k in range(2, order + 1):
            h, of[k - 2] = of[k - 2], None  # no longer held than its turn
            g, total = self.chunk.grams[k - 1], self.total[k - 1]
            g.names = np.zeros(0, np.uint64)
            at = h.sent[h.asked]
            h.kept[at], h.lower[at] = kept[k - 2], lower[k - 2]
            if k > 2:  # f of the history without its first word
                h.lower *= f[np.append(self.chunk.grams[k - 2].lower, len(f) - 1)]
            f, a = model.weights(h.count.astype(float), h.kept, h.lower)
            # Where others have a history and nothing was asked, f is 1 and a is not needed.
            shared = np.append(self.marks[k - 2] & SHARED, SHARED) > 0
            shared[at] = False
            f[shared] = 1.0
            seen = model.kept(k, total) / np.maximum(h.count[g.before], 1) * f[g.before]
            p = np.where(total > 0, seen, a[g.before] * p[g.lower])
        return p


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_katz(docs: DataFrame, order: int = ORDER, chunk_tokens: int = CHUNK_TOKENS, partition_keys: int = PARTITION_KEYS, fan_bits: int = FAN_BITS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32(doc_id) mod 5 is 1 are scored only, the others are
    counted too. A null text counts as empty, which is one token, its end; a
    null doc_id counts as the empty text. Rows that repeat are counted and
    scored each. Without training text every token has probability 1 in the
    model, and an empty table gives an empty one.
    """
    with scratch() as keep:
        return reduce(DataFrame.unionByName, [keep(x) for x in _scored(documents(docs), order, chunk_tokens, partition_keys, fan_bits)])


def _scored(docs: DataFrame, order: int, chunk_tokens: int, partition_keys: int, fan_bits: int) -> list[DataFrame]:
    chunks = stored(_chunks(docs, chunk_tokens), "chunks")
    n_chunks, words, tokens, texts = (x or 0 for x in chunks.agg(F.count("*"), F.sum("n_words"), F.sum("n_tokens"), F.sum("n_train")).first())
    needed = max(0, math.ceil(math.log2(max(1, (words + (order - 1) * tokens) / partition_keys))))
    bits = min(fan_bits, needed)

    def answers(sent: DataFrame, counting: bool, what: str) -> DataFrame:
        return stored(_answered(sent, counting, bits, needed, fan_bits, partition_keys), what)

    def chunk_of(row: tuple) -> _Chunk:
        return _Chunk(*row, order)

    def counting(orders: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    grams = _Chunk(*(b.column(k)[i].as_py() for k in range(1, 5)), max(orders), orders).grams
                    values = [np.concatenate([g.count for g in grams]).astype(np.int64), np.concatenate([g.sought for g in grams])]
                    yield from _messages(b.column(0)[i].as_py(), [g.names for g in grams], values, bits)
                    del grams, values
                    _given_back()

        return count

    blob = ("held", "lengths", "words", "codes")
    # The highest order apart from the others: the shuffle files of both aren't there at once.
    parts = [x for x in (list(range(1, order)), [order]) if x]
    asked = [answers(chunks.select("chunk", *blob).mapInArrow(counting(x), _SENT_SQL), True, "counts") for x in parts]
    counts = reduce(DataFrame.unionByName, asked)
    spectra = [np.zeros(_CLASSES, np.int64) for _ in range(order)]
    for r in counts.filter("sender is null").groupBy("part").agg(F.sum("n").alias("n")).collect():  # at most _CLASSES rows an order
        spectra[r["part"] // _CLASSES - 1][r["part"] % _CLASSES] = r["n"]
    model = Model.of(spectra, texts)

    own = chunks.select("chunk", F.lit(-1).alias("turn"), F.lit(0).cast("long").alias("part"), F.lit(None).cast("binary").alias("a"), F.lit(None).cast("binary").alias("b"), *blob, "ids")
    empty = [F.lit(None).cast("binary").alias(c) for c in blob] + [F.lit(None).cast("array<long>").alias("ids")]
    said = dict(enumerate(asked))
    weights = len(parts)

    def with_chunks(work: Callable[[int, tuple, _Scorer, list[tuple]], Iterator[pa.RecordBatch]], schema: str, what: str) -> list[DataFrame]:
        """``work`` on each chunk with all the answers to it, stored in ``TURNS`` tables."""
        every, turns = own, tuple(said)
        for turn, frame in said.items():
            every = every.unionByName(frame.filter("sender is not null").select(F.col("sender").alias("chunk"), F.lit(turn).alias("turn"), "part", "a", "b", *empty))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk, rows in _grouped(batches):
                head = next(r for r in rows if r[0] == -1)
                of = {turn: [r[1:4] for r in rows if r[0] == turn] for turn in turns}
                del rows
                yield from work(chunk, head, _Scorer(chunk_of(head[4:8]), model, [(x, of[turn]) for turn, x in enumerate(parts)], bits), of.get(weights, []))
                del head, of
                _given_back()

        own_turn = F.pmod(F.xxhash64("chunk"), F.lit(TURNS))
        return [stored(_dealt(every.filter(own_turn == i), "chunk", -(-n_chunks // TURNS)).mapInArrow(run, schema), what) for i in range(TURNS)]

    def weigh(chunk: int, _: tuple, s: _Scorer, __: list[tuple]) -> Iterator[pa.RecordBatch]:
        of = [s.histories(k) for k in range(2, order + 1)]
        values = [np.concatenate([x[h.sent] for x, h in zip(sums, of)]) for sums in ([h.kept for h in of], [h.lower for h in of])]
        yield from _messages(chunk, [h.names for h in of], [*values, np.concatenate([h.asked for h in of]).astype(np.uint8)], bits)

    if order > 1:
        sums = with_chunks(weigh, _SENT_SQL, "sums")
        sent = reduce(DataFrame.unionByName, sums)
        rounds = [answers(sent.filter(F.col("part") % ROUNDS == i), False, "weights") for i in range(min(ROUNDS, 1 << bits))]
        dropped(*sums)
        said[weights] = reduce(DataFrame.unionByName, rounds)

    def score(_: int, head: tuple, s: _Scorer, partial: list[tuple]) -> Iterator[pa.RecordBatch]:
        c, first = s.chunk, s.chunk.starts
        p = s.probabilities(partial) if order > 1 else model.unigram(s.total[0])
        log_p = np.log10(np.maximum(p, 1e-300))[c.grams[-1].of]
        words = c.grams[0].of
        base = np.log10((s.total[0] + 0.5) / (model.total + 0.5 * (model.distinct + 1)))[words]
        known = (s.total[0] > 0)[words]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(head[8], pa.int64()), pa.array(c.held), pa.array(c.lengths.astype(np.int64)), pa.array(np.add.reduceat(known.astype(np.int64), first)),
                pa.array(np.full(len(first), model.total, np.int64)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(log_p, first)),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return with_chunks(score, _SCORES, "scores")

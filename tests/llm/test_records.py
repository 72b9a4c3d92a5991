"""Row patterns, conversation tries and archives against brute force and exact round trips."""

import base64
import datetime
import gzip
import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbandemand.llm.conversation_trie import prefix_trie
from urbandemand.llm.row_pattern import _NONE, GOALS, MaxTree, match_rows
from urbandemand.llm.warc import CorruptArchive, archived, read_chunks, read_records, records, write_warc

DAY = datetime.datetime(2024, 1, 1)
CLICKS = "click_id long, ts timestamp_ntz, client_id long, kind string, value double, part long, nth long, tie string, rows string"


@pytest.fixture
def many_tasks(spark):
    """Shuffles keep their tasks, so that segments are cut at many borders."""
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _matches(rows, goal):
    """All matches of one client's ordered rows (ts in minutes, id, kind, cents) by backtracking."""

    def follows(j):
        return j < len(rows) and rows[j][0] - rows[j - 1][0] <= 30 and rows[j][3] is not None

    def moves(j, down):
        if not follows(j) or rows[j - 1][3] is None or rows[j][2] in (None, "error"):
            return False
        return rows[j][3] < rows[j - 1][3] if down else rows[j][3] > rows[j - 1][3]

    def ends(j, down):
        while moves(j, down):
            j += 1
            yield j

    def groups(j, greedy):
        turn = (lambda x: reversed(list(x))) if greedy else list
        for a in turn(ends(j, True)):
            for b in turn(ends(a, False)):
                if greedy:
                    yield from groups(b, greedy)
                    yield b
                else:
                    yield b
                    yield from groups(b, greedy)

    out = []
    for i, row in enumerate(rows):
        if row[3] is None:
            continue
        goal_at = lambda j: follows(j) and rows[j][2] == "click" and rows[j][3] >= row[3]  # noqa: B023, E731
        hit = None
        for e in groups(i + 1, goal != "first"):
            if goal_at(e):
                hit = (e + 1, "P")
            elif goal == "optional":
                hit = (e, "")
            if hit:
                break
        if hit:
            text = "A" + "".join("D" if moves(j, True) else "U" for j in range(i + 1, hit[0] - len(hit[1]))) + hit[1]
            out.append((len(out) + 1, row[1], rows[hit[0] - 1][1], hit[0] - i, sum(r[3] for r in rows[i : hit[0]]), hashlib.sha256(text.encode()).hexdigest()))
    return out


def _clicks(seed, n_clients, n_rows):
    rng = random.Random(seed)
    out = []
    for c in range(n_clients):
        minute = 0
        for k in range(n_rows if c else 3 * n_rows):
            minute += rng.choice([0, 1, 30, 30, 31]) if rng.random() < 0.2 else 1
            value = None if rng.random() < 0.05 else (rng.choice([1.0, 9.0, 5.0]) + (k % 2) * 3 if c == 0 else rng.randint(-3, 5) / 100)
            out.append((1000 * c + k, DAY + datetime.timedelta(minutes=minute), c, rng.choice(["click", "view", "click", None if c else "view", "error" if rng.random() < 0.3 else "view"]), value, 1, 2, "t", "r"))
    for k in range(120):  # one segment over most tasks
        out.append((10**6 + k, DAY + datetime.timedelta(seconds=k), 99, "click", 50.0 - k // 4 + (k % 3), 1, 2, "t", "r"))
    return out


@pytest.mark.parametrize("goal", GOALS)
def test_row_pattern_against_backtracking(spark, many_tasks, goal):
    rows = _clicks(3, 4, 60)
    got = match_rows(spark.createDataFrame(rows + rows[:50], CLICKS).repartition(5), goal, fan=3)
    want = []
    for c in sorted({r[2] for r in rows}):
        own = sorted((r[1], r[0], r[3], r[4]) for r in rows if r[2] == c)
        plain = [((ts - DAY).total_seconds() / 60, i, kind, None if v is None else int(np.floor(100 * v + 0.5))) for ts, i, kind, v in own]
        want += [(c, *m) for m in _matches(plain, goal)]
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20


def test_max_tree():
    rng = random.Random(1)
    for _ in range(100):
        v = np.array([rng.choice([_NONE, 1, 2, 3, 4, 5]) for _ in range(rng.randint(1, 40))], np.int64)
        low, high, least = (np.array([rng.randrange(k) + d for _ in range(30)]) for k, d in ((len(v), 0), (len(v) + 3, 0), (6, 1)))
        last, first = MaxTree(v).last(low, high, least), MaxTree.first(v, low, high, least)
        for k in range(30):
            fit = [j for j in range(low[k], min(high[k], len(v) - 1) + 1) if v[j] >= least[k]]
            assert last[k] == (fit[-1] if fit else -1) and first[k] == (fit[0] if fit else -1)


def test_row_pattern_edges(spark):
    at = lambda m: DAY + datetime.timedelta(minutes=m)
    rows = [(1, at(0), 1, None, 5.0), (2, at(1), 1, "view", 4.0), (2, at(1), 1, "view", 4.0), (3, at(2), 1, "view", 4.5), (4, at(3), 1, "click", 5.0), (5, at(4), 1, "view", None), (None, at(4), None, "click", 1.0), (6, None, 1, "click", 1.0)]
    rows += [(7, at(0), 2, "click", float("nan")), (8, at(1), 2, "view", 3.0), (9, at(2), 2, "view", 2.0), (10, at(32), 2, "view", 3.0), (11, at(62) + datetime.timedelta(microseconds=1), 2, "click", 4.0)]
    frame = spark.createDataFrame([(*r, 1, 2, "t", "r") for r in rows], CLICKS)
    got = {(r["client_id"], r["match_no"]): (r["first_id"], r["last_id"], r["n_rows"], r["sum_cents"]) for r in match_rows(frame).collect()}
    # 4.5 to 5.0 is a rise too, so the run is D U U and has no goal behind it; half an hour exactly still belongs.
    assert got == {(1, 1): (1, 4, 4, 1850), (2, 1): (8, 10, 3, 800)}
    assert match_rows(frame.limit(0)).collect() == []
    assert match_rows(frame.withColumn("ts", F.col("ts").cast("timestamp"))).count() == 2


def _trie(rows):
    """Nodes of rebuilt conversations by plain dictionaries of whole prefixes."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = {}
    for c, path in whole.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    out = []
    for node, of in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(str(c) for c in sorted(of) if len(whole[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(of), len(node), parent, len(of), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string, path string, unit string, base long"


@pytest.mark.parametrize("limit", [50_000, 40, 2])
def test_conversation_trie_against_brute_force(spark, limit):
    rng = random.Random(limit)
    rows = [(c, t, rng.choice(["user", "assistant", None]) if t % 3 == 2 else "user", rng.choice(["", "é", None, "yes", "no"]) if t > 2 else "hello") for c in range(60) for t in range(rng.choice([1, 2, 6, 9, 12]))]
    rows += [(70 + 5 * c, t, "user", f"long {t}") for c in range(3) for t in range(40 + c)]  # one path goes on where another ends
    rows += [(200 + c, t, "user", f"same {t}") for c in range(30) for t in range(4)]
    rows += [(300, None, "system", "first"), (300, 0, "user", "b"), (300, 0, "user", "a"), (300, 0, "user", "a"), (None, 1, "user", "nobody's")]
    got = prefix_trie(spark.createDataFrame([(*r, "p", "u", 3) for r in rows], TURNS), limit)
    assert sorted(map(tuple, got.collect()), key=str) == _trie(rows)


def test_conversation_trie_edges(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie(empty).collect() == []
    # Of conversation 8 nothing is left: its turns are replaced by those of 5, which isn't there.
    assert zlib.crc32(b"8") % 9 > 1
    rows = [(8, 0, "user", "gone")]
    got = prefix_trie(spark.createDataFrame([(*r, "p", "u", 3) for r in rows], TURNS)).collect()
    assert [tuple(r) for r in got] == [(8, 0, None, 1, 0, 1, 0, hashlib.sha256(b"8").hexdigest())]


PAGES = "page_id long, url string, html string, sha string, digest string, payload string"
HTML = [
    (1, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (7, None, "<p>one</p>"), (3, "http://c/", None), (4, "http://d/", ""), (5, "http://e/\r\nX-Page-Id: 9", "\r\n\r\nWARC/1.1\r\n\r\n" * 3),
    (6, "http://f/", "é\U0001f600" * 20_000), (8, "http://g/", "é\U0001f600" * 20_000), (9, "http://h/", "twice"), (9, "http://h/", "twice"), (None, "http://i/", "<p>one</p>"), (None, "http://j/", "nobody's"),
]


def _frame(spark):
    return spark.createDataFrame([(*r, "s", "d", "p") for r in HTML], PAGES)


def _told(min_bytes):
    payloads = [(p, (h or "").encode()) for p, _, h in HTML]
    out = []
    for page, raw in payloads:
        top = max((p for p, r in payloads if r == raw), key=lambda p: -1 if p is None else p)
        own = len(raw) < min_bytes or page == top
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if own else "revisit", None if own else top))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes, chunk_bytes", [(0, 256 << 10), (0, 7), (11, 1000)])
def test_archives_read_back(spark, min_bytes, chunk_bytes):
    assert sorted(map(tuple, archived(_frame(spark), min_bytes, chunk_bytes).collect()), key=str) == _told(min_bytes)


def test_archives_keep_every_byte(spark, tmp_path):
    folder = f"file://{tmp_path}/archives"
    write_warc(_frame(spark), folder, chunk_bytes=1000, archive_bytes=2000)
    names = os.listdir(f"{tmp_path}/archives")
    assert len(names) > 1 and all(n.endswith(".warc.gz") for n in names)  # rolled over, and nothing is left of the tasks' own files
    chunks = read_chunks(spark, folder, chunk_bytes=999).collect()
    got = {}
    for r in sorted(chunks, key=lambda r: (r["record_id"], r["chunk_no"])):
        assert len(r["data"]) <= 999
        got.setdefault((r["page_id"], r["record_type"]), []).append(r)
    for (page, kind), rows in got.items():
        raw = b"".join(r["data"] for r in rows)
        want = next((h or "").encode() for p, _, h in HTML if p == page and (p is not None or (h == "nobody's") == (kind == "response")))
        assert raw == (b"" if kind == "revisit" else want * (2 if page == 9 else 1))
        if kind == "response" and page != 9:  # digests and sizes of what has come so far
            upto = 0
            for r in rows:
                upto += len(r["data"])
                assert (r["payload_bytes"], r["payload_digest"]) == (upto, base64.b32encode(hashlib.sha1(raw[:upto]).digest()).decode())
    whole = b"".join(gzip.open(f"{tmp_path}/archives/{n}").read() for n in names)
    assert whole.count(b"WARC/1.1\r\nWARC-Type") == len(HTML)
    assert read_records(spark, folder).filter("target_uri like '%X-Page-Id%'").count() == 1  # a line break in a url adds no field


def test_broken_archives_are_told(spark, tmp_path):
    folder = f"file://{tmp_path}/archives"
    write_warc(_frame(spark).filter("page_id = 6"), folder)
    path = next(f"{tmp_path}/archives/{n}" for n in os.listdir(f"{tmp_path}/archives"))
    whole = gzip.open(path).read()
    for broken in (whole[:-300], whole.replace("é".encode(), "è".encode(), 1)):
        with open(f"{tmp_path}/broken.gz", "wb") as f:
            f.write(gzip.compress(broken))
        with open(f"{tmp_path}/broken.gz", "rb") as f, pytest.raises(CorruptArchive):
            list(records(f, 1000, True))
    with open(path, "rb") as f:
        cut = f.read()[:-20]
    with open(f"{tmp_path}/cut.gz", "wb") as f:
        f.write(cut)
    with open(f"{tmp_path}/cut.gz", "rb") as f, pytest.raises(CorruptArchive):
        list(records(f, 1000, True))


def test_no_pages(spark):
    assert archived(spark.createDataFrame([], PAGES)).collect() == []

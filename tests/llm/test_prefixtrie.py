import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from judgelake.llm import prefixtrie as P
from judgelake.llm.queries_prefixtrie import rebuilt

SCHEMA = "conv_id long, turn long, role string, text string, pos int, id string, size long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def ordered(rows):
    """conv -> (role, text) turns, by turn (null first), then by digest."""
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            r, x = role or "", text or ""
            said[conv].append(((turn is not None, turn or 0), sha(f"{len(r)}:{r}{x}")[:32], (r, x)))
    return {c: [t[-1] for t in sorted(ts)] for c, ts in said.items()}


def brute(convs):
    members = defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    out = {}
    for path, ms in members.items():
        below = [q for q in members if q[:len(path)] == path]
        kids = {q[:-1] for q in members if q}
        ends = sorted(c for c in ms if len(convs[c]) == len(path))
        out[min(ms), len(path)] = (min(members[path[:-1]]) if path else None, len(ms), sum(q[:-1] == path for q in members if q),
                                   sum(q not in kids for q in below), sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q), sha(",".join(map(str, ends))))
    return out


def got(df):
    rows = df.collect()
    assert len({(r.conv_id, r.depth) for r in rows}) == len(rows)
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 9) for r in rows], SCHEMA)  # with names the operator uses itself


def some(seed, n):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-50, 10_000), n):
        head = [rng.choice("ab") for _ in range(rng.randrange(0, 9))]
        for k, x in enumerate(head if c % 3 else ["a"] * rng.choice([1, 4, 5, 7])):
            rows.append((c, rng.choice([k, k, None]) if c % 5 == 0 else k, rng.choice(["u", None, ""]) if c % 7 == 0 else "u", x * (1 + k) if c % 11 else None))
    return rows + rows[:4]


@pytest.mark.parametrize("block", [2, 8])
def test_against_brute_force(spark, block):
    rows = some(block, 60)
    rows += [(20_000 + k, t, "u", f"same {t} é𝄞") for k in range(12) for t in range(7)]  # a large group of copies
    rows += [(30_000, t, "u", "ab"[t % 2]) for t in range(40)] + [(30_001, t, "u", "ab"[t % 2] if t < 9 else "z") for t in range(20)]
    rows += [(None, 1, "u", "no conversation"), (40_000, None, None, None)]
    assert got(P.prefixes(frame(spark, rows), block=block)) == brute(ordered(rows))


def test_rebuilt_conversations(spark):
    rng, rows = random.Random(4), some(11, 50)
    for c in [0, 100, 101, 102, 103, 104, 105, 150, 199, 300, 307, 5001, 5002, -3]:  # 300 is a base, 5000 is absent
        rows += [(c, t, "u", rng.choice("pq")) for t in range(2 if c == 100 else rng.randrange(1, 9))]
    own = ordered(rows)
    want = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, own.get(c - (abs(c) % 100) * (1 if c > 0 else -1), [])
        want[c] = base[:h] + turns[h:]
    assert any(not t for t in want.values())  # some are left without turns
    assert got(P.trie(*rebuilt(frame(spark, rows)), block=2)) == brute(want)


def test_long_conversations_are_numbered_in_buckets(spark):
    turns = list(range(-1500, 3000, 3)) + [None, None]
    random.Random(2).shuffle(turns)
    rows = [(1, t, "u", str(t)) for t in turns] + [(2, 5, "u", "x")]
    out = P.turn_ids(frame(spark, rows)).filter("conv = 1")
    ids = {sha(f"1:u{t}")[:32]: t for t in turns}
    seen = [ids[r.h] for r in out.orderBy("pos").select(F.lower(F.hex("id")).alias("h")).collect()]
    assert seen == [None, None] + sorted(t for t in turns if t is not None)
    assert [r.pos for r in out.orderBy("pos").collect()] == list(range(1, len(turns) + 1))


def test_many_ends_of_one_node_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE", 4)
    rows = [(c, 1, "u", "hi") for c in [*range(-9, 30), 10**12]]
    assert got(P.prefixes(frame(spark, rows))) == brute(ordered(rows))


def test_empty_table(spark):
    assert P.prefixes(frame(spark, []).limit(0)).count() == 0
    assert P.trie(*rebuilt(frame(spark, []))).count() == 0

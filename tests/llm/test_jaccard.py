import random
import re
from itertools import combinations

import numpy as np

from judgelake.llm import jaccard as J

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets, root = {}, {k: k for k, _ in docs if k is not None}
    for k, t in docs:
        sets.setdefault(k, []).append(plain(t))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(root), 2):
        if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return sorted(((k, len(plain(t)), find(k) if k is not None else None) for k, t in docs), key=repr)


def corpus(rng, n):
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(300))
    passage = [word() for _ in range(60)]
    docs, k = [], 0
    while k < n:
        size = rng.choice((1, 3, 5, 6, 7, 8, 9, 11, 15, 30, 60, 120))
        base = [word() for _ in range(size)]
        kind = rng.randrange(4)
        if kind == 0:
            base += passage
        if kind == 1:
            base = passage[:rng.randrange(20, 60)] + base[:8]
        for _ in range(rng.choice((1, 1, 2, 3, 40 if kind == 2 else 1))):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
                copy[rng.randrange(len(copy))] = word()
            docs.append((k, " ".join(copy)))
            k += 1
    return docs


def test_fingerprints_stand_for_plain_shingles():
    rng = random.Random(1)
    texts = [t for _, t in corpus(rng, 60)] + ["A b\tC\x0bd E", "a B c d e", "", "   ", None, "É é x y z \x1c w", "one"]
    for x, y in combinations(texts, 2):
        a, b = J.shingles(x), J.shingles(y)
        assert len(a) == len(plain(x)) and len(np.intersect1d(a, b)) == len(plain(x) & plain(y))


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 62, size=n).astype(np.uint64)) for n in (1, 40, 170, 171, 900, 5000)]
    sets += [np.unique(np.concatenate([x[: len(x) // 2], sets[1]])) for x in sets]
    pairs = [(a, b) for a in sets for b in sets]
    apart = J.sketch_distances([J.sketch(a).tobytes() for a, _ in pairs], [J.sketch(b).tobytes() for _, b in pairs])
    true = [len(np.setxor1d(a, b)) for a, b in pairs]
    assert all(d <= t for d, t in zip(apart, true)) and all(d == 0 for d, (a, b) in zip(apart, pairs) if a is b)
    assert len(J.sketch_distances([], [])) == 0


def test_every_similar_size_pair_shares_a_scheme():
    for n in range(1, 400):
        for s in range(n, 4 * n // 3 + 1):
            mine, other = {x[0]: x for x in J.schemes(n)}, {x[0]: x for x in J.schemes(s)}
            apart = n + s - 2 * -(-3 * (n + s) // 7)
            if 4 * n >= 3 * s:
                both = mine.keys() & other.keys()
                assert any(min(mine[k][1], other[k][1]) >= apart and mine[k][2] == other[k][2] for k in both), (n, s)


def test_components_against_brute_force(spark):
    for seed in (3, 4):
        docs = corpus(random.Random(seed), 420)
        docs += [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one TWO"), docs[0], docs[5], (None, docs[7][1]), (docs[9][0], "other words here now then")]
        docs += [(905, "w " * 40_000 + "end"), (906, "w " * 30_000 + "end"), *((2000 + i, docs[11][1]) for i in range(50))]
        df = spark.createDataFrame([(a, b, 1, "x") for a, b in docs], "doc_id long, text string, n int, sketch string")
        got = sorted((tuple(r) for r in J.classes(df.repartition(7)).collect()), key=repr)
        assert got == brute(docs)


def test_tight_sets_lose_no_link(spark, monkeypatch):
    """With hardly any subset counting as light and no pair ahead of the others, nearly all sets are tight."""
    monkeypatch.setattr(J, "HEAVY", 2)
    monkeypatch.setattr(J, "EARLY", 9.0)
    docs = corpus(random.Random(6), 500)
    got = sorted((tuple(r) for r in J.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()), key=repr)
    assert got == brute(docs)


def test_sets_that_share_a_passage_only_are_in_no_pair(spark, monkeypatch):
    """A set whose lists together have fewer subsets than it needs stays out of them all."""
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = text(30)
    docs = [(k, f"{text(90)} {passage} {text(90)}") for k in range(30)]
    seen, real = [], J._light_pairs
    monkeypatch.setattr(J, "_light_pairs", lambda placed: seen.append(placed.count()) or real(placed))
    got = J.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert seen == [0] and sorted((tuple(r) for r in got), key=repr) == brute(docs)


def test_empty_table(spark):
    assert J.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pairs_that_share_a_passage_only_do_not_leave_the_lists(spark, monkeypatch):
    """Sets with enough subsets in common to be counted, which their sketches tell apart; near copies are met."""
    class Counted:
        def __init__(self, df):
            self.df = df

        def select(self, *columns):
            return Counted(self.df.select(*columns))

        def mapInArrow(self, *args):  # noqa: N802
            made.append(self.df.mapInArrow(*args).count())
            return self.df.mapInArrow(*args)

    rng, made, real = random.Random(5), [], J._light_pairs
    word = lambda: f"w{rng.randrange(10 ** 6)}"
    passage = [word() for _ in range(380)]
    texts = [passage + [word() for _ in range(230)] for _ in range(60)]
    for k in range(0, 60, 6):
        near = list(texts[k])
        near[140], near[450] = word(), word()
        texts.append(near)
    monkeypatch.setattr(J, "_light_pairs", lambda placed: real(Counted(placed)))
    got = {r.doc_id: r.component_id for r in J.classes(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert got == {k: k for k in range(60)} | {60 + i: k for i, k in enumerate(range(0, 60, 6))}
    assert made and made[0] < 100

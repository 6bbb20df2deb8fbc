import random
import re

from judgelake.llm import decontaminate as D

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for k, text in docs:
        w, hit, named = plain(text), set(), set()
        for item, t in items:
            v = plain(t)
            for s in range(max(1, len(v) - 9)) if v and item is not None else ():
                g = v[s:s + 10]
                for p in range(len(w) - len(g) + 1):
                    if w[p:p + len(g)] == g:
                        hit |= set(range(p, p + len(g)))
                        named.add(str(item))
        out.append((k, len(w), len(hit), tuple(sorted(named))))
    return out


def test_against_brute_force(spark):
    rng = random.Random(7)
    vocab = ["the", "of", "Été", "ß2", "x", "rare1", "rare2", "a"] + [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choices(vocab, weights=[40, 20, 9, 9, 9, 1, 1, 9] + [1] * 30, k=n))
    items = [(i, text(rng.choice((1, 2, 3, 7, 10, 11, 25)))) for i in range(2, 30)] + [(30, None), (31, " .. "), (None, "the of"), (10, "The, OF")]
    docs = [(i, f"{text(rng.randrange(40))}, {rng.choice(items)[1] or ''}. {text(5)}") for i in range(60)]
    docs += [(60, None), (61, ""), (62, " - "), (7, "a the of"), docs[3], docs[3], (None, items[5][1]), (63, items[6][1] + " x" * 50_000)]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, words int")
    out = D.scan(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in out), key=repr)
    assert got == sorted(brute(docs, items), key=repr) and any(g[2] for g in got)


def test_proximity_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "alpha x x x beta gamma"), (3, "alpha beta gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "alpha beta gamma")], "item_id long, text string")
    hits = lambda slop: sorted(r.doc_id for r in D.scan(docs, items, slop=slop).filter("n_hit > 0").collect())
    assert hits(0) == [3] and hits(1) == [1, 3] and hits(3) == [1, 2, 3]
    assert D.scan(docs.limit(0), items).count() == 0
    assert [(r.n_hit, r["items"]) for r in D.scan(docs, items.limit(0)).collect()] == [(0, [])] * 3

"""Window cutting, site merging, symbol cut and halves on small units."""

import random

from judgelake.operators import units as U

ENTRY = "unit_id int, file string, pos int, kind string, new_line int, old_line int, head_line int, hunk_start int, text string"


def cut_windows(entries, n):
    """A plain loop over one unit: the expected window starts."""
    def at(e):
        return e[5] if e[3] == "-" else e[4]
    groups, run, start = [], [], None
    for e in entries:
        start = at(e) if start is None else start
        if run and at(e) - start + 1 > n:
            cut = len(run)
            for k in reversed(range(1, len(run))):
                if at(run[k]) - start + 1 > n:
                    break
                if not run[k][8].strip():
                    cut = k + 1
                    break
            groups.append(run[:cut])
            run = run[cut:]
            start = at(run[0]) if run else None
        run.append(e)
    groups.append(run)
    out = []
    for g in groups:
        if out and all(e[3] == " " for e in g):
            out[-1] = out[-1] + g
        else:
            out.append(g)
    return out


def random_unit(rng, uid):
    rows, new, old = [], rng.randrange(1, 50), rng.randrange(1, 50)
    for pos in range(rng.randrange(1, 60)):
        kind = rng.choice("+- ")
        rows.append((uid, "a.py", pos, kind, None if kind == "-" else new, None if kind == "+" else old, new, 1, rng.choice(["x", "y", "  ", ""])))
        new += kind != "-"
        old += kind != "+"
        if rng.random() < 0.1:
            new, old = new + 7, old + 7
    return rows


def test_line_windows_equal_the_plain_loop(spark):
    rng = random.Random(3)
    units = {u: random_unit(rng, u) for u in range(150)}
    df = spark.createDataFrame([e for u in units.values() for e in u], ENTRY)
    got = {}
    for r in U.line_windows(df, 10).collect():
        got.setdefault(r.unit_id, {})[r.pos] = r.win
    for u, rows in units.items():
        groups = cut_windows(rows, 10)
        if len(groups) < 2 or all(e[3] == " " for e in rows):
            assert u not in got
        else:
            assert got[u] == {e[2]: w for w, g in enumerate(groups, 1) for e in g}


def test_site_parts_glue_and_merge(spark):
    e = [(1, "a.py", p, "+" if p % 2 else " ", p + 1, None if p % 2 else p + 1, p + 1, 1, "x") for p in range(40)]
    sites = [("a.py", "s1", 1, 10, 0), ("a.py", "s2", 12, 13, 0), ("a.py", "s3", 20, 40, 0), ("a.py", "deep", 30, 31, 3)]
    df, st = spark.createDataFrame(e, ENTRY), spark.createDataFrame(sites, "file string, site_id string, start int, end int, depth int")
    fine = {r.part for r in U.site_parts(df, st, 1).collect()}
    assert fine == {"s1", "s2", "s3", "deep"}
    rows = U.site_parts(df, st, 9).collect()
    assert len(rows) == 40 and {r.part for r in rows} < fine
    assert {r.part for r in U.site_parts(df, st, 100).collect()} == {None}


def test_symbol_cut_parts(spark):
    e = [(1, "a.py", 0, "+", 2, None, 2, 1, "x"), (1, "a.py", 1, "+", 9, None, 9, 1, "stray"), (1, "a.py", 2, "-", None, 3, 10, 1, "y"), (1, "a.py", 3, "+", 12, None, 12, 1, "z"),
         (1, "a.py", 4, "-", None, 30, 13, 1, "gone"), (1, "a.py", 5, "-", None, 50, 13, 1, "l1"), (1, "a.py", 6, "-", None, 52, 13, 1, "l2"), (1, "a.py", 7, "-", None, 60, 13, 1, "l3")]
    s = [("a.py", "after", "f", 1, 5, 0), ("a.py", "after", "g", 11, 15, 0), ("a.py", "before", "g", 1, 5, 0), ("a.py", "before", "h", 29, 31, 0)]
    got = U.symbol_cut(spark.createDataFrame(e, ENTRY), spark.createDataFrame(s, "file string, side string, name string, start int, end int, depth int"))
    assert {r.pos: r.part for r in got.collect()} == {0: "post:1", 1: "post:11", 2: "post:11", 3: "post:11", 4: "pre:29", 5: "loose:1", 6: "loose:1", 7: "loose:2"}


def test_halves(spark):
    def unit(uid, kinds):
        return [(uid, "a.py", p, k, p + 1, p + 1, p + 1, 1, "x") for p, k in enumerate(kinds)]
    df = spark.createDataFrame(unit(1, " +-+ ") + unit(2, "+") + unit(3, "  + ") + unit(4, "+ "), ENTRY)
    got = {}
    for r in U.halves(df).collect():
        got.setdefault(r.unit_id, {})[r.pos] = r.half
    assert got == {1: {0: 1, 1: 1, 2: 2, 3: 2, 4: 2}, 3: {2: 2, 3: 2}}


def settle(groups, floor):
    """Rounds of merging by plain loops: (lo, hi, name, members), each round at once."""
    groups = sorted(groups)
    while len(groups) > 1 and any(g[1] - g[0] + 1 < floor for g in groups):
        to = []
        for i, g in enumerate(groups):
            others = [(min(abs(o[0] - g[0]), abs(o[1] - g[1])), j) for j, o in enumerate(groups) if j != i]
            to.append(min(others)[1] if g[1] - g[0] + 1 < floor else i)
        to = [i if to[j] == i and i < j else j for i, j in enumerate(to)]
        merged = {}
        for i, g in enumerate(groups):
            r = i
            while to[r] != r:
                r = to[r]
            merged.setdefault(r, []).append(g)
        groups = sorted((min(g[0] for g in m), max(g[1] for g in m), groups[r][2], sum((g[3] for g in m), [])) for r, m in merged.items())
    return {n: g[2] for g in groups for n in g[3]} if len(groups) > 1 else {}


def test_floor_merges_until_stable(spark):
    rng, reach, want = random.Random(6), [], {}
    for u in range(150):
        spans = [(lo, lo + rng.choice([0, 0, 1, 5, 30])) for lo in rng.sample(range(200), rng.randrange(1, 25))]
        names = [f"s{k:02}" for k in rng.sample(range(99), len(spans))]
        reach += [(u, n, lo, hi) for n, (lo, hi) in zip(names, spans)]
        for floor in (1, 7, 16, 64):
            want[u, floor] = settle([(lo, hi, n, [n]) for n, (lo, hi) in zip(names, spans)], floor)
    got = {k: {} for k in want}
    for r in U._hosts(spark.createDataFrame(reach, "unit_id int, site_id string, lo int, hi int"), (1, 7, 16, 64)).collect():
        got[r.unit_id, r.size_floor][r.site_id] = r.part
    assert got == want and sum(len(set(v.values())) > 1 for (_, f), v in want.items() if f == 16) > 20
    for (u, floor), hosts in want.items():  # no group under the floor is left
        ends = {}
        for v, n, lo, hi in reach:
            if v == u and hosts:
                ends.setdefault(hosts[n], []).append((lo, hi))
        assert all(max(h for _, h in e) - min(lo for lo, _ in e) + 1 >= floor for e in ends.values())


def test_deletions_and_single_sites_are_not_cut(spark):
    sites = spark.createDataFrame([("a.py", "s1", 1, 30, 0), ("a.py", "s2", 40, 70, 0)], "file string, site_id string, start int, end int, depth int")
    gone = [(1, "a.py", p, "-", None, p + 1, 1, 1, "x") for p in range(70)]
    one = [(2, "a.py", p, "+", p + 1, None, p + 1, 1, "x") for p in range(30)]
    two = [(3, "a.py", p, "+" if p < 30 or p > 40 else " ", p + 1, p + 1, p + 1, 1, "x") for p in range(70)]
    df = spark.createDataFrame(gone + one + two, ENTRY)
    got = {}
    for r in U.site_parts(df, sites, 16).collect():
        got.setdefault(r.unit_id, {})[r.pos] = r.part
    assert set(got[1].values()) == {None} and set(got[2].values()) == {None} and len(got[1]) == 70
    assert [got[3][p] for p in (0, 29, 32, 38, 69)] == ["s1", "s1", "s1", "s2", "s2"] and len(got[3]) == 70
    rows = {r.size_floor: r for r in U.site_census(df, sites, (16, 64)).collect()}
    assert (rows[16].n_clusters, rows[16].n_sites, rows[16].median_span, rows[16].outcome, rows[16].chosen) == (3, 4, 35, "pass", True)
    assert (rows[64].n_sites, rows[64].median_span, rows[64].chosen) == (3, 30, False)

import numpy as np
import pytest

from judgelake.llm import neardup as N


def brute(rows):
    """Links between distinct rows by plain cosines."""
    seen = list({(k, lab, None if v is None else tuple(v)): None for k, v, lab in rows})
    ok = [r for r in seen if r[0] is not None and r[1] is not None and r[2] and all(x is not None and np.isfinite(x) for x in r[2]) and any(r[2])]
    unit = [np.array(v, float) / np.linalg.norm(v) for _, _, v in ok]
    return {frozenset((i, j)) for i in range(len(ok)) for j in range(i) if ok[i][1] == ok[j][1] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93}, ok


def rows_of(rng, n, d=32):
    base, rows, k = rng.normal(size=(n, d)), [], 0
    for x in base:
        for _ in range(rng.choice([1, 1, 1, 2, 3, 6])):
            rows.append((k, (x + rng.normal(size=d) * rng.choice([0, 0.1, 0.25, 0.3])).astype(np.float32).tolist(), int(rng.integers(3))))
            k += 1
    return rows


def test_recall_and_precision_against_brute_force(spark):
    rows = rows_of(np.random.default_rng(2), 500)
    links, ok = brute(rows)
    out = {r.vec_id: r for r in N.links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    want = dict.fromkeys(range(len(rows)), 0)
    for pair in links:
        for i in pair:
            want[ok[i][0]] += 1
    got = {k: r.n_links for k, r in out.items()}
    assert all(got[k] <= want[k] for k in want) and sum(got.values()) >= 0.9 * sum(want.values()) > 100
    assert all(r.kept == (k == r.component_id) and r.component_id <= k and out[r.component_id].component_id == r.component_id for k, r in out.items())


def test_one_large_group_is_met_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 40)
    rng = np.random.default_rng(1)
    x = rng.normal(size=16)
    rows = [(i, (x + rng.normal(size=16) * 0.01).tolist(), 1) for i in range(300)] + [(1000 + i, x.tolist(), 1) for i in range(100)]
    out = N.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(out) == 400 and {r.component_id for r in out} == {0} and sum(r.kept for r in out) == 1
    assert np.mean([r.n_links for r in out]) > 0.97 * 399 and max(r.n_links for r in out) <= 399


def test_unusable_vectors_repeats_and_empty_table(spark):
    e, nan = [1.0, 0.0, 2.0], float("nan")
    rows = [(5, e, 1), (5, e, 1), (3, e, 1), (7, [2.0, 0.0, 4.0], 1), (8, e, 2), (9, None, 1), (10, [0.0, 0.0, 0.0], 1), (11, [1.0, None, 2.0], 1), (12, [1.0, nan, 2.0], 1),
            (13, [1.0, 0.0, float("inf")], 1), (14, e, None), (None, e, 1), (15, [], 1), (16, [1.0, 0.0], 1), (17, [1e300, 0.0, 2e300], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, rep string")
    out = sorted((tuple(r) for r in N.links(df).collect()), key=repr)
    linked = [(3, 3, 3, True), (5, 3, 3, False), (5, 3, 3, False), (7, 3, 3, False), (17, 3, 3, False)]
    alone = [(k, 0, k, True) for k in (8, 9, 10, 11, 12, 13, 14, 15, 16, None)]
    assert out == sorted(linked + alone, key=repr)
    assert N.links(df.limit(0)).count() == 0


def test_negative_zeros_are_zeros(spark):
    rows = [(1, [-0.0, 1.0, 2.0], 1), (2, [0.0, 1.0, 2.0], 1), (3, [-0.0, 1.0, 2.1], 1), (4, [-0.0, 1.0, 2.0], 1), (5, [-0.0, -0.0, 0.0], 1)]
    out = sorted(tuple(r) for r in N.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert out == [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 3, 1, False), (5, 0, 5, True)]


def near(rng, x, cos):
    """Vectors of the cosine ``cos`` to each row of ``x``, in random directions."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    g = rng.normal(size=x.shape)
    g -= (g * x).sum(axis=1, keepdims=True) * x
    return cos * x + np.sqrt(1 - cos * cos) * g / np.linalg.norm(g, axis=1, keepdims=True)


@pytest.mark.parametrize("sizes", [(8, 12), (7, 16, 33)])
def test_vectors_of_several_lengths_link_among_their_own(spark, sizes):
    rng, rows = np.random.default_rng(4), []
    for d in sizes:
        x = rng.normal(size=(40, d))
        for v in np.concatenate([x, near(rng, x, 0.99)]):
            rows.append((len(rows), v.tolist(), 1))
    links, ok = brute(rows)
    out = {r.vec_id: r.n_links for r in N.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = dict.fromkeys(out, 0)
    for pair in links:
        for i in pair:
            want[ok[i][0]] += 1
    assert all(out[k] <= want[k] for k in want) and sum(out.values()) >= 0.9 * sum(want.values()) >= 0.9 * 80 * len(sizes)


@pytest.mark.parametrize("d", [256])
def test_recall_off_the_leading_axes_of_long_vectors(spark, d):
    rng = np.random.default_rng(6)
    axes, _ = np.linalg.qr(rng.normal(size=(d, d)))
    lead, off = rng.normal(size=(1500, 64)) @ axes[:, :64].T, rng.normal(size=(40, 8)) @ axes[:, -8:].T
    groups = {"lead": np.concatenate([lead[:40], near(rng, lead[:40], 0.935)]), "off": np.concatenate([off, near(rng, off, 0.935)])}
    x = np.concatenate([groups["lead"], groups["off"], lead[40:]])
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    out = {r.vec_id: r.n_links for r in N.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert sum(out[k] > 0 for k in range(80)) >= 0.9 * 80 and sum(out[k] > 0 for k in range(80, 160)) >= 0.9 * 80

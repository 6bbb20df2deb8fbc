"""Streams over appended files: ties, late and replayed batches, size of the store."""

import json
import random
from pathlib import Path

import pytest

from judgelake.streaming import ledger_stream as LS

SCHEMA = "label string, ts bigint, value bigint"


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))


def last_of(files):
    """label -> value of the last record by (ts, file, line)."""
    best = {}
    for name, rows in sorted(files.items()):
        for k, r in enumerate(rows):
            best[r["label"]] = max(best.get(r["label"], (-1,)), (r["ts"], name, k, r["value"]))
    return {k: v[-1] for k, v in best.items()}


def run(spark, src, store, check, folders=3):
    LS.start_latest(LS.read_ledger_stream(spark, str(src), SCHEMA, 1), str(store), str(check), folders=folders).awaitTermination()
    return {r.label: r.value for r in LS.latest(spark, str(store)).collect()}


def test_equal_times_late_records_and_restarts(spark, tmp_path):
    rng, src, files = random.Random(3), tmp_path / "in", {}
    for n in range(11):
        rows = [{"label": f"l{rng.randrange(6)}", "ts": rng.choice([5, 5, 5, n, 0]), "value": 100 * n + k} for k in range(40)]
        files[f"f{n:02}"] = rows
        put(src, f"f{n:02}", rows)
        if n in (0, 4, 10):  # a new run of the query goes on where the last one stopped
            assert run(spark, src, tmp_path / "store", tmp_path / "check") == last_of(files)


def test_store_follows_the_keys(spark, tmp_path):
    for n in range(14):
        put(tmp_path / "in", f"f{n:02}", [{"label": f"l{k}", "ts": n, "value": n} for k in range(5)])
        run(spark, tmp_path / "in", tmp_path / "store", tmp_path / "check")
    there = LS._folders(spark, str(tmp_path / "store"))
    base, live = LS._live(there)
    assert base == 11 and len(there) <= 2 * (3 + 1) and len(live) == 3
    assert spark.read.parquet(there[base, "base"]).count() == 5


def test_replayed_batches_count_once(spark, tmp_path):
    store, done = tmp_path / "store", []
    batches = [[("a", 10 * n + k, k, (n + k) % 3 > 0) for k in range(7)] + [("b", n, n, True), (None, n, n, False)] for n in range(6)]

    class Stream:  # hands the writer its batches, some of them more than once
        class writeStream:
            @staticmethod
            def foreachBatch(write):
                for n in [0, 0, 1, 2, 2, 1, 3, 4, 3, 5, 5, 0]:
                    if n <= len(done):
                        write(spark.createDataFrame(batches[n], "class string, ts bigint, id bigint, sustained boolean"), n)
                        done.append(n) if n == len(done) else None
                raise StopIteration

    with pytest.raises(StopIteration):
        LS.start_class_state(Stream, str(store), "", window=10, folders=2)
    got = {r["class"]: r for r in LS.class_state(spark, str(store), 10).collect()}
    every = [r for b in batches for r in b]
    for name in ("a", "b", None):
        mine = sorted((r[1:] for r in every if r[0] == name), reverse=True)
        assert (got[name].n_adjudicated, got[name].n_sustained, got[name].n_last) == (len(mine), sum(m[2] for m in mine), min(10, len(mine)))
        assert got[name].recent_rate == sum(m[2] for m in mine[:10]) / min(10, len(mine))


def test_half_written_folders_do_not_count(spark, tmp_path):
    put(tmp_path / "in", "f0", [{"label": "a", "ts": 1, "value": 1}])
    run(spark, tmp_path / "in", tmp_path / "store", tmp_path / "check")
    broken = tmp_path / "store" / "base-9"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"half")
    put(tmp_path / "in", "f1", [{"label": "a", "ts": 2, "value": 2}, {"label": "a", "ts": 2, "value": 3}])
    assert run(spark, tmp_path / "in", tmp_path / "store", tmp_path / "check") == {"a": 3}
    assert not Path(tmp_path / "store" / "base-9" / "_SUCCESS").exists()

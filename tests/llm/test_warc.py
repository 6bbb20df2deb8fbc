import gzip
import hashlib
import io
import random

import pytest

from judgelake.llm import warc as W

SCHEMA = "page_id long, url string, html string, shard int, digest string"


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def brute(rows, least=100):
    out, first = [], {}
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    for num, url, html in sorted(rows, key=key):
        size, digest = len((html or "").encode()), sha(html)
        if size >= least and digest in first:
            out.append((num, url, size, digest, "revisit", first[digest]))
        else:
            out.append((num, url, size, digest, "response", None))
            first.setdefault(digest, num)
    return sorted(out, key=repr)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(parts)


def got(df):
    return sorted(((r.row_id, r.target_uri, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_row) for r in df.collect()), key=repr)


@pytest.fixture()
def rows():
    rng = random.Random(1)
    rows = [(k, f"http://h/{k}", f"<p>{'é𝄞x' * 40}{rng.randrange(9)}</p>" if k % 2 else f"{k % 5}") for k in rng.sample(range(-20, 500), 150)]
    rows += [(None, "http://n", "n" * 100), (None, None, "n" * 100), (9000, None, "n" * 100), (9001, "u", None), (9002, "", ""), (9003, "u", "z" * 99), (9004, "u", "z" * 99)]
    rows += [(9010, "u", "w" * 200), (9010, "u", "w" * 200), (9010, "a", "w" * 200), (9010, None, "w" * 200), (9011, "u", "w" * 200)]
    rows += [(9020, "http://x", "a\r\n\r\nContent-Length: 3\r\nWARC/1.1 " * 5)]
    return rows + [(10_000 + k, "http://hot", "hot" * 50) for k in range(80)] + [(9500, "u", "long " * 300_000)]


def test_round_trip_against_brute_force(spark, tmp_path, rows):
    W.write(frame(spark, rows), str(tmp_path / "a"), shards=5, roll_bytes=3000)
    back = W.read(spark, str(tmp_path / "a"), content=True)
    assert got(back) == brute(rows)
    got_rows = back.collect()
    assert len({r.record_id for r in got_rows}) == len(rows)
    responses = {r.record_id: r for r in got_rows if r.record_type == "response"}
    assert all(hashlib.sha256(r.content).hexdigest() == r.payload_digest for r in responses.values())
    for r in got_rows:
        if r.record_type == "revisit":
            assert r.content is None and responses[r.refers_to].payload_digest == r.payload_digest and responses[r.refers_to].row_id == r.refers_to_row
    # any record can be read from its offset alone
    one = responses[min(responses)]
    data = (tmp_path / "a" / one.file).read_bytes()[one.offset:]
    assert data[:2] == b"\x1f\x8b" and one.content in next(W._members(io.BytesIO(data)))[1]


def test_files_depend_on_the_rows_only(spark, tmp_path, rows):
    for k, parts in enumerate((1, 7)):
        W.write(frame(spark, random.Random(k).sample(rows, len(rows)), parts), str(tmp_path / str(k)), shards=4, roll_bytes=2000)
    files = [{f.name: f.read_bytes() for f in (tmp_path / str(k)).glob("*.warc.gz")} for k in (0, 1)]
    assert files[0] == files[1] and len(files[0]) > 8
    listed = {r.file: r for r in W.manifest(spark, str(tmp_path / "0")).collect()}
    assert {(n, len(d), hashlib.sha256(d).hexdigest()) for n, d in files[0].items()} == {(r.file, r.bytes, r.sha256) for r in listed.values()}
    assert sum(r.records for r in listed.values()) == len(rows) and all(r.bytes <= 2000 or r.records == 1 for r in listed.values())
    assert len({r.shard for r in listed.values()}) == 4 and not (tmp_path / "0" / W.PARTS).exists()
    # ranges: ids of a shard lie before those of the next
    first = [min((r.row_id is not None, r.row_id or 0) for r in W.read(spark, str(tmp_path / "0")).collect() if listed[r.file].shard == s) for s in range(4)]
    assert first == sorted(first)


def test_format_of_a_record(spark, tmp_path):
    W.write(frame(spark, [(5, "http://h/a b\r\nX: 1", "hi")]), str(tmp_path / "a"), shards=1)
    text = gzip.decompress((tmp_path / "a" / "records-000000-000000.warc.gz").read_bytes()).decode()
    info, record = text.split("\r\n\r\n\r\n\r\n")[0], text.split("WARC/1.1\r\n")[2]
    assert "WARC-Type: warcinfo" in info and "WARC-Filename: records-000000-000000.warc.gz" in info
    assert "WARC-Target-URI: http://h/a%20b%0D%0AX:%201\r\n" in record and f"WARC-Payload-Digest: sha256:{sha('hi')}" in record
    assert record.endswith("\r\n\r\nHTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n")


def test_leftovers_of_failed_attempts_and_repeated_commit(spark, tmp_path, rows):
    path = tmp_path / "a"
    (path / W.PARTS).mkdir(parents=True)
    (path / W.PARTS / "000000-000000-dead").write_bytes(b"half a file")
    out = W.write(frame(spark, rows), str(path), shards=2)
    assert len(list(path.glob("*.warc.gz"))) == out.count() and got(W.read(spark, str(path))) == brute(rows)
    (path / W.PARTS).mkdir()
    W.commit(spark.createDataFrame(out.collect(), out.schema), str(path))  # renames are done already
    assert got(W.read(spark, str(path))) == brute(rows)


def test_damage_is_an_error(spark, tmp_path, rows):
    W.write(frame(spark, rows), str(tmp_path / "a"), shards=1)
    file = tmp_path / "a" / "records-000000-000000.warc.gz"
    whole = file.read_bytes()
    file.write_bytes(whole[:-20])
    with pytest.raises(Exception, match="cut off|records, the manifest"):
        W.read(spark, str(tmp_path / "a")).count()


def test_large_lists_of_repeated_payloads_and_empty_table(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(W, "BROADCAST_ROWS", 0)
    W.write(frame(spark, rows), str(tmp_path / "a"), shards=3)
    assert got(W.read(spark, str(tmp_path / "a"))) == brute(rows)
    assert W.write(frame(spark, rows).limit(0), str(tmp_path / "e")).count() == 0
    assert W.read(spark, str(tmp_path / "e")).count() == 0

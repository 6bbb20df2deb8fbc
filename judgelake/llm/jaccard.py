"""Exact Jaccard join of word shingle sets by partitioning the token universe.

A pair of sets with Jaccard similarity of 3/4 or more differs in at most H shingles, where
H follows from the two sizes. Shingles are hashed to m segments (m by size band). If both
sets are cut by the same segments, at most H segments can differ, so choosing segments
whose allowances add up to more than H must meet the pair in one of them:

* allowance 1: the segment's subset is equal (its hash is a key);
* allowance 2: it is equal or one set has one shingle more (keys of the subset and of
  every subset with one deletion);
* allowance 0: the segment is passed over, as an empty one always is.

Ahead of all others, the subsets of a few segments link most copies to the first set that
shares them, after an exact check. A subset shared within one component has nothing left
to say, so what follows grows with what is still apart, not with the copies.

Cost-based allocation: subsets that few sets share are taken first. A set whose light
subsets suffice never meets anybody over a heavy one. Only sets for which they do not
(``tight`` sets) are met with each other again, over subsets of any cost and with
one-deletion neighbourhoods. Short ones are met by single shingles.

Candidates that components already join need no check. What is left is compared by odd
sketches, whose distance never exceeds the sets' difference, and then exactly on the texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from judgelake.llm.common import components, small, stored
from judgelake.llm.fingerprints import BASE as _BASE
from judgelake.llm.fingerprints import U as _U
from judgelake.llm.fingerprints import mix as _mix
from judgelake.llm.fingerprints import word_marks

SHINGLE = 5
#: A subset shared by more sets than this is heavy.
HEAVY = 256
#: Segments of each scheme whose subsets link copies ahead of all others, and the part of them
#: that a set must share with the first set to be checked against it.
EARLY_SEGMENTS, EARLY = 6, 0.25
#: Tight sets up to this size are met by single shingles.
SHORT = 24
#: Least bits of a sketch; larger sets get the next power of two above 1.5 bits a shingle.
SKETCH_BITS = 256
#: Bits of the sketch that travels with a set in the lists of light subsets.
BRIEF_BITS = 512
BROADCAST_ROWS = 200_000

def shingles(text: str | None) -> np.ndarray:
    """The distinct 5-word shingles of a whole text as sorted 64-bit fingerprints.

    Words are runs without ASCII white space, A-Z lowered. A text of fewer words is one
    shingle; null and wordless texts have none.
    """
    word = word_marks(text)
    if not len(word):
        return word
    width = min(SHINGLE, len(word))
    whole = np.full(len(word) - width + 1, _U(width))
    for i in range(width):
        whole = _mix(whole * _U(_BASE) + word[i:len(word) - width + 1 + i])
    return np.unique(whole)


def bands(longest: int) -> list[int]:
    """First sizes of the bands: a set's partners are in its own band or the next ones to it."""
    first = [1, 2]
    while first[-1] <= longest:
        first.append(max(first[-1] + 1, 4 * (first[-1] - 1) // 3 + 1))
    return first


_FIRST = np.array(bands(1 << 40))


def schemes(n: int) -> list[tuple[int, int, int]]:
    """(scheme, H, segments) of a set of ``n``: scheme k is for band k and what band k+1 meets in it."""
    k = int(np.searchsorted(_FIRST, n, "right")) - 1
    out = []
    for s in (k, k - 1):
        top = int(_FIRST[s + 1]) - 1 if s >= 0 else 0
        if s < 0 or 4 * top < 3 * n:
            continue
        most = (top + 4 * top // 3) // 7
        h = (n + min(4 * n // 3, n if s < k else 4 * n // 3)) // 7 if s == k else (n + min(top, n)) // 7
        out.append((s, h, most + 1 + most // 4 + 4))
    return out


def _segments(u: np.ndarray, scheme: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment of each shingle, its own mixed value, and the sum of values by segment."""
    seg = (_mix(u ^ _U(scheme * 0x9E37 + m)) % _U(m)).astype(np.int64)
    value = _mix(u + _U(0x51ED270B))
    total = np.zeros(m, _U)
    np.add.at(total, seg, value)
    return seg, value, total


def _key(total: np.ndarray, seg: np.ndarray, scheme: int, m: int) -> np.ndarray:
    return _mix(_mix(total) + seg.astype(_U) * _U(0xD6E8FEB86659FD93) + _U(scheme << 32 | m))


def subset_keys(u: np.ndarray, scheme: int, m: int) -> np.ndarray:
    """A key for every non-empty segment's subset."""
    seg, _, total = _segments(u, scheme, m)
    held = np.unique(seg)
    return _key(total[held], held, scheme, m)


def early_keys(u: np.ndarray, scheme: int, m: int) -> tuple[np.ndarray, int]:
    """The keys of the first ``EARLY_SEGMENTS`` segments, and how many segments hold a shingle."""
    seg = (_mix(u ^ _U(scheme * 0x9E37 + m)) % _U(m)).astype(np.int64)
    value, at = _mix(u[seg < EARLY_SEGMENTS] + _U(0x51ED270B)), seg[seg < EARLY_SEGMENTS]
    held = np.unique(at)
    total = np.array([np.add.reduce(value[at == k], dtype=_U) for k in held], _U)
    return _key(total, held, scheme, m), int(np.count_nonzero(np.bincount(seg, minlength=m)))


def deletion_keys(u: np.ndarray, scheme: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the subsets and their segments; keys of each subset of two or more without
    one shingle and their segments."""
    seg, value, total = _segments(u, scheme, m)
    held, n = np.unique(seg, return_counts=True)
    many = np.isin(seg, held[n > 1])
    return _key(total[held], held, scheme, m), held, _key(total[seg] - value, seg, scheme, m)[many], seg[many]


def sketch(u: np.ndarray, least: int = SKETCH_BITS) -> np.ndarray:
    """Parity of the shingles that fall on each bit.

    A sketch of twice the bits folds to this one by xor of its halves, so sets of different
    sizes compare at the smaller one's bits.
    """
    bits = max(least, 1 << (3 * len(u) // 2).bit_length())
    at = (_mix(u + _U(77)) & _U(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1)


def _folded(x: np.ndarray, size: int) -> np.ndarray:
    while x.shape[1] > size:
        x = x[:, :x.shape[1] // 2] ^ x[:, x.shape[1] // 2:]
    return x


def sketch_distances(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Bits by which sketches differ, pair by pair: never more than the sets do."""
    bits, out = np.array([bin(i).count("1") for i in range(256)], np.uint8), np.empty(len(a), np.int64)
    sizes = np.array([(len(x), len(y)) for x, y in zip(a, b)]).reshape(-1, 2)
    for m, n in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes == (m, n)).all(axis=1))
        x, y = (np.frombuffer(b"".join(z[i] for i in at), np.uint8).reshape(len(at), -1) for z in (a, b))
        out[at] = bits[_folded(x, min(m, n)) ^ _folded(y, min(m, n))].sum(axis=1, dtype=np.int64)
    return out


def _longs(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _parted(parts: int, keys: np.ndarray, more: dict[str, np.ndarray]) -> pa.RecordBatch:
    """part, keys and ``more`` as lists, a row for each part that has any of the keys."""
    part = (keys % _U(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) != 0]))
    split = lambda x: _lists(np.split(x[order], first[1:]))
    return pa.RecordBatch.from_arrays([pa.array(part[order][first]), split(_longs(keys)), *map(split, more.values())], names=["part", "keys", *more])


def _gathered(batches, names: list[str]) -> list[np.ndarray]:
    """The lists of a whole part, end to end."""
    held = [[batch.column(batch.schema.get_field_index(n)).flatten().to_numpy(zero_copy_only=False) for n in names] for batch in batches]
    return [np.concatenate(x) for x in zip(*held)] if held else []


def measured(docs: DataFrame) -> DataFrame:
    """doc, n, mark, twin, sketch, brief, early, spare, held: set size, fingerprint of the set, and
    the first document of the same set in its task, which stands for it from here on; its
    sketch, one of ``BRIEF_BITS`` as numbers, its early keys, how many
    subsets more it has than it needs, in the scheme with the fewest, and, for its schemes of
    even and of odd number (null: it has none), how many it has, then how many of them it shares at least."""
    schema = "doc long, n long, mark long, twin long, sketch binary, brief array<long>, early array<long>, spare int, held array<int>"

    def run(batches):
        first: dict[bytes, int] = {}
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for k, text in zip(ids, texts):
                u = shingles(text)
                whole = u.tobytes()
                mark = int(_longs(_mix(np.array([len(u)], _U) + np.add.reduce(_mix(u), dtype=_U)))[0]) if len(u) else None
                key = hash(whole), mark
                twin = first.setdefault(key, k) if len(u) and k is not None else k
                drawn = sketch(u) if twin == k and len(u) else None
                brief = None if drawn is None else _folded(sketch(u, BRIEF_BITS)[None, :], BRIEF_BITS // 8).view(np.int64)[0].tolist()
                early, spare, held = None, None, None
                if drawn is not None:
                    of = [(*early_keys(u, scheme, m), h, scheme) for scheme, h, m in schemes(len(u))]
                    early, spare = _longs(np.concatenate([x[0] for x in of])).tolist(), min(has - h - 1 for _, has, h, _ in of)
                    by = {scheme & 1: (has, has - h) for _, has, h, scheme in of}
                    held = [by.get(k, (None, None))[i] for i in (0, 1) for k in (0, 1)]
                rows.append((k, len(u), mark, twin, None if drawn is None else drawn.tobytes(), brief, early, spare, held))
            cols = list(zip(*rows)) if rows else [[]] * 9
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc", "n", "mark", "twin", "sketch", "brief", "early", "spare", "held"])

    return docs.mapInArrow(run, schema)


def _early_pairs(sizes: DataFrame) -> DataFrame:
    """a, b: a set and the first set of an early key, where they share enough of them."""
    heads = (sizes.filter("early is not null").groupBy("n", "mark").agg(F.min(F.struct("doc", "early")).alias("x"))
             .select(F.col("x.doc").alias("b"), F.size("x.early").alias("m"), F.explode("x.early").alias("key")))
    first = heads.groupBy("key").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("key", "a")
    return (heads.join(first, "key").filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.max("m").alias("m"))
            .filter(F.col("c") >= F.greatest(F.lit(1), F.floor(F.col("m") * EARLY))).select("a", "b"))


def _packed(docs: DataFrame, parts: int) -> DataFrame:
    """part, keys, docs, apart, spare: the subset keys of a batch of sets that fall to one part.

    ``docs``: doc, text, root and whether it is a copy of another set, which has no keys.
    ``apart`` is a root's distance from its set, nothing for most. ``spare`` is how many
    subsets more a set has than it needs, one entry a key; the scheme's number is in its
    lowest bit, so the two schemes of a set stay apart.
    """
    schema = "part int, keys array<long>, docs array<long>, apart array<long>, spare array<int>"

    def run(batches):
        seen = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                keys, owner, apart, spare = [], [], [], []
                for k, text, root, copy in zip(*(rows.column(i).to_pylist() for i in range(4))):
                    if k is None or copy:
                        continue
                    u = shingles(text)
                    same = hash(u.tobytes()), len(u)
                    if not len(u) or same in seen:
                        continue
                    seen.add(same)
                    for scheme, h, m in schemes(len(u)):
                        x = subset_keys(u, scheme, m)
                        keys.append(x)
                        owner.append(np.full(len(x), k, np.int64))
                        apart.append(np.full(len(x), root, np.int64) - owner[-1])
                        spare.append(np.full(len(x), 2 * max(-2, len(x) - h - 1) + (scheme & 1), np.int32))
                if not keys:
                    continue
                yield _parted(parts, np.concatenate(keys), {"docs": np.concatenate(owner), "apart": np.concatenate(apart), "spare": np.concatenate(spare)})

    return docs.select("doc", "text", "root", "copy").mapInArrow(run, schema)


def _shared(packed: DataFrame, parts: int) -> DataFrame:
    """kind, docs, n, odd: what the subsets that sets of several components share say, by part.

    kind 0: sets that share ``n`` equal light subsets of schemes of even and ``odd`` of odd
    number, in one list; kind 2: a set, its spare subsets, that ``n`` of its subsets are
    heavy. Subsets shared within one component say nothing and are not heavy, however many
    sets share them.
    """
    schema = "kind int, docs array<long>, n int, odd int"

    def run(batches):
        gathered = _gathered(batches, ["keys", "docs", "apart", "spare"])
        if not gathered:
            return
        keys, docs, apart, spare = gathered
        order = np.lexsort((docs, keys))
        keys, docs, apart, spare = keys[order], docs[order], apart[order], spare[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        root = docs + apart
        crossing = np.minimum.reduceat(root, starts) < np.maximum.reduceat(root, starts)
        light: dict[bytes, list[int]] = {}
        for a, g in zip(starts[crossing & (sizes <= HEAVY)], sizes[crossing & (sizes <= HEAVY)]):
            light.setdefault(docs[a:a + g].tobytes(), [0, 0])[spare[a] & 1] += 1
        heavy = np.repeat(crossing & (sizes > HEAVY), sizes)
        lists = [np.unique(np.frombuffer(x, np.int64)) for x in light]
        counts, odds = ([x[k] for x in light.values()] for k in (0, 1))
        kinds = [0] * len(lists)
        for (d, s), n in pd.DataFrame({"d": docs[heavy], "s": spare[heavy]}).value_counts().items():
            kinds.append(2)
            lists.append(np.array([d, s]))
            counts.append(int(n))
            odds.append(0)
        for at in range(0, len(lists), 20_000):
            numbers = (pa.array(x[at:at + 20_000], pa.int32()) for x in (kinds, counts, odds))
            kind, n, odd = numbers
            yield pa.RecordBatch.from_arrays([kind, _lists(lists[at:at + 20_000]), n, odd], names=["kind", "docs", "n", "odd"])

    return packed.repartitionById(parts, F.col("part")).mapInArrow(run, schema)


def _near(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """a, b of those pairs that sizes and sketches leave possible."""
    s = sizes.filter("sketch is not null").select("doc", "n", "sketch")
    both = (pairs.join(s.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
            .join(s.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
            .filter("4 * least(na, nb) >= 3 * greatest(na, nb)"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                apart = sketch_distances(rows.column(4).to_pylist(), rows.column(5).to_pylist())
                n = rows.column(2).to_numpy() + rows.column(3).to_numpy()
                keep = pa.array(apart <= n - 2 * -(-3 * n // 7))
                yield pa.RecordBatch.from_arrays([rows.column(0).filter(keep), rows.column(1).filter(keep)], names=["a", "b"])

    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def _exact(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b of the pairs whose sets, taken anew from the texts, are similar enough."""
    pairs = stored(pairs, "jaccard-pairs")
    need = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
    texts = docs.join(small(need, BROADCAST_ROWS), "doc", "left_semi")
    both = (pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b"))

    def run(batches):
        for batch in batches:
            last, mine, keep = None, None, []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if x is not last and x != last:
                    last, mine = x, shingles(x)
                other = shingles(y)
                common = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(100 * common >= 75 * (len(mine) + len(other) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def _rooted(rows: DataFrame, doc: str, roots: DataFrame, root: str) -> DataFrame:
    """``rows`` with the component of column ``doc``: itself if no link is known yet."""
    named = roots.select(F.col("node").alias(doc), F.col("root").alias("_root"))
    return rows.join(named, doc, "left").withColumn(root, F.coalesce("_root", doc)).drop("_root")


def _pairs(root, n, brief, asks) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of a group, of different components, that sizes and brief sketches leave possible.

    ``asks`` marks the sets of which one at least is in a pair. Rows are compared in
    blocks by sketches folded to ``SKETCH_BITS``, and what is left by whole ones; what is
    held at once does not grow with the group's square.
    """
    whole = np.ascontiguousarray(brief).view(_U)
    left, right, brief = [], [], _folded(whole, SKETCH_BITS // 64)
    for at in np.array_split(np.flatnonzero(asks), -(-int(asks.sum()) // 256) or 1):
        total = n[at][:, None] + n[None, :]
        far = np.zeros(total.shape, np.int64)
        for w in range(brief.shape[1]):
            far += np.bitwise_count(brief[at, w][:, None] ^ brief[None, :, w])
        near = (far <= total - 2 * -(-3 * total // 7)) & (root[at][:, None] != root[None, :])
        near &= 4 * np.minimum(n[at][:, None], n[None, :]) >= 3 * np.maximum(n[at][:, None], n[None, :])
        i, j = np.nonzero(near)
        i = at[i]
        if whole.shape[1] > brief.shape[1]:
            both = n[i] + n[j]
            near = np.bitwise_count(whole[i] ^ whole[j]).sum(axis=1, dtype=np.int64) <= both - 2 * -(-3 * both // 7)
            i, j = i[near], j[near]
        left.append(i)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _distinct(pairs: list[tuple[np.ndarray, np.ndarray]]):
    """Batches of the distinct pairs."""
    found = pd.DataFrame({"a": np.concatenate([p[0] for p in pairs]), "b": np.concatenate([p[1] for p in pairs])}).drop_duplicates()
    for at in range(0, len(found), 50_000):
        yield pa.RecordBatch.from_pandas(found.iloc[at:at + 50_000], preserve_index=False)


def _tight_pairs(docs: DataFrame, parts: int) -> DataFrame:
    """a, b: pairs of tight sets of different components that may be similar.

    ``docs``: doc, text, root, n, brief. Sets meet over equal subsets and over subsets of
    which one has a shingle more. A set of at most ``SHORT`` + 8 shingles also has each
    shingle as a key, as sets that short may have too few segments. Keys travel packed by
    part; what comes out of a part are possible pairs only.
    """
    def keyed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                keys, of, whole = [], [], []

                def add(k, x, full):
                    keys.append(x)
                    of.append(np.full(len(x), k))
                    whole.append(np.full(len(x), full, np.int8))

                for k, text in enumerate(rows.column(0).to_pylist()):
                    u = shingles(text)
                    if len(u) <= SHORT + 8:
                        add(k, u, 1)
                    if len(u) > SHORT:
                        for scheme, _, m in schemes(len(u)):
                            full, _, less, _ = deletion_keys(u, scheme, m)
                            add(k, full, 1)
                            add(k, less, 0)
                if not keys:
                    continue
                of = np.concatenate(of)
                mine = [rows.column(i).to_numpy(zero_copy_only=False)[of] for i in (1, 2, 3)]
                words = _folded(np.stack(rows.column(4).to_pylist()).astype(np.int64), SKETCH_BITS // 64)[of]
                yield _parted(parts, np.concatenate(keys), dict(zip(("docs", "roots", "sizes"), mine)) | {f"b{i}": words[:, i] for i in range(words.shape[1])} | {"whole": np.concatenate(whole)})

    names = ["keys", "docs", "roots", "sizes", *(f"b{i}" for i in range(SKETCH_BITS // 64)), "whole"]
    kinds = ", ".join(f"{x} array<{'tinyint' if x == 'whole' else 'long'}>" for x in names)

    def met(batches):
        gathered = _gathered(batches, names)
        if not gathered:
            return
        order = np.lexsort((gathered[1], gathered[0]))
        keys, doc, root, n, *brief, whole = (x[order] for x in gathered)
        brief, found, held = np.stack(brief, axis=1), [], 0
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        low, high, full = np.minimum.reduceat(root, starts), np.maximum.reduceat(root, starts), np.add.reduceat(whole.astype(np.int64), starts)
        ends = np.append(starts[1:], len(keys))
        for s, e in zip(starts[(low < high) & (full > 0)], ends[(low < high) & (full > 0)]):
            i, j = _pairs(root[s:e], n[s:e], brief[s:e], whole[s:e] == 1)
            found.append((np.minimum(doc[s:e][i], doc[s:e][j]), np.maximum(doc[s:e][i], doc[s:e][j])))
            held += len(i)
            if held > 1_000_000:
                yield from _distinct(found)
                found, held = [], 0
        if found:
            yield from _distinct(found)

    packed = docs.select("text", "doc", "root", "n", "brief").mapInArrow(keyed, f"part int, {kinds}")
    return packed.repartitionById(parts, F.col("part")).mapInArrow(met, "a long, b long").distinct()


def _light_pairs(placed: DataFrame) -> DataFrame:
    """a, b: pairs of different components that may share as many light subsets as each of
    them needs in a scheme.

    ``placed``: docs, roots, sizes, briefs, ``n`` and ``odd`` subsets of a list; by set and by
    parity of the scheme, ``needs``, all its subsets but the heavy ones, and ``left``, those of
    this list and of the lists of that set that come after it. Of what a set needs, a pair
    may lack as many as its sizes let it differ in.

    All sets have their lists in one order, short ones first. What a pair shares is in the
    first list that has both or in later ones, so it is met there if in no other: a list
    after which too few are left to either set meets no pair of it. Long lists, which come
    last, are so passed over by all that share little more than a passage.
    """
    names = ["a", "b"]

    def run(batches):
        found, held = [], 0
        for batch in batches:
            columns = [batch.column(i) for i in range(6)]
            for row, n, odd in zip(range(batch.num_rows), batch.column(6).to_pylist(), batch.column(7).to_pylist()):
                doc, root, size, brief, need, left = (c[row].values.to_numpy(zero_copy_only=False) for c in columns)
                need, left = need.reshape(-1, 2), left.reshape(-1, 2)
                i, j = _pairs(root, size, brief.reshape(len(doc), -1), np.ones(len(doc), bool))
                i, j = i[doc[i] < doc[j]], j[doc[i] < doc[j]]
                both = size[i] + size[j]
                lack = np.maximum(need[i], need[j]) - (both - 2 * -(-3 * both // 7))[:, None]
                can = ((np.minimum(left[i], left[j]) >= lack) & ((np.array([n, odd]) > 0) | (lack <= 0))).any(axis=1)
                found.append((doc[i[can]], doc[j[can]]))
                held += int(can.sum())
                if held > 1_000_000:
                    yield from _distinct(found)
                    found, held = [], 0
        if held:
            yield from _distinct(found)

    return placed.select("docs", "roots", "sizes", "briefs", "needs", "left", "n", "odd").mapInArrow(run, ", ".join(f"{x} long" for x in names)).distinct()


def _needs(sizes: DataFrame, shared: DataFrame, lists: DataFrame) -> DataFrame:
    """doc, needs of the sets that may be in a pair of ``_light_pairs``.

    In one scheme the subsets that all lists of a set have must come to what it shares there
    with the largest set it may be similar to; nearly all that share a passage only do not.
    """
    doc, odd = F.col("docs")[0].alias("doc"), F.col("docs")[1].bitwiseAND(1)
    heavy = shared.filter("kind = 2").groupBy(doc).agg(*[F.sum(F.when(odd == k, F.col("n")).otherwise(0)).alias(f"h{k}") for k in (0, 1)])
    totals = lists.groupBy("doc").agg(F.sum("n").alias("t0"), F.sum("odd").alias("t1"))
    held = sizes.filter("held is not null").groupBy("doc").agg(*[F.min(F.col("held")[k]).alias(f"s{k}") for k in range(4)])
    need, least = ([F.coalesce(F.col(f"s{i + k}") - F.coalesce(f"h{k}", F.lit(0)), F.lit(1 << 40)) for k in (0, 1)] for i in (0, 2))
    return (held.join(totals, "doc").join(heavy, "doc", "left").withColumn("needs", F.array(*need))
            .filter((F.col("t0") >= least[0]) | (F.col("t1") >= least[1])).select("doc", "needs"))


def join(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc, n) of every row and (node, root) of every linked document.

    Two documents link if the Jaccard similarity of their 5-word shingle sets is 0.75 or
    more; root is the smallest id that links reach. Null texts and texts without words have
    n = 0 and link with nothing; rows without an id keep their n and link with nothing.
    Equal rows count as one document; texts under one id link as that id. Only the two
    columns are read; empty tables give empty results. Texts are read whole.
    """
    docs = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    spark = documents.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sizes = stored(measured(docs), "jaccard-sizes")
    copies = (sizes.filter("n > 0 and twin is not null").select("twin", "n", "mark").distinct()
              .join(sizes.filter("n > 0 and twin is not null").groupBy("n", "mark").agg(F.min("twin").alias("first")), ["n", "mark"])
              .select(F.col("twin").alias("a"), F.col("first").alias("b")))
    links = (sizes.filter("n > 0 and twin is not null").select(F.col("doc").alias("a"), F.col("twin").alias("b")).union(copies)
             .filter("a <> b").distinct())
    first = _exact(_near(_early_pairs(sizes), sizes), docs)
    links = stored(links.union(first), "jaccard-links")
    roots = components(links)
    copy = (sizes.filter("n > 0 and twin <> doc").select("doc").union(copies.filter("a <> b").select("a")).distinct()
            .join(copies.filter("a = b").select(F.col("a").alias("doc")), "doc", "left_anti"))
    joined = (roots.select(F.col("node").alias("doc"), "root").join(copy.withColumn("copy", F.lit(True)), "doc", "left")
              .select("doc", "root", F.coalesce("copy", F.lit(False)).alias("copy")))
    told = docs.join(small(stored(joined, "jaccard-roots"), BROADCAST_ROWS), "doc", "left").select(
        "doc", "text", F.coalesce("root", "doc").alias("root"), F.coalesce("copy", F.lit(False)).alias("copy"))
    shared = stored(_shared(_packed(told, parts), parts), "jaccard-shared")
    # sets that light subsets alone do not cover
    heavy = (shared.filter("kind = 2").groupBy(F.col("docs")[0].alias("doc"), F.col("docs")[1].alias("spare")).agg(F.sum("n").alias("n"))
             .filter("n > shiftright(spare, 1)").select("doc").union(sizes.filter("spare < 0").select("doc")).distinct())
    heavy = stored(heavy, "jaccard-tight")
    known = _rooted(sizes.filter("brief is not null").select("doc", "n", "brief").distinct(), "doc", roots, "root")
    named = known.join(heavy, "doc", "left_semi")
    crossing = _tight_pairs(docs.join(small(named, BROADCAST_ROWS, heavy.count()), "doc"), parts)
    # light subsets whose sets are not all joined yet
    lists = (shared.filter("kind = 0").withColumn("g", F.monotonically_increasing_id())
             .select("g", F.array_min("docs").alias("lead"), F.size("docs").alias("c"), "n", "odd", F.explode("docs").alias("doc")))
    # of each set's lists, all in one order, what this one and those after it have
    after = Window.partitionBy("doc").orderBy(F.desc("c"), F.desc("g")).rowsBetween(Window.unboundedPreceding, 0)
    left = F.array(*[F.sum(c).over(after) for c in ("n", "odd")])
    of = lambda c: F.transform("x", lambda x: x[c])
    each = F.struct("doc", "root", "size", "brief", "needs", "left")
    # lists of one first set lie together, so that most pairs are told apart in one task
    placed = (lists.join(known.withColumnRenamed("n", "size").join(_needs(sizes, shared, lists), "doc"), "doc").withColumn("left", left).repartition(parts, "lead").groupBy("lead", "g")
              .agg(F.max("n").alias("n"), F.max("odd").alias("odd"), F.collect_list(each).alias("x"), F.min("root").alias("lo"), F.max("root").alias("hi"))
              .filter("lo <> hi").select(of("doc").alias("docs"), of("root").alias("roots"), of("size").alias("sizes"), *[F.flatten(of(c)).alias(name) for c, name in (("brief", "briefs"), ("needs", "needs"), ("left", "left"))], "n", "odd"))
    open_pairs = _light_pairs(placed)
    rest = _exact(_near(crossing.union(open_pairs), sizes), docs)
    final = components(links.union(rest))
    return sizes.select("doc", "n"), final


def classes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row per input row; a row without an id has no component."""
    sizes, roots = join(documents, doc_id, text)
    return sizes.join(roots.select(F.col("node").alias("doc"), "root"), "doc", "left").select(
        F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("root", "doc").alias("component_id"))


def representatives(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``documents``, with all their columns, that stand for their class.

    Of each class the document with the smallest id stays. Of several rows with one id the
    first stays, in order of all columns. Rows without an id are in no class and stay.
    """
    _, roots = join(documents, doc_id, text)
    gone = stored(roots.filter("node <> root").select(F.col("node").alias("_id")), "jaccard-gone")
    one = documents.join(small(gone, BROADCAST_ROWS), F.col(doc_id) == F.col("_id"), "left_anti")
    again = stored(one.filter(F.col(doc_id).isNotNull()).groupBy(doc_id).count().filter("count > 1").select(F.col(doc_id).alias("_id")), "jaccard-again")
    n = again.count()
    if not n:
        return one
    many = one.join(small(again, BROADCAST_ROWS, n), F.col(doc_id) == F.col("_id"), "left_semi")
    first = many.groupBy(doc_id).agg(F.min(F.struct(*[c for c in documents.columns if c != doc_id])).alias("_row"))
    first = first.select(*[F.col(doc_id) if c == doc_id else F.col("_row").getField(c).alias(c) for c in documents.columns])
    return one.join(small(again, BROADCAST_ROWS, n), F.col(doc_id) == F.col("_id"), "left_anti").unionByName(first)

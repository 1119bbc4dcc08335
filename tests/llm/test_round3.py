"""Operators 11 to 13 against plain versions, and on awkward and empty tables."""

import random
import struct
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stemsonde.llm import multiindex, queries, runs, windows
from stemsonde.llm.common import Words

from . import plain


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(plain.awkward(), plain.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], plain.SCHEMA)


def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                found[s, i - s + q] = min(q, found.get((s, i - s + q), q))
            i = max(i, s + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic(rng, n):
    out = []
    while len(out) < n:
        unit = [rng.choice("abcdefgh"[: rng.randrange(1, 8)]) for _ in range(rng.randrange(1, 12))]
        out += unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit) + 1)]
    return out[:n]


def test_runs_are_exact():
    rng, seen = random.Random(1), 0
    for _ in range(60):
        texts = [[rng.choice("ab") for _ in range(rng.randrange(90))] for _ in range(4)] + [periodic(rng, rng.randrange(150)) for _ in range(6)] + [["x"] * rng.randrange(40)]
        got = runs.runs_of(Words(pa.array([" ".join(t) for t in texts])))
        for k, t in enumerate(texts):
            assert got.get(k, []) == plain_runs(t), t
            seen += len(got.get(k, []))
    assert seen > 500


def test_maximal_pairs_are_the_close_ones():
    rng = random.Random(2)
    for _ in range(40):
        w = periodic(rng, 60)
        order, common = runs.ordered_suffixes(np.unique(w, return_inverse=True)[1], np.full(len(w), len(w)))
        assert [w[i:] for i in order] == sorted(w[i:] for i in range(len(w)))
        got = sorted(runs.maximal_pairs(order.tolist(), common[1:].tolist(), ["", *w[:-1]]))
        want = []
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                n = 0
                while j + n < len(w) and w[i + n] == w[j + n]:
                    n += 1
                if n and (i == 0 or w[i - 1] != w[j - 1]) and 3 * (j - i) <= n:
                    want.append((i, n + j - i, j - i))
        assert got == want


def test_long_periodic_texts_take_few_steps():
    for w in (["x"] * 60000, list("ab") * 30000, ("a b c d e f g ".split() * 10 + ["z"]) * 800):
        found = runs.runs_of(Words(pa.array([" ".join(w)])))[0]
        assert (0, len(w), {60000: 1 if w[1] == "x" else 2}.get(len(w), 71)) in found


def told(i, w):
    own = plain_runs(w)
    gone = {k for s, n, q in own for k in range(s + q, s + n)}
    best = min(own, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (i, len(own), *((None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])), sha256("".join(f"{s},{n},{q}\n" for s, n, q in own).encode()).hexdigest(),
            sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())


def test_runs_of_documents(spark, docs, none):
    rows = [(i, t) for i, t, *_ in plain.awkward() if len(t or "") < 50000]
    rng = random.Random(4)
    rows += [(100 + i, "  ".join(periodic(rng, 90))) for i in range(20)] + [(100, "y y y y y y y"), (None, "é é é é é é z")]
    got = runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [told(i, plain.words(t)) for i, t in rows]
    assert sorted((tuple(r) for r in got.drop("n_words", "runs", "collapsed_text").collect()), key=str) == sorted(want, key=str)
    one = got.where("doc_id is null and n_runs > 0").first()
    assert [tuple(r) for r in one.runs] == [(0, 6, 1)] and one.collapsed_text == "é z"
    assert runs.periodic_runs(docs).count() == len(plain.awkward()) and runs.periodic_runs(none).collect() == []


def test_looped_documents(spark):
    """Every tenth document becomes periodic, by its own checksum."""
    rows = [(i, None if i == 3 else plain.prose(i, 5 + i)) for i in range(120)] + [(10, ""), (None, "a b")]
    got = {}
    for r in queries.looped(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append(r.text)
    changed = 0
    for i, t in rows:
        w = plain.words(t)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            t = " ".join(w[k if k < a else a + (k - a) % p] for k in range(len(w)))
            changed += 1
        assert t in got[i]
    assert changed > 5


# ---------------------------------------------------------------- hard negatives
def plain_negatives(rows, scale=256.0, k=5):
    v = []
    for i, label, x in rows:
        if label is not None and x is not None and all(c is not None and np.isfinite(c) for c in x):
            v.append((i, label, [int(np.floor(scale * c)) for c in x]))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    last = 1 << 63
    out = []
    for n, (i, label, x) in enumerate(v):
        if i is None or i % 100:
            continue
        scored = sorted(((-dot(x, y), last if j is None else j, m == label) for o, (j, m, y) in enumerate(v) if o != n))
        for s, j, _ in [r for r in scored if r[2]][:k]:
            inside = [r for r in scored if not r[2] and 80 * -s <= 100 * -r[0] <= 100 * -s][:k]
            out += [(i, None if j == last else j, rank, None if o == last else o, -s, -t) for rank, (t, o, _) in enumerate(inside, 1)]
    return sorted(out, key=str)


VECTORS = "vec_id long, label int, embedding array<float>, id string, a string, w int, score double"


def negatives(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", "y", 1, 0.5) for r in rows], VECTORS).repartition(3)
    got = multiindex.hard_negatives(multiindex.whole_vectors(df), F.col("id") % 100 == 0, **more)
    return sorted((tuple(r) for r in got.collect()), key=str)


def clustered(seed, n, dim=8):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, dim))
    x = centre[rng.integers(0, 6, n)] * 0.4 + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.1, 0.4], n)[:, None]
    return [(int(i), int(rng.integers(0, 4)), [float(np.float32(c)) for c in x[i]]) for i in range(n)]


def test_hard_negatives_are_exact(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "CELL", 4)
    monkeypatch.setattr(multiindex, "FIRST", 40)  # several rounds
    monkeypatch.setattr(multiindex, "BLOCK", 16)
    rows = clustered(1, 900)
    got = negatives(spark, rows)
    assert got == plain_negatives(rows) and len(got) > 50


def test_hard_negatives_with_copies_nulls_and_ties(spark):
    rows = clustered(2, 150, 3)
    same = rows[100][2]
    rows += [(200 + i, i % 3, same) for i in range(120)] + [(None, 1, same), (None, 2, rows[0][2]), (5, None, same), (6, 1, None), (7, 1, [float("nan"), 1.0, 0.0]), (8, 1, [None, 1.0, 0.0])]
    rows += [(300, 0, same), (100, 1, rows[3][2]), (100, 1, rows[3][2]), (400, 2, [0.0, 0.0, 0.0]), (401, 2, []), (402, 2, [1.0]), (500, 3, [float("inf"), 0.0, 0.0]), (700, 1, [-1.0, -1.0, -1.0])]
    assert negatives(spark, rows) == plain_negatives(rows)


def test_hard_negatives_of_nothing(spark):
    assert negatives(spark, [(1, None, [1.0])]) == [] and negatives(spark, [(0, 1, [1.0, 2.0])]) == [] and negatives(spark, [(3, 1, [1.0, 2.0]), (4, 2, [1.0, 2.0])]) == []


def test_cells_come_in_order():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = rng.normal(size=rng.integers(1, 9)), rng.normal(size=rng.integers(1, 9))
        got = list(multiindex.in_order(a, b))
        assert len({(i, j) for _, i, j in got}) == len(a) * len(b)
        assert np.allclose([t for t, _, _ in got], np.sort((a[:, None] + b[None, :]).ravel())[::-1])


def test_bounds_hold():
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (500, 6)).astype("<i4")
    index = multiindex.Index(x[:200], 5)
    batch = pa.RecordBatch.from_pydict({"label": [0] * 500, "vec": [v.tobytes() for v in x], "ids": [[0]] * 500})
    filed = next(index.file([batch])).to_pydict()
    cells = defaultdict(list)
    for k, c in enumerate(filed["cell"]):
        cells[c].append(k)
    index.describe([(c, len(v), *[max(filed[f][k] for k in v) for f in ("r1", "r2", "n1", "n2")]) for c, v in cells.items()])
    for q in x[:40]:
        first, second, own = index.bounds(q)
        for c, v in cells.items():
            i, j = divmod(c, index.shape[1])
            most = max(int(x[k].astype(int) @ q.astype(int)) for k in v)
            assert most <= own[i, j] <= first[i] + second[j] + 1e-6


def test_large_numbers_stay_exact():
    q = np.array([[1 << 30, -(1 << 30) + 1]], "<i4")
    assert multiindex._products(q, q)[0, 0] == (1 << 60) + ((1 << 30) - 1) ** 2


# ---------------------------------------------------------------- online packing
def sequences(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
    return {k: sum(r.length for r in v) for k, v in by.items()}


def round_trip(docs, rows, end=1):
    """Each token of each document in exactly one piece."""
    from tokenizers import Tokenizer

    tokenizer, by = Tokenizer.from_file(windows.VOCABULARY), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    texts = defaultdict(list)
    for i, t in docs:
        texts[i].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, end])
    assert set(by) == set(texts)
    for i, own in by.items():
        want, left = [], texts[i]
        assert sum(r.length for r in own) == sum(map(len, left))
        for r in own:
            assert any(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start: r.start + r.length])) for ids in left)
            want.append((r.start, r.length))
        if len(left) == 1:
            at = 0
            for start, length in sorted(want):
                assert start == at
                at += length


def test_online_packing_round_trip(docs, none):
    rows = windows.packed(docs).collect()
    round_trip([r[:2] for r in plain.awkward()], rows)
    lengths = sequences(rows)
    assert all(n <= 2048 and (n == 2048 or n & (n - 1) == 0) for n in lengths.values())
    assert windows.packed(none).collect() == []


def test_online_packing_over_many_partitions(spark):
    """Last windows meet over two levels; nothing is padded."""
    rng = random.Random(3)
    rows = [(i if i % 3 else None, plain.prose(i, rng.randrange(0, 60)) if i % 11 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    got = windows.packed(df, capacity=64, windows=3, fan=4).collect()
    round_trip(rows, got)
    lengths = list(sequences(got).values())
    assert all(n & (n - 1) == 0 for n in lengths) and sum(n == 64 for n in lengths) > 100
    assert sum(n < 64 for n in lengths) <= 6  # the binary digits of one last window
    assert len(got) < 1.25 * (len(rows) + len(lengths))


def test_segments_encode_like_whole_texts():
    from tokenizers import Tokenizer

    with open(windows.VOCABULARY, "rb") as f:
        encoder, tokenizer = windows.Encoder(f.read()), Tokenizer.from_file(windows.VOCABULARY)
    rng = random.Random(2)
    parts = [*"abzABZ019.,'’-<|>_ \t\n\x0b\x1c", "é", "É", "é", "́", "̸", "—", "日", "本", " ", "\u0085", "ß", "İ", "Σ", "١", "²", "'s", "'re", "<|endoftext|>", "don't", "½"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(3000)]
    ids, first = encoder.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[first[k]: first[k + 1]].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 1], t


def test_open_windows_are_bounded():
    rng, out = random.Random(6), []
    packer = windows.Packer(out.append, capacity=100, windows=4)
    for i in range(500):
        packer.place(windows.Piece(i, 0, np.arange(rng.randrange(1, 250), dtype=np.uint32), 0))
        assert len(packer.room) <= 4 and packer.room == sorted(packer.room)
    assert all(sum(len(p.ids) for p in s) == 100 for s in out)
    assert sum(len(p.ids) for p in packer.merged()) < 100

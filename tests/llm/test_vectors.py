"""Spelling variants, whitening and nearest neighbours against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tenderflow.llm import neighbours, spelling, whitening

VECTORS = "vec_id long, embedding array<float>"


def plain_variants(rows, dominance=10):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 7:
                counts[word] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found, forms = {}, {}
    for w, n in counts.items():
        some = [v for v in counts if near(w, v)]
        top = min(some, key=lambda v: (-counts[v], v), default=None)
        if top and counts[top] >= dominance * n:
            forms[w] = top
        found[w] = (n, len(some), counts.get(forms.get(w)))
    out = {}
    for w, (n, k, form_n) in found.items():
        root = w
        while root in forms:
            root = forms[root]
        out[w] = (forms.get(w), root, n, k, form_n)
    return out


def spelled(docs, **how):
    rows = spelling.variants(docs, **how).collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdé×") for _ in range(rng.randrange(6, 10))) for _ in range(60)]
    weights = [rng.random() ** 6 for _ in words]
    rows = [(i, " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, weights, k=rng.randrange(1, 400)))) for i in range(120)]
    edits = ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aaabaaaa", "Éaaaaaaa", "éaaaaaaa"]
    return [*rows, (None, None), (500, ""), (501, "a1" * 50), (502, " ".join(edits * 3)), (503, "aaaaaaaa " * 300), (None, "bbbbbbb bbbbbbb"), (504, "aaaaaaaa-" * 40_000), rows[3], rows[3]]


def test_variants(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert spelled(docs) == plain_variants(texts)
    clashing = spark.createDataFrame([(*r, "w", 3, "x") for r in texts], "doc_id long, text string, word string, n long, near string")
    assert spelled(clashing) == plain_variants(texts)
    assert spelled(docs.limit(0)) == {}
    assert spelled(spark.createDataFrame([(1, "12345 67")], "doc_id long, text string")) == {}


def test_variants_whatever_is_held(spark, texts, monkeypatch):
    for name, value in (("HELD", 3), ("ROWS", 2), ("LEAST_BITS", 64), ("BITS_A_WORD", 1)):
        monkeypatch.setattr(spelling, name, value)
    assert spelled(spark.createDataFrame(texts, "doc_id long, text string")) == plain_variants(texts)


def test_chains_of_forms(spark):
    chain = {"aaaaaaaa": 2, "aaaaaaab": 21, "aaaaaabb": 220, "aaaaabbb": 2300}
    rows = [(i, w) for w, n in chain.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = spelled(docs, one_in=1 << 40)
    assert [found[w][1] for w in chain] == ["aaaaabbb"] * 4 and found["aaaaaaaa"][0] == "aaaaaaab"


def test_neighbourhood_is_whole_and_distinct():
    rng = random.Random(4)
    letters = sorted("abcé")
    alphabet = spelling.Alphabet.of(letters)
    for _ in range(60):
        words = ["".join(rng.choice("aab") for _ in range(5)) for _ in range(3)]
        want = [sorted({w[:i] + w[i + 1 :] for i in range(5)} | {w[:i] + c + w[i + 1 :] for i in range(5) for c in letters} - {w} | {w[:i] + c + w[i:] for i in range(6) for c in letters}) for w in words]
        made = defaultdict(list)
        for at, places in spelling.by_length(words, alphabet):
            for kind, sums, counts in spelling.neighbourhood(places, alphabet):
                for row, place, *letter in zip(*np.nonzero(counts)):
                    text = spelling.edited(words[at[row]], kind, place, letters[letter[0]] if letter else "")
                    made[at[row]].append(text)
                    points = np.searchsorted(alphabet.letters, [ord(c) for c in text])
                    whole = (alphabet.codes[points] * spelling.powers(len(text))).sum(dtype=np.uint64)
                    assert sums[row, place, *letter] == whole
        assert [sorted(made[i]) for i in range(3)] == want


def odd_vectors(rng, d=6):
    good = [(i, rng.standard_normal(d).astype(np.float32).tolist()) for i in range(200)]
    bad = [(300, None), (301, []), (302, [1.0] * (d - 1) + [None]), (303, [float("nan")] * d), (304, [float("inf")] + [0.0] * (d - 1)), (305, [1.0] * (d + 1)), (320, [0.0] * d)]
    return good, bad


def test_whitening(spark):
    rng = np.random.default_rng(1)
    good, bad = odd_vectors(rng)
    good = [*good, good[5], good[5], (None, good[7][1]), bad[-1]]
    extra = "component int, deviation string, x long, n long"
    rows = spark.createDataFrame([(*r, 1, "d", 2, 3) for r in [*good, *bad[:-1]]], f"{VECTORS}, {extra}").repartition(4)
    got = whitening.whiten(rows).collect()
    x = np.floor(1024 * np.array([v for _, v in good], float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    moved = n * x - s
    v = (moved.T @ moved) / n**3
    e, u = np.linalg.eigh(v)
    assert len(got) == n * 6 and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    made = defaultdict(list)
    for r in got:
        assert r.explained == pytest.approx(e[-r.component] / e.sum(), rel=1e-9)
        made[r.vec_id, r.component].append((r.whitened, int(r.deviation)))
    for k in range(1, 7):
        want = (moved / n) @ u[:, -k] / e[-k] ** 0.5
        sign = np.sign(want[0] * made[0, k][0][0])
        for (vec_id, _), w, d in zip(good, want, (moved**2).sum(axis=1)):
            assert all(y == int(d) and abs(x - sign * w) < 1e-9 for x, y in made[vec_id, k])


def test_whitening_of_little(spark):
    frame = lambda rows: spark.createDataFrame(rows, VECTORS)
    assert whitening.whiten(frame([])).count() == 0
    assert whitening.whiten(frame([(1, None), (2, [])])).count() == 0
    one = whitening.whiten(frame([(1, [0.5, 1.5])])).collect()
    assert [(r.vec_id, r.component, r.whitened, r.explained, r.identity_error, r.deviation) for r in one] == [(1, k, None, 0.0, None, 0) for k in (1, 2)]
    line = whitening.whiten(frame([(i, [float(i), float(i), 1.0]) for i in range(9)])).collect()
    assert {r.component: r.whitened is None for r in line} == {1: False, 2: True, 3: True}
    assert line[0].identity_error < 1e-9 and {r.explained for r in line if r.component == 1} == {1.0}


def test_exact_deviations_of_large_numbers(spark):
    rows = [(i, [2.0**30 * (-1) ** i, float(i)]) for i in range(1000)]
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()}
    x = [[int(1024 * c) + 100_000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    assert got == {i: sum((1000 * c - t) ** 2 for c, t in zip(v, s)) for i, v in enumerate(x)}


def plain_nearest(rows, k, every):
    held = {(i, tuple(v)) for i, v in rows if i is not None and v}
    ids, vectors = np.array([i for i, _ in held]), np.array([v for _, v in held], float)
    out = {}
    for i, v in held:
        if i % every == 0:
            scores = (vectors * np.array(v, float)).sum(axis=1)
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), scores[j]) for j in order]
    return out


def found_nearest(rows, **how):
    out = defaultdict(list)
    for r in sorted(neighbours.nearest(rows, **how).collect(), key=lambda r: (r.query_id, r.rank)):
        out[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return dict(out)


def test_nearest_edges(spark):
    good, bad = odd_vectors(np.random.default_rng(3))
    copies = [(400 + i, good[0][1]) for i in range(60)]
    rows = [*good, *copies, good[9], good[9]]
    extra = [(*r, 1, 2.0, "c") for r in [*rows, *bad, (None, good[3][1])]]
    frame = spark.createDataFrame(extra, f"{VECTORS}, query long, score double, cell string").repartition(3)
    assert found_nearest(frame, every=10, sure=0.999999) == plain_nearest(rows, 20, 10)
    few = good[:5]
    assert found_nearest(spark.createDataFrame(few, VECTORS), every=2) == plain_nearest(few, 20, 2)
    assert found_nearest(spark.createDataFrame(bad, VECTORS).filter("vec_id <> 305")) == {}
    assert found_nearest(spark.createDataFrame([], VECTORS)) == {}


@pytest.mark.parametrize("norms", [False, True])
def test_nearest_recall(spark, monkeypatch, norms):
    for name, value in (("GROUP", 20), ("LEAF", 16), ("SAMPLE", 512)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((6, 24))
    vectors = centres[rng.integers(0, 6, 3000)] + 0.7 * rng.standard_normal((3000, 24))
    vectors /= 1 if norms else np.linalg.norm(vectors, axis=1)[:, None]
    vectors[1000:2000] = vectors[0] + 1e-3 * rng.standard_normal((1000, 24))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(vectors)]
    got, want = found_nearest(spark.createDataFrame(rows, VECTORS).repartition(4), cell=200), plain_nearest(rows, 20, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 20 * len(want)
    score = {q: dict(plain_nearest(rows, 3000, 20)[q]) for q in list(want)[:3]}
    assert all(s == score[q][i] for q in score for i, s in got[q])


def test_chi_square():
    assert neighbours.chi_square(2.0, 2) == pytest.approx(1 - np.exp(-1))
    draws = (np.random.default_rng(0).standard_normal((200_000, 12)) ** 2).sum(axis=1)
    assert (draws <= neighbours.quantile(0.97, 12)).mean() == pytest.approx(0.97, abs=0.003)


def test_groups():
    assert neighbours.groups([600, 600, 3000, 5, 5]) == [(0, 1), (1, 1), (2, 3), (5, 1), (5, 1)]

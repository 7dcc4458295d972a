"""Substring and suffix deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from skylattice.llm import substring_dedup, suffix_dedup, windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, units, width):
    first = {}
    cut = [(i, units(t or "")) for i, t in rows]
    for i, u in cut:
        for a in range(len(u) - width + 1):
            k = tuple(u[a : a + width])
            first[k] = min(first.get(k, 1 << 62), 1 << 61 if i is None else i)
    out = []
    for i, u in cut:
        gone = np.zeros(len(u), bool)
        for a in range(len(u) - width + 1):
            if first[tuple(u[a : a + width])] < (1 << 61 if i is None else i):
                gone[a : a + width] = True
        out.append((i, u, gone))
    return out


def corpus(seed=0):
    rng = random.Random(seed)
    vocab = [f"word{i}é" for i in range(90)]
    passages = [" ".join(rng.choices(vocab, k=n)) for n in (50, 60, 130, 12)]
    out = []
    for i in range(60):
        parts = [" ".join(rng.choices(vocab, k=rng.randrange(1, 90)))]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        out.append(rng.choice(["  ", "\n", " "]).join(parts))
    out += [out[3], out[3], " ".join(["same"] * 140), " ".join(["same"] * 170), "", None, "x " * 49, "a" * 400, "b" + "a" * 300]
    rows = list(enumerate(out))
    rng.shuffle(rows)
    return rows + [(None, out[3]), (7, out[5]), (7, out[5]), (8, out[9])]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, rk string, id int").repartition(3)


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_words(spark):
    rows = corpus()
    want = Counter((i, len(u), int(g.sum()), sha(" ".join(w for w, x in zip(u, g) if not x).encode())) for i, u, g in brute(rows, WORD.findall, 50))
    got = substring_dedup.substring_dedup(frame(spark, rows)).drop("kept").collect()
    assert Counter(map(tuple, got)) == want


@pytest.mark.parametrize(("hot", "runs"), [(20_000, 200_000), (0, 200_000), (20_000, 0), (0, 0)])
def test_bytes(spark, hot, runs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", runs)
    monkeypatch.setattr(suffix_dedup, "BIN", 100)
    rows = corpus()
    want = Counter()
    for i, u, g in brute(rows, lambda t: t.encode(), 50):
        spans = int(np.diff(np.concatenate([[0], g.astype(int)])).clip(0).sum())
        want[i, len(u), int(g.sum()), spans, sha(bytes(x for x, d in zip(u, g) if not d))] += 1
    got = suffix_dedup.suffix_dedup(frame(spark, rows)).drop("kept").collect()
    assert Counter(map(tuple, got)) == want


def test_columnwise_construction():
    rng = np.random.default_rng(0)
    for alphabet in (2, 4, 30):
        strings = [rng.integers(97, 97 + alphabet, rng.integers(1, 60)).astype(np.uint8) for _ in range(40)]
        owner, size, lcp = suffix_dedup.bwt_lcp(strings)
        got = [strings[o][len(strings[o]) - s :].tobytes() for o, s in zip(owner, size)]
        assert len(got) == sum(map(len, strings)) + len(strings) and got == sorted(got)
        for i in range(1, len(got)):
            n = 0
            while n < min(len(got[i]), len(got[i - 1])) and got[i][n] == got[i - 1][n]:
                n += 1
            assert lcp[i] == n


def test_pack():
    rng = np.random.default_rng(1)
    cols = {"m": rng.integers(0, 1 << 48, 50).astype(np.uint64), "c": rng.integers(0, 1 << 32, 50).astype(np.uint32), "row": np.sort(rng.integers(3, 9, 50)), "start": rng.integers(0, 1 << 24, 50), "n": rng.integers(1, 27, 50)}
    rk, ids = np.arange(100, 120), np.arange(20)
    out, r, i = suffix_dedup.unpack(suffix_dedup.pack(dict(cols), rk, ids))
    assert all((out[k] == cols[k]).all() for k in ("m", "c", "start", "n"))
    assert (r[out["row"]] == rk[cols["row"]]).all() and (i[out["row"]] == ids[cols["row"]]).all()


def test_contents_alike_in_32_bits(spark):
    """Two texts with one minimizer whose content hashes agree in the high half only."""
    rng = np.random.default_rng(5)
    heads = rng.integers(97, 123, (20_000, 24)).astype(np.uint8)
    grams = windows.rolling(windows.byte_units(heads.ravel(), None)[0], 24)[::24]
    tails = rng.integers(97, 123, (300_000, 26)).astype(np.uint8)
    texts = np.hstack([np.tile(heads[grams.argmin()], (len(tails), 1)), tails])
    c = windows.cut_runs(windows.byte_units(texts.ravel(), None)[0], np.arange(len(texts) + 1) * 50, 50, 24)[4]
    assert len(c) == len(texts)
    order = np.argsort(c, kind="stable")
    at = np.flatnonzero((c[order][1:] >> np.uint64(32) == c[order][:-1] >> np.uint64(32)) & (c[order][1:] != c[order][:-1]))[0]
    a, b = (texts[i].tobytes().decode() for i in order[at : at + 2])
    assert a[:24] == b[:24] and a != b
    got = suffix_dedup.suffix_dedup(frame(spark, [(1, a), (2, b), (3, a)])).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0, 3: 50}


def test_empty_and_pieces(spark, monkeypatch):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.substring_dedup(none).count() == 0
    assert suffix_dedup.suffix_dedup(none).count() == 0
    values = np.arange(1000, dtype=np.uint64)
    text, start, n, m, c = windows.cut_runs(values, np.array([0, 400, 430, 1000]), 50, 10)
    assert n.sum() == 351 + 521 and n.max() <= 41


def test_masks_cost_no_pass_a_bit(monkeypatch):
    """Spans of a long text: the same units as bit by bit, and no pass over the text for every bit of a mask."""
    rng, n, width = np.random.default_rng(1), 200_000, 50
    spans = [(int(s), int(m)) for s, m in zip(rng.integers(0, n - 200, 3000), rng.integers(1, 1 << 63, 3000), strict=True)]
    spans += [(7, 0b101), (n - 113, (1 << 63) - 1)]
    want = np.zeros(n, bool)
    for s, m in spans:
        for j in range(63):
            if m >> j & 1:
                want[s + j : s + j + width] = True
    kind = pa.list_(pa.struct([("start", pa.int32()), ("mask", pa.int64())]))
    column = pa.array([[{"start": s, "mask": m} for s, m in spans]], kind)
    passes, count = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **b: passes.append(1) or count(*a, **b))
    got = windows.removed_units(column, np.array([0, n]), width)
    assert (got == want).all()
    assert len(passes) <= 4

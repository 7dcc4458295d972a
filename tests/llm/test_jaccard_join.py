"""The join against brute force over all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from skylattice.llm import jaccard_join as jj

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, k))
    parent = {i: i for i in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(parent)
    for x in ids:
        for y in ids:
            if x < y and any(100 * len(a & b) >= percent * len(a | b) for a in sets[x] for b in sets[y] if a and b):
                a, b = sorted((root(x), root(y)))
                parent[b] = a
    return Counter((i, len(shingles(t, k)), None if i is None else root(i)) for i, t in rows)


def corpus(seed=0):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out, line = [], " ".join(rng.choices(vocab, k=30))
    for n in (1, 2, 3, 8, 12, 20, 40, 90, 200, 400):
        for _ in range(3):
            base = rng.choices(vocab, k=n)
            out.append(" ".join(base))
            for edits in (0, 1, 2, n // 60, n // 30):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.randrange(len(copy))] = rng.choice(vocab)
                out.append(" ".join(copy))
            out.append(" ".join(base[: max(1, n * 95 // 100)]))
            out.append(line + " " + " ".join(rng.choices(vocab, k=n)))
    rng.shuffle(out)
    ids = list(range(len(out)))
    rng.shuffle(ids)  # equal sets come in any order of their ids
    rows = list(zip(ids, out)) + [(9001, None), (9002, ""), (9003, " \t "), (9004, "A b C"), (9005, "a B c"), (None, "a b c"), (9006, "a b c"), (9006, "a b c")]
    return rows


@pytest.mark.parametrize(("k", "percent", "tile"), [(3, 90, 256), (5, 80, 4), (3, 60, 2), (3, 40, 8)])
def test_against_all_pairs(spark, k, percent, tile):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n int, component string").repartition(3)
    got = jj.jaccard_components(docs, words=k, percent=percent, tile=tile).collect()
    assert Counter(map(tuple, got)) == brute(rows, k, percent)


def test_similar_sets_keep_a_common_key():
    """Whatever order of keys decides what is taken back."""
    rng = np.random.default_rng(1)
    for trial in range(3000):
        percent, n = int(rng.choice([40, 60, 80, 85, 90, 97])), int(rng.integers(1, 120))
        pool = rng.permutation(400).astype(np.uint64)
        a = pool[:n]
        cut, more = int(rng.integers(0, n)), int(rng.integers(0, 1 + n * (100 - percent) // percent))
        b = np.concatenate([a[cut if trial % 2 else min(cut, n * (100 - percent) // 100) :], pool[n : n + more]])
        a, b = np.sort(a), np.sort(b)
        common = len(np.intersect1d(a, b))
        if 100 * common < percent * (len(a) + len(b) - common):
            continue
        rows, keys, spare = jj.prefix_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), np.array([0, 1]), percent)
        order = {k: (rng.integers(0, 4), k) for k in keys.tolist()}
        kept = [set(sorted(keys[rows == r].tolist(), key=order.get)[: (rows == r).sum() - spare[rows == r][0]]) for r in (0, 1)]
        assert kept[0] & kept[1]


def test_bounds_hold():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(2))
        maps = jj.bitmaps(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 64)
        only = int(np.bitwise_count(maps[0] & ~maps[1]).sum())
        assert len(np.intersect1d(a, b)) <= len(a) - only


def test_empty_and_drop(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jj.jaccard_components(none).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")], "doc_id long, text string")
    assert sorted(r.doc_id for r in jj.drop_near_copies(docs).collect()) == [1, 3]

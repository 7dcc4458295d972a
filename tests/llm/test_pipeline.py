"""The pipeline's stages against brute force, and on rows of every odd kind."""

import random
from collections import Counter

import pytest

import corpus_pipeline as cp
from skylattice.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(0)
    kinds = {"en": ["the", "thing", "er", "ly", "of"], "de": ["sch", "ung", "ver", "die", "keit"]}
    out = []
    for i in range(120):
        lang = rng.choice(list(kinds))
        words = ["".join(rng.choices(kinds[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(20, 200))]
        out.append((i, " ".join(words), lang, f"s{i % 4}", 1))
    for i in range(120, 150):  # exact and near copies
        base = out[i - 120]
        words = base[1].split(" ")
        if i % 2:
            words[len(words) // 2] = "changed"
        out.append((i, " ".join(words), base[2], base[3], 1))
    return out


def odd():
    return [(200, None, None, None, None), (201, "", "en", None, 0), (202, "123 456", "en", "s1", 1), (203, "the thing erly of " * 30000, "en", None, 1), (None, "the thing of the erly thing", "en", "s0", 1), rows()[3], rows()[3]]


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def test_stages(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    stage = dict(cp.STAGES)
    kept = stage["language_id"](spark, docs, "").collect()
    assert Counter(map(tuple, kept)) == Counter(data)  # clean documents stay
    one = stage["exact_dedup"](spark, docs, "").collect()
    by = {}
    for r in data:
        by[r[1]] = max(by.get(r[1], -1), r[0])
    assert sorted(r.doc_id for r in one) == sorted(by.values())
    parent = {r.doc_id: r.doc_id for r in one}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {r.doc_id: shingles(r.text) for r in one}
    for x in sets:
        for y in sets:
            if x < y and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                parent[b] = a
    near = stage["near_dedup"](spark, spark.createDataFrame(one, SCHEMA), "").collect()
    assert sorted(r.doc_id for r in near) == sorted(x for x in parent if root(x) == x)
    mixed = stage["mixing"](spark, spark.createDataFrame(near, SCHEMA), "").collect()
    taken = {r.doc_id: r.taken for r in mixing.Mix(spark.createDataFrame(near, SCHEMA)).taken().collect()}
    words, text = Counter(), {r.doc_id: r.text for r in near}
    for r in mixed:
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
        left = iter(text[r.doc_id].split())
        assert all(w in left for w in r.text.split())  # words in their order
    assert words == Counter({k: v for k, v in taken.items() if v})
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3
    out = stage["sentence_pieces"](spark, spark.createDataFrame(mixed, SCHEMA), "").collect()
    assert len(out) == len(mixed) and all(r.round_trip and len(r.pieces) == r.n_tokens for r in out)


@pytest.mark.parametrize("kind", ["odd", "empty", "extra"])
def test_every_stage_takes_every_row(spark, kind):
    data = rows()[:40] + odd() if kind != "empty" else []
    docs = spark.createDataFrame(data, SCHEMA)
    if kind == "extra":
        docs = docs.selectExpr("*", "1 as score", "'x' as lang_pred", "array(1) as pieces", "2 as size", "3 as id", "doc_id as component_id")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, "")
        if name != "sentence_pieces":
            assert out.columns == docs.columns
        got = Counter((r.doc_id, r.text) for r in out.select("doc_id", "text").collect()) if name != "sentence_pieces" else out.count()
        want = Counter((r[0], r[1]) for r in data)
        if name == "language_id":  # rows without a letter go, clean ones stay
            assert got == Counter({k: n for k, n in want.items() if k[1] and any(map(str.isalpha, k[1]))})
        elif name == "exact_dedup":
            best = {}
            for i, t in want:
                best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
            assert Counter((-1 if i is None else i, t or "") for i, t in got.elements()) == Counter((i, t) for t, i in best.items())
        elif name == "near_dedup":
            assert {t for _, t in got} == {t for _, t in want} and all(n <= want[k] for k, n in got.items())
        elif name == "mixing":
            assert {i for i, _ in got} <= {i for i, t in want if t and t.strip()} and sum(got.values()) >= (1 if data else 0)
        else:
            assert got == len(data)
    assert name == "sentence_pieces"


def test_registered():
    assert [n for n, _ in cp.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "sentence_pieces"]
    assert cp.ORACLE_SQL is None

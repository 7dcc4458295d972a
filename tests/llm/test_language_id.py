"""Held-out accuracy, calibration and edge cases of language identification."""

import os
import random
import zlib

import numpy as np
import pytest

from skylattice.llm import language_id as lid

SF = "/root/testdata/sf0.001"
PARTS = {"aa": ["ba", "ka", "lamo", "tari", "nu"], "bb": ["sch", "ver", "ung", "keit", "ä"], "cc": ["ción", "ll", "ez", "os", "ñ"]}


def rows(n=240, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(PARTS))
        text = " ".join("".join(rng.choices(PARTS[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60)))
        out.append((i, text, lang, "s", 1, 0.1))
    return out + [(1000, None, "aa", None, None, 0.1), (1001, "", "aa", "s", 0, 0.1), (1002, "12 34 !", None, "s", 0, 0.1), (None, "ba ka", "aa", "s", 0, 0.1), (1003, "ba ka lamo " * 60000, None, "s", 0, 0.1), (5, *out[5][1:])]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def test_accuracy_and_edges(docs):
    got = lid.language_id(docs).collect()
    assert len(got) == len(rows())
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[5]) == 2 and by[5][0] == by[5][1]
    for i in (1000, 1001, 1002):
        assert by[i][0].lang_pred == "und" and by[i][0].score == 0
    assert by[1003][0].lang_pred == "aa"
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    want = {r[0]: r[2] for r in rows()}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert len(held) > 20 and np.mean([r.lang_pred == want[r.doc_id] for r in held]) > 0.95


def test_predictions_ignore_labels(spark, docs):
    model = lid.train(docs, ~lid.held_out())
    bare = spark.createDataFrame([(r[1], "zz", "other") for r in rows()], "text string, lang string, source string")
    one = sorted((r.text or "", r.lang_pred, r.score) for r in lid.predict(docs.select("text"), model).collect())
    assert one == sorted((r.text or "", r.lang_pred, r.score) for r in lid.predict(bare, model).collect())


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert lid.language_id(none).count() == 0
    one = spark.createDataFrame([(1, "some text", None, "s", 1, 0.0)], SCHEMA)
    assert lid.language_id(one).first().lang_pred == "und"


def test_sparse_and_calibrated():
    rng = np.random.default_rng(0)
    data = []
    for _ in range(400):
        k = int(rng.integers(2))
        at = np.array([k if rng.random() < 0.8 else 1 - k, 2, int(rng.integers(3, 50))])
        data.append((at, np.ones(3) / 3**0.5, k))
    w = lid.ftrl(data, 60, 2, l1=2.0)
    assert (w[3:-1] == 0).sum() > (lid.ftrl(data, 60, 2, l1=0.0)[3:-1] == 0).sum() + 20
    scores = np.array([x @ w[at] + w[-1] for at, x, _ in data])
    labels = np.array([k for *_, k in data])
    t = lid.temperature(5 * scores, labels)
    assert abs(t / lid.temperature(scores, labels) - 5) < 0.2


def test_whole_texts_count():
    assert lid.counts("ab" * 300_000).sum() == sum(600_002 - n + 1 for n in lid.ORDERS)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = lid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95

"""The scan against plain dynamic programming, against the library, and round trips."""

import random

import numpy as np
import pytest
import sentencepiece

from skylattice.llm import sentence_pieces as sp

TEXTS = ["", " ", "Hello  world\n\tx", "é ü \U0001f600 mixed text", "a" * 500, "Thnt eringing onheed, with erenenst thaner ing", "x\n\n\ny", "trailing  ", "naïve façade " * 40]


@pytest.fixture(scope="module")
def pieces():
    return sp.Pieces(sp.read_model())


def plain(p: sp.Pieces, text: str) -> int:
    """The best score, without stretches, lanes or chunks."""
    text = text.replace(" ", sp.MARK)
    text = sp.MARK + text if p.prefix and text else text
    best = [0] + [sp._NONE] * len(text)
    score = {}
    for node_id, s in zip(p.ids.tolist(), p.score.tolist(), strict=True):
        if node_id >= 0:
            score[p.names[node_id]] = s
    for i in range(len(text)):
        for d in range(1, p.longest + 1):
            s = score.get(text[i : i + d])
            if s is not None and i + d <= len(text):
                best[i + d] = max(best[i + d], best[i] + s)
        if text[i] not in score:
            best[i + 1] = max(best[i + 1], best[i] + p.unknown)
    return best[-1]


def total(p: sp.Pieces, ids: list[int]) -> int:
    score = dict(zip(p.ids.tolist(), p.score.tolist(), strict=True))
    out, i, byte = 0, 0, {v: k for k, v in p.byte.items()}
    while i < len(ids):
        if ids[i] in byte:
            lead = byte[ids[i]]
            i += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            out += p.unknown
        else:
            out += score[ids[i]]
            i += 1
    return out


@pytest.mark.parametrize("chunk", [48, 61, 4096])
def test_best_score_and_round_trip(pieces, chunk):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("etaoin shrdlu\né中") for _ in range(n)) for n in (1, 5, 60, 300)]
    for t in texts:
        pieces.cache.clear()
        ids = np.frombuffer(pieces.encode_block([t], chunk)[0], "<i4").tolist()
        assert pieces.decode(ids) == t.encode()
        assert total(pieces, ids) == plain(pieces, t)


@pytest.mark.parametrize("letters", ["etaoinshrdlucmfwyp", "aab\U0001f600中 "])
def test_giant_stretch(pieces, letters):
    """A text without a break has full matrices; the best score is that of one long scan."""
    rng = random.Random(5)
    text = "".join(rng.choice(letters) for _ in range(1500))
    for chunk in (pieces.longest, 100, 999):
        ids = np.frombuffer(pieces.encode_block([text], chunk)[0], "<i4").tolist()
        assert total(pieces, ids) == plain(pieces, text) and pieces.decode(ids) == text.encode()


def test_every_chunk_has_a_matrix(pieces):
    """Ordinary texts go through chunk matrices too, and chunk products are what one chunk gives."""
    text = pieces.mark("the thing that ering onheed with naïve words " * 30, True)
    one = pieces.chunks("", text, "", 1 << 20)
    many = pieces.chunks("", text, "", 100)
    assert len(one) == 1 and len(many) == -(-len(text) // 100) and not any(c.whole for c in many)
    assert "".join(c.left + "".join(c.parts) + c.right for c in many) == text
    pieces.remember({p for c in one + many for p in c.parts})
    assert (sp.max_plus_scan(pieces.matrices(many))[-1][0, 0] == pieces.matrices(one)[0, 0, 0]).all()


def test_segments_are_shared_by_tasks(spark, pieces):
    """Texts of several segments: rows, a scan of their matrices, and traces give the best score again."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("etaoin shrdlu\né中") for _ in range(900)), "x" * 700, "", "short", "\U0001f600 é" * 200, "the thing " * 90]
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts + texts[:1])], "doc_id long, text string, row string")
    got = sp.encode(docs, chunk=50, segment=256).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert r.round_trip and r.row == "a" and pieces.decode(r.pieces) == r.text.encode() and r.n_tokens == len(r.pieces)
        assert total(pieces, r.pieces) == plain(pieces, r.text)


def test_small_cache(pieces, monkeypatch):
    monkeypatch.setattr(sp, "_CACHE_BYTES", 100)
    texts = ["the thing", "a thing", "that thing"]
    got = [pieces.encode_block([t], 64)[0] for t in texts]
    assert got == pieces.encode_block(texts, 64)


def test_scan_is_associative():
    rng = np.random.default_rng(0)
    m = rng.integers(-50, 0, (9, 4, 4))
    got, want = sp.max_plus_scan(m), m[0]
    for k in range(1, 9):
        want = sp.max_plus(want, m[k])
        assert (got[k] == want).all()


def test_against_the_library(pieces):
    """No segmentation of the library scores better, and both decode alike."""
    lib = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    for t in ["Hello world", "the thing", "internationalisation of words", "erenenst thaner ing that", "éléphant", "a\nb"]:
        ids = np.frombuffer(pieces.encode_block([t], 64)[0], "<i4").tolist()
        assert total(pieces, ids) >= total(pieces, lib.encode(t))
        assert lib.decode(ids) == t == pieces.decode(lib.encode(t)).decode()


def test_table(spark):
    rows = [(i, t, "x", "x") for i, t in enumerate(TEXTS)] + [(99, None, "x", None), (99, None, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pieces string, __text2 string")
    out = sp.encode(docs, chunk=64)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(TEXTS) + 1 and all(r.round_trip for r in got.values())
    assert got[99].pieces == [] and got[0].n_tokens == 0
    back = {r.doc_id: r.text for r in sp.decode(out.drop("text")).collect()}
    assert [back[i] for i in range(len(TEXTS))] == TEXTS
    assert sp.encode(docs.limit(0)).count() == 0


def test_stretches_are_traced_side_by_side(pieces):
    """One by one and in lanes of mixed widths, stretches have the same pieces and scores; unknown characters become bytes in both."""
    rng = random.Random(7)
    texts = ["".join(rng.choice("etaoinshrdlu中\U0001f600") for _ in range(rng.choice((1, 2, 4, 5, 9, 40)))) for _ in range(300)] + [sp.MARK, sp.MARK + "the"]
    ids, scores = pieces.segment(texts)
    for t, got, score in zip(texts, ids, scores, strict=True):
        ((best, step, piece),) = pieces.solve([(t, len(t), 0)])
        assert np.frombuffer(got, "<i4").tolist() == pieces.trace(t, step, piece, len(t))
        assert score == best[len(t)]
    assert pieces.segment([]) == ([], [])

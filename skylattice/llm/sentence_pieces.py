"""SentencePiece encoding and decoding as a max-plus parallel scan.

The encoding of a text is its segmentation into pieces with the largest sum
of scores.  Every text is cut into *chunks* of a fixed number of characters,
wherever that falls.  A chunk yields its transfer matrix: the best score from
each entry state to each exit state, a state being how far a piece reaches
across the boundary.  Matrices combine associatively in the max-plus semiring,
a prefix scan fixes the states at all boundaries, and every chunk is then
traced back on its own.

Inside a chunk no piece crosses certain places (in front of a space mark, and
around characters that occur in no longer piece).  The *stretches* between
them have one state, are the same in every chunk, and are segmented once a
worker, side by side, one lane each; only the chunk's first and last stretch,
which a boundary may cut, have more states.  A chunk without such a place has
a full matrix, found with one lane for each entry state.

Texts of several *segments* (runs of chunks) are shared by several tasks: a
row for each segment gives its matrix, the matrices of a text are scanned, and
the rows are traced with the states at their ends.

The model file is read on the driver and its bytes travel with the task, so
executors need no local copy.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.llm.text import bound_batches, buffers, list_array, trim
from skylattice.storage import broadcast_if_small, materialize

#: The model file; any SentencePiece model without a normalisation table can be named instead.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The space mark.
MARK = "▁"
#: What an unknown character costs beyond the worst piece, as in SentencePiece.
UNKNOWN = 10.0
#: Scores are whole numbers of this unit, so that sums are exact.
UNIT = 1e-6
_NONE = -(1 << 60)
#: Estimated bytes of segmented stretches that a worker keeps.
_CACHE_BYTES = 24_000_000
#: Characters handled at once.
_BLOCK = 500_000
_models: dict = {}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        x = shift = 0
        while True:
            c = data[i]
            i += 1
            x |= (c & 127) << shift
            shift += 7
            if c < 128:
                return x

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[i : i + n]
            i += n


class Pieces:
    """The pieces of a model, their scores and the trie of those that segmentation can use.

    ``scores`` is ``stored`` (as in the file) or ``rank``: a model trained by
    merging stores minus the merge rank, and the logarithm of the rank takes
    its place (Zipf's law), or else sums would favour many early merges over
    one late one.  ``auto`` takes ``rank`` for such models only.
    """

    def __init__(self, model: bytes, scores: str = "auto"):
        pieces, trainer, normalizer = [], {}, {}
        for field, value in _fields(model):
            if field == 1:
                p = dict(_fields(value))
                pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, 1)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        if normalizer.get(2):
            raise ValueError("models with a normalisation table are not supported")
        self.prefix = bool(normalizer.get(3, 1))
        if scores == "auto":
            scores = "rank" if trainer.get(3, 1) == 2 else "stored"
        self.names = [p[0] for p in pieces]
        self.byte = {int(n[1:-1], 16): i for i, (n, _, kind) in enumerate(pieces) if kind == 6}
        usable = [(n, s, i) for i, (n, s, kind) in enumerate(pieces) if kind in (1, 4)]
        if scores == "rank":
            # -1e9 marks what merging never makes; single characters need no merge
            usable = [(n, -math.log(2.0 - s if s > -1e8 else 2.0 + len(pieces)), i) for n, s, i in usable if s > -1e8 or len(n) == 1]
        self.longest = max((len(n) for n, _, _ in usable), default=1)
        worst = min((s for _, s, _ in usable), default=0.0)
        self.unknown = round((worst - UNKNOWN) / UNIT)
        # characters by class; class 0 is any other
        chars = sorted({c for n, _, _ in usable for c in n})
        self.classes = {c: k + 1 for k, c in enumerate(chars)}
        top = max(map(ord, chars), default=0) + 2
        self.class_of = np.zeros(top, np.int64)
        self.class_of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self._build(usable)
        inside = {c for n, _, _ in usable if len(n) > 1 for c in n}
        alone = "".join(c for c in "\n\t\r" if c not in inside)
        marks = [n for n, _, _ in usable if MARK in n[1:]]
        #: Places that no piece crosses: before a mark, or only before the first of several; beside ``alone``.
        self.breaks, self.alone = "mark", alone
        if not marks:
            self.stretch = re.compile(f"{MARK}[^{MARK}{alone}]*|[{alone}]|[^{MARK}{alone}]+" if alone else f"{MARK}[^{MARK}]*|[^{MARK}]+")
        elif all(set(n) == {MARK} or MARK not in n.lstrip(MARK) for n in marks):
            self.stretch = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
            self.breaks, self.alone = "marks", ""
        else:
            self.stretch = re.compile("(?s).+")
            self.breaks, self.alone = "", ""
        self.bytes = []
        for name, _, kind in pieces:
            self.bytes.append(b"" if kind == 3 else bytes([int(name[1:-1], 16)]) if kind == 6 else name.replace(MARK, " ").encode())
        self.cache: dict[str, tuple[bytes, int]] = {}
        self.cached = 0

    def _build(self, usable: list) -> None:
        edges: dict[tuple[int, int], int] = {}
        score, ids = [_NONE], [-1]
        for name, s, i in usable:
            node = 0
            for c in name:
                key = (node, self.classes[c])
                nxt = edges.get(key)
                if nxt is None:
                    nxt = edges[key] = len(score)
                    score.append(_NONE)
                    ids.append(-1)
                node = nxt
            score[node], ids[node] = round(s / UNIT), i
        self.score, self.ids = np.array(score, np.int64), np.array(ids, np.int64)
        self.width = len(self.classes) + 1
        bits = max(4, (4 * len(edges)).bit_length())
        self.shift, self.slots = np.uint64(64 - bits), (1 << bits) - 1
        keys, to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        for (node, c), nxt in edges.items():
            k = node * self.width + c
            at = (k * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> int(self.shift)
            while keys[at] != -1:
                at = (at + 1) & self.slots
            keys[at], to[at] = k, nxt
        self.keys, self.to = keys, to

    def child(self, node: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The trie's next nodes; 0 where there is none."""
        k = node * self.width + c
        at = ((k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        got = self.keys[at]
        out = np.where(got == k, self.to[at], 0)
        left = np.flatnonzero((got != k) & (got != -1))
        while len(left):
            at[left] = (at[left] + 1) & self.slots
            got = self.keys[at[left]]
            hit = got == k[left]
            out[left[hit]] = self.to[at[left[hit]]]
            left = left[~hit & (got != -1)]
        return out

    def lanes(self, code: np.ndarray, length: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best scores, last steps and pieces at all positions, one lane a row.

        ``code`` holds character classes, -1 beyond the text.  Pieces start at
        positions from ``entry`` up to ``length`` - 1 and may end beyond.
        """
        n, w = code.shape
        best = np.full((n, w + 1), _NONE, np.int64)
        step = np.zeros((n, w + 1), np.int8 if self.longest < 127 else np.int32)
        piece = np.full((n, w + 1), -1, np.int32)
        best[np.arange(n), entry] = 0
        for p in range(int(length.max(initial=0))):
            lane = np.flatnonzero((length > p) & (best[:, p] > _NONE))
            if not len(lane):
                continue
            here = best[lane, p]
            single = np.zeros(len(lane), bool)
            act, node = np.arange(len(lane)), np.zeros(len(lane), np.int64)
            for d in range(1, min(self.longest, w - p) + 1):
                c = code[lane[act], p + d - 1]
                ok = c > 0
                act, node, c = act[ok], node[ok], c[ok]
                if not len(act):
                    break
                node = self.child(node, c)
                ok = node > 0
                act, node = act[ok], node[ok]
                s = self.score[node]
                end = s > _NONE
                who, s, i = act[end], s[end], self.ids[node[end]]
                if d == 1:
                    single[who] = True
                at, total = lane[who], here[who] + s
                better = total > best[at, p + d]
                at = at[better]
                best[at, p + d], step[at, p + d], piece[at, p + d] = total[better], d, i[better]
            bare = np.flatnonzero(~single)
            if len(bare):
                at, total = lane[bare], here[bare] + self.unknown
                better = total > best[at, p + 1]
                at = at[better]
                best[at, p + 1], step[at, p + 1], piece[at, p + 1] = total[better], 1, -1
        return best, step, piece

    def code(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        return self.class_of[np.minimum(points, len(self.class_of) - 1)]

    def trace(self, text: str, step: np.ndarray, piece: np.ndarray, end: int, start: int = 0) -> list[int]:
        """The pieces on the best way from ``start`` to ``end``; an unknown character becomes its bytes."""
        out: list[int] = []
        while end > start:
            d, i = int(step[end]), int(piece[end])
            if i >= 0:
                out.append(i)
            elif self.byte:
                out += [self.byte[b] for b in reversed(text[end - 1].encode())]
            else:
                out.append(0)
            end -= d
        return out[::-1]

    def breaks_at(self, text: str, at: int) -> bool:
        """Whether no piece crosses the place in front of ``text[at]``."""
        if at <= 0 or at >= len(text):
            return True
        before, here = text[at - 1], text[at]
        if here == MARK and self.breaks:
            return self.breaks == "mark" or before != MARK
        return here in self.alone or before in self.alone

    def solve(self, jobs: list[tuple[str, int, int]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Best scores, last steps and pieces at all positions for each (text, length, entry), in lanes of similar width."""
        out: list = [None] * len(jobs)
        groups: dict[int, list[int]] = {}
        for i, (t, _, _) in enumerate(jobs):
            groups.setdefault(max(4, 1 << max(0, len(t) - 1).bit_length()), []).append(i)
        for width, who in groups.items():
            width = min(width, max(len(jobs[i][0]) for i in who))
            for at in range(0, len(who), max(1, (1 << 19) // max(1, width))):
                part = [jobs[i] for i in who[at : at + max(1, (1 << 19) // max(1, width))]]
                size = np.array([len(t) for t, _, _ in part])
                code = np.full((len(part), width), -1, np.int64)
                code[np.arange(width) < size[:, None]] = self.code("".join(t for t, _, _ in part))
                got = self.lanes(code, np.array([n for _, n, _ in part]), np.array([e for _, _, e in part]))
                for r in range(len(part)):
                    out[who[at + r]] = tuple(x[r] for x in got)
        return out

    def remember(self, stretches: set[str]) -> None:
        """Segment stretches that are not known yet."""
        if self.cached > _CACHE_BYTES:
            self.cache.clear()
            self.cached = 0
        new = [t for t in stretches if t not in self.cache]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            ids, scores = self.segment(part)
            self.cache.update(zip(part, zip(ids, scores, strict=True), strict=True))
            self.cached += 200 * len(part) + 2 * sum(map(len, part)) + sum(map(len, ids))

    def segment(self, texts: list[str]) -> tuple[list[bytes], list[int]]:
        """Pieces (32-bit integers) and scores of whole stretches, which are traced side by side as well."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(size, kind="stable")
        kind = np.ceil(np.log2(np.maximum(size[order], 4)))
        ids, scores = [b""] * len(texts), [0] * len(texts)
        for lo, hi in pairwise([*np.flatnonzero(np.r_[True, np.diff(kind) != 0]).tolist(), len(order)] if len(order) else []):
            most = max(1, (1 << 19) // max(1, int(size[order[hi - 1]])))
            for at in range(lo, hi, most):
                who = order[at : min(at + most, hi)].tolist()
                part, n = [texts[i] for i in who], size[who]
                width, rows = int(n[-1]), np.arange(len(who))
                code = np.full((len(who), width), -1, np.int64)
                code[np.arange(width) < n[:, None]] = self.code("".join(part))
                best, step, piece = self.lanes(code, n, np.zeros(len(who), np.int64))
                # every round takes a piece from the end of each lane that has one left
                found, count, end = np.empty((len(who), width), "<i4"), np.zeros(len(who), np.int64), n.copy()
                bare = np.zeros(len(who), bool)
                lane, column = np.flatnonzero(end > 0), width
                while len(lane):
                    column -= 1
                    place = end[lane]
                    found[lane, column] = i = piece[lane, place]
                    bare[lane[i < 0]] = True
                    count[lane] += 1
                    end[lane] = place - step[lane, place]
                    lane = lane[end[lane] > 0]
                flat = found[np.arange(width) >= (width - count)[:, None]].tobytes()
                cuts = (4 * np.concatenate([[0], np.cumsum(count)])).tolist()
                for i, a, b, score in zip(who, cuts[:-1], cuts[1:], best[rows, n].tolist(), strict=True):
                    ids[i], scores[i] = flat[a:b], score
                for r in np.flatnonzero(bare).tolist():  # unknown characters become several pieces
                    ids[who[r]] = _ids(self.trace(part[r], step[r], piece[r], len(part[r])))
        return ids, scores

    def mark(self, text: str, first: bool) -> str:
        """The text with marks for spaces; the model may put one in front of it."""
        text = text.replace(" ", MARK)
        return MARK + text if first and self.prefix and text else text

    def chunks(self, before: str, body: str, after: str, size: int) -> list[Chunk]:
        """The chunks of a marked segment; ``before`` and ``after`` are what the text has beside it."""
        text, first = before + body + after, len(before)
        out = []
        for at in range(first, first + len(body), size):
            end = min(at + size, first + len(body))
            parts = self.stretch.findall(text, at, end)
            head, tail = self.breaks_at(text, at), self.breaks_at(text, end)
            beyond = text[end : end + self.longest - 1]
            if head or tail or len(parts) > 1:
                left = "" if head else parts.pop(0)
                right = "" if tail or not parts else parts.pop()
                out.append(Chunk(left, parts, right, "" if tail else beyond, False))
            else:
                out.append(Chunk("", [], parts[0], beyond, True))
        return out

    def matrices(self, chunks: list[Chunk]) -> np.ndarray:
        """The transfer matrix of each chunk; stretches must be known.  What the traces need stays in the chunks."""
        k = self.longest
        out = np.full((len(chunks), k, k), _NONE, np.int64)
        jobs: list[tuple[str, int, int]] = []
        spans = []
        for c in chunks:
            at = len(jobs)
            if not c.whole:
                if c.left:
                    jobs += [(c.left, len(c.left), r) for r in range(min(k, len(c.left)))]
                if c.right:
                    jobs.append((c.right + c.beyond, len(c.right), 0))
            spans.append((at, len(jobs)))
        solved = self.solve(jobs)
        for b, (c, (lo, hi)) in enumerate(zip(chunks, spans, strict=True)):
            if c.whole:
                continue
            into, outof = np.full(k, _NONE, np.int64), np.full(k, _NONE, np.int64)
            lanes = solved[lo:hi]
            if c.right:
                *lanes, c.last = lanes
                reach = c.last[0][len(c.right) : len(c.right) + k]
                outof[: len(reach)] = reach
            else:
                outof[0] = 0
            c.first = lanes
            for r, lane in enumerate(lanes):
                into[r] = lane[0][len(c.left)]
            if len(c.left) < k:  # a piece that ends where the first stretch does
                into[len(c.left)] = 0
            known = list(map(self.cache.__getitem__, c.parts))
            c.inner = b"".join([ids for ids, _ in known])
            inner = sum([score for _, score in known])
            out[b] = np.maximum(into[:, None] + outof[None, :] + inner, _NONE)
        whole = [b for b, c in enumerate(chunks) if c.whole]
        for at in range(0, len(whole), 32):
            some = whole[at : at + 32]
            lanes = self.solve([(chunks[b].right + chunks[b].beyond, len(chunks[b].right), r) for b in some for r in range(min(k, len(chunks[b].right)))])
            for b in some:
                n = len(chunks[b].right)
                for r in range(min(k, n)):
                    reach = lanes.pop(0)[0][n : n + k]
                    out[b, r, : len(reach)] = reach
                for r in range(n, k):  # a piece that reaches beyond a short chunk passes through
                    out[b, r, r - n] = 0
        return out

    def states(self, matrices: np.ndarray, entry: int = 0, leave: int = 0) -> list[int]:
        """The states at all boundaries of a run of chunks on its best way from ``entry`` to ``leave``."""
        n = len(matrices)
        out = [entry] + [leave] * n
        if n > 1:
            prefix = max_plus_scan(matrices)
            for b in range(n - 1, 0, -1):
                out[b] = int((prefix[b - 1][entry] + matrices[b][:, out[b + 1]]).argmax())
        return out

    def traces(self, chunks: list[Chunk], states: list[int]) -> list[bytes]:
        """The pieces of each chunk, given the states at its ends."""
        whole = [b for b, c in enumerate(chunks) if c.whole and states[b] < len(c.right)]
        lanes = {}
        for at in range(0, len(whole), 32):
            some = whole[at : at + 32]
            lanes |= zip(some, self.solve([(chunks[b].right + chunks[b].beyond, len(chunks[b].right), states[b]) for b in some]), strict=True)
        out = []
        for b, c in enumerate(chunks):
            ids: list[bytes] = []
            if c.whole:
                if b in lanes:
                    _, step, piece = lanes[b]
                    ids.append(_ids(self.trace(c.right + c.beyond, step, piece, len(c.right) + states[b + 1], states[b])))
            else:
                if states[b] < len(c.left):
                    _, step, piece = c.first[states[b]]
                    ids.append(_ids(self.trace(c.left, step, piece, len(c.left), states[b])))
                ids.append(c.inner)
                if c.right:
                    _, step, piece = c.last
                    ids.append(_ids(self.trace(c.right + c.beyond, step, piece, len(c.right) + states[b + 1])))
            out.append(b"".join(ids))
        return out

    def encode_block(self, texts: list[str], size: int) -> list[bytes]:
        """Piece numbers of whole texts, as 32-bit integers."""
        chunks = [self.chunks("", self.mark(t, True), "", size) for t in texts]
        self.remember(set().union(*(c.parts for own in chunks for c in own)))
        matrices = self.matrices([c for own in chunks for c in own])
        out, at = [], 0
        for own in chunks:
            states = self.states(matrices[at : at + len(own)])
            out.append(b"".join(self.traces(own, states)))
            at += len(own)
        return out

    def plain(self, ids) -> bytes:
        """The bytes of piece numbers inside a text."""
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids) -> bytes:
        """The UTF-8 text of piece numbers."""
        out = self.plain(ids)
        return out[1:] if self.prefix and out[:1] == b" " else out


@dataclass(slots=True)
class Chunk:
    """A chunk: its first stretch if the boundary cuts it, the stretches inside, its last one if cut, and what follows.

    ``whole`` chunks lie inside one stretch, which is ``right``.
    """

    left: str
    parts: list[str]
    right: str
    beyond: str
    whole: bool
    first: list = field(default_factory=list)
    last: tuple | None = None
    inner: bytes = b""


def _ids(pieces: list[int]) -> bytes:
    return np.array(pieces, "<i4").tobytes()


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of matrices (or of stacks of them)."""
    return np.maximum((a[..., :, :, None] + b[..., None, :, :]).max(axis=-2), _NONE)


def max_plus_scan(m: np.ndarray) -> np.ndarray:
    """Inclusive prefix products, by doubling: all products of one step are independent."""
    out, span = m.copy(), 1
    while span < len(out):
        out[span:] = max_plus(out[:-span], out[span:])
        span *= 2
    return out


def load(model: bytes, scores: str) -> Pieces:
    key = (hashlib.sha256(model).digest(), scores)
    if key not in _models:
        _models[key] = Pieces(model, scores)
    return _models[key]


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _texts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Blocks of texts and where they start; null counts as empty."""
    at, held, size = 0, [], 0
    for r in range(len(column)):
        text = column[r].as_py() or ""
        if held and size + len(text) > _BLOCK:
            yield at, held
            at, held, size = r, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield at, held


def _lists(blobs: list[bytes]) -> pa.ListArray:
    counts = np.array([len(b) // 4 for b in blobs], np.int64)
    return list_array(np.frombuffer(b"".join(blobs), np.int32), np.concatenate([[0], np.cumsum(counts)]))


def _cut(column: pa.Array, segment: int, reach: int) -> Iterator[tuple[int, int, str, str, str]]:
    """(row, segment number, character before, text, characters after) of texts in segments of about ``segment`` bytes."""
    data, off = buffers(column)
    for r in range(len(column)):
        lo, hi = int(off[r]), int(off[r + 1])
        cuts = [lo]
        while hi - cuts[-1] > segment:
            at = cuts[-1] + segment
            while data[at] & 0xC0 == 0x80:  # inside a character
                at -= 1
            cuts.append(at)
        cuts.append(hi)
        for k in range(len(cuts) - 1):
            body = data[cuts[k] : cuts[k + 1]].tobytes().decode()
            before = data[max(lo, cuts[k] - 4) : cuts[k]].tobytes().decode("utf-8", "ignore")[-1:]
            after = data[cuts[k + 1] : min(hi, cuts[k + 1] + 4 * reach)].tobytes().decode("utf-8", "ignore")[:reach]
            yield r, k, before, body, after


def encode(docs: DataFrame, text_col: str = "text", model_path: str = MODEL, scores: str = "auto", chunk: int = 2048, segment: int = 1 << 16, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns in ``keep``) with pieces (array of int), n_tokens and round_trip.

    Null and empty text have no pieces.  round_trip says whether decoding
    gives back the text; it does unless the text holds the space mark itself,
    which SentencePiece cannot tell from a space.  Of segmentations with one
    score any may be given.  Columns of these names are replaced; an empty
    table gives none.  ``chunk`` counts characters; a text of more than
    ``segment`` bytes is shared by several tasks.
    """
    bound_batches(docs)
    model = read_model(model_path)
    longest = load(model, scores).longest
    chunk = max(chunk, longest)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("pieces", "n_tokens", "round_trip")]
    schema = docs.select(keep).schema.add("pieces", T.ArrayType(T.IntegerType())).add("n_tokens", T.LongType()).add("round_trip", T.BooleanType())
    rows = docs.select(F.col(text_col).alias("__text"), *keep)
    several = F.coalesce(F.octet_length("__text") > segment, F.lit(False))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model, scores)
        for batch in batches:
            for at, texts in _texts(batch.column(0)):
                blobs = pieces.encode_block(texts, chunk)
                same = [pieces.decode(np.frombuffer(b, "<i4").tolist()) == t.encode() for b, t in zip(blobs, texts, strict=True)]
                rest = [batch.column(c).slice(at, len(texts)) for c in range(1, batch.num_columns)]
                out = [*rest, _lists(blobs), pa.array([len(b) // 4 for b in blobs], pa.int64()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(out, schema.names)
            trim()

    short = rows.filter(~several).mapInArrow(kernel, schema)
    long = _encode_segments(rows.filter(several), keep, lambda: load(model, scores), longest, chunk, segment)
    return short if long is None else short.unionByName(long)


def _encode_segments(rows: DataFrame, keep: list[str], pieces_of: Callable[[], Pieces], longest: int, chunk: int, segment: int) -> DataFrame | None:
    """The same for texts of several segments, each a row of its own; None if there are none."""
    rows = rows.select(F.monotonically_increasing_id().alias("key"), F.struct(F.lit(0).alias("__none"), *[F.col(c) for c in keep]).alias("row"), "__text")
    head = T.StructType([T.StructField("key", T.LongType()), T.StructField("seg", T.IntegerType())])
    cut_schema = T.StructType([*head.fields, *(T.StructField(c, T.StringType()) for c in ("before", "body", "after")), T.StructField("row", rows.schema["row"].dataType)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            for part in _cut(batch.column(2), segment, longest):
                held.append(part)
                if len(held) * segment >= 8 * _BLOCK:
                    yield cut_rows(batch, held)
                    held = []
            if held:
                yield cut_rows(batch, held)
            trim()

    def cut_rows(batch: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
        # the other columns travel with the first segment only
        own = pa.array([r if k == 0 else None for r, k, *_ in held], pa.int32())
        columns = [batch.column(0).take(pa.array([h[0] for h in held], pa.int32())), *(pa.array([h[i] for h in held], kind) for i, kind in ((1, pa.int32()), (2, pa.string()), (3, pa.string()), (4, pa.string())))]
        return pa.RecordBatch.from_arrays([*columns, batch.column(1).take(own)], cut_schema.names)

    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = materialize(rows.mapInArrow(cut, cut_schema).repartition(spread, "key", "seg"), "piece-segments")
    if cuts.isEmpty():
        return None

    def open_segments(batch: pa.RecordBatch, first: int) -> Iterator[tuple[int, list[Chunk], np.ndarray]]:
        pieces = pieces_of()
        for r in range(batch.num_rows):
            before, body, after = (batch.column(first + i)[r].as_py() for i in range(3))
            start = batch.column(1)[r].as_py() == 0
            chunks = pieces.chunks(pieces.mark(before, False), pieces.mark(body, start), pieces.mark(after, False), chunk)
            pieces.remember({p for c in chunks for p in c.parts})
            yield r, chunks, pieces.matrices(chunks)

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [max_plus_scan(m)[-1].astype("<i8").tobytes() for _, _, m in open_segments(batch, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["key", "seg", "matrix"])
            trim()

    def scan(table: pa.Table) -> pa.Table:
        table = table.sort_by("seg")
        m = np.stack([np.frombuffer(x.as_py(), "<i8").reshape(longest, longest) for x in table.column("matrix")])
        s = pieces_of().states(m)
        return pa.table({"key": table.column("key"), "seg": table.column("seg"), "entry": pa.array(s[:-1], pa.int32()), "leave": pa.array(s[1:], pa.int32())})

    matrices = cuts.select("key", "seg", "before", "body", "after").mapInArrow(transfer, "key long, seg int, matrix binary")
    # a text's matrices are 2 KB a segment, so at most some 64 MB for the longest text that a row can hold
    states = materialize(matrices.groupBy("key").applyInArrow(scan, "key long, seg int, entry int, leave int"), "piece-states")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of()
        for batch in batches:
            blobs, same = [], []
            for r, chunks, m in open_segments(batch, 4):
                entry, leave = batch.column(2)[r].as_py(), batch.column(3)[r].as_py()
                blobs.append(b"".join(pieces.traces(chunks, pieces.states(m, entry, leave))))
                start = batch.column(1)[r].as_py() == 0
                text = batch.column(5)[r].as_py() + batch.column(6)[r].as_py()[:leave]
                ids = np.frombuffer(blobs[-1], "<i4").tolist()
                same.append((pieces.decode(ids) if start else pieces.plain(ids)) == text[entry:].encode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(blobs), pa.array(same, pa.bool_())], ["key", "seg", "pieces", "same"])
            trim()

    found = cuts.select("key", "seg", "before", "body", "after").join(broadcast_if_small(states), ["key", "seg"])
    found = found.select("key", "seg", "entry", "leave", "before", "body", "after").mapInArrow(trace, "key long, seg int, pieces array<int>, same boolean")
    found = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("seg", "pieces"))).alias("parts"), F.min("same").alias("same"))
    found = found.select("key", F.flatten("parts.pieces").alias("pieces"), "same")
    out = cuts.filter("seg = 0").select("key", "row").join(found, "key")
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], "pieces", F.size("pieces").cast("long").alias("n_tokens"), F.col("same").alias("round_trip"))


def decode(table: DataFrame, pieces_col: str = "pieces", text_col: str = "text", model_path: str = MODEL) -> DataFrame:
    """``table`` with the text of its pieces; null pieces give null."""
    model = read_model(model_path)
    keep = [c for c in table.columns if c != text_col]
    at = keep.index(pieces_col)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model, "auto")
        for batch in batches:
            out = [None if ids is None else pieces.decode(ids).decode("utf-8", "replace") for ids in (x.as_py() for x in batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*keep, text_col])
            trim()

    rows = table.select(*keep)
    return rows.mapInArrow(kernel, T.StructType([*rows.schema.fields, T.StructField(text_col, T.StringType())]))

"""Exact deduplication, sharding and mixing against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from skylattice.llm import exact_dedup, mixing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, size int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    out = [(i, f"text {i % 7} " * (i % 5), "en", f"s{i % 3}" if i % 11 else None, 1, "x", 1) for i in range(60)]
    out += [(100, None, None, None, None, None, None), (101, "", "en", "s0", 0, "x", 1), (102, "é ü x\ty" * 40000, "en", "s1", 0, "x", 1)]
    out += [(103, "é ü x\ty" * 40000, "en", "s1", 0, "x", 1), (5, "text 5 " * 0, "en", "s2", 1, "x", 1), (None, "no id", "en", "s2", 1, "x", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def expected_dedup(data):
    groups = defaultdict(list)
    for r in data:
        groups[r[1] or ""].append(r[0])
    out = Counter()
    for r in data:
        g = groups[r[1] or ""]
        keep = max((x for x in g if x is not None), default=None)
        out[r[0], keep, len(g), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("moduli", [exact_dedup.MODULI, ((3, 2), (2, 1))])
def test_exact_dedup(docs, moduli):
    got = exact_dedup.exact_dedup(docs, moduli=moduli, chunk_bytes=1000).collect()
    assert Counter(map(tuple, got)) == expected_dedup(rows())


def test_fingerprints_compose():
    fp = exact_dedup.Fingerprint(chunk_symbols=16)
    data = np.random.default_rng(0).integers(0, 256, 4 * 16 * 37 + 12, dtype=np.uint8)
    whole = fp.of(data)
    for cut in (64, 640, 2000):
        a, b = fp.of(data[:cut]), fp.of(data[cut:])
        assert [fp.combine(a[k], b[k], (len(data) - cut) // 4, k) for k in range(3)] == whole


def test_drop_copies(docs):
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    best = {}
    for r in rows():
        best[r[1] or ""] = max(best.get(r[1] or "", -1), -1 if r[0] is None else r[0])
    got = left.collect()
    assert Counter((r.text or "", -1 if r.doc_id is None else r.doc_id) for r in got) == Counter(best.items())


def test_drop_copies_of_repeated_rows(spark):
    """Rows that repeat id and text leave one row; so do those without an id."""
    data = [(1, "same"), (1, "same"), (2, "x"), (None, "n"), (None, "n"), (3, "same"), (3, "same"), (1, "other"), (4, None), (4, "")]
    left = exact_dedup.drop_copies(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == [(0, "n"), (1, "other"), (2, "x"), (3, "same"), (4, "")]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_dedup(none).count() == 0
    assert sharding.shard_rows(none).count() == 0
    assert mixing.Mix(none).taken().count() == 0


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_sharding(docs, shards):
    got = sharding.shard_rows(docs, shards=shards, salts=4).collect()
    assert len(got) == len(rows())
    text = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == text
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(by) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def walk(data, shards, salts):
    """Every row on its own: to the next point clockwise whose shard has room, a step further each round."""
    points = sharding.ring(shards, 32)
    waiting = defaultdict(list)
    for point, salt, rid, size, crc in data:
        at = np.searchsorted([p[0] for p in points], (point % (1 << 64)) >> (64 - sharding.SLOT_BITS)) % len(points)
        waiting[at].append((salt, point, rid is not None, rid or 0, size, crc, rid))
    room = [len(data) // shards + (s < len(data) % shards) for s in range(shards)]
    used, out = [0] * shards, []
    for step in range(len(points)):
        for arc in range(len(points)):
            left = []
            for row in sorted(waiting[arc]):
                shard = points[(arc + step) % len(points)][1]
                if used[shard] < room[shard]:
                    out.append((row[6], row[4], row[5], shard, used[shard]))
                    used[shard] += 1
                else:
                    left.append(row)
            waiting[arc] = left
    return Counter(out)


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_sharding_walks_the_ring(docs, shards):
    got = sharding.shard_rows(docs, shards=shards, salts=4).collect()
    text = "coalesce(text, '')"
    data = docs.selectExpr(f"xxhash64({text})", f"pmod(xxhash64(doc_id, xxhash64({text})), 4)", "doc_id", f"octet_length({text}) + 8", f"crc32(cast({text} as binary))").collect()
    assert Counter(map(tuple, got)) == walk(data, shards, 4)


def test_overflow_goes_clockwise():
    points = [(10, 0), (20, 1), (30, 2)]
    pieces = sharding.place(points, {1: 9}, 3)
    assert sorted(pieces) == [(1, 0, 3, 1, 0), (1, 3, 6, 2, 0), (1, 6, 9, 0, 0)]


def test_ring_moves_few_rows():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << sharding.SLOT_BITS, 20000)

    def home(shards):
        points = sharding.ring(shards, 32)
        at = np.searchsorted([p[0] for p in points], hashes) % len(points)
        counts = Counter(at.tolist())
        pieces = sharding.place(points, counts, shards, epsilon=0.1)
        assert sum(p[2] - p[1] for p in pieces) == len(hashes)
        where = np.empty(len(hashes), int)
        rank = {a: iter(np.flatnonzero(at == a)) for a in counts}
        for arc, lo, hi, shard, _ in sorted(pieces):
            for _ in range(hi - lo):
                where[next(rank[arc])] = shard
        assert np.bincount(where, minlength=shards).max() <= 1.1 * len(hashes) / shards + 1
        return where

    assert (home(24) != home(25)).mean() < 0.3  # far fewer than by hash modulo


def test_permutations():
    for n in (1, 2, 3, 10, 1000):
        got = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 99, np.uint64))
        assert sorted(got.tolist()) == list(range(n))


def test_targets():
    t = mixing.targets({"a": 100, "b": 1000, None: 10, "c": 0})
    assert abs(sum(t.values()) - 1110) < 1e-9 and t[None] <= 30 and t["a"] <= 300 and t["c"] == 0


def test_mix(docs):
    mix = mixing.Mix(docs, block_words=8, output_shards=5, buckets=4)
    got = mix.taken().collect()
    sizes = Counter((r[0], len(WORDS.findall(r[1] or ""))) for r in rows())
    assert Counter((r.doc_id, r["size"]) for r in got) == sizes
    assert all(r.taken <= 3 * r["size"] for r in got)
    total = defaultdict(int)
    for r in rows():
        total[r[3]] += len(WORDS.findall(r[1] or ""))
    want, source = mixing.targets(total), {(r[0], len(WORDS.findall(r[1] or ""))): r[3] for r in rows()}
    taken = defaultdict(int)
    for r in got:
        taken[source[r.doc_id, r["size"]]] += r.taken
        assert r.source_size == total[source[r.doc_id, r["size"]]]
    for s in total:
        assert abs(taken[s] - want[s]) <= 8 + 0.02 * want[s]
    again = mixing.Mix(docs.repartition(2), block_words=8, output_shards=5, buckets=4).taken().collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    # every slot takes one block, and the blocks of a source differ by one use at most
    slots = mix.slots.collect()
    uses = defaultdict(Counter)
    for r in slots:
        uses[r.sid][r.block] += 1
    assert all(max(c.values()) - min(c.values()) <= 1 for c in uses.values())


def feistel(x, n, seed):
    """The place of one index, in whole numbers."""
    bits = max(1, int(np.ceil(np.log2(max(n, 2)) / 2)))
    m, full = (1 << bits) - 1, (1 << 64) - 1
    while True:
        lo, hi = x & m, x >> bits
        for r in range(4):
            f = (lo + seed + (r + 1) * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 & full
            f = (f ^ (f >> 29)) * 0x94D049BB133111EB & full
            lo, hi = hi ^ ((f ^ (f >> 32)) & m), lo
        x = (hi << bits) | lo
        if x < n:
            return x


def replay(data, block, shards, seed=42):
    """Words taken of each row: the streams word by word, the draw, and every slot's block."""
    total = defaultdict(int)
    for *_, src, size in data:
        total[src] += size
    names = sorted(total, key=lambda s: (s is None, s or ""))
    want = mixing.targets(total)
    blocks = {s: -(-total[s] // block) for s in names}
    takes = [min(3 * blocks[s], round(want[s] * blocks[s] / max(1, total[s]))) for s in names]
    counts = mixing.draw(takes, shards, seed)
    assert counts.sum(axis=1).tolist() == takes
    taken = Counter()
    for sid, s in enumerate(names):
        stream = [r for r in sorted(range(len(data)), key=lambda r: (data[r][0], data[r][1] is not None, data[r][1] or 0, data[r][4], data[r][2])) if data[r][3] == s for _ in range(data[r][4])]
        key = (sid * 1000003 + seed) * 0x9E3779B97F4A7C15 % (1 << 64)
        for slot in range(int(counts[sid].sum())):
            b = feistel(slot % blocks[s], blocks[s], key)
            for r in stream[b * block : (b + 1) * block]:
                taken[r] += 1
    return taken


def test_mix_replayed(docs):
    got = mixing.Mix(docs, block_words=8, output_shards=5, buckets=4).taken().collect()
    size = "coalesce(regexp_count(text, '[^ \\\\t-\\\\r]+'), 0)"
    data = [tuple(r) for r in docs.selectExpr(f"pmod(xxhash64(doc_id, cast({size} as long), xxhash64(text)), 4)", "doc_id", "xxhash64(text)", "source", size).collect()]
    assert sorted(d[4] for d in data) == sorted(len(WORDS.findall(r[1] or "")) for r in rows())
    taken = replay(data, 8, 5)
    assert Counter((r.doc_id, r["size"], r.taken) for r in got) == Counter((d[1], d[4], taken[i]) for i, d in enumerate(data))


def test_mixed_documents_of_repeated_ids(spark):
    """Rows that share an id, or have none, each give what the mix takes of them."""
    data = [(1, "a b c d " * 40, "s"), (1, "e f " * 300, "t"), (None, "g h i " * 100, "s"), (None, "j k " * 50, "t"), (1, "a b c d " * 40, "s"), (2, None, "s"), (3, " ", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(2)
    got = mixing.mixed_documents(docs, block_words=8, output_shards=3, buckets=2).collect()
    taken = Counter()
    for r in mixing.Mix(docs, block_words=8, output_shards=3, buckets=2).taken().collect():
        taken[r.doc_id, r["size"]] += r.taken
    words = Counter()
    full = {(d[0], WORDS.findall(d[1] or "")[0]): len(WORDS.findall(d[1] or "")) for d in data if WORDS.findall(d[1] or "")}
    first = {w: k for k, size in full.items() for w in [d[1].split() for d in data if d[0] == k[0] and d[1] and d[1].split()[:1] == [k[1]]][0]}
    for r in got:
        w = r.text.split()
        assert len({first[x] for x in w}) == 1 and first[w[0]][0] == r.doc_id  # no words of another row
        words[r.doc_id, full[first[w[0]]]] += len(w)
    assert words == Counter({k: v for k, v in taken.items() if v})

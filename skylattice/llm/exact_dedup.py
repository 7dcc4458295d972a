"""Exact deduplication by composable polynomial fingerprints.

A text is a sequence of 4-byte symbols (the tail is padded with zeros and the
byte length is part of the fingerprint).  Chunks are hashed side by side as
rows of one matrix modulo three primes below 2**31, and chunk hashes combine
by ``h(AB) = h(A) * r**len(B) + h(B)``, so a huge text needs no second pass
and no copy.  Rows with equal fingerprints are then compared byte by byte,
chunk after chunk: the least and the greatest chunk of each (fingerprint,
chunk number) are aggregated with map-side combining, and they are the same
exactly if all members agree there.  No group ever meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.llm.text import bound_batches, buffers, trim
from skylattice.storage import broadcast_if_small, materialize

#: (prime, base) pairs; about 93 bits together.
MODULI = ((2147483647, 1103515245), (2147483629, 743102071), (2147483587, 1299709177))
_CHUNK_SYMBOLS = 8192


def _powers(prime: int, base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    x = 1
    for i in range(n - 1, -1, -1):
        out[i] = x
        x = x * base % prime
    return out


class Fingerprint:
    """Chunk hashes and their length-shifted combination."""

    def __init__(self, moduli=MODULI, chunk_symbols: int = _CHUNK_SYMBOLS):
        self.moduli, self.n = tuple(moduli), chunk_symbols
        self.tables = [_powers(p, r, chunk_symbols) for p, r in self.moduli]

    def combine(self, left: int, right: int, right_len: int, k: int) -> int:
        """The hash of a concatenation from the hashes of its parts, for modulus ``k``."""
        p, r = self.moduli[k]
        return (left * pow(r, right_len, p) + right) % p

    def chunk(self, symbols: np.ndarray, k: int) -> int:
        """The hash of at most one chunk of symbols."""
        p = np.uint64(self.moduli[k][0])
        return int((symbols % p * self.tables[k][self.n - len(symbols) :] % p).sum(dtype=np.uint64) % p)

    def of(self, data: np.ndarray) -> list[int]:
        """The fingerprint of a byte array."""
        pad = -len(data) % 4
        if pad:
            data = np.concatenate([data, np.zeros(pad, np.uint8)])
        symbols = np.ascontiguousarray(data).view("<u4")
        whole = len(symbols) // self.n * self.n
        out = []
        for k in range(len(self.moduli)):
            h, p = 0, np.uint64(self.moduli[k][0])
            for at in range(0, whole, 16 * self.n):  # up to 16 chunks side by side
                rows = symbols[at : min(at + 16 * self.n, whole)].reshape(-1, self.n).astype(np.uint64)
                for x in ((rows % p * self.tables[k] % p).sum(axis=1, dtype=np.uint64) % p).tolist():
                    h = self.combine(h, x, self.n, k)
            tail = symbols[whole:].astype(np.uint64)
            out.append(self.combine(h, self.chunk(tail, k), len(tail), k))
        return out


_KEY = ["_n", "_f"]
_FP = T.StructType([T.StructField("_n", T.LongType()), T.StructField("_f", T.BinaryType())])


def _fingerprints(col: pa.Array, fp: Fingerprint) -> tuple[pa.Array, pa.Array]:
    data, off = buffers(col)
    lengths, keys = np.diff(off), []
    for i in range(len(lengths)):
        keys.append(b"".join(x.to_bytes(4, "little") for x in fp.of(data[off[i] : off[i + 1]])))
    return pa.array(lengths, pa.int64()), pa.array(keys, pa.binary())


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    moduli=MODULI,
    chunk_bytes: int = 65536,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty.  Of equal texts the largest id stays; a null id
    is smaller than any other.  A row is kept if its id is its group's
    keep_id, so rows that repeat both id and text say the same.  An empty
    table gives an empty result; other columns are not read.
    """
    bound_batches(docs)
    id_field = docs.schema[id_col]
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = T.StructType([T.StructField("_id", id_field.dataType), *_FP.fields, T.StructField("_sha", T.StringType())])

    def stamp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp = Fingerprint(moduli)
        for batch in batches:
            data, off = buffers(batch.column(1))
            view = memoryview(data)
            sha = [hashlib.sha256(view[off[i] : off[i + 1]]).hexdigest() for i in range(batch.num_rows)]
            n, f = _fingerprints(batch.column(1), fp)
            yield pa.RecordBatch.from_arrays([batch.column(0), n, f, pa.array(sha, pa.string())], ["_id", "_n", "_f", "_sha"])
            trim()

    stamped = materialize(base.mapInArrow(stamp, schema), "fingerprints")
    groups = materialize(
        stamped.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("_size"), F.max("_id").alias("_keep")).filter("_size > 1"),
        "fingerprint-groups",
    )
    key = list(_KEY)
    if not _members_agree(base.select("_text"), groups, moduli, chunk_bytes):
        # different texts share a fingerprint: tell them apart by their digest
        key = [*_KEY, "_sha"]
        groups = materialize(
            stamped.groupBy(*key).agg(F.count(F.lit(1)).alias("_size"), F.max("_id").alias("_keep")).filter("_size > 1"),
            "fingerprint-groups",
        )
    joined = stamped.join(broadcast_if_small(groups), key, "left")
    keep = F.when(F.col("_size").isNotNull(), F.col("_keep")).otherwise(F.col("_id"))
    return joined.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def _members_agree(texts: DataFrame, groups: DataFrame, moduli, chunk_bytes: int) -> bool:
    """Whether all texts of each fingerprint group are the same, byte for byte."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp = Fingerprint(moduli)
        for batch in batches:
            n, f = _fingerprints(batch.column(0), fp)
            yield pa.RecordBatch.from_arrays([n, f, batch.column(0)], ["_n", "_f", "_text"])
            trim()

    schema = T.StructType([*_FP.fields, T.StructField("_text", T.StringType())])
    members = texts.mapInArrow(key, schema).filter("_n > 0").join(broadcast_if_small(groups.select(*_KEY)), _KEY)
    chunks = members.select(
        *_KEY,
        F.col("_text").cast("binary").alias("_bytes"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / F.lit(chunk_bytes)).cast("long"))).alias("_at"),
    ).select(*_KEY, "_at", F.col("_bytes").substr((F.col("_at") * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes)).alias("_chunk"))
    odd = chunks.groupBy(*_KEY, "_at").agg(F.min("_chunk").alias("lo"), F.max("_chunk").alias("hi")).filter("lo <> hi")
    return odd.isEmpty()


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts: one with the largest id.

    Of rows that repeat both id and text any one stays; the others are found
    by their number of rows and reduced by an aggregation that combines on the
    map side, so many of them never meet in one task.
    """
    result = exact_dedup(docs, id_col, text_col).select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha"), "kept")
    few = result.groupBy("__id", "__sha", "kept").agg(F.count(F.lit(1)).alias("n")).filter("not kept or n > 1")
    few = materialize(few, "exact-gone")
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (sha == F.col("__sha"))
    out = docs.join(broadcast_if_small(few.select("__id", "__sha")), same, "left_anti")
    again = few.filter("kept").select("__id", "__sha")
    if again.isEmpty():
        return out
    first = docs.withColumn("__text_sha", sha).join(broadcast_if_small(again), same, "left_semi").groupBy(F.col(id_col), "__text_sha")
    first = first.agg(F.any_value(F.struct(*[F.col(c) for c in docs.columns])).alias("__row")).select("__row.*")
    return out.unionByName(first)

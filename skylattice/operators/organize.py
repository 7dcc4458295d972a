"""Organising files of two sensors: ids, thresholds, pairing, mapping tables."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.operators.numbering import number_rows

#: Least common prefix, in characters, of a pair that shares no id.
MIN_PREFIX = 6


def stem(path: Column) -> Column:
    """File name without folders and extension."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def extract_id(name: Column) -> Column:
    """The last run of digits without leading zeros; without digits, the name itself."""
    run = F.try_element_at(F.regexp_extract_all(name, F.lit(r"(\d+)"), F.lit(1)), F.lit(-1))
    return F.coalesce(F.regexp_replace(run, "^0+(?=.)", ""), name)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two strings, in one pass over their characters."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    # empty strings split into one empty part
    return F.least(F.when(first > 0, first - 1).otherwise(F.size(same)), F.length(a), F.length(b)).cast("int")


def auto_threshold(sizes: DataFrame, col: str) -> DataFrame:
    """One row, threshold: the geometric mean around the largest ratio of neighbouring distinct sizes.

    The first of equal ratios wins; fewer than two sizes give no row.  Sizes
    that are null or not positive (unread images) take no part.
    """
    distinct = number_rows(sizes.select(F.col(col).cast("double").alias("p")).filter(F.col("p") > 0).distinct(), ["p"])
    after = distinct.select((F.col("rn") - 1).alias("rn"), F.col("p").alias("nx"))
    pairs = distinct.join(after, "rn")
    best = pairs.agg(F.max_by(F.struct("p", "nx"), F.struct(F.col("nx") / F.col("p"), -F.col("p"))).alias("b"))
    return best.filter("b is not null").select(F.sqrt(F.col("b.p") * F.col("b.nx")).alias("threshold"))


def classify(files: DataFrame, col: str, threshold: DataFrame) -> DataFrame:
    """``files`` with kind: thermal up to the threshold (the boundary included), else visible."""
    kind = F.when(F.col(col) <= F.col("threshold"), "thermal").otherwise("visible")
    return files.join(F.broadcast(threshold)).withColumn("kind", kind).drop("threshold")  # one row


def pair_by_id(thermal: DataFrame, visible: DataFrame, name: str = "name", order: str = "pos") -> DataFrame:
    """id, thermal, visible: one pair an id, the first of each side by ``order``."""

    def first(side: DataFrame, as_: str) -> DataFrame:
        keyed = side.select(extract_id(stem(F.col(name))).alias("id"), F.col(name).alias("n"), F.col(order).alias("o"))
        return keyed.groupBy("id").agg(F.min_by("n", F.struct("o", "n")).alias(as_))

    return first(thermal, "thermal").join(first(visible, "visible"), "id")


def number_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with idx from 1 in the order of their id as a number; ids that are no numbers come last."""
    numeric = F.col("id").try_cast("decimal(38,0)")
    return number_rows(pairs, [numeric.isNull(), numeric, F.col("id")], "idx")


def best_prefix_partner(left: DataFrame, right: DataFrame, a: str, b: str, least: int = MIN_PREFIX) -> DataFrame:
    """a, b, length: for each string of the left the right one with the longest common prefix, ties to the smaller.

    Prefixes are joined instead of pairs: the right side becomes the smallest
    string of each prefix, so work is linear in the text.
    """
    lengths = lambda c: F.sequence(F.lit(least), F.length(c))
    first = right.select(F.col(b).alias("b")).filter(F.length("b") >= least).select("b", F.explode(lengths("b")).alias("n"))
    first = first.groupBy(F.expr("substring(b, 1, n)").alias("prefix")).agg(F.min("b").alias("b"))
    own = left.select(F.col(a).alias("a")).filter(F.length("a") >= least).distinct().select("a", F.explode(lengths("a")).alias("n"))
    hits = own.withColumn("prefix", F.expr("substring(a, 1, n)")).join(first, "prefix")
    return hits.groupBy("a").agg(F.max("n").alias("length"), F.max_by("b", "n").alias("b")).select("a", "b", "length")


def greedy_prefix_pairs(left: DataFrame, right: DataFrame, a: str, b: str, order: str, least: int = MIN_PREFIX) -> DataFrame:
    """a, b, length: in the left's order each takes the unused right string with the longest common prefix.

    Ties go to the right's order, and prefixes under ``least`` never pair.
    Pairs share their first ``least`` characters, so groups by these are
    independent and the sequential rule runs inside a group only.
    """
    sides = left.select(F.lit(0).alias("side"), F.col(a).alias("s"), F.col(order).cast("long").alias("o"))
    sides = sides.unionByName(right.select(F.lit(1).alias("side"), F.col(b).alias("s"), F.col(order).cast("long").alias("o")))
    sides = sides.filter(F.length("s") >= least).withColumn("key", F.substring("s", 1, least))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["o", "s"], kind="stable")
        free = pdf.s[pdf.side == 1].tolist()
        # the free strings under every prefix, in order; used ones are skipped when met
        by: dict[str, list[int]] = {}
        for i, s in enumerate(free):
            for n in range(least, len(s) + 1):
                by.setdefault(s[:n], []).append(i)
        at, used, out = dict.fromkeys(by, 0), set(), []
        for s in pdf.s[pdf.side == 0]:
            for n in range(len(s), least - 1, -1):
                mine = by.get(s[:n])
                if mine is None:
                    continue
                while at[s[:n]] < len(mine) and mine[at[s[:n]]] in used:
                    at[s[:n]] += 1
                if at[s[:n]] < len(mine):
                    i = mine[at[s[:n]]]
                    used.add(i)
                    out.append((s, free[i], n))
                    break
        return pd.DataFrame(out, columns=["a", "b", "length"])

    return sides.groupBy("key").applyInPandas(match, "a string, b string, length int")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` replacing or adding to it by key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def pending(all_rows: DataFrame, done: DataFrame, key: str, order: Column, n: int | None = None) -> DataFrame:
    """Rows without a result, the first ``n`` of them if a bound is given."""
    left = all_rows.join(done.select(key).distinct(), key, "left_anti").orderBy(order)
    return left.limit(n) if n else left


def planned_names(pairs: DataFrame, idx: str = "idx") -> DataFrame:
    """Target names of organised files: four digits or more."""
    number = F.format_string("%04d", F.col(idx).cast("long"))
    ext = lambda c: F.regexp_extract(c, r"(\.[^./\\]*)$", 1)
    return pairs.withColumn("new_visible", F.concat(F.lit("DJI_"), number, F.lit("_V"), ext("visible"))).withColumn(
        "new_thermal", F.concat(F.lit("DJI_"), number, F.lit("_T"), ext("thermal"))
    )


def unmatched(files: DataFrame, pairs: DataFrame, name: str, side: str) -> DataFrame:
    """The files of one side that no pair holds."""
    return files.join(pairs.select(F.col(side).alias(name)), name, "left_anti").select(F.lit(side).alias("side"), name)


def parse_output(path: Column, suffix: str) -> Column:
    """The image number in an output's name, ``<idx><suffix>``; null for other names."""
    return F.nullif(F.regexp_extract(path, r"([^/\\]+)" + re.escape(suffix) + "$", 1), F.lit(""))


def dry_run(plan: DataFrame, order: str = "idx", n: int = 10) -> DataFrame:
    """The first ``n`` planned rows; nothing is written."""
    return plan.orderBy(order).limit(n)


def original_names(mapping: DataFrame, original: str = "original_visible", new: str = "new_visible") -> DataFrame:
    """idx, original, new: file names without folders; of rows with one new name the one with the greatest index stays.

    Read from left to right it leads from the survey's names to the organised
    ones, and from right to left back.
    """
    name = lambda c: F.regexp_extract(c, r"([^/\\]*)$", 1)
    rows = mapping.select(F.col("index").alias("idx"), name(original).alias("original"), name(new).alias("new"))
    last = rows.groupBy("new").agg(F.max_by(F.struct("idx", "original"), F.struct(F.col("idx").try_cast("long"), "idx")).alias("r"))
    return last.select("r.idx", "r.original", "new")


def file_mapping_index(mapping: DataFrame, path: str, key: str) -> DataFrame:
    """One path a key, the greatest by name."""
    return mapping.groupBy(key).agg(F.max(path).alias(path))



"""Line corpora: alignment, grouped splits without leakage, hashes and manifests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumflow.sources.scratch import cut

COLUMNS = ["text", "image_path", "language", "century", "shelfmark", "project", "source_corpus"]
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])

# File name prefixes and the registers they belong to.
SHELFMARKS = {"FRAN_0021": "JJ207", "FRAN_0200": "JJ210"}


def lines(docs: DataFrame, text_col: str = "text", out: str = "line") -> DataFrame:
    """A row per line that isn't blank, with ``line_no`` from 0 over all lines."""
    from vellumflow.functions.text import is_blank

    rows = docs.select("*", F.posexplode(F.split(text_col, "\n")).alias("line_no", out)).drop(text_col)
    return rows.filter(~is_blank(F.col(out)))


def filter_members(df: DataFrame, **allowed: list) -> DataFrame:
    """Rows whose columns, as text, are all among the allowed values."""
    for name, values in allowed.items():
        df = df.filter(F.col(name).cast("string").isin([str(v) for v in values]))
    return df


def align(df: DataFrame, columns: list[str] = COLUMNS) -> DataFrame:
    """The common columns as text, absent ones null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in columns])


def union_aligned(frames: list[DataFrame], columns: list[str] = COLUMNS) -> DataFrame:
    """All rows of all frames, in the common columns."""
    out = align(frames[0], columns)
    for df in frames[1:]:
        out = out.unionByName(align(df, columns))
    return out


def with_image_path(df: DataFrame, index_col: str = "source_idx", pattern: str = "images/ligne_%d.png") -> DataFrame:
    return df.withColumn("image_path", F.format_string(pattern, F.col(index_col)))


def shelfmark_of(file_name: Column, table: dict[str, str] = SHELFMARKS) -> Column:
    out = None
    for start, name in table.items():
        out = (F.when if out is None else out.when)(file_name.startswith(start), F.lit(name))
    return out.otherwise(F.lit("unknown"))


def column_or(df: DataFrame, name: str, default: str = "?") -> Column:
    return F.col(name) if name in df.columns else F.lit(default)


def dense_index(df: DataFrame, order: list[str], out: str = "index") -> DataFrame:
    """0, 1, 2 ... in a given order, by offsets of range partitions: no task orders all rows.

    The sorted rows are written once and read for sizes and numbers, so ties in
    ``order`` keep the number they got, but a rerun may number them otherwise.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut(ranges.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", "_first", before.alias("_before"))
    return rows.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_first", "_before")


def with_source_index(df: DataFrame, order: list[str], keep: Column, out: str = "source_idx") -> DataFrame:
    """The rows to keep, with the number each had among all rows; names of files made from it stay true after any filter."""
    return dense_index(df.withColumn("_keep", F.coalesce(keep, F.lit(False))), order, out).filter("_keep").drop("_keep")


def split_missing(df: DataFrame, known: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key ``known`` has, and the others; null keys are missing."""
    keys = known.select(on).distinct()
    return df.join(keys, on, "left_semi"), df.join(keys, on, "left_anti")


def value_counts(df: DataFrame, col: str, *, normalize: bool = False, digits: int = 3) -> DataFrame:
    """Rows per value, or their share; nulls are left out."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    if not normalize:
        return counts.orderBy(F.desc("n"), col)
    total = df.agg(F.count(col).alias("_total"))
    return counts.join(F.broadcast(total)).select(col, F.round(F.col("n") / F.col("_total"), digits).alias("share")).orderBy(F.desc("share"), col)


def first_rows(df: DataFrame, order: list[str], n: int = 1) -> DataFrame:
    """The first ``n`` rows in an order; each task passes on ``n`` at most."""
    return df.orderBy(*order).limit(n)


def last_rows(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The last ``n`` rows in an order (nulls are its first), in that order."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def allowed_sources(df: DataFrame, sources: DataFrame, allowed: list[str], *, source: str = "source_corpus", license_col: str = "license") -> DataFrame:
    """Rows whose source has an allowed licence, by a table of sources; sources that it lacks are refused."""
    good = sources.filter(F.lower(F.trim(license_col)).isin([a.lower().strip() for a in allowed])).select(F.col(source).alias("_source")).distinct()
    return df.join(good, F.col(source) == F.col("_source"), "left_semi")


def sample_rows(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer), those with the smallest hash of seed and id."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), id_col).limit(n)


def _order(seed: Column, group: Column, salt: str = "") -> Column:
    return F.md5(F.concat_ws(":", seed.cast("string"), F.lit(salt), group) if salt else F.concat_ws(":", seed.cast("string"), group))


def kth_smallest(df: DataFrame, hashed: str, tie: str, k: int, *, digits: int = 3, few: int = 4096) -> tuple[str, str] | None:
    """The hash (hexadecimal text, not null) and tie of the ``k``-th smallest row, from 1; None if there are not so many.

    Rows are counted by the next digits of their hash and the place that holds the
    rank is counted again by the digits after, until it has ``few`` rows or its rows
    share their hash. A round brings 16**digits counts to the driver, never the rows.
    """
    prefix, length = "", df.agg(F.max(F.length(hashed))).first()[0] or 0
    here = df.select(hashed, tie)
    while k > 0:
        place = F.substring(hashed, len(prefix) + 1, digits)
        for next_digits, n in sorted(map(tuple, here.groupBy(place).count().collect())):
            if k <= n:
                break
            k -= n
        else:
            return None
        prefix += next_digits
        here = here.filter(F.col(hashed).startswith(prefix))
        if n <= few or len(prefix) >= length:
            found = here.orderBy(hashed, tie).offset(k - 1).limit(1).first()
            return found[hashed], found[tie]
    return None


def group_split(df: DataFrame, group: str, *, seed: int = 42, test: float = 0.15, val: float = 0.15) -> DataFrame:
    """group, split: whole groups go to test, val or train.

    Groups are shuffled by a hash of seed and name; the first ceil(test * n) are
    test, of the rest the first ceil(val / (1 - test) * rest) are val. The last group
    of each is found by its rank, so no task orders all groups. Null groups have none.
    """
    names = df.select(F.col(group).cast("string").alias("group")).filter("group is not null").distinct()
    hashed = {"_h": _order(F.lit(seed), F.col("group")), "_v": _order(F.lit(seed), F.col("group"), "val")}
    groups = cut(names.withColumns(hashed), "groups")

    def first(rows: DataFrame, by: str, share: float) -> Column:
        n = rows.count()
        last = kth_smallest(rows, by, "group", min(n, math.ceil(share * n)))
        return (F.col(by) < last[0]) | ((F.col(by) == last[0]) & (F.col("group") <= last[1])) if last else F.lit(False)

    is_test = first(groups, "_h", test)
    is_val = first(groups.filter(~is_test), "_v", val / (1 - test)) if test < 1 else F.lit(False)
    return groups.select("group", F.when(is_test, "test").when(is_val, "val").otherwise("train").alias("split"))


def _assigned(groups: DataFrame, seeds: DataFrame, test: float, val: float) -> DataFrame:
    """seed1, seed2, group, split for every pair of seeds: a table of seeds x groups, never of lines."""
    n = F.count("*").over(Window.partitionBy("seed1"))
    first = groups.join(seeds.select("seed1").distinct()).select("seed1", "group", F.row_number().over(Window.partitionBy("seed1").orderBy(_order(F.col("seed1"), F.col("group")), "group")).alias("k"), n.alias("n"))
    first = first.withColumn("is_test", F.col("k") <= F.ceil(F.lit(test) * F.col("n")))
    rest = first.filter(~F.col("is_test")).join(seeds, "seed1")
    w = Window.partitionBy("seed1", "seed2")
    rest = rest.select("seed1", "seed2", "group", F.row_number().over(w.orderBy(_order(F.col("seed2"), F.col("group"), "val"), "group")).alias("k"), F.count("*").over(w).alias("n"))
    rest = rest.select("seed1", "seed2", "group", F.when(F.col("k") <= F.ceil(F.lit(val / (1 - test)) * F.col("n")), F.lit("val")).otherwise(F.lit("train")).alias("split"))
    held = first.filter("is_test").join(seeds, "seed1").select("seed1", "seed2", "group", F.lit("test").alias("split"))
    return rest.unionByName(held)


def split_search(df: DataFrame, group: str, stratum: str | None = None, strata: list[str] | None = None, *, seeds: int = 60, test: float = 0.15, val: float = 0.15) -> DataFrame:
    """score, seed1, seed2 of the best pair of seeds: the smallest score, then seeds.

    Score: squared distances of the splits' sizes from their targets, and of each
    split's shares of ``strata`` from the whole's. Lines are counted once, by group
    and stratum; the search runs over those counts.
    """
    strata = strata or []
    kinds = [F.count_if(F.col(stratum).cast("string") == s).alias(f"s{i}") for i, s in enumerate(strata)]
    counts = df.filter(F.col(group).isNotNull()).groupBy(F.col(group).cast("string").alias("group")).agg(F.count("*").alias("n"), *kinds)
    spark = df.sparkSession
    pairs = spark.range(seeds).select(F.col("id").cast("int").alias("seed1")).join(spark.range(seeds).select(F.col("id").cast("int").alias("seed2")))
    parts = _assigned(counts.select("group"), pairs, test, val).join(counts, "group").groupBy("seed1", "seed2", "split").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(strata))])
    total = counts.agg(F.sum("n").alias("all_n"), *[F.sum(f"s{i}").alias(f"all_s{i}") for i in range(len(strata))])
    target = F.when(F.col("split") == "train", 1 - test - val).when(F.col("split") == "val", val).otherwise(test)

    def square(x: Column) -> Column:
        return x * x

    score = square(F.col("n") / F.col("all_n") - target)
    for i in range(len(strata)):
        score = score + square(F.col(f"s{i}") / F.col("n") - F.col(f"all_s{i}") / F.col("all_n"))
    scored = parts.join(F.broadcast(total)).withColumn("part", score).groupBy("seed1", "seed2").agg(F.round(F.sum("part"), 12).alias("score"))
    return scored.agg(F.min(F.struct("score", "seed1", "seed2")).alias("best")).select("best.score", "best.seed1", "best.seed2")


def with_split(df: DataFrame, group: str, assigned: DataFrame) -> DataFrame:
    """Rows and their group's split; Spark broadcasts the table of groups if it is small."""
    key = assigned.select(F.col("group").alias("_group"), "split")
    return df.join(key, F.col(group).cast("string") == F.col("_group")).drop("_group")


def leaks(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that lie in more than one split."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("n_splits")).filter("n_splits > 1")


def content_hash(df: DataFrame, by: str, row: Column) -> DataFrame:
    """A hash per group that depends on its rows and not on their order.

    Rows' SHA-256 digests are added up in four 60-bit lanes, with the row count, so
    that partial sums combine before the shuffle and no group is gathered.
    """
    digest = F.sha2(row.cast("string"), 256)
    lane = [F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"l{i}") for i in range(4)]
    sums = df.groupBy(by).agg(F.count("*").alias("n"), *lane)
    return sums.select(by, "n", F.sha2(F.concat_ws(":", "n", *[F.col(f"l{i}").cast("string") for i in range(4)]), 256).alias("sha256"))


def overlap(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of ``df``, those whose key ``other`` has too, and their share."""
    keys = other.select(F.col(key).alias("_k"), F.lit(1).alias("_hit")).distinct()
    joined = df.join(keys, F.col(key) == F.col("_k"), "left")
    return joined.agg(F.count("*").alias("n"), F.count("_hit").alias("n_shared")).withColumn("share", F.when(F.col("n") > 0, F.col("n_shared") / F.col("n")).otherwise(F.lit(0.0)))


def group_documents(df: DataFrame, group: str, text: str, order: list[str]) -> DataFrame:
    """One document per group, its lines in order and joined by spaces: a row is meant to hold a whole group."""
    gathered = df.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(*order, text))).alias("rows"), F.count("*").alias("n_lines"))
    return gathered.select(group, F.array_join(F.transform("rows", lambda r: r[text]), " ").alias("document"), "n_lines")


def update_element(array: Column, key: str, value: Column, **fields: Column) -> Column:
    """Fields of the structs whose ``key`` equals ``value``; the others stay."""

    def one(x: Column) -> Column:
        new = x
        for name, v in fields.items():
            new = new.withField(name, v)
        return F.when(x[key] == value, new).otherwise(x)

    return F.transform(array, one)

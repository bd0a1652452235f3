"""Deterministic samples, partitions and leak checks. Orders come from hashes, so they repeat on any cluster."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(seed: int | str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(str(seed)), F.lit(":"), key.cast("string")), 256)


def rank_rows(df: DataFrame, order: list[Column], into: str, buckets: int | None = None, rows_a_bucket: int = 100_000) -> DataFrame:
    """Add a global row number from 0 by `order` (strings, hex digits first): counts of hash ranges, then ranks within each, so that no task sees all rows.

    Without `buckets` their number follows the number of rows.
    """
    if buckets is None:
        buckets = min(65536, max(8, -(-df.count() // rows_a_bucket)))
    keyed = df.withColumn("__b", F.conv(F.substr(order[0], F.lit(1), F.lit(4)), 16, 10).cast("int") % F.lit(65536))
    keyed = keyed.withColumn("__b", F.floor(F.col("__b") * buckets / 65536).cast("int"))
    before = keyed.groupBy("__b").agg(F.count("*").alias("__n"))
    base = before.withColumn("__base", F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).drop("__n")  # `buckets` rows
    k = F.row_number().over(Window.partitionBy("__b").orderBy(*order))
    return keyed.join(F.broadcast(base), "__b").withColumn(into, F.col("__base") + k - 1).drop("__b", "__base")


def sample(df: DataFrame, key: str, n: int, seed: int, strict: bool = True) -> DataFrame:
    """n rows by the order of hashes of a key (top-k, not a full sort). strict: fewer rows are an error."""
    out = df.orderBy(order_key(seed, F.col(key)), key).limit(n)
    if strict and (found := out.count()) < n:
        raise ValueError(f"{n} rows wanted, {found} there")
    return out


def per_class(df: DataFrame, key: str, label: str, quotas: dict[str, int], seed: int, strict: bool = True) -> DataFrame:
    """A quota of rows of each class; fewer are an error if strict."""
    return reduce(DataFrame.unionByName, [sample(df.filter(F.col(label) == c), key, n, seed, strict) for c, n in quotas.items()])


def partition(df: DataFrame, key: str, splits: list[str], seed: int) -> DataFrame:
    """Distinct keys dealt to splits in turn, in the order of their hashes: sizes differ by one at most."""
    distinct = df.select(key).distinct().withColumn("__h", order_key(seed, F.col(key)))
    ranked = rank_rows(distinct, [F.col("__h"), F.col(key).cast("string")], "__k")
    names = F.array(*map(F.lit, splits))
    return ranked.select(key, F.get(names, F.pmod("__k", F.lit(len(splits))).cast("int")).alias("split"))


def grouped_split(df: DataFrame, group: str, share: float, seed: int) -> DataFrame:
    """All rows with split train or eval: the first `share` of groups by hash train, and a group is never in both."""
    groups = df.select(group).distinct().withColumn("__h", order_key(seed, F.col(group)))
    ranked = rank_rows(groups, [F.col("__h"), F.col(group).cast("string")], "__k")
    n = groups.agg(F.count("*").alias("__n"))
    marked = ranked.join(F.broadcast(n), F.lit(True)).select(group, F.when(F.col("__k") < F.floor(F.col("__n") * F.lit(share)), "train").otherwise("eval").alias("split"))
    return df.join(marked, group)


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the first by order."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__k = 1").drop("__k")


def first_n(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("__k") <= n).drop("__k")


def overlap(rows: DataFrame, splits: list[str], dimensions: dict[str, Column], examples: int = 5) -> DataFrame:
    """(left_split, right_split, dimension, n, examples) for every pair of splits and dimension, zeros too. rows has a column split."""
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("value")) for n, c in dimensions.items()]))
    long = rows.select("split", values.alias("x")).select("split", "x.*").filter("value is not null").distinct()
    # A value's splits are a small set; its pairs are made within one row, so there is one shuffle and no self-join.
    held = long.groupBy("dimension", "value").agg(F.sort_array(F.collect_set("split")).alias("s")).filter(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("left_split"), b.alias("right_split")))))
    met = held.select("dimension", "value", F.explode(pairs).alias("p")).select("dimension", "value", "p.*")
    w = Window.partitionBy("dimension", "left_split", "right_split").orderBy("value")
    counted = met.groupBy("dimension", "left_split", "right_split").agg(F.count("*").alias("n"))
    few = met.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= examples).groupBy("dimension", "left_split", "right_split").agg(F.sort_array(F.collect_list("value")).alias("examples"))
    names = sorted(splits)
    frame = rows.sparkSession.createDataFrame([(a, b, x) for i, a in enumerate(names) for b in names[i + 1 :] for x in dimensions], "left_split string, right_split string, dimension string")
    keys = ["dimension", "left_split", "right_split"]
    out = frame.join(counted, keys, "left").join(few, keys, "left")
    return out.select(*keys, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def assert_disjoint(report: DataFrame) -> None:
    if bad := report.filter("n > 0").limit(5).collect():
        raise ValueError(f"splits overlap: {[(r['left_split'], r['right_split'], r['dimension'], r['n']) for r in bad]}")


def exclude(df: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    return df.join(excluded.select(key).distinct(), key, "left_anti")


def existing(df: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    return df.join(listing.select(key), key, "left_semi")


def lookup(df: DataFrame, key: str, table: DataFrame, value: str, default: str = "") -> DataFrame:
    """df with table's value of its key (one row a key), or the default where key or value is missing."""
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def same_order(a: DataFrame, b: DataFrame, place: str, key: str) -> DataFrame:
    """One row: n_left, n_right, n_different (places held by one side only or by different keys), equal."""
    left, right = (x.select(F.col(place).alias("at"), F.struct(key).alias(n)) for x, n in ((a, "l"), (b, "r")))
    met = left.join(right, "at", "full")
    out = met.agg(F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.count_if(~F.col("l").eqNullSafe(F.col("r"))).alias("n_different"))
    return out.withColumn("equal", F.col("n_different") == 0)

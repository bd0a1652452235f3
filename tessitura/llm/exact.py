"""Exact dedup with a log-structured merge index of text digests.

Memtables flush sorted runs with Bloom filters; compaction merges the runs in order and keeps the extreme identifier of each
digest, digests met again apart from those met once; rows whose digest the filter of the run of digests met again may hold
are looked up there, and every hit is verified byte by byte against the text of the row that stays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.llm import bloom
from tessitura.llm.common import store, table


@dataclass(frozen=True)
class Run:
    """A table of the log (digest, keep_id, n), sorted by digest within its files, and the filter that was flushed with it."""

    table: DataFrame
    held: bloom.Sieve


class DigestLog:
    """The index: runs in tables of the shared folder. Digests are binary; identifiers are longs, null last in any order.

    add(): a table (digest, id) through memtables into a new level of sorted runs. compact(): all runs into two, of digests
    met once and of digests met again. lookup(): what the index has of other rows' digests. keep: "min" or "max", the
    identifier that stays.
    """

    def __init__(self, spark: SparkSession, keep: str = "min", memtable_rows: int = 100_000):
        if keep not in ("min", "max"):
            raise ValueError(f"keep is min or max, not {keep!r}")
        self.spark, self.keep, self.memtable_rows = spark, keep, memtable_rows
        self.runs: list[Run] = []
        self.compacted = False

    def _flush(self, rows: DataFrame, label: str) -> Run:
        run = store(rows, label)
        return Run(run, bloom.sieve(run.select(F.xxhash64("digest"))))

    def add(self, rows: DataFrame) -> None:
        """Rows (digest, id) as sorted runs: a memtable takes rows until it is full, is sorted, and its equal digests become one row."""
        most, larger = self.memtable_rows, self.keep == "max"

        def memtables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mem: list[pa.RecordBatch] = []
            for b in batches:
                for i in range(0, b.num_rows, most):
                    mem.append(pa.RecordBatch.from_arrays([b.column(0).slice(i, most), b.column(1).slice(i, most), pa.array(np.ones(min(most, b.num_rows - i), np.int64))], RUN))
                    if sum(m.num_rows for m in mem) >= most:
                        yield from _fold(pa.Table.from_batches(mem).sort_by("digest").to_batches(), larger)
                        mem = []
            if mem:
                yield from _fold(pa.Table.from_batches(mem).sort_by("digest").to_batches(), larger)

        self.runs.append(self._flush(rows.mapInArrow(memtables, RUN_SCHEMA), "run"))
        self.compacted = False

    def compact(self) -> tuple[Run, Run]:
        """Merge all runs: rows of one digest come together in sorted order, and a pass over them keeps one of each.

        (digests met once, digests met again), each a run of its own with its filter.
        """
        if not self.compacted:
            larger = self.keep == "max"
            both = reduce(DataFrame.unionByName, [r.table for r in self.runs]).select(*RUN)
            merged = store(both.repartition("digest").sortWithinPartitions("digest").mapInArrow(lambda it: _fold(it, larger), RUN_SCHEMA), "merged")
            self.runs = [Run(t, bloom.sieve(t.select(F.xxhash64("digest")))) for t in (merged.filter("n = 1"), merged.filter("n > 1"))]
            self.compacted = True
        return self.runs[0], self.runs[1]

    def lookup(self, rows: DataFrame) -> DataFrame:
        """rows (with a column digest) and keep_id, n of the index, null where it has none. Rows that no run's filter may hold skip the join."""
        marked = rows.withColumn("__maybe", F.lit(False))
        for r in self.runs:
            marked = bloom.mark(marked, F.xxhash64("digest"), r.held, "__now").withColumn("__maybe", F.col("__maybe") | F.col("__now")).drop("__now")
        found = reduce(DataFrame.unionByName, [r.table for r in self.runs]).groupBy("digest").agg((F.max if self.keep == "max" else F.min)("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        none = {"keep_id": F.lit(None).cast("long"), "n": F.lit(None).cast("long")}
        return marked.filter("__maybe").join(found, "digest", "left").unionByName(marked.filter("not __maybe").withColumns(none)).drop("__maybe")


RUN, RUN_SCHEMA = ["digest", "keep_id", "n"], "digest binary, keep_id long, n long"


def _fold(batches: Iterable[pa.RecordBatch], larger: bool) -> Iterator[pa.RecordBatch]:
    """Rows (digest, keep_id, n) sorted by digest, with the rows of each digest made one: its extreme identifier and the sum of n."""
    carry: pa.RecordBatch | None = None  # the last digest so far, which may go on
    for b in batches:
        if carry is not None:
            b = pa.Table.from_batches([carry, b]).combine_chunks().to_batches()[0]
        if not b.num_rows:
            continue
        d = b.column(0)
        new = np.append(True, pc.not_equal(d.slice(1), d.slice(0, len(d) - 1)).to_numpy(zero_copy_only=False))
        at = np.flatnonzero(new)
        keep = b.column(1)
        worst = np.iinfo(np.int64).min if larger else np.iinfo(np.int64).max
        ids = keep.fill_null(worst).to_numpy(zero_copy_only=False)
        best = (np.maximum if larger else np.minimum).reduceat(ids, at)
        some = np.add.reduceat(keep.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), at) > 0
        folded = pa.RecordBatch.from_arrays([d.take(pa.array(at)), pa.array(best, pa.int64(), mask=~some), pa.array(np.add.reduceat(b.column(2).to_numpy(), at))], RUN)
        carry = folded.slice(folded.num_rows - 1)
        yield folded.slice(0, folded.num_rows - 1)
    if carry is not None:
        yield carry


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "min", digest: Column | None = None, salts: int = 32, hot_rows: int = 1_000, memtable_rows: int = 100_000) -> DataFrame:
    """Add keep_id, group_size, kept, digest (binary) to every row of docs.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the least (keep="max": the
    largest) id stays, null ids last; of repeated rows with that id and text one stays, by the order of their other
    columns as JSON. group_size counts all rows with the text, repeated ones too. An empty table gives no rows. Columns
    of docs with the names of results are replaced; other names are left alone, as docs' columns travel in one struct.

    digest: SHA-256 of the text by default; texts of equal digests are compared, so that weaker ones give the same result.
    A digest of more than hot_rows rows and a thousandth of all is dealt over `salts` tasks; there are at most a thousand.
    """
    spark = docs.sparkSession
    own = docs.drop("keep_id", "group_size", "kept", "digest")
    content = F.coalesce(F.col(text), F.lit(""))
    code = F.unhex(F.sha2(content, 256)) if digest is None else digest
    rows = own.select(code.alias("digest"), F.col(doc_id).cast("long").alias("id"), F.struct("*").alias("row"))

    log = DigestLog(spark, keep, memtable_rows)
    log.add(rows.select("digest", "id"))
    once, again = log.compact()
    total = once.table.count() + (again.table.agg(F.sum("n")).first()[0] or 0)
    least = max(hot_rows, total // 1000)
    hot = [bytes(r["digest"]) for r in again.table.filter(F.col("n") > least).select("digest").collect()]  # a thousand at most
    zero = F.lit(0).cast("long")
    if hot:
        salt_of = lambda d, i: F.when(d.isin(hot), F.pmod(F.xxhash64(i), F.lit(salts).cast("long"))).otherwise(zero)
        all_salts = lambda d: F.explode(F.when(d.isin(hot), F.sequence(zero, zero + (salts - 1))).otherwise(F.array(zero)))
    else:
        salt_of, all_salts = (lambda d, i: zero), (lambda d: zero)

    marked = bloom.mark(rows, F.xxhash64("digest"), again.held, "maybe")
    single = marked.filter(~F.col("maybe")).select("row", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    twice = again.table.select("digest", "keep_id", "n")
    met = (
        marked.filter("maybe").withColumn("salt", salt_of(F.col("digest"), F.col("id")))
        .join(twice.withColumn("salt", all_salts(F.col("digest"))), ["digest", "salt"], "left")
    )
    lone = met.filter(F.col("n").isNull()).select("row", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    member = met.filter(F.col("n").isNotNull())
    # Byte verification: each member against one text of the row that stays.
    its_text = F.coalesce(F.col(f"row.{text}"), F.lit(""))
    heads = member.filter(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min(its_text).alias("head")).withColumn("salt", all_salts(F.col("digest")))
    order = F.to_json(F.struct("row"))
    verified = (
        member.join(heads, ["digest", "salt"])
        .withColumn("same", its_text == F.col("head"))
        .drop("head")
        .withColumn("k", F.row_number().over(Window.partitionBy("digest", "salt", "same", "id").orderBy(F.when(F.col("id").eqNullSafe(F.col("keep_id")), order))))
    )
    if digest is None:  # SHA-256: a difference would be news; it is met with an error, not with a wrong group
        member_out = verified.select("row", "keep_id", F.col("n").alias("group_size"), (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("k") == 1) & F.assert_true("same").isNull()).alias("kept"), "digest")
        parts = [single, lone, member_out]
    else:
        held = store(verified, "verified")
        apart = held.filter("not same").withColumn("t", its_text)
        pick = F.max("id") if keep == "max" else F.min("id")
        texts = apart.groupBy("digest", "t").agg(pick.alias("own_id"), F.count("*").alias("own_n"))
        mine = Window.partitionBy("digest", "t", "id").orderBy(order)
        others = apart.join(texts, ["digest", "t"]).withColumn("k", F.row_number().over(mine)).select("row", F.col("own_id").alias("keep_id"), F.col("own_n").alias("group_size"), (F.col("id").eqNullSafe(F.col("own_id")) & (F.col("k") == 1)).alias("kept"), "digest")
        less = apart.groupBy("digest").agg(F.count("*").alias("gone"))
        same = held.filter("same").join(less, "digest", "left").select("row", "keep_id", (F.col("n") - F.coalesce("gone", F.lit(0))).alias("group_size"), (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("k") == 1)).alias("kept"), "digest")
        parts = [single, lone, same, others]
    return reduce(DataFrame.unionByName, parts).select("row.*", "keep_id", "group_size", "kept", "digest")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts; the largest doc_id stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = exact_dedup(docs, keep="max")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP10_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(text) AS text_sha256
FROM d WINDOW g AS (PARTITION BY text)
"""

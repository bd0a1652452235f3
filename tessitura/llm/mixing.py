"""Mixing overlapping sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to; the flow routes each pattern's token capacity to its
sources' quotas at convex repetition costs (a first copy is free, each further copy costs more); then whole documents are
selected in a seeded order, past those that do not fit, and the rest of each pattern's flow is closed by subset sums. Only
patterns, never documents, reach the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.llm.common import WORD, store, table

MOST_PATTERNS = 200_000
#: Documents of a pattern, half of them taken and half not, whose subset sums close the gap that the selection in order leaves.
POOL = 200
#: Bits of one table of reachable sums; larger sums are counted in units.
SUM_BITS = 1 << 22


def targets(sizes: dict[str | None, int], weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words due to each source: share of all sizes by weight, none above `most` times its own size, the excess reshared by weight.

    Weights repeat over the sources in order of code points, null last.
    """
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, open_ = share * sum(sizes.values()), list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: most * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def min_cost_flow(capacity: dict[tuple, int], quota: dict[str | None, float], copies: int = 2) -> dict[tuple[tuple, str | None], float]:
    """Flow of each (pattern, source): successive cheapest paths. capacity: tokens of one copy of a pattern (its sources).

    Copy c of a pattern costs c - 1 a token; not meeting a quota costs more than any copy. Patterns reach only their sources,
    so the graph has one node for each pattern and source, one edge for each membership and `copies` edges into a pattern.
    """
    inn = {p: [0.0] * copies for p in capacity}
    order = sorted(capacity, key=repr)
    flow: dict[tuple[tuple, str | None], float] = {}
    need = dict(quota)
    eps = 1e-9 * max(1.0, sum(quota.values()))
    members: dict[str | None, list[tuple]] = {}
    for p in order:
        for s in p:
            members.setdefault(s, []).append(p)
    for s in members:  # patterns of one source first use their free copy there: they have no other use
        for p in members[s]:
            if len(p) == 1 and s in need:
                f = min(float(capacity[p]), max(0.0, need[s]))
                inn[p][0], flow[p, s], need[s] = f, f, need[s] - f
    while True:
        # Cheapest way from a pattern with room to each source with need: Dijkstra from patterns; a step back moves flow from one source to another.
        heap, best, came = [], {}, {}
        for n, p in enumerate(order):
            for c in range(copies):
                if inn[p][c] < capacity[p] - eps:
                    heapq.heappush(heap, (float(c), n, ("p", p), None))
                    break
        end, n = None, len(heap)
        while heap:
            cost, _, node, prev = heapq.heappop(heap)
            if node in best:
                continue
            best[node], came[node] = cost, prev
            if node[0] == "s":
                if need.get(node[1], 0.0) > eps:
                    end = node
                    break
                nexts = [("p", p) for p in members[node[1]] if flow.get((p, node[1]), 0.0) > eps]
            else:
                nexts = [("s", s) for s in node[1] if s in quota]
            for x in nexts:
                if x not in best:
                    n += 1
                    heapq.heappush(heap, (cost, n, x, node))
        if end is None:
            return flow
        path = [end]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        path.reverse()
        root = path[0][1]
        c = next(c for c in range(copies) if inn[root][c] < capacity[root] - eps)
        room = min(capacity[root] - inn[root][c], need[end[1]])
        for a, b in zip(path, path[1:], strict=False):
            if a[0] == "s":
                room = min(room, flow[b[1], a[1]])
        inn[root][c] += room
        need[end[1]] -= room
        for a, b in zip(path, path[1:], strict=False):
            if a[0] == "p":
                flow[a[1], b[1]] = flow.get((a[1], b[1]), 0.0) + room
            else:
                flow[b[1], a[1]] -= room


def nearest_subset(sizes: Sequence[int], due: int) -> list[bool]:
    """Which of sizes (in order of preference) to take, so that their sum is as near to due as any; the smaller of two equally near.

    Reachable sums are the bits of whole numbers, one for each prefix; going back, later sizes are left out where they can be.
    Sums beyond SUM_BITS are counted in units of their SUM_BITS-th part, which puts the sum off by half a unit a size at most.
    """
    unit = -(-sum(sizes) // SUM_BITS)
    if unit > 1:
        sizes, due = [(s + unit // 2) // unit for s in sizes], (due + unit // 2) // unit
    reach = [1]
    for s in sizes:
        reach.append(reach[-1] | reach[-1] << s)
    low = (reach[-1] & ((1 << (due + 1)) - 1)).bit_length() - 1
    high = reach[-1] >> (due + 1)
    above = due + 1 + (high & -high).bit_length() - 1 if high else None
    left = above if above is not None and above - due < due - low else low
    take = [False] * len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        if not reach[i] >> left & 1:
            take[i], left = True, left - sizes[i]
    return take


def mix(docs: DataFrame, doc_id: str, size: Column, sources: Column, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, copies: int = 2, seed: int = 17) -> DataFrame:
    """doc_id, size, sources (sorted array), source_size, target (arrays beside sources), taken, times.

    sources: an array of the sources of a row, null among them allowed; null or empty arrays stand for the null source.
    size: tokens of a row, as long. Each row of docs gives one row; rows with equal doc_id are documents of their own,
    selected one by one. taken is a multiple of size, `copies` times at most; rows of size 0 take 0. A pattern's selection
    follows a seeded hash: the documents that fit are passed in order until none fits what is left (a long one that nothing
    can be exchanged for is set apart first); then taken and other documents are exchanged for a sum nearest to what is due
    (nearest_subset; a pattern of POOL / 2 documents or fewer is chosen from as a whole). An empty table gives no rows. More
    than MOST_PATTERNS membership patterns are refused before anything is gathered: they are what the driver holds.
    """
    spark = docs.sparkSession
    set_of = F.array_sort(F.array_distinct(F.transform(F.coalesce(sources, F.array()), lambda s: F.struct(s.isNull().alias("none"), s.alias("name")))))
    set_of = F.when(F.size(set_of) == 0, F.array(F.struct(F.lit(True).alias("none"), F.lit(None).cast("string").alias("name")))).otherwise(set_of)
    rows = docs.select(F.col(doc_id).alias("doc_id"), size.cast("long").alias("size"), set_of["name"].alias("sources"))
    rows = store(rows.withColumns({"pattern": F.xxhash64(F.to_json("sources")), "row_no": F.monotonically_increasing_id()}), "sizes")
    patterns = rows.groupBy("pattern", "sources").agg(F.sum("size").alias("tokens"), F.count("*").alias("n"))
    found = patterns.limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    capacity = {tuple(r["sources"]): int(r["tokens"]) for r in found}
    if len({r["pattern"] for r in found}) < len(found):
        raise ValueError("two membership patterns share a hash")
    sizes: dict[str | None, int] = {}
    for p, n in capacity.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    quota = targets(sizes, weights, share, copies)
    flow = min_cost_flow(capacity, quota, copies)
    due = {p: min(float(copies * n), sum(flow.get((p, s), 0.0) for s in p)) for p, n in capacity.items()}

    most = max((r["n"] for r in found), default=1)
    buckets = max(64, most // 20_000)
    sets = [tuple(r["sources"]) for r in found]
    plan = spark.createDataFrame(
        pa.table(
            {
                "pattern": pa.array([r["pattern"] for r in found], pa.int64()),
                "whole": pa.array([int(due[p] // capacity[p]) if capacity[p] else 0 for p in sets], pa.int32()),
                "rest": pa.array([int(round(due[p] % capacity[p])) if capacity[p] else 0 for p in sets], pa.int64()),
                "source_size": pa.array([[sizes[s] for s in p] for p in sets], pa.list_(pa.int64())),
                "target": pa.array([[float(quota[s]) for s in p] for p in sets], pa.list_(pa.float64())),
            }
        )
    )  # as Arrow: a list of rows would start Python workers of a second kind
    # Seeded order in two steps, so that no source meets in one task: sums of hash buckets, then the order within a bucket.
    order = F.xxhash64(F.lit(seed), "doc_id", "size")
    keyed = rows.withColumns({"order": order, "bucket": F.pmod(F.shiftrightunsigned(order, 8), F.lit(buckets)).cast("int")})
    keyed = keyed.join(F.broadcast(plan.select("pattern", "whole", "rest")), "pattern")  # plan: MOST_PATTERNS rows at most

    def passed(left: DataFrame) -> DataFrame:
        """left (row_no, pattern, bucket, order, doc_id, size, gap) with `fits`: in order, up to the first that goes beyond the gap."""
        per_bucket = left.groupBy("pattern", "bucket").agg(F.sum("size").alias("sum"))
        before = per_bucket.select("pattern", "bucket", (F.sum("sum").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("sum")).alias("base"))
        inside = Window.partitionBy("pattern", "bucket").orderBy("order", "doc_id", "row_no").rowsBetween(Window.unboundedPreceding, 0)
        up_to = F.col("base") + F.sum("size").over(inside)
        return store(left.join(before, ["pattern", "bucket"]).withColumn("fits", up_to <= F.col("gap")).drop("base"), "pass")

    def in_order(reserved: DataFrame) -> DataFrame:
        """keyed with `more`: the reserved documents (pattern, row_no, size), then all that fit, in passes until none does.

        Each pass takes one document of each pattern at least, and what it stops at no longer fits: what is left shrinks with the gap.
        """
        held = reserved.groupBy("pattern").agg(F.sum("size").alias("held"))
        left = keyed.join(F.broadcast(held), "pattern", "left").withColumn("gap", F.col("rest") - F.coalesce("held", F.lit(0))).join(reserved.select("row_no"), "row_no", "left_anti")
        left = left.filter("size > 0 and size <= gap").select("row_no", "pattern", "bucket", "order", "doc_id", "size", "gap")
        taken = reserved.select("row_no")
        while not left.isEmpty():
            now = passed(left)
            taken = taken.unionByName(now.filter("fits").select("row_no"))
            gap = now.groupBy("pattern").agg((F.first("gap") - F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0))).alias("gap"))
            left = now.filter("not fits").drop("fits", "gap").join(F.broadcast(gap), "pattern").filter("size <= gap")
        return store(keyed.join(taken.withColumn("more", F.lit(1)), "row_no", "left").fillna(0, ["more"]), "passed")

    reserved = spark.range(0).select(*(F.col("id").alias(c) for c in ("pattern", "row_no", "size")))
    while True:
        filled = in_order(reserved)
        gap = filled.groupBy("pattern").agg((F.first("rest") - F.sum(F.col("size") * F.col("more"))).alias("gap")).filter("gap > 0")
        pool = filled.filter("size > 0").join(F.broadcast(gap), "pattern").select("pattern", "bucket", "row_no", "order", "size", "more", "gap", "rest")
        for by in (["pattern", "more", "bucket"], ["pattern", "more"]):  # the first of each bucket, then the first of those
            pool = pool.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("order", "row_no"))).filter(F.col("rank") <= POOL // 2).drop("rank")
        pool = store(pool, "pool")
        # A document too long to be exchanged for those of the pool is set apart, and the others are passed again.
        give = pool.groupBy("pattern").agg(F.first("rest").alias("rest"), (F.first("gap") + F.sum(F.col("size") * F.col("more"))).alias("give"))
        least = filled.filter("more = 0 and size > 0").groupBy("pattern").agg(F.min(F.struct("size", "order", "row_no")).alias("least"))
        apart = least.join(give, "pattern").filter("least.size > give and least.size <= rest").select("pattern", "least.row_no", "least.size")
        held = reserved.groupBy("pattern").agg(F.sum("size").alias("held"))
        apart = store(apart.join(give, "pattern").join(held, "pattern", "left").filter("size + coalesce(held, 0) <= rest").select("pattern", "row_no", "size"), "apart")
        if apart.isEmpty():
            break
        reserved = reserved.unionByName(apart)

    def exchange(part: pa.Table) -> pa.Table:
        part = part.sort_by([("more", "descending"), ("order", "ascending"), ("row_no", "ascending")])
        size, more = part.column("size").to_numpy(), part.column("more").to_numpy()
        take = nearest_subset(size.tolist(), part.column("gap")[0].as_py() + int((size * more).sum()))
        return pa.table({"row_no": part.column("row_no"), "new": pa.array(take).cast(pa.int32())})

    new = pool.drop("bucket", "rest").groupBy("pattern").applyInArrow(exchange, "row_no long, new int")
    chosen = filled.join(new, "row_no", "left").withColumn("more", F.coalesce("new", "more"))
    out = chosen.join(F.broadcast(plan.select("pattern", "source_size", "target")), "pattern")
    times = F.least(F.lit(copies), F.col("whole") + F.col("more"))
    return out.select("doc_id", "size", "sources", "source_size", "target", (F.col("size") * times).alias("taken"), F.when(F.col("size") > 0, times).otherwise(0).alias("times"))


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1 over their sources."""
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id", word_count(), F.array("source"))
    return out.select("doc_id", "size", F.element_at("source_size", 1).alias("source_size"), F.element_at("target", 1).alias("target"), "taken", F.element_at("sources", 1).alias("source"))

"""MinHash near-dedup by an inverted join over signature coordinates.

Every distinct shingle set has a signature of COORDS coordinates. Sets that match in at least `least` coordinates share one
of their first COORDS - least + 1 coordinate-value pairs, in any order that all sets keep; so only these prefixes are
posted, rarest pairs first. Posting lists are merged in two steps that skip what is settled: all members against one
pivot, then only members of different components against each other. Pairs above the match threshold are confirmed on full
sets. Groups of near copies never become all their pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.llm import bloom, bytescan
from tessitura.llm.common import store, sums_of, table
from tessitura.llm.components import components

COORDS = 48
#: Counters of coordinate-value pairs, by hash; they only order the pairs.
COUNTERS = 1 << 18
#: Members of a posting list that are compared in one piece, and pairs a member above which a list is settled by blocks.
BLOCK, PAIRS_A_MEMBER = 2048, 8
U = np.uint64
_rng = np.random.default_rng(48)
_FACTORS = _rng.integers(0, 2**63, COORDS, dtype=np.uint64) * U(2) + U(1)
_SALTS = _rng.integers(0, 2**63, COORDS, dtype=np.uint64)


def match_threshold(percent: int, coords: int = COORDS) -> int:
    """Coordinates that must match: five standard deviations below what a pair at the similarity expects."""
    s = percent / 100
    return max(1, math.floor(coords * s - 5 * math.sqrt(coords * s * (1 - s))))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text in turn, offsets). A text of fewer than k words has its whole sequence."""
    w = bytescan.Words(bytescan.TO_LOWER[data], offsets)
    h = w.hashes()
    s, doc = bytescan.shingles(w, k, h)
    counts = w.counts()
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        own = []
        for d in short.tolist():
            x = 0
            for v in h[w.first[d] : w.first[d + 1]].tolist():
                x = (x * 0x9E3779B97F4A7C15 + v + 0x51ED27) & (2**64 - 1)
            own.append(x)
        s, doc = np.concatenate([s, bytescan.mix(np.array(own, dtype=np.uint64))]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        s, doc = s[order], doc[order]
    at = np.searchsorted(doc, np.arange(len(offsets)))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        s[a:b].sort()
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[new], np.concatenate([[0], np.cumsum(new)])[at]


def signatures(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(sets, COORDS) upper halves of the least products; sets must not be empty."""
    out = np.empty((len(at) - 1, COORDS), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for c in range(COORDS):
            out[:, c] = np.minimum.reduceat(s * _FACTORS[c], at[:-1]) >> U(32)
    return out


def sketch(k: int):
    @F.arrow_udf("struct<n: bigint, fp: binary, sig: binary>")
    def run(text: pa.Array) -> pa.Array:
        n, fp, sig = [], [], []
        for _, _, data, offsets in bytescan.slices(text):
            s, at = shingle_sets(data, offsets, k)
            size = np.diff(at)
            n.append(size)
            full = size > 0
            bounds = np.append(at[:-1][full], at[-1])
            rows = iter(signatures(s, bounds)) if full.any() else iter(())
            for i, f in enumerate(full.tolist()):
                fp.append(hashlib.blake2b(s[at[i] : at[i + 1]].tobytes(), digest_size=16).digest() if f else None)
                sig.append(next(rows).tobytes() if f else None)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(n) if n else [], pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())], ["n", "fp", "sig"])

    return run


def full_set(k: int):
    @F.arrow_udf("struct<fp: binary, items: array<bigint>>")
    def run(text: pa.Array) -> pa.Array:
        fp, items, ends = [], [], [0]
        for _, _, data, offsets in bytescan.slices(text):
            s, at = shingle_sets(data, offsets, k)
            fp += [hashlib.blake2b(s[a:b].tobytes(), digest_size=16).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            items.append(s.view(np.int64))
            ends += (at[1:] + ends[-1]).tolist()
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(items) if items else [], pa.int64()))
        return pa.StructArray.from_arrays([pa.array(fp, pa.binary()), lists], ["fp", "items"])

    # Not evaluated a second time for a filter that a join implies.
    return run.asNondeterministic()


def _tokens(sig: pa.Array) -> np.ndarray:
    """Hashes of the coordinate-value pairs (sets, COORDS)."""
    rows = np.frombuffer(b"".join(sig.to_pylist()), dtype=np.uint32).reshape(-1, COORDS)
    return bytescan.mix(rows.astype(np.uint64) + _SALTS)


def _frequencies(classes: DataFrame) -> np.ndarray:
    """COUNTERS counts over all sets, summed on executors."""
    step = 1 << 12

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for b in batches:
            total += np.bincount((_tokens(b.column(0)).ravel() >> U(46)).astype(np.int64), minlength=COUNTERS)
        at = list(range(0, COUNTERS, step))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([total[a : a + step].tobytes() for a in at], pa.binary())], ["at", "part"])

    out = np.zeros(COUNTERS, dtype=np.int64)
    for at, n in sums_of(classes.select("sig").mapInArrow(count, "at long, part binary"), np.int64):
        out[at : at + step] = n
    return out


def _post(classes: DataFrame, prefix: int) -> DataFrame:
    """(token, node): each set under its `prefix` rarest coordinate-value pairs."""
    given = classes.sparkSession.sparkContext.broadcast(_frequencies(classes))  # 8 * COUNTERS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = given.value
        for b in batches:
            t = _tokens(b.column(1))
            # Rarest first by the order of magnitude, then by hash: near copies then tend to choose alike.
            f = np.minimum(often[(t >> U(46)).astype(np.int64)], 1 << 40)
            key = (np.frexp(f.astype(float))[1].astype(np.uint64) << U(58)) | (bytescan.mix(t) >> U(6))
            first = np.argsort(key, axis=1, kind="stable")[:, :prefix]
            t = np.take_along_axis(t, first, axis=1)
            node = np.repeat(b.column(0).to_numpy(), t.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(t.ravel().view(np.int64)), pa.array(node)], ["token", "node"])

    return classes.select("node", "sig").mapInArrow(run, "token long, node long")


@F.arrow_udf(T.IntegerType())
def matches(a: pa.Array, b: pa.Array) -> pa.Array:
    x, y = (np.frombuffer(b"".join(s.to_pylist()), dtype=np.uint32).reshape(-1, COORDS) for s in (a, b))
    return pa.array((x == y).sum(axis=1).astype(np.int32))


class Sets:
    """Full sets of nodes, made anew from the texts of one document a node."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, k: int, classes: DataFrame):
        self.docs, self.k, self.classes = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), k, classes

    def of(self, nodes: DataFrame) -> DataFrame:
        """(node, items) of distinct nodes. A filter keeps other texts out of the shuffle."""
        need = store(nodes.join(self.classes.select("node", "low", "fp"), "node"), "need")
        near = bloom.sieve(need.select(F.xxhash64("low")))
        some = bloom.mark(self.docs, F.xxhash64("id"), near, "near").filter("near").drop("near")
        keys = need.select("low").distinct()
        rows = some.join(keys, some["id"].eqNullSafe(keys["low"]), "left_semi").withColumn("set", full_set(self.k)("text")).select("id", "set.fp", "set.items")
        at = rows.join(need.withColumnRenamed("fp", "its"), rows["id"].eqNullSafe(need["low"]) & (rows["fp"] == F.col("its")))
        return at.select("node", "items").dropDuplicates(["node"])


def _alike(both: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * both >= percent * (a + b - both)


def _confirm(pairs: DataFrame, classes: DataFrame, sets: Sets, least: int, percent: int, sift: bool) -> DataFrame:
    """Of distinct pairs (a, b) those that the full sets confirm. sift: count matching coordinates first."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), *([F.col("sig").alias(f"sig_{x}")] if sift else []))
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(_alike(F.least("n_a", "n_b"), F.col("n_a"), F.col("n_b"), percent))
    if sift:
        near = near.filter(matches("sig_a", "sig_b") >= least)
    near = store(near.select("a", "b", "n_a", "n_b"), "near")
    nodes = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    items = store(sets.of(nodes), "sets")
    full = near.join(items.select(F.col("node").alias("b"), F.col("items").alias("items_b")), "b").join(items.select(F.col("node").alias("a"), F.col("items").alias("items_a")), "a")
    return full.filter(_alike(F.size(F.array_intersect("items_a", "items_b")), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def _cross(open_: DataFrame, least: int, percent: int) -> DataFrame:
    """Pairs of different components within lists: rows (token, a, b), or one row (token, null, null) for a part with too many pairs.

    open_: (token, part, node, root, n, sig). Lists arrive sorted by token; `part` deals longer lists out by blocks, and a
    member of block i comes to each pair of blocks (i, j).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, rows in _runs(batches):
            node, root, n = (rows[c].to_numpy(zero_copy_only=False) for c in (2, 3, 4))
            sig = np.frombuffer(b"".join(rows[5].to_pylist()), dtype=np.uint32).reshape(-1, COORDS)
            i, j = _alike_pairs(root, n, sig, least, percent)
            if len(i) > PAIRS_A_MEMBER * len(node):
                yield pa.RecordBatch.from_arrays([pa.array([token]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], ["token", "a", "b"])
            elif len(i):
                a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), token)), pa.array(a), pa.array(b)], ["token", "a", "b"])

    return open_.mapInArrow(run, "token long, a long, b long")


def _alike_pairs(root: np.ndarray, n: np.ndarray, sig: np.ndarray, least: int, percent: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of different roots, sizes that can be alike, and at least `least` equal coordinates; a few rows against all at a time."""
    left, right = [], []
    for a in range(0, len(n), rows):
        at = slice(a, a + rows)
        same = np.zeros((len(n[at]), len(n)), dtype=np.uint8)
        for c in range(COORDS):
            same += sig[at, c, None] == sig[None, :, c]
        ok = (same >= least) & (root[at, None] != root[None, :]) & (np.arange(len(n))[None, :] > np.arange(a, a + len(same))[:, None])
        i, j = np.nonzero(ok)
        fits = 100 * np.minimum(n[i + a], n[j]) >= percent * np.maximum(n[i + a], n[j])
        left.append(i[fits] + a)
        right.append(j[fits])
    return np.concatenate(left), np.concatenate(right)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.Array]]]:
    """Rows of each (token, part) in turn; columns 0 and 1 are token and part."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        t, p = b.column(0).to_numpy(), b.column(1).to_numpy()
        edges = np.flatnonzero((t[1:] != t[:-1]) | (p[1:] != p[:-1])) + 1
        at = [0, *edges.tolist(), b.num_rows]
        for x, y in zip(at, at[1:], strict=False):
            piece = b.slice(x, y - x)
            if held and (held[0].column(0)[0] != piece.column(0)[0] or held[0].column(1)[0] != piece.column(1)[0]):
                yield _joined(held)
                held = []
            held.append(piece)
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[int, list[pa.Array]]:
    t = pa.Table.from_batches(held).combine_chunks()
    return t.column(0)[0].as_py(), [t.column(i).combine_chunks() for i in range(t.num_columns)]


def spanning(node: np.ndarray, root: np.ndarray, items: list[np.ndarray], percent: int, width: int = 2048) -> list[tuple[int, int]]:
    """Links that join the components of one block's nodes, a forest: exact intersections of all pairs as products of 0-1 matrices."""
    size = np.array([len(x) for x in items])
    flat = np.concatenate(items)
    owner = np.repeat(np.arange(len(items)), size)
    value, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[code] > 1
    code, owner = np.cumsum(times > 1)[code[shared]] - 1, owner[shared]
    both = np.zeros((len(items), len(items)), dtype=np.float32)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for a in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        lo, hi = np.searchsorted(code, [a, a + width])
        x = np.zeros((len(items), width), dtype=np.float32)
        x[owner[lo:hi], code[lo:hi] - a] = 1
        both += x @ x.T
    i, j = np.nonzero(np.triu(100 * both.astype(np.int64) >= percent * (size[:, None] + size[None, :] - both.astype(np.int64)), 1))
    parent = {r: r for r in root.tolist()}

    def find(r: int) -> int:
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        if (p := find(int(root[x]))) != (q := find(int(root[y]))):
            parent[p] = q
            out.append((int(node[x]), int(node[y])))
    return out


def _dense(members: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """Links between members (token, node, root) of lists with many pairs: blocks meet in pairs with their full sets, and send a forest."""
    items = sets.of(members.select("node").distinct())
    rows = _deal(members).join(items, "node")

    def run(part: pa.Table) -> pa.Table:
        node, first = np.unique(part.column("node").to_numpy(), return_index=True)
        items = part.column("items").take(pa.array(first)).combine_chunks()
        links = spanning(node, part.column("root").to_numpy()[first], [x.values.to_numpy() for x in items], percent)
        return pa.table({n: pa.array([x[i] for x in links], pa.int64()) for i, n in enumerate("ab")})

    return rows.groupBy("token", "part").applyInArrow(run, "a long, b long")


def _deal(lists: DataFrame) -> DataFrame:
    """Add part: lists of more than BLOCK members are dealt into blocks, and every pair of blocks is a part."""
    sizes = lists.groupBy("token").agg(F.count("*").alias("m"))
    blocks = lists.join(sizes, "token").withColumn("q", F.ceil(2 * F.col("m") / BLOCK).cast("long"))
    own = F.pmod(F.xxhash64("node"), F.col("q"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("q") - 1), lambda j: F.least(own, j) * F.col("q") + F.greatest(own, j))
    return blocks.withColumn("part", F.explode(F.when(F.col("q") <= 2, F.array(F.lit(0).cast("long"))).otherwise(pairs))).drop("m", "q")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash (xxhash64 of the text), one row per row of docs.

    A text's set: its distinct shingles of `words` words, with A-Z lower-cased; a text of fewer words has its whole sequence
    as one. Null texts and texts without words have none, and link with nothing. Rows whose sets satisfy 100 * intersection
    >= percent * union are linked; component_id is the least doc_id reachable (null ids last, so null only if all are).
    kept: doc_id equals component_id; repeated rows are kept together, and rows with one id but different texts are nodes
    of their own. An empty table gives no rows. Sets are sets of 64-bit hashes; equal sets are told by 128 bits.
    Candidates match in match_threshold(percent) of COORDS coordinates, which a pair at the similarity misses about once in
    10**5 to 10**6.
    """
    least = match_threshold(percent)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), sketch(words)(F.col(text)).alias("s"))
    rows = store(own.select("doc_id", "text_hash", "s.n", "s.fp", "s.sig"), "sketches")
    classes = rows.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("low"), F.min("n").alias("n"), F.min("sig").alias("sig"))
    classes = store(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    sets = Sets(docs, doc_id, text, words, classes)

    posts = store(_post(classes, COORDS - least + 1), "posts")
    lists = posts.groupBy("token").agg(F.count("*").alias("m"), F.min("node").alias("pivot")).filter("m > 1")
    merged = store(posts.join(lists, "token"), "lists")
    star = merged.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = store(_confirm(star, classes, sets, least, percent, True), "links")
    labels = components(links, "a", "b")

    # Lists of which the pivot has not settled everything: members besides it that are of different components.
    rest = merged.filter("m > 2 and node <> pivot").select("token", "node").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rest.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("token")
    open_ = _deal(rest.join(mixed, "token")).join(classes.select("node", "n", "sig"), "node")
    order = ["token", "part"]
    found = store(_cross(open_.select("token", "part", "node", "root", "n", "sig").repartition(*order).sortWithinPartitions(*order), least, percent), "cross")
    sparse = found.filter("b is not null").select("a", "b").distinct()
    dense = rest.join(found.filter("b is null").select("token").distinct(), "token").select("token", "node", "root")
    more = []
    if sparse.limit(1).count():
        more.append(_confirm(sparse, classes, sets, least, percent, False))
    if found.filter("b is null").limit(1).count():
        more.append(_dense(dense, sets, percent))
    if more:
        both = links
        for x in more:
            both = both.unionByName(x)
        labels = components(both, "a", "b")

    placed = classes.select("fp", "node", "low").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    of = placed.join(low, "root").select("fp", "component_id")
    out = rows.select("doc_id", "text_hash", "n", "fp").join(of, "fp", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with Jaccard similarity of 3-word shingles of 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=85).drop("text_hash")

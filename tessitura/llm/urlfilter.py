"""URL filters over a sorted array of 64-bit digests: mapped into memory, probed by binary search, confirmed by the stored strings."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.llm.common import LOWER, UPPER, hadoop_path, new_path, table

Rule = tuple[str, str, str]  # verdict, host, path
RULES: list[Rule] = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
VERDICTS = ("allow", "block")
MOST_INDEX_BYTES = 256 << 20


def build_index(rules: Iterable[Rule]) -> bytes:
    """The index file: count, sorted digests, verdicts, offsets of strings, strings (host and path, \\0 between). The last of equal rules holds."""
    last = {f"{h.translate(str.maketrans(UPPER, LOWER))}\0{p}".encode(): VERDICTS.index(v) for v, h, p in rules}
    rows = sorted((xxhash.xxh64_intdigest(k), k, v) for k, v in last.items())
    ends = np.cumsum([0, *(len(k) for _, k, _ in rows)], dtype=np.int64)
    parts = [struct.pack("<q", len(rows)), np.array([d for d, _, _ in rows], dtype="<u8").tobytes(), ends.astype("<i8").tobytes(), bytes(v for _, _, v in rows), b"".join(k for _, k, _ in rows)]
    return b"".join(parts)


class DigestArray:
    """An index file mapped into memory; the workers of a machine share its pages."""

    def __init__(self, path: str):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        n = self.n = int(raw[:8].view("<i8")[0])
        self.digests = raw[8 : 8 + 8 * n].view("<u8")
        self.offsets = raw[8 + 8 * n : 16 + 16 * n].view("<i8")
        self.verdicts = raw[16 + 16 * n : 16 + 17 * n]
        self.strings = raw[16 + 17 * n :]

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Places of the keys, -1 if absent. Equal digests stand side by side; the stored string decides."""
        d = np.fromiter(map(xxhash.xxh64_intdigest, keys), dtype=np.uint64, count=len(keys))
        at = np.searchsorted(self.digests, d)
        out = np.full(len(keys), -1, dtype=np.int64)
        for i in np.flatnonzero((at < self.n) & (self.digests[np.minimum(at, self.n - 1)] == d)) if self.n else ():
            j = at[i]
            while j < self.n and self.digests[j] == d[i]:
                if self.strings[self.offsets[j] : self.offsets[j + 1]].tobytes() == keys[i]:
                    out[i] = j
                    break
                j += 1
        return out


def suffixes(host: str) -> list[str]:
    """The host and the domains above it, longest first."""
    parts = host.split(".")
    return [".".join(parts[i:]) for i in range(len(parts))]


def split_url(urls: DataFrame, url: str = "url") -> DataFrame:
    """Add host and path: what stands after the first `://` up to `/`, `?`, `#`, with A-Z lower-cased, then up to `?` or `#`. Else empty."""
    rest = F.when(F.instr(F.col(url), "://") > 0, F.substr(F.col(url), F.instr(F.col(url), "://") + 3))
    return urls.withColumns({
        "host": F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit("")),
        "path": F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")),
    })


def classify(urls: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url", most_bytes: int = MOST_INDEX_BYTES) -> DataFrame:
    """Add host, path, rule (host + path of the rule, or null) and verdict to every row.

    A rule fits its host and all subdomains where the url's path starts with the rule's path; the longest rule wins, and
    of equally long ones that with the longer host. Without a rule the verdict is `default`. Null urls and urls without
    `://` have empty host and path, which only a rule for the empty host fits. Repeated urls are judged alike. Columns
    of the input named host, path, rule or verdict are replaced. The index goes to each executor as one file, only if
    it is no larger than `most_bytes`; larger rule sets are joined (classify_by_join), with the same result.
    """
    index = build_index(rules)
    spark = urls.sparkSession
    if len(index) > most_bytes:
        return classify_by_join(urls, spark.createDataFrame(rules, "verdict string, host string, path string"), default, url)
    name = f"urls-{zlib.crc32(index):08x}-{len(index)}.idx"
    uri = f"{new_path(spark, 'index')}/{name}"
    fs, p = hadoop_path(spark, uri)
    out = fs.create(p, True)
    out.write(bytearray(index))
    out.close()
    if name not in {x.rsplit("/", 1)[-1] for x in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(uri)
    lengths = sorted({len(p) for _, _, p in rules}, reverse=True)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = DigestArray(SparkFiles.get(name))
        for b in batches:
            hosts, paths = b.column("host").to_pylist(), b.column("path").to_pylist()
            keys: dict[str, int] = {}  # a key once a batch, however often its host comes
            tries = []
            for h, x in zip(hosts, paths, strict=True):
                tries.append([keys.setdefault(f"{s}\0{x[:n]}", len(keys)) for s in suffixes(h) for n in lengths if n <= len(x)])
            names = list(keys)
            hit = found.find([k.encode() for k in names])
            rule, verdict = [], []
            for mine in tries:
                best = max((k for k in mine if hit[k] >= 0), key=lambda k: (len(names[k]), names[k].index("\0")), default=None)
                rule.append(None if best is None else names[best].replace("\0", "", 1))
                verdict.append(default if best is None else VERDICTS[found.verdicts[hit[best]]])
            kept = [c for c in b.schema.names if c not in ("rule", "verdict")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [*kept, "rule", "verdict"])

    parts = split_url(urls, url).drop("rule", "verdict")
    return parts.mapInArrow(judge, T.StructType([*parts.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]))


def classify_by_join(urls: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """The same for rules of any number (verdict, host, path): distinct hosts meet the rules of their domains in an equi-join, paths are compared after.

    Only distinct (host, path) pairs are expanded, so a host that many rows share costs one key a path.
    """
    parts = split_url(urls, url).drop("rule", "verdict")
    labels = F.split("host", r"\.", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pairs = parts.select("host", "path").distinct().withColumn("domain", F.explode(above))
    r = rules.select(F.translate("host", UPPER, LOWER).alias("domain"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    best = (
        pairs.join(r, "domain").filter(F.expr("startswith(path, rule_path)"))
        .groupBy("host", "path")
        .agg(F.max(F.struct((F.length("domain") + F.length("rule_path")).alias("n"), F.length("domain").alias("m"), F.concat("domain", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("best"))
    )
    return parts.join(best, ["host", "path"], "left").select(*parts.columns, F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url under RULES."""
    return classify(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(substr(url, nullif(instr(url, '://'), 0) + 3), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(substr(url, nullif(instr(url, '://'), 0) + 3), '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
judged AS (
  SELECT page_id, host, path, h || p AS rule, v,
    row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS k
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM judged WHERE k = 1
"""

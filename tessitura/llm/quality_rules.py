"""Quality rules by weak supervision: rules vote or abstain, EM estimates their accuracies, the posterior decides."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.llm import bytescan, votes
from tessitura.llm.common import store, table

#: Common short words of English, German, French and Spanish. Fixed values.
FUNCTION_WORDS = (
    "a an and are as at be by for from has he in is it its not of on or that the this to was were will with you "
    "auf das dem den der des die ein eine er es für im ist mit nicht sich sie und von wie zu "
    "au ce dans de des du elle en et il la le les ne pas par plus pour que qui sur un une "
    "como con del el en es la las lo los más no para pero por que se su un una y"
).split()
STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_function", "n_shouts", "n_marked")
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 0xC0)
_LEAD = (np.arange(256) & 0xC0) != 0x80


def _function_hashes() -> np.ndarray:
    both = sorted({w for x in FUNCTION_WORDS for w in (x, x.capitalize())})
    raw = [w.encode() for w in both]
    offsets = np.cumsum([0, *map(len, raw)])
    return np.sort(bytescan.ranges(np.frombuffer(b"".join(raw), np.uint8), offsets[:-1], offsets[1:]))


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all places whose key occurs twice or more, the places among them that are not the first of their key)."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later = np.zeros(len(keys), dtype=bool)
    every = np.zeros(len(keys), dtype=bool)
    later[order[1:][same]] = True
    every[order[1:][same]] = True
    every[order[:-1][same]] = True
    return every, later


def scan(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """STATS of each text of a slice."""
    w = bytescan.Words(data, offsets)
    docs = len(offsets) - 1
    counts = w.counts()
    per_byte = lambda mask: bytescan.sums(mask.astype(np.int64), offsets)
    at_end = data[w.ends - 1] if len(w.ends) else data[:0]
    hashes = w.hashes()
    # Lines: split at \n; a line counts if it has a word.
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    ends = ends - (data[ends - 1] == 10) if len(ends) else ends
    line_doc = np.searchsorted(offsets, starts, "right") - 1
    full = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends, line_doc = starts[full], ends[full], line_doc[full]
    salt = bytescan.mix(np.arange(1, docs + 1, dtype=np.uint64))
    _, later = _again(bytescan.ranges(data, starts, ends) ^ salt[line_doc])
    # Words in 3-word windows that occur twice or more in their text.
    n = len(hashes)
    covered = np.zeros(n, dtype=bool)
    if n > 2:
        doc = w.doc()
        place = np.flatnonzero(doc[:-2] == doc[2:])
        window, _ = bytescan.shingles(w, 3, hashes)
        place = place[_again(window ^ salt[doc[place]])[0]]
        for i in range(3):
            covered[place + i] = True
    listed = _function_hashes()
    at = np.minimum(np.searchsorted(listed, hashes), len(listed) - 1)
    per_word = lambda mask: bytescan.sums(mask.astype(np.int64), w.first)
    return {
        "n_words": counts,
        "word_chars": per_byte(bytescan.IS_WORD[data] & _LEAD[data]),
        "n_symbols": per_byte(_SYMBOL[data]),
        "n_lines": np.bincount(line_doc, minlength=docs),
        "n_dup_lines": np.bincount(line_doc[later], minlength=docs),
        "n_repeat_words": per_word(covered),
        "n_upper": per_byte(_UPPER[data]),
        "n_letters": per_byte(_LETTER[data]),
        "n_function": per_word(listed[at] == hashes),
        "n_shouts": per_word(at_end == 33),
        "n_marked": per_word(_SYMBOL[at_end]),
    }


@F.arrow_udf(T.StructType([T.StructField(s, T.LongType()) for s in STATS]))
def text_stats(text: pa.Array) -> pa.Array:
    """STATS of whole texts, null as empty. Lines and windows are compared by 64-bit hashes within a text."""
    parts = [scan(data, offsets) for _, _, data, offsets in bytescan.slices(text)]
    columns = [pa.array(np.concatenate([p[s] for p in parts]) if parts else np.zeros(0), pa.int64()) for s in STATS]
    return pa.StructArray.from_arrays(columns, list(STATS))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules(s: str = "stats") -> dict[str, Column]:
    """Each rule's vote on the statistics in struct column s: 1 good, -1 bad, 0 abstains."""
    c = lambda n: F.col(f"{s}.{n}")
    enough = c("n_words") >= 20
    return {
        "length": _vote(c("n_words") < 20, c("n_words") >= 60),
        "symbols": _vote(enough & (c("n_symbols") * 10 > c("n_words") * 3), c("n_symbols") * 50 < c("n_words")),
        "word_length": _vote((c("word_chars") > c("n_words") * 14) | (c("word_chars") < c("n_words") * 2), (c("word_chars") <= c("n_words") * 9) & (c("word_chars") >= c("n_words") * 3)),
        "lines": _vote((c("n_lines") >= 4) & (c("n_dup_lines") * 10 > c("n_lines") * 3), (c("n_lines") >= 4) & (c("n_dup_lines") * 20 <= c("n_lines"))),
        "repeats": _vote(enough & (c("n_repeat_words") * 10 > c("n_words") * 3), enough & (c("n_repeat_words") * 20 <= c("n_words"))),
        "capitals": _vote(enough & (c("n_upper") * 2 > c("n_letters")), c("n_upper") * 5 < c("n_letters")),
        "function_words": _vote(enough & (c("n_function") * 20 < c("n_words")), enough & (c("n_function") * 8 > c("n_words"))),
        "shouts": _vote(enough & (c("n_shouts") * 4 > c("n_words")), c("n_shouts") * 50 <= c("n_words")),
        "marked": _vote(enough & (c("n_marked") * 4 > c("n_words")), c("n_marked") * 50 <= c("n_words")),
    }


def judge(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Add stats, base_failed, quality (posterior of good) and kept to docs; columns of these names are replaced.

    base_failed: fewer than 50 words, or repeated words more than half of all. kept: not base_failed and quality at least
    threshold. Null text counts as empty and fails. Every row is judged on its own, repeated rows alike; an empty table
    gives no rows.
    """
    own = docs.drop("stats", "base_failed", "quality", "kept").withColumn("stats", text_stats(F.col(text)))
    n, r = F.col("stats.n_words"), F.col("stats.n_repeat_words")
    own = own.withColumn("base_failed", (n < 50) | (100 * r > 50 * n))
    labelled, _ = votes.label(own, list(rules().values()), "quality")
    return labelled.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document. The statistics are stored once: EM and the verdicts read them again."""
    stats = store(table(spark, sf_dir, "documents").select("doc_id", text_stats("text").alias("stats")), "stats")
    n, r = F.col("stats.n_words"), F.col("stats.n_repeat_words")
    labelled, _ = votes.label(stats.withColumn("base_failed", (n < 50) | (100 * r > 50 * n)), list(rules().values()), "quality")
    return labelled.select("doc_id", *(F.col(f"stats.{s}").alias(s) for s in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", (~F.col("base_failed") & (F.col("quality") >= 0.5)).alias("kept"), "quality")

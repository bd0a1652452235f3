"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. The probability of a word is the sum over all
its segmentations into pieces, by the forward algorithm; EM with expected piece counts learns the distributions. A text's
score is the product over its words. All of it runs on arrays of many words at once, in logarithms, so that neither long
words nor rare pieces underflow.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import bytescan
from tessitura.llm.common import sums_of, small_batches, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Places of words, and cells of their tables over languages, that are worked on at once; a longer word is worked on alone.
PLACES, CELLS = 1 << 16, 1 << 21
CACHE_WORDS = 200_000
U = np.uint64
_B = U(bytescan.BASE)


class Pieces:
    """All pieces without A-Z and without white space after their first byte, found by hash; so are their prefixes.

    Number 0 is a prefix that is no piece; all single bytes are pieces.
    """

    def __init__(self, path: str):
        found = {bytes([i]) for i in range(256)}
        with open(path, "rb") as f:
            for line in f:
                p = base64.b64decode(line.split()[0]).lower()
                if not any(c in p[1:] for c in b" \t\n\r"):
                    found.add(p)
        self.names = sorted(found)
        self.size = len(self.names) + 1
        number: dict[int, int] = {}
        for i, p in enumerate(self.names, 1):
            h = 0
            for c in p:
                h = (h * bytescan.BASE + int(bytescan.BYTE_VALUE[c])) % 2**64
                number.setdefault(h, 0)
            number[h] = i
        keys = np.fromiter(number, dtype=np.uint64, count=len(number))
        ids = np.fromiter(number.values(), dtype=np.int32, count=len(number))
        self.bits = 2 + len(keys).bit_length()
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.ids = np.full(1 << self.bits, -1, dtype=np.int32)
        at, open_ = self._slot(keys), np.arange(len(keys))
        while len(open_):  # of the keys that want one free slot the first gets it, the others try the next
            want, first = np.unique(at[open_], return_index=True)
            free = self.keys[want] == 0
            self.keys[want[free]], self.ids[want[free]] = keys[open_[first[free]]], ids[open_[first[free]]]
            open_ = np.delete(open_, first[free])
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, 0 for prefixes that are no pieces, -1 for all else."""
        at = self._slot(h)
        keys = self.keys[at]
        out = np.where(keys == h, self.ids[at], -1)
        open_ = np.flatnonzero((keys != h) & (keys != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            keys = self.keys[at[open_]]
            hit = keys == h[open_]
            out[open_[hit]] = self.ids[at[open_[hit]]]
            open_ = open_[~hit & (keys != 0)]
        return out


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _pieces:
        with np.errstate(over="ignore"):
            _pieces[path] = Pieces(path)
    return _pieces[path]


class Lattice:
    """Every piece at every place of some words, each with a space before it: steps (source, target, piece) over flat places.

    A word of n bytes has n + 2 places, from `begin` to `end`. Steps are sorted by place in the word, then by length, and
    `runs` are their ranges of one place and length: within a run no two steps share a source or a target.
    """

    def __init__(self, p: Pieces, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        size = ends - starts + 2
        self.end = np.cumsum(size) - 1
        self.begin = self.end - size + 1
        self.places = int(size.sum())
        self.word = np.repeat(np.arange(len(size)), size)
        inner = np.ones(self.places, dtype=bool)
        inner[self.begin], inner[self.end] = False, False
        text = np.full(self.places, 32, dtype=np.uint8)
        n = ends - starts
        text[inner] = data[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        value = bytescan.BYTE_VALUE[bytescan.TO_LOWER[text]]
        left = self.end[self.word] - np.arange(self.places)
        live = np.flatnonzero(left > 0)
        h, length, found = value[live], 1, []
        with np.errstate(over="ignore"):
            while len(live):
                ids = p.find(h)
                hit = ids > 0
                found.append((live[hit], np.full(hit.sum(), length), ids[hit]))
                on = (ids >= 0) & (left[live] > length)
                live = live[on]
                h = h[on] * _B + value[live + length]
                length += 1
        source, n, self.piece = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        key = (source - self.begin[self.word[source]]) * (length + 1) + n if len(source) else source
        order = np.argsort(key, kind="stable")
        self.source, self.target, self.piece, key = source[order], (source + n)[order], self.piece[order], key[order]
        self.runs = np.flatnonzero(np.diff(key, prepend=-1, append=-1)).tolist() if len(key) else [0]

    def forward(self, logs: np.ndarray) -> np.ndarray:
        """Log sums over all segmentations of the prefixes up to each place. logs: of each step's probability, with further axes."""
        out = np.full((self.places, *logs.shape[1:]), -np.inf)
        out[self.begin] = 0
        for x, y in zip(self.runs, self.runs[1:], strict=False):
            to = self.target[x:y]
            out[to] = np.logaddexp(out[to], out[self.source[x:y]] + logs[x:y])
        return out

    def backward(self, logs: np.ndarray) -> np.ndarray:
        """The same of the suffixes from each place on."""
        out = np.full((self.places, *logs.shape[1:]), -np.inf)
        out[self.end] = 0
        for x, y in zip(self.runs[-2::-1], self.runs[:0:-1], strict=False):
            of = self.source[x:y]
            out[of] = np.logaddexp(out[of], out[self.target[x:y]] + logs[x:y])
        return out


def blocks(starts: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of words in order of length, about PLACES places at a time."""
    order = np.argsort(ends - starts, kind="stable")
    until = np.cumsum((ends - starts)[order] + 2)
    i = 0
    while i < len(order):
        j = max(i + 1, int(np.searchsorted(until, (until[i - 1] if i else 0) + PLACES, "right")))
        yield order[i:j]
        i = j


def word_logs(p: Pieces, logs: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Log probabilities (words, languages); logs: (pieces, languages)."""
    out = np.zeros((len(starts), logs.shape[1]))
    for at in blocks(starts, ends):
        lattice = Lattice(p, data, starts[at], ends[at])
        step = max(1, CELLS // (lattice.places + len(lattice.piece)))  # languages at once
        for k in range(0, logs.shape[1], step):
            out[at, k : k + step] = lattice.forward(logs[lattice.piece, k : k + step])[lattice.end]
    return out


def expected(p: Pieces, logs: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lang: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected counts (pieces, languages) of words of known languages: forward, backward, and the pieces' shares."""
    out = np.zeros(logs.size)
    for at in blocks(starts, ends):
        lattice = Lattice(p, data, starts[at], ends[at])
        word = lattice.word[lattice.source]
        of = lang[at][word]
        own = logs[lattice.piece, of]
        alpha, beta = lattice.forward(own), lattice.backward(own)
        share = np.exp(alpha[lattice.source] + own + beta[lattice.target] - alpha[lattice.end][word]) * weight[at][word]
        out += np.bincount(lattice.piece.astype(np.int64) * logs.shape[1] + of, share, minlength=logs.size)
    return out.reshape(logs.shape)


class Scorer:
    """Log probabilities of words under every language, with a bounded cache by hash."""

    def __init__(self, path: str, logs: np.ndarray):
        self.p, self.piece_logs = pieces(path), logs
        self.most = CACHE_WORDS * 4 // max(4, logs.shape[1])
        self.keys = np.zeros(0, dtype=np.uint64)
        self.logs = np.zeros((0, logs.shape[1]))

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log probabilities (texts, languages)."""
        w = bytescan.Words(data, offsets)
        h, first, inverse = np.unique(bytescan.ranges(bytescan.TO_LOWER[data], w.starts, w.ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, h)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == h if len(self.keys) else np.zeros(len(h), dtype=bool)
        logs = np.empty((len(h), self.piece_logs.shape[1]))
        logs[known] = self.logs[at[known]]
        new = first[~known]
        logs[~known] = word_logs(self.p, self.piece_logs, data, w.starts[new], w.ends[new])
        if len(self.keys) + len(new) > self.most:
            self.keys, self.logs = h[: self.most], logs[: self.most]
        elif len(new):
            keys = np.concatenate([self.keys, h[~known]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.logs = keys[order], np.concatenate([self.logs, logs[~known]])[order]
        return np.stack([bytescan.sums(logs[inverse, k], w.first) for k in range(logs.shape[1])], axis=1)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", path: str | None = None, start_rows: int = 2_000, start_rounds: int = 2, smooth: float = 0.05, most_languages: int = 1_000) -> tuple[list[str], np.ndarray]:
    """(languages in order of code points, piece probabilities (pieces, languages)) from rows with text and language.

    EM starts from equal probabilities on about start_rows rows, picked by a hash of the text, for start_rounds rounds;
    the last round counts pieces over all rows. Counts are summed on executors: pieces x languages, some 0.4 MB a language,
    reach the driver, so more than most_languages languages are refused with an error before anything is counted.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").count().limit(most_languages + 1).collect()
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    names = sorted(r["lang"] for r in sizes)
    p = pieces(path)
    prob = np.full((p.size, len(names)), 1.0 / p.size)
    if not names:
        return names, prob
    share = start_rows / max(1, sum(r["count"] for r in sizes))
    some = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1) if share < 1 else rows
    for data in [some] * start_rounds + [rows]:
        counts = _count(data, names, path, prob) + smooth
        prob = counts / counts.sum(axis=0)
    return names, prob


def _count(rows: DataFrame, names: list[str], path: str, prob: np.ndarray) -> np.ndarray:
    """One E step over rows (lang, text)."""
    given = rows.sparkSession.sparkContext.broadcast(np.log(prob))  # pieces x languages, whatever the data
    step = 4096

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, logs = pieces(path), given.value
        total = np.zeros_like(logs)
        number = {n: i for i, n in enumerate(names)}
        held: list[tuple] = []

        def flush() -> None:
            nonlocal total
            if not held:
                return
            keys, data, _, _, of, n = (np.concatenate([x[i] for x in held]) for i in range(6))
            base = np.cumsum([0, *(len(x[1]) for x in held)])[:-1]
            starts, ends = (np.concatenate([x[i] + b for x, b in zip(held, base, strict=True)]) for i in (2, 3))
            held.clear()
            _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
            total += expected(p, logs, data, starts[first], ends[first], of[first], np.bincount(inverse, n))

        for b in batches:
            lang = np.array([number[x] for x in b.column(0).to_pylist()], dtype=np.int64)
            for i, j, data, offsets in bytescan.slices(b.column(1)):
                w = bytescan.Words(data, offsets)
                of = lang[i:j][w.doc()]
                keys = bytescan.mix(bytescan.ranges(bytescan.TO_LOWER[data], w.starts, w.ends) + of.astype(np.uint64))
                k, first, n = np.unique(keys, return_index=True, return_counts=True)
                # Keep only the bytes of the distinct words.
                s, size = w.starts[first], (w.ends - w.starts)[first]
                base = np.cumsum(size) - size
                took = data[np.repeat(s - base, size) + np.arange(size.sum())]
                held.append((k, took, base, base + size, of[first], n))
                if sum(len(x[0]) for x in held) > 200_000 or sum(len(x[1]) for x in held) > 4 << 20:
                    flush()
        flush()
        for k in range(len(names)):
            for a in range(0, len(total), step):
                yield pa.RecordBatch.from_arrays([pa.array([k * len(total) + a], pa.int64()), pa.array([total[a : a + step, k].tobytes()], pa.binary())], ["at", "part"])

    out = np.zeros_like(prob)
    with small_batches(rows.sparkSession):
        for at, part in sums_of(rows.mapInArrow(count, "at long, part binary"), np.float64):
            k, a = divmod(at, len(out))
            out[a : a + len(part), k] = part
    given.destroy()
    return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", path: str | None = None) -> DataFrame:
    """Add lang_pred and score (posterior of the language, equal priors) to docs; columns of these names are replaced.

    `und` with score 0 if the text is null or has no letter, or if the model has no language. Ties go to the first
    language by code point. Whole texts count, of any length. Repeated rows get equal results.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    names, prob = model
    if not names:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    with np.errstate(divide="ignore"):
        given = docs.sparkSession.sparkContext.broadcast(np.log(prob))

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def classify(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(path, given.value)  # for this task: nothing stays in an idle worker
        for column in columns:
            langs, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
            for _, _, data, offsets in bytescan.slices(column):
                logs = scorer.texts(data, offsets)
                odds = np.exp(logs - logs.max(axis=1, keepdims=True))
                langs.append(odds.argmax(axis=1))
                scores.append(1 / odds.sum(axis=1))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()).take(pa.array(np.concatenate(langs))), pa.array(np.concatenate(scores))], ["lang_pred", "score"])
        del scorer
        bytescan.release()

    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    out = docs.withColumn("__said", classify(F.col(text)))
    return out.withColumns({"lang_pred": F.when(letters, F.col("__said.lang_pred")).otherwise("und"), "score": F.when(letters, F.col("__said.score")).otherwise(0.0)}).drop("__said")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

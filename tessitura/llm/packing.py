"""Best-fit packing of tokenised documents with a swap-based local search.

Texts are tokenised whole; longer documents are cut into pieces. Full pieces are sequences of their own. The others are
dealt into groups of bounded size, each packed by best fit, longest first, and improved by moves and exchanges (one for
one, two for one) between underfull bins that increase the sum of squared fills until bins empty.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import bytescan
from tessitura.llm.common import store, table

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
GROUP_ITEMS = 20_000
CACHE_WORDS = 100_000
LONGEST_CACHED = 64
PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long, row_no long"


#: Texts on which encoding by runs must equal encoding as a whole.
PROBES = (
    "The cat's  sat,\n\non THE mat... it's (really) 3.14 o'clock!", "\u00c9t\u00e9 na\u00efve \u00fcber stra\u00dfe \u00d7 \u00f7", " a\tb\x0bc\x0cd\re ", "x\x85y z\u00a0w \u2003 v",
    "\u65e5\u672c\u8a9e \u30c6\u30b9\u30c8 \u0e44\u0e17\u0e22 \ud55c\uad6d\uc5b4 e\u0301 \u200d \U0001f600!!", "http://a.b/c?d=e&f=%20 <tag/> {x: [1, 2]} a_b a-b --", "\u0130I\u0131 \ufb01 \u1e9e",
)


class Encoder:
    """Token ids of whole slices of texts, by runs between ASCII white space, with a bounded cache of runs.

    A vocabulary of words drops white space, never joins characters across it or between letters and signs, folds case, and
    ends each word with a piece that ends no other place. So a text's ids are its runs' ids in order, a run's those of its stem
    and of the signs after it; only a slice's distinct runs are looked up, and words can be encoded many at a time and told
    apart. Whether a vocabulary is of this kind is seen in its file and tried on PROBES; texts are encoded whole by any other.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        # The same pieces and merges without normaliser: for words of letters that are folded already.
        self.special = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        parts = json.loads(self.tokenizer.to_str())["model"]
        self.by_runs = parts["type"] == "BPE" and parts.get("end_of_word_suffix") == "</w>"
        if not self.by_runs:
            return
        self.bare = Tokenizer(BPE(parts["vocab"], [tuple(m) for m in parts["merges"]], end_of_word_suffix=parts["end_of_word_suffix"], cache_capacity=0))
        self.bare.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        raw = [p.encode() for p in PROBES]
        ids, at = self.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        self.by_runs = all(np.array_equal(ids[x:y], self.tokenizer.encode(p, add_special_tokens=False).ids) for p, x, y in zip(PROBES, at, at[1:], strict=False))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids)."""
        low = bytescan.TO_LOWER[data]
        raw = low.tobytes()
        if not self.by_runs or any(t in raw for t in self.special):  # in any case: strings of special tokens must be seen as they stand
            texts = [data[x:y].tobytes().decode() for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
            ids = [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            return np.concatenate(ids), np.cumsum([0, *map(len, ids)])
        w = bytescan.Words(low, offsets)
        starts, ends, first = _cut(low, w)
        _, at, inverse = np.unique(bytescan.ranges(low, starts, ends), return_index=True, return_inverse=True)
        runs = [raw[x:y] for x, y in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        extra = self.learn([r for r in runs if r not in known])
        found = [known.get(r) or extra.get(r, b"") for r in runs] if extra else list(map(known.__getitem__, runs))
        pieces = np.frombuffer(b"".join(found), dtype="<u4")
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        base = np.cumsum(size) - size
        n = size[inverse]
        until = np.cumsum(n)
        ids = pieces[np.repeat(base[inverse] - (until - n), n) + np.arange(until[-1] if len(until) else 0)]
        return ids, np.concatenate([[0], until])[first]

    def learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Put runs into the cache; those too long for it are returned."""
        long, plain = {}, []
        for r in new:
            if len(r) > LONGEST_CACHED:
                long[r] = self.one(r.decode())
            elif r.isalpha():  # of bytes: letters of ASCII only
                plain.append(r)
            elif (w := r.decode()).isalpha() and w == w.lower() and max(w) < "\u0100":
                plain.append(r)
            else:
                self.known[r] = self.one(w)
        for a in range(0, len(plain), 2000):
            self.many(plain[a : a + 2000])
        return long

    def one(self, run: str) -> bytes:
        return np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def many(self, words: list[bytes]) -> None:
        """Words of letters only, in one go: a word ends where a piece ends a word."""
        ids = np.array(self.bare.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
        stop = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(stop) != len(words):
            self.known.update((w, self.one(w.decode())) for w in words)
            return
        raw, stop = ids.tobytes(), stop.tolist()
        self.known.update(zip(words, [raw[x:y] for x, y in zip([0, *stop[:-1]], stop, strict=True)], strict=True))


#: ASCII signs that may follow a letter without changing how the letters are cut; an apostrophe may not.
_SIGN = np.isin(np.arange(256), np.frombuffer(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8))


def _cut(low: np.ndarray, w: bytescan.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs with the signs at their end as runs of their own: starts, ends, each text's first run.

    Only after a letter of ASCII or of U+00C0 to U+00FF; other runs stay whole.
    """
    n = len(low)
    if not len(w.starts):
        return w.starts, w.ends, w.first
    plain = np.where(_SIGN[low], 0, np.arange(1, n + 1))
    stem = np.maximum.accumulate(plain)[w.ends - 1]  # past the last byte that is no sign
    last, before = low[stem - 1], low[np.maximum(stem - 2, 0)]
    letter = ((last >= 97) & (last <= 122)) | ((before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))
    cut = (stem > w.starts) & (stem < w.ends) & letter
    place = np.arange(len(cut)) + np.cumsum(cut) - cut
    starts, ends = np.empty(len(cut) + cut.sum(), np.int64), np.empty(len(cut) + cut.sum(), np.int64)
    starts[place], ends[place] = w.starts, np.where(cut, stem, w.ends)
    starts[place[cut] + 1], ends[place[cut] + 1] = stem[cut], w.ends[cut]
    return starts, ends, np.append(place, len(starts))[w.first]


_encoders: dict[str, Encoder] = {}


def tokenise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, capacity: int = CAPACITY, path: str | None = None, slice_bytes: int = 1 << 18) -> DataFrame:
    """Pieces of each row of docs: doc_id, piece, start, length, ids_crc32, row_no (one number a row of docs and piece).

    A row's tokens are the ids of its whole text (null: none) and then end_id, cut into pieces of `capacity` tokens.
    Texts are encoded by about slice_bytes at once: more of them need more memory and less time, and give the same.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    schema = PIECES.format(id=docs.schema[doc_id].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        bytescan.release()
        n = TaskContext.get().partitionId() << 34
        for b in batches:
            for i, j, data, offsets in bytescan.slices(b.column(1), slice_bytes):
                ids, at = enc.encode(data, offsets)
                at = at + np.arange(j - i + 1)
                own = np.full(len(ids) + j - i, end_id, dtype="<u4")
                mask = np.ones(len(own), dtype=bool)
                mask[at[1:] - 1] = False
                own[mask] = ids
                raw = memoryview(own).cast("B")
                row, piece, start, length, crc = [], [], [], [], []
                for k, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    for p, z in enumerate(range(x, y, capacity)):
                        end = min(y, z + capacity)
                        row.append(i + k)
                        piece.append(p)
                        start.append(z - x)
                        length.append(end - z)
                        crc.append(zlib.crc32(raw[4 * z : 4 * end]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc, range(n, n + len(row))))], ["doc_id", "piece", "start", "length", "ids_crc32", "row_no"])
                n += len(row)
        enc.known.clear()  # an idle worker keeps nothing
        bytescan.release()

    return docs.select(doc_id, text).mapInArrow(run, schema)


class Bins:
    """Bins of one group: items by number, sizes, and for each fill the bins that have it."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self) -> None:
        """Longest first, each into the fullest bin that has room."""
        by_room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        rooms: list[int] = []  # rooms of bins that are open, in order, once each
        for i in sorted(range(len(self.sizes)), key=lambda i: (-self.sizes[i], i)):
            s = self.sizes[i]
            at = bisect_left(rooms, s)
            if at == len(rooms):
                b, room = len(self.items), self.capacity
                self.items.append([])
                self.fill.append(0)
            else:
                room = rooms[at]
                b = by_room[room].pop()
                if not by_room[room]:
                    rooms.pop(at)
            self.items[b].append(i)
            self.fill[b] += s
            if room := room - s:
                if not by_room[room]:
                    insort(rooms, room)
                by_room[room].append(b)

    def improve(self) -> None:
        """Local search: while a step raises the sum of squared fills, fill the fuller underfull bins from the emptier ones.

        Donors are taken from the emptiest up; each gives whole items (a move), one item for a smaller one, or one for two
        smaller ones. Every step moves tokens from a bin to one at least as full, so squared fill grows and the search ends.
        """
        sizes, fill, items, cap = self.sizes, self.fill, self.items, self.capacity
        under = [b for b in range(len(items)) if fill[b] < cap]
        holders: dict[int, set[int]] = {}  # gap -> underfull bins with that gap
        for b in under:
            holders.setdefault(cap - fill[b], set()).add(b)
        self.swaps: list[list[tuple[int, ...]]] = [[] for _ in range(cap + 1)]
        for b in under:
            self._list(b, True)
        changed = True
        while changed:  # an exchange between fuller bins may make room for what found none before
            changed = False
            for donor in sorted((b for b in under if items[b] and fill[b] < cap), key=lambda b: (fill[b], b)):
                again = True
                while again and items[donor] and fill[donor] < cap:
                    again = False
                    for i in sorted(items[donor], key=lambda i: (-sizes[i], i)):
                        if (to := self._room(holders, donor, sizes[i])) is not None:  # a move
                            self._shift(holders, donor, to, [i], [])
                        elif (found := self._exchange(holders, donor, i)) is not None:
                            self._shift(holders, donor, found[0], [i], found[1])
                        else:
                            continue
                        again = changed = True
                        break

    def _room(self, holders: dict[int, set[int]], donor: int, size: int) -> int | None:
        """The fullest other bin with room for size, at least as full as the donor."""
        most = self.capacity - self.fill[donor]
        for gap in sorted(g for g in holders if size <= g <= most):
            for b in holders[gap]:
                if b != donor and self.items[b]:
                    return b
        return None

    def _exchange(self, holders: dict[int, set[int]], donor: int, i: int) -> tuple[int, list[int]] | None:
        """A fuller bin that takes item i for one or two smaller items of its own, filled the more the better."""
        size, most = self.sizes[i], self.capacity - self.fill[donor]
        for room in range(size, min(self.capacity, size + most - 1) + 1):
            own = self.swaps[room]
            at = bisect_left(own, (room - most,)) if own else 0
            while at < len(own) and own[at][0] < size:
                _, b, *back = own[at]
                if b != donor:
                    items = {self.sizes[j]: j for j in self.items[b]}
                    if len(back) == 2 and back[0] == back[1]:
                        return b, [j for j in self.items[b] if self.sizes[j] == back[0]][:2]
                    return b, [items[x] for x in back]
                at += 1
        return None

    def _list(self, b: int, add: bool) -> None:
        """Put a bin's swaps into the index or take them out: (size, bin, sizes) of one or two items, by the room without them."""
        gap = self.capacity - self.fill[b]
        if not gap:
            return
        n = Counter(self.sizes[j] for j in self.items[b])
        own = sorted(n)
        back = [(x,) for x in own] + [(x, y) for k, x in enumerate(own) for y in own[k if n[x] > 1 else k + 1 :]]
        for x in back:
            at = self.swaps[gap + sum(x)]
            if add:
                insort(at, (sum(x), b, *x))
            else:
                at.pop(bisect_left(at, (sum(x), b, *x)))

    def _shift(self, holders: dict[int, set[int]], a: int, b: int, give: list[int], back: list[int]) -> None:
        for x in (a, b):
            self._list(x, False)
            holders[gap := self.capacity - self.fill[x]].discard(x)
            if not holders[gap]:
                del holders[gap]
        for src, dst, moved in ((a, b, give), (b, a, back)):
            for i in moved:
                self.items[src].remove(i)
                self.items[dst].append(i)
                self.fill[src] -= self.sizes[i]
                self.fill[dst] += self.sizes[i]
        for x in (a, b):
            self._list(x, True)
            if self.items[x] and self.fill[x] < self.capacity:
                holders.setdefault(self.capacity - self.fill[x], set()).add(x)


def pack_sizes(sizes: list[int], capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size; bins from 0 without gaps. Sizes are 1 to capacity."""
    bins = Bins(sizes, capacity)
    bins.best_fit()
    if len(sizes) > 1:
        bins.improve()
    where, offset, n = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    for own in bins.items:
        at = 0
        for i in own:
            where[i], offset[i] = n, at
            at += sizes[i]
        n += bool(own)
    return where, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Add sequence_id and offset to pieces (columns length, row_no; row_no distinct).

    Pieces of full length are sequences by themselves, numbered below 0. The others go to groups of about group_items by a
    hash of row_no; a group costs one underfull sequence at most over packing all together. An empty table gives no rows.
    """
    short = pieces.filter(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group_items))

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("row_no")
        where, offset = pack_sizes(part.column("length").to_pylist(), capacity)
        where += part.column("__group")[0].as_py() << 32
        return part.drop_columns("__group").append_column("sequence_id", pa.array(where)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    packed = short.withColumn("__group", F.pmod(F.xxhash64("row_no"), F.lit(groups))).groupBy("__group").applyInArrow(run, schema)
    whole = pieces.filter(F.col("length") == capacity).withColumns({"sequence_id": -F.col("row_no") - 1, "offset": F.lit(0).cast("long")})
    return whole.unionByName(packed)


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, capacity: int = CAPACITY, path: str | None = None, slice_bytes: int = 1 << 18) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every row of docs, packed.

    Null and empty texts are one token, end_id. Repeated rows are packed each. Null ids stay null. Other columns are ignored.
    """
    pieces = store(tokenise(docs, doc_id, text, end_id, capacity, path, slice_bytes), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), slice_bytes=1 << 20)

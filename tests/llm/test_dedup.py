import hashlib
import random
from collections import defaultdict
from pathlib import Path

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.llm import common, components, exact, minhash, substring


def test_exact_groups(spark, sf, texts):
    groups = defaultdict(list)
    for i, r in texts.items():
        groups[r.text or ""].append(i)
    rows = exact.op10_exact_dedup(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = groups[texts[r.doc_id].text or ""]
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.doc_id == max(own))
        assert r.text_sha256 == hashlib.sha256((texts[r.doc_id].text or "").encode()).hexdigest()


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_on_odd_rows(edge, nothing, keep, weak):
    """weak: a digest of two values, so that different texts collide and byte verification has to part them."""
    digest = F.unhex(F.lpad(F.conv(F.pmod(F.length(F.coalesce("text", F.lit(""))), F.lit(2)).cast("string"), 10, 16), 2, "0")) if weak else None
    rows = exact.exact_dedup(edge, keep=keep, digest=digest, hot_rows=1, salts=3, memtable_rows=2).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r)
    assert len(rows) == edge.count()
    for own in groups.values():
        ids = [r.doc_id for r in own if r.doc_id is not None]
        want = (max if keep == "max" else min)(ids) if ids else None
        assert all(r.keep_id == want and r.group_size == len(own) for r in own)
        assert sum(r.kept for r in own) == 1 and all(r.doc_id == want for r in own if r.kept)
        assert all(r.extra is None or r.extra == "x" for r in own) and all(r.node == "mine" for r in own)
    assert exact.exact_dedup(nothing, keep=keep, digest=digest).count() == 0


def test_index_takes_batches_and_looks_up(spark):
    rows = lambda ids: spark.createDataFrame([(bytes([i % 50]) * 32, i) for i in ids], "digest binary, id long")
    log = exact.DigestLog(spark, memtable_rows=7)
    log.add(rows(range(40)))
    log.add(rows(range(30, 90)))
    want = {bytes([d]) * 32: (min(i for i in [*range(40), *range(30, 90)] if i % 50 == d), sum(i % 50 == d for i in [*range(40), *range(30, 90)])) for d in range(50)}
    probe = spark.createDataFrame([(bytes([d]) * 32,) for d in range(60)], "digest binary")
    for _ in range(2):
        got = {bytes(r.digest): (r.keep_id, r.n) for r in log.lookup(probe).collect()}
        assert got == {bytes([d]) * 32: want.get(bytes([d]) * 32, (None, None)) for d in range(60)}
        log.compact()
    assert len(log.runs) == 2  # digests met once, digests met again


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(docs, texts, k, percent):
    root, size = brute.components([(i, r.text) for i, r in texts.items()], k, percent)
    rows = minhash.near_duplicates(docs, words=k, percent=percent).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in rows} == {i: (root[i], size[i], root[i] == i) for i in root}


def _family(n, seed, edits, words=120, vocabulary=900):
    """Copies of one text with some words changed each."""
    rng = random.Random(seed)
    base = [f"v{rng.randrange(vocabulary)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("edits", [1, 2, 4])
def test_large_groups_of_near_copies(spark, edits, monkeypatch):
    """Around the threshold, with blocks smaller than the group, so that lists are dealt out and settled in blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 64)
    monkeypatch.setattr(minhash, "PAIRS_A_MEMBER", 2)
    rows = list(enumerate(_family(150, edits, edits) + _family(40, 9, 3)))
    root, size = brute.components(rows, 3, 85)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == root


def test_near_duplicates_on_odd_rows(edge, nothing):
    rows = minhash.near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    at = defaultdict(list)
    for r in rows:
        at[r.doc_id].append(r)
    assert all(r.n_shingles == 0 and r.component_id == i and r.kept for i in (2, 3, 4) for r in at[i])
    assert {r.component_id for i in (5, 6, None) for r in at[i]} == {5} and not any(r.kept for i in (6, None) for r in at[i])
    assert at[9][0].component_id == 8 and at[8][0].kept
    assert minhash.near_duplicates(nothing).count() == 0


def test_spanning_links():
    a = np.arange(100)
    items = [a, a + 2, a + 200, a + 203, a + 500]
    links = minhash.spanning(np.arange(5), np.arange(5), items, 85)
    assert sorted(map(sorted, links)) == [[0, 1], [2, 3]]
    assert minhash.spanning(np.arange(2), np.zeros(2), items[:2], 85) == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def _prose(n, seed):
    rng = random.Random(seed)
    return [f"t{rng.randrange(5000)}" for _ in range(n)]


def test_planted_passages(spark):
    """Exact, fuzzy and periodic passages in otherwise different texts are found; clean texts are left alone."""
    exact_p, fuzzy, run = _prose(60, 1), _prose(90, 2), ["la"] * 80
    rows, want = [], {}
    for i in range(40):
        own = _prose(200, 100 + i)
        p = None
        if i % 4 == 0:
            p = exact_p
        elif i % 4 == 1:
            p = list(fuzzy)
            for k in range(5 + i, 90, 17):
                p[k % 90] = f"e{i}x{k}"
        elif i % 8 == 2:
            p = run
        at = 37 + i
        rows.append((i, " ".join(own[:at] + (p or []) + own[at:])))
        if p:
            want[i] = (at, at + len(p))
    got = defaultdict(list)
    for r in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].append((r.start_word, r.end_word))
    assert set(got) == set(want)
    for i, (a, b) in want.items():
        assert sum(max(0, min(y, b) - max(x, a)) for x, y in got[i]) >= 0.85 * (b - a)
        assert all(x >= a - 12 and y <= b + 12 for x, y in got[i])


@pytest.mark.parametrize("between", [60, 100, 200])
def test_passages_around_different_text(spark, between):
    """A shared opening and a shared end around different middles are two passages, though one chain runs over both."""
    head, tail = _prose(60, 1), _prose(60, 2)
    rows = [(i, " ".join([*head, *_prose(between, 10 + i), *tail])) for i in range(2)]
    got = defaultdict(list)
    for r in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].append((r.start_word, r.end_word))
    for i in range(2):
        (a, b), (c, d) = sorted(got[i])
        assert abs(a) <= 4 and abs(b - 60) <= 4 and abs(c - 60 - between) <= 4 and abs(d - 120 - between) <= 4


def test_passage_of_which_all_parts_are_frequent(spark):
    """Two texts share 60 words; 300 others hold 30 to 45 of those words each, so that no short seed leads from one to the other."""
    shared = _prose(60, 7)
    rows = [(i, [*_prose(40, 100 + i), *shared, *_prose(40, 200 + i)]) for i in (0, 900)]
    for i in range(1, 301):
        n = 30 + i % 16
        at = i * 7 % (61 - n)
        rows.append((i, [*_prose(30, 1000 + i), *shared[at : at + n], *_prose(30, 2000 + i)]))
    got = {r.doc_id: r for r in substring.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()}
    for i in (0, 900):
        assert got[i].start_word <= 42 and got[i].end_word >= 98


def test_changed_passage_of_which_all_parts_are_frequent(spark):
    """As above, but a word of the 60 differs, so that the two texts share no 50 words either; links by pairs of seeds remain."""
    shared = _prose(60, 7)
    rows = [(i, [*_prose(40, 100 + i), *shared[:30], f"other{i}", *shared[31:], *_prose(40, 200 + i)]) for i in (0, 900)]
    for i in range(1, 301):
        n = 20 + i % 10
        at = i % 2 * 31 + i * 7 % (30 - n)
        rows.append((i, [*_prose(30, 1000 + i), *shared[at : at + n], *_prose(30, 2000 + i)]))
    got = {r.doc_id: r for r in substring.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()}
    for i in (0, 900):
        assert got[i].start_word <= 44 and got[i].end_word >= 96 and got[i].partner_id == 900 - i


def test_partner_is_the_least_id_of_all_holders(spark):
    """Forty texts hold one passage of 60 words: each of them names the least other id, not that of a neighbour in the list of a seed."""
    shared = _prose(60, 8)
    rows = [(i, " ".join([*_prose(40, 3000 + i), *shared, *_prose(40, 4000 + i)])) for i in range(40)]
    got = {r.doc_id: r.partner_id for r in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i else 1 for i in range(40)}


def test_every_exact_repeat_is_found(spark, sf, texts):
    """Brute force: all windows of 50 words that two texts share lie within the rows of both. By the query itself."""
    words = {i: brute.WORD.findall(r.text or "") for i, r in texts.items()}
    holders = defaultdict(set)
    for i, w in words.items():
        for p in range(len(w) - 49):
            holders[tuple(w[p : p + 50])].add(i)
    got = defaultdict(list)
    for r in substring.op6_substring_dedup(spark, sf).collect():
        got[r.doc_id].append((r.start_word, r.end_word))
        assert r.end_word - r.start_word >= 50 and r.identity >= 0.8
    seen = covered = 0
    for i, w in words.items():
        for p in range(len(w) - 49):
            if len(holders[tuple(w[p : p + 50])]) > 1:
                seen += 50
                covered += max((max(0, min(b, p + 50) - max(a, p)) for a, b in got[i]), default=0)
                assert any(b - max(a, p) >= 40 and min(b, p + 50) - a >= 40 for a, b in got[i])
    assert seen and covered >= 0.995 * seen


def test_recall_of_changed_passages(spark):
    """60 pairs of texts, each with a passage of 60 words of which every tenth on average is changed: the figure of the README."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(60):
        shared = _prose(60, 5000 + i)
        other = [f"changed{i}x{j}" if rng.random() < 0.1 else w for j, w in enumerate(shared)]
        rows += [(2 * i, " ".join([*_prose(50, 6000 + i), *shared])), (2 * i + 1, " ".join([*_prose(70, 7000 + i), *other]))]
    got = {r.doc_id for r in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    print("recall of changed passages", len(got) / 120)
    assert len(got) >= 0.8 * 120


def test_passages_store_few_pairs_and_keep_no_table_longer_than_needed(spark, monkeypatch):
    """Phrases of 16 words in 16 places, in another order each time: their seeds are frequent, most pairs of them are met once."""
    rng = np.random.default_rng(11)
    phrases = [[f"p{i}x{j}" for j in range(16)] for i in range(500)]
    rows = [(i, " ".join(w for p in rng.permutation(500)[:20] for w in phrases[p])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    real, made, paths = substring.store, [], {}

    def store(df, label, *more):
        out = real(df, label, *more)
        made.append((label, out.count()))
        paths[label] = Path(common._written[-1][1].removeprefix("file:"))
        return out

    monkeypatch.setattr(substring, "store", store)
    substring.repeated_passages(docs).count()
    words = 400 * 20 * 16
    assert max(n for label, n in made if label in ("seeds", "again", "wide", "pairs")) < words // 4
    assert paths["rows"].exists() and not paths["seeds"].exists() and not paths["wide"].exists()


def test_windows_meet_in_few_rows_and_as_by_brute_force(spark, monkeypatch):
    """Windows of 50 words travel by their least shingle, many in a row; of very frequent ones each by itself, with the same result."""
    pool = [_prose(90, 9000 + i) for i in range(6)]
    rng = np.random.default_rng(3)
    rows = [(1000 - i, [*_prose(30, 9100 + i), *(w for p in rng.permutation(6)[:3] for w in pool[p][: rng.integers(45, 91)])], None if i % 7 == 0 else i // 2) for i in range(24)]
    rows += [(1, ["la"] * 200, 90), (2, ["la"] * 130, 91), (3, _prose(70, 9200) * 2, 92)]
    texts = spark.createDataFrame([(n, " ".join(w), low) for n, w, low in rows], "node long, text string, low long")
    holders = defaultdict(dict)
    for n, w, low in rows:
        for p in range(len(w) - 49):
            holders[tuple(w[p : p + 50])][n] = low
    want = set()
    for n, w, _ in rows:
        spans = []
        for p in range(len(w) - 49):
            if others := [v for m, v in holders[tuple(w[p : p + 50])].items() if m != n]:
                least = min((v for v in others if v is not None), default=None)
                if spans and p < spans[-1][1]:
                    spans[-1] = (spans[-1][0], p + 50, [*spans[-1][2], least])
                else:
                    spans.append((p, p + 50, [least]))
        want |= {(n, a, b, min((v for v in of if v is not None), default=None)) for a, b, of in spans}
    assert len(want) > 20
    every, none = np.full(1 << 10, 255, np.uint8), np.zeros(1 << 10, np.uint8)
    wide = substring._wide_seeds(texts, every, none, 1, substring.K, substring.WINDOW, 50).filter("seed is not null").drop("seeds", "places", "sums").cache()
    assert wide.count() < sum(len(w) - 49 for _, w, _ in rows) // 8
    real = substring._hot
    for hot in (real, lambda seeds, total, *_: real(seeds, total, 1, 1)):
        monkeypatch.setattr(substring, "_hot", hot)
        assert {(r.node, r.start, r.stop, r.partner_id) for r in substring._same_windows(wide, 50).collect()} == want


def test_words_of_ranges_that_very_many_links_ask_for(spark):
    rows = [(i, " ".join(_prose(400, 9300 + i))) for i in range(3)]
    need = [(0, i, i % 2, i % 300, i % 300 + 90) for i in range(3000)] + [(1, 5000, 0, 350, 500), (2, 5000, 1, 0, 400)]
    texts, asked = spark.createDataFrame(rows, "node long, text string"), spark.createDataFrame(need, "node long, link long, side int, start int, stop int")
    hashes = [(substring.bytescan.Words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])).hashes() >> np.uint64(32)).astype(np.uint32) for _, t in rows]
    got = substring._spans(texts, asked).collect()
    assert {(r.link, r.side, bytes(r.words)) for r in got} == {(n, s, hashes[i][a:b].tobytes()) for i, n, s, a, b in need} and len(got) == len(need)


def test_parts_of_a_chain():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = rng.integers(0, 8, 40), rng.integers(0, 8, 30)
        x, y = substring.common(a, b)
        assert len(x) == substring.align(a, b) and (a[x] == b[y]).all()
        assert x == sorted(set(x)) and y == sorted(set(y))
    x = np.concatenate([np.arange(60), np.arange(160, 220)])
    assert substring.parts(x, x, 50, 0.8) == [(0, 60, 0, 60, 1.0), (160, 220, 160, 220, 1.0)]
    assert substring.parts(x[:60:2], x[:60:2], 50, 0.8) == []


def test_passages_on_odd_rows(edge, nothing):
    rows = substring.repeated_passages(edge).collect()
    assert {r.doc_id for r in rows} == {8, 9} and all(r.end_word - r.start_word >= 50 for r in rows)
    copies = substring.repeated_passages(edge.unionByName(edge.filter("doc_id = 1")))
    assert {r.doc_id for r in copies.collect()} == {1, 8, 9}
    assert substring.repeated_passages(nothing).count() == 0


def test_chains_rise_and_alignment_counts():
    x, y = np.array([0, 5, 10, 15, 20, 3]), np.array([100, 105, 110, 115, 120, 7])
    best = substring.chain(x, y)
    assert best[0] == [0, 1, 2, 3, 4] and best[1] == [5]
    t = substring.Fenwick(8)
    for i, v in enumerate([3.0, 1.0, 4.0, 1.0, 5.0]):
        t.put(i, (v, i))
    assert [t.most(k)[0] for k in range(1, 6)] == [3.0, 3.0, 4.0, 4.0, 5.0]
    a = np.arange(50, dtype=np.uint32)
    b = np.concatenate([a[:20], [999], a[20:30], a[31:]]).astype(np.uint32)
    assert substring.align(a, a) == 50 and substring.align(a, b) == 49
    assert substring.extend(a, a[:10]) == 10 and substring.extend(a, a + 1) == 0

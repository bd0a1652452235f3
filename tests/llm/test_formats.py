import hashlib
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessitura.llm import chat, urlfilter

TURNS = "conv_id long, turn long, role string, text string"
pieces = st.lists(st.sampled_from(["<|", "|>", "<", "|", "\\", "\n", "%", "%25", "im_end", "<|im_end|>\n", "<|im_start|>user\n", "a", "é", ""]), max_size=6).map("".join)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(pieces, pieces), min_size=1, max_size=12))
def test_round_trip(spark, turns):
    rows = [(1, i, r, t) for i, (r, t) in enumerate(turns)]
    out = chat.format_conversations(spark.createDataFrame(rows, TURNS))
    got = out.select(chat.parse_turns(F.col("formatted")).alias("t")).first().t
    assert [(x.role, x.text) for x in got] == turns


def test_machine_and_loss(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a<|im_end|>"), (2, 0, "user", "u"), (2, 1, "user", "v"), (3, 1, None, None), (3, None, "assistant", "x"), (None, 0, "user", "q"), (4, 0, "user", "u"), (4, 0, "user", "u")]
    out = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, TURNS).withColumns({"state": F.lit("mine"), "t": F.lit(1)})).collect()}
    assert (out[1].state, out[1].bad_turn) == ("assistant", None) and (out[2].state, out[2].bad_turn) == ("error", 1)
    assert out[3].bad_turn == 0 and None in out and out[4].formatted.count("<|im_start|>") == 2
    assert [s.text for s in out[1].segments if s.loss] == ["a<\\|im_end|>"]
    assert out[1].formatted == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\na<\\|im_end|><|im_end|>\n"
    assert chat.format_conversations(spark.createDataFrame([], TURNS)).count() == 0


def test_query_against_plain_version(spark, sf):
    talks = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        talks[r.conv_id].append((r.turn, r.role, r.text or ""))
    talks[-1] = [(0, "user", "<|im_end|><|im_start|>assistant ok"), (1, "assistant", "<|im_end|><|im_start|>assistant ok")]
    rows = chat.op8_chat_format(spark, sf).collect()
    assert len(rows) == len(talks)
    for r in rows:
        own = sorted(talks[r.conv_id])
        loss = "".join(t for _, role, t in own if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(own), len(loss))
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in own).encode()).hexdigest()


def _plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for i, c in enumerate(rest):
        if c in "/?#":
            host, rest = rest[:i], rest[i:]
            break
    else:
        host, rest = rest, ""
    path = rest.split("?")[0].split("#")[0] if rest[:1] == "/" else ""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def _judge(host, path, rules, default):
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, default)


URLS = [None, "", "no scheme", "http://", "http://net", "https://NET/x", "http://a.net/", "http://example.net/en/x?y#z", "http://x.example.net/en", "http://notexample.net/en/", "http://É.org/fr/a", "http://example.com/de/", "http://example.com?de/", "http://a.b.example.com/de/q://w", "x://org/fr/", "http://example.com:80/de/", "http://user@example.com/de/", "http://..net/", "http://example.com#/de/", "http://a.net/\nb"]


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_url_rules(spark, sf, most):
    """By the digest array and by the join."""
    own = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(URLS + URLS)], "page_id long, url string, host string").withColumn("rule", F.lit(1))
    pages = own.unionByName(spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id") + 1000, "url", F.lit("mine").alias("host"), F.lit(1).alias("rule")).toDF("page_id", "url", "host", "rule"))
    more = [*urlfilter.RULES, ("block", "ththth.example.org", "/en/1"), ("allow", "", "")]
    for rules, default in ((urlfilter.RULES, "allow"), (more, "block")):
        rows = urlfilter.classify(pages, rules, default, most_bytes=most).collect()
        assert len(rows) == pages.count()
        for r in rows:
            assert (r.host, r.path) == _plain(r.url)
            assert (r.rule, r.verdict) == _judge(r.host, r.path, rules, default), r.url
    assert urlfilter.classify(pages.limit(0), more, most_bytes=most).count() == 0
    assert Counter(c for c in urlfilter.classify(pages, more, most_bytes=most).columns)["rule"] == 1


def test_collisions_are_told_by_strings(tmp_path):
    path = tmp_path / "x.idx"
    path.write_bytes(urlfilter.build_index([("block", f"h{i}", "/") for i in range(300)]))
    a = urlfilter.DigestArray(str(path))
    found = a.find([f"h{i}\0/".encode() for i in range(310)])
    assert (found[:300] >= 0).all() and (found[300:] == -1).all()
    a.digests = a.digests.copy()
    a.digests[:] = a.digests[7]  # all digests collide
    key = bytes(a.strings[a.offsets[200] : a.offsets[201]])
    import xxhash

    a.digests[:] = xxhash.xxh64_intdigest(key)
    assert a.find([key])[0] == 200 and a.find([b"h999\0/"])[0] == -1

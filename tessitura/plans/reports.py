"""More named queries: variants of chunks and word errors, portable references, lookups and checks, metrics documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.config import REASONS
from tessitura.functions import arrays, text
from tessitura.functions.numeric import d, logistic, ratio
from tessitura.operators import ensemble, gate, metrics, splits
from tessitura.plans import catalogue, views
from tessitura.plans.catalogue import DEC, SIG, WHY, rounded
from tessitura.plans.views import FILES_SQL, METRICS_SQL, PREDICTIONS_SQL, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Signals.


@query(f"""WITH s AS ({SIG}), c AS (SELECT vec_id, len(x[start + 1:start + 20]) AS n FROM (SELECT vec_id, x, unnest(range(0, len(x), 20)) AS start FROM s))
SELECT vec_id, count(*) AS n_chunks, count(*) FILTER (WHERE n >= 10) AS n_kept, sum(n) FILTER (WHERE n >= 10)::BIGINT AS kept_samples FROM c GROUP BY vec_id""")
def signal_eval_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 1.3 ms, 20 whole samples, and those left when a last one below half of that is dropped."""
    x, size = F.col("embedding"), lambda c: F.size(c).cast("long")
    kept = arrays.eval_chunks(x, 0.0013, 16000, drop_short=True)
    total = F.aggregate(kept, F.lit(0).cast("long"), lambda a, c: a + F.size(c["samples"]))
    return table(spark, sf_dir, "embeddings").select("vec_id", size(arrays.eval_chunks(x, 0.0013, 16000)).alias("n_chunks"), size(kept).alias("n_kept"), total.alias("kept_samples"))


@query(f"""WITH s AS ({SIG}), t AS (SELECT vec_id, x, (vec_id % 7 - 1) * 1e-3 AS a, (vec_id % 5) * 1e-3 AS b FROM s),
i AS (SELECT vec_id, x, greatest(0, trunc(a * 16000)::BIGINT) AS f, least(len(x), trunc(b * 16000)::BIGINT) AS e FROM t)
SELECT vec_id, greatest(0, e - f)::INTEGER AS n, CASE WHEN e > f THEN round(list_sum(x[f + 1:e]), 6) ELSE 0 END AS total FROM i""")
def segment_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of a segment by its seconds: before the start, beyond the end, and none, by number of the vector."""
    k = F.col("vec_id")
    s = arrays.slice_seconds(F.col("embedding"), (k % 7 - 1) * d(1e-3), (k % 5) * d(1e-3), 16000)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(s).alias("n"), F.round(arrays.total(s), 6).alias("total"))


@query(f"""WITH s AS ({SIG}), z AS (SELECT vec_id, list_transform(x, lambda v: CASE WHEN abs(v) < 5e-2 THEN 0 WHEN v > 0 THEN 1 ELSE -1 END) AS x FROM s)
SELECT vec_id, len(list_filter(range(2, len(x) + 1), lambda i: x[i - 1] <> x[i])) * 16000::DOUBLE / len(x) AS sign_rate, len(list_filter(range(2, len(x) + 1), lambda i: (x[i - 1] >= 0) <> (x[i] >= 0))) * 16000::DOUBLE / len(x) AS zcr FROM z""")
def signal_sign_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rates of crossings of signals whose small samples are zero, where they differ."""
    x = F.transform("embedding", lambda v: F.when(F.abs(v.cast("double")) < d(0.05), d(0)).otherwise(v.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", arrays.sign_change_rate(x, 16000).alias("sign_rate"), arrays.zero_crossing_rate(x, 16000).alias("zcr"))


# Word errors.

_BLANK = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"
_PLAIN = f"c AS (SELECT conv_id, turn, role, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{_BLANK}'), lambda w: w <> '') AS w FROM conversations)"


@query(f"WITH RECURSIVE {_PLAIN}, {catalogue._ALIGN} SELECT conv_id, turn, n_ref::INTEGER AS n_ref, errors::INTEGER AS errors, CASE WHEN n_ref > 0 THEN round(errors / n_ref::DOUBLE, 6) END AS wer FROM e")
def wer_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word errors of whole turns against the next, split at white space only; null where there is no reference."""
    c = table(spark, sf_dir, "conversations").withColumn("w", text.plain_words(F.col("text")))
    p = c.select("conv_id", "turn", F.col("w").alias("ref")).join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("hyp")), ["conv_id", "turn"])
    n = F.size("ref")
    a = p.withColumns({"a": text.alignment("ref", "hyp"), "n_ref": n})
    a = a.withColumn("errors", F.when(n > 0, F.col("a.substitutions") + F.col("a.deletions") + F.col("a.insertions")).otherwise(0))
    return rounded(a.select("conv_id", "turn", "n_ref", "errors", F.when(F.col("n_ref") > 0, ratio(F.col("errors"), F.col("n_ref"))).alias("wer")))


@query(f"""WITH RECURSIVE {catalogue._PAIR}, x AS (SELECT e.*, coalesce(a.text, '') <> '' AS has, coalesce(b.text, '') = '' AS empty FROM e
  JOIN conversations a ON a.conv_id = e.conv_id AND a.turn = e.turn JOIN conversations b ON b.conv_id = e.conv_id AND b.turn = e.turn + 1)
SELECT role, count(*) FILTER (WHERE has) AS n_refs, count(*) FILTER (WHERE has AND NOT empty) AS n_scored, count(*) FILTER (WHERE has AND empty) AS n_skipped, 0::BIGINT AS n_empty_hyp,
  coalesce(sum(n_ref) FILTER (WHERE has AND NOT empty), 0)::BIGINT AS n_ref, coalesce(sum(errors) FILTER (WHERE has AND NOT empty), 0)::BIGINT AS errors,
  round(coalesce(sum(errors) FILTER (WHERE has AND NOT empty) / nullif(sum(n_ref) FILTER (WHERE has AND NOT empty), 0)::DOUBLE, 0), 6) AS wer FROM x GROUP BY role""")
def wer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored, skipped and empty pairs by role, empty hypotheses skipped."""
    c = table(spark, sf_dir, "conversations")
    a = c.select("conv_id", "turn", "role", F.col("text").alias("ref"))
    p = a.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp")), ["conv_id", "turn"])
    w = {n: text.words(text.normalise(F.coalesce(F.col(n), F.lit("")))) for n in ("ref", "hyp")}
    p = p.withColumns({"a": text.alignment(w["ref"], w["hyp"]), "n_ref": F.size(w["ref"])})
    p = p.withColumn("errors", F.when(F.col("n_ref") > 0, F.col("a.substitutions") + F.col("a.deletions") + F.col("a.insertions")).otherwise(0))
    return rounded(metrics.wer_report(p, "role", skip_empty=True))


# References, lookups, checks.

_CLEAN = lambda q: f"'/' || array_to_string(list_reduce(list_concat([[]::VARCHAR[]], list_transform(list_filter(string_split({q}, '/'), lambda x: x NOT IN ('', '.')), lambda x: [x])), lambda a, b: CASE WHEN b[1] = '..' THEN a[1:len(a) - 1] ELSE list_concat(a, b) END), '/')"
_REST = "regexp_replace(url, '^[a-z]+://', '')"


@query(f"""WITH r AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/srv/repo/' || {_REST} WHEN 1 THEN 'clips/' || {_REST} WHEN 2 THEN '/mnt/' || {_REST} ELSE split_part({_REST}, '/', 1) END AS v FROM pages),
c AS (SELECT *, {_CLEAN("CASE WHEN starts_with(v, '/') THEN v ELSE '/srv/repo/' || v END")} AS whole FROM r)
SELECT page_id, CASE WHEN coalesce(v, '') = '' THEN '' WHEN instr(v, '/') = 0 THEN v WHEN starts_with(whole, '/srv/repo/') THEN substr(whole, 11)
  WHEN instr(whole, 'data/raw/') > 0 THEN substr(whole, instr(whole, 'data/raw/')) WHEN starts_with(whole, '/mnt/') THEN 'data/raw/' || substr(whole, 6) END AS reference FROM c""")
def portable_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths within a root, relative ones, those of another root, and plain names, without host folders."""
    k, rest = F.col("page_id") % 4, F.regexp_replace("url", "^[a-z]+://", "")
    v = F.when(k == 0, F.concat(F.lit("/srv/repo/"), rest)).when(k == 1, F.concat(F.lit("clips/"), rest)).when(k == 2, F.concat(F.lit("/mnt/"), rest)).otherwise(F.substring_index(rest, "/", 1))
    rows = table(spark, sf_dir, "pages").select("page_id", v.alias("v"))
    return rows.select("page_id", text.portable(F.col("v"), "/srv/repo", {"/mnt": "data/raw"}).alias("reference"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN array_to_string(list_sort(['data/raw/a/' || doc_id || '.wav', 'data/raw/b/' || doc_id % 10 || '.wav']), '|') ELSE 'data/raw/a/' || doc_id || '.wav' END AS identities FROM documents""")
def example_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of all inputs: the corruption is the source itself, a plain name, or a file of another host folder."""
    k = F.col("doc_id")
    source = F.concat(F.lit("/mnt/./a/"), k, F.lit(".wav"))
    noise = F.when(k % 3 == 0, F.concat(F.lit("/home/x/data/raw/a/"), k, F.lit(".wav"))).when(k % 3 == 1, "white_noise").otherwise(F.concat(F.lit("/mnt/b/c/../"), k % 10, F.lit(".wav")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.input_identities(source, noise, {"/mnt": "data/raw"}), "|").alias("identities"))


@query("""SELECT d.doc_id, coalesce(l.kind, '') AS kind FROM documents d LEFT JOIN (SELECT doc_id, 'toxic=' || toxic AS kind FROM labels) l USING (doc_id)""")
def default_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's label as text, empty where there is none."""
    marks = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("toxic="), F.col("toxic")).alias("kind"))
    return splits.lookup(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", marks, "kind")


@query("""WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS k FROM orders WHERE o_orderkey % 11 <> 0),
c AS (SELECT count(a.o_orderkey) AS n_left, count(b.o_orderkey) AS n_right, count(*) FILTER (WHERE a.o_custkey IS DISTINCT FROM b.k) AS n_different FROM orders a FULL JOIN b USING (o_orderkey)) SELECT *, n_different = 0 AS equal FROM c""")
def order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables by place: rows that one side lacks, and keys that differ."""
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("place"), F.col("o_custkey").alias("key"))
    b = a.filter("place % 11 <> 0").withColumn("key", F.expr("if(place % 7 = 0, key + 1, key)"))
    return splits.same_order(a, b, "place", "key")


_MEANS = "CASE {} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REASONS.items()) + " ELSE '' END"


@query(f"WITH {METRICS_SQL} SELECT event_id, {WHY} AS reason, {_MEANS.format(f'({WHY})')} AS meaning FROM m")
def reason_meanings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.gate(views.metrics(spark, sf_dir)).select("event_id", "reason", gate.describe(F.col("reason")).alias("meaning"))


# Metrics.

_MAPPED = "CASE label WHEN 'de' THEN 'music' WHEN 'en' THEN 'clean_speech' ELSE label END"


@query(f"""WITH {PREDICTIONS_SQL}, k AS (SELECT target, probability, {_MAPPED} AS label, kind, threshold FROM p, (VALUES ('selected', 3e-1::DOUBLE), ('default', 5e-1::DOUBLE)) v(kind, threshold)),
w AS (SELECT kind, threshold, label, grouping(label) AS whole, {catalogue._COUNTS('probability >= threshold')}, count(*) FILTER (WHERE label = 'music' AND probability >= threshold) AS music_fa,
  count(*) FILTER (WHERE label = 'clean_speech' AND probability < threshold) AS clean_speech_fr FROM k GROUP BY GROUPING SETS ((kind, threshold), (kind, threshold, label)))
SELECT kind, threshold, label, tp, fp, tn, fn, music_fa, clean_speech_fr, {catalogue._RATES} FROM w WHERE whole = 1 OR label IS NOT NULL""")
def metrics_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and rates at the selected threshold and at 0.5, of all rows and of each label."""
    return metrics.document(views.predictions(spark, sf_dir), F.expr(_MAPPED), F.col("target"), F.col("probability"), 0.3)


@query(f"""WITH {METRICS_SQL}, {FILES_SQL},
r AS (SELECT path, {DEC} <> 'FAIL' AS ok, 1 / (1 + exp(-({catalogue._RAW}))) AS pr FROM m),
f AS (SELECT path, should_transcribe = 'yes' AS target, bool_or(ok) AS rule, count(*) FILTER (WHERE ok) AS rule_calls, count(*) AS chunks, max(pr) >= 6e-1 AS learned FROM r JOIN files USING (path) WHERE should_transcribe <> '' GROUP BY path, should_transcribe),
x AS (SELECT target, chunks, policy, CASE policy WHEN 'rule' THEN rule WHEN 'learned' THEN learned ELSE rule AND learned END AS said, rule_calls FROM f, (VALUES ('rule'), ('learned'), ('hybrid')) v(policy)),
w AS (SELECT policy, {catalogue._COUNTS('said')}, sum(CASE WHEN policy = 'rule' THEN rule_calls ELSE said::BIGINT END)::BIGINT AS calls, sum(chunks)::BIGINT AS ungated FROM x GROUP BY policy),
y AS (SELECT *, tp / (tp + fp)::DOUBLE AS p, tp / (tp + fn)::DOUBLE AS q FROM w)
SELECT policy, tp, fp, tn, fn, calls, ungated, round(fp / (fp + tn)::DOUBLE, 6) AS far, round(fn / (tp + fn)::DOUBLE, 6) AS frr, round(2 * p * q / (p + q), 6) AS f1, round(100 * (ungated - calls) / ungated::DOUBLE, 6) AS avoided_pct FROM y""")
def policy_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies by the calls that they make: the rule calls once a chunk it admits, the others once a file; all would be once a chunk."""
    rows = gate.gate(views.metrics(spark, sf_dir)).withColumn("pr", logistic(ensemble.score_sql(catalogue._ENS, catalogue._features())))
    ok = F.col("decision") != "FAIL"
    per = rows.groupBy("path").agg(F.bool_or(ok).alias("rule"), F.count_if(ok).alias("rule_calls"), F.count("*").alias("chunks"), (F.max("pr") >= 0.6).alias("learned"))
    f = per.join(views.files(spark, sf_dir).filter("should_transcribe <> ''"), "path")
    x = f.withColumn("policy", F.explode(F.array(*map(F.lit, ("rule", "learned", "hybrid")))))
    x = x.withColumn("said", gate.admission(F.col("policy"), F.col("rule"), F.col("learned"))["admitted"])
    calls = F.sum(F.when(F.col("policy") == "rule", F.col("rule_calls")).otherwise(F.col("said").cast("long")))
    w = x.groupBy("policy").agg(*metrics.counts(F.col("should_transcribe") == "yes", F.col("said")), calls.alias("calls"), F.sum("chunks").alias("ungated"))
    return rounded(metrics.policy_report(w))


@query(f"""WITH s AS ({SIG}) SELECT vec_id, vec_id % 3 = 0 AS ran, CASE WHEN vec_id % 3 = 0 THEN len(x)::INTEGER END AS result FROM s""")
def admitted_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admitted signals reach the function (here: the number of samples) once, others never."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return gate.admit_once(e, F.col("vec_id") % 3 == 0, F.col("x"), F.size).drop("x")

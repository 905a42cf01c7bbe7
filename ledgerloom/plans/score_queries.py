"""Queries on relations, matching, agreement, metrics, jobs and access."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ledgerloom.functions import scores
from ledgerloom.operators import relations
from ledgerloom.session import dealt
from ledgerloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def items(spark, sf):
    return table(spark, sf, "lineitem")


# A rule that predicts low quality, held against the labels.
PRED = """p AS (SELECT d.doc_id, d.lang, l.quality = 0 AS gold, (contains(d.text, '!!') OR contains(d.text, '$$$') OR contains(d.text, ' | ')) AS predicted FROM documents d JOIN labels l USING (doc_id))"""


def predictions(spark, sf):
    has = lambda x: F.contains("text", F.lit(x))
    docs = table(spark, sf, "documents").select("doc_id", "lang", (has("!!") | has("$$$") | has(" | ")).alias("predicted"))
    return docs.join(table(spark, sf, "labels").select("doc_id", (F.col("quality") == 0).alias("gold")), "doc_id")


def confusion(rows, *by):
    g, p = F.col("gold"), F.col("predicted")
    return rows.groupBy(*by).agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))


@query("prf_by_lang", f"""WITH {PRED}, c AS (SELECT lang, count(*) FILTER (gold AND predicted) AS tp, count(*) FILTER (NOT gold AND predicted) AS fp, count(*) FILTER (gold AND NOT predicted) AS fn FROM p GROUP BY lang),
q AS (SELECT *, tp / nullif(tp + fp, 0)::DOUBLE AS pr, tp / nullif(tp + fn, 0)::DOUBLE AS rc FROM c)
SELECT lang, tp, fp, fn, round(pr, 6) AS precision, round(rc, 6) AS recall, round(2 * pr * rc / nullif(pr + rc, 0), 6) AS f1 FROM q""")
def prf_by_lang(spark, sf):
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return confusion(predictions(spark, sf), "lang").select("lang", tp, fp, fn, scores.precision(tp, fp).alias("precision"), scores.recall(tp, fn).alias("recall"), scores.f1(tp, fp, fn).alias("f1"))


@query("agreement_outcomes", f"""WITH {PRED}, a AS (SELECT doc_id, quality = 0 AS gold FROM labels), b AS (SELECT doc_id, (contains(text, '!!') OR contains(text, '$$$') OR contains(text, ' | ')) AS predicted FROM documents)
SELECT CASE WHEN a.doc_id IS NULL THEN 'only_second' WHEN b.doc_id IS NULL THEN 'only_first' WHEN gold AND predicted THEN 'both_yes' WHEN gold THEN 'first_yes' WHEN predicted THEN 'second_yes' ELSE 'both_no' END AS outcome, count(*) AS n
FROM a FULL JOIN b ON a.doc_id = b.doc_id GROUP BY 1""")
def agreement_outcomes(spark, sf):
    """The labels of all labelled documents against the rule's predictions for all documents."""
    has = lambda x: F.contains("text", F.lit(x))
    a = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 0).alias("gold"), F.lit(True).alias("first"))
    b = table(spark, sf, "documents").select("doc_id", (has("!!") | has("$$$") | has(" | ")).alias("predicted"), F.lit(True).alias("second"))
    outcome = scores.first_that((F.col("first").isNull(), "only_second"), (F.col("second").isNull(), "only_first"), (F.col("gold") & F.col("predicted"), "both_yes"), (F.col("gold"), "first_yes"), (F.col("predicted"), "second_yes"), otherwise="both_no")
    return a.join(b, "doc_id", "full").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("calibration_buckets", f"""WITH {PRED}, x AS (SELECT doc_id % 10 AS bucket, gold, predicted FROM p)
SELECT bucket, count(*) AS n, round(avg(CASE WHEN gold = predicted THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM x GROUP BY bucket""")
def calibration_buckets(spark, sf):
    rows = predictions(spark, sf).groupBy((F.col("doc_id") % 10).alias("bucket"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg((F.col("gold") == F.col("predicted")).cast("double")), 6).alias("accuracy"))


@query("metric_variance", """WITH s AS (SELECT source, avg(CAST(quality AS DOUBLE)) AS q, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT count(*) AS sources, round(avg(q), 6) AS mean, round(var_pop(q), 6) AS variance, round(min(q), 6) AS worst FROM s""")
def metric_variance(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id").groupBy("source").agg(F.avg(F.col("quality").cast("double")).alias("q"))
    return rows.agg(F.count("*").alias("sources"), F.round(F.avg("q"), 6).alias("mean"), F.round(F.var_pop("q"), 6).alias("variance"), F.round(F.min("q"), 6).alias("worst"))


@query("latency_percentiles", """SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 3) AS p50, round(quantile_cont(value, 0.95), 3) AS p95, round(max(value), 3) AS worst FROM events GROUP BY event_type""")
def latency_percentiles(spark, sf):
    p = lambda q: F.round(F.percentile("value", q), 3)
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.round(F.max("value"), 3).alias("worst"))


@query("perf_dispersion", """WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY event_type)
SELECT event_type, round(any_value(med), 4) AS median, round(median(abs(value - med)), 4) AS mad, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) AS iqr FROM events JOIN m USING (event_type) GROUP BY event_type""")
def perf_dispersion(spark, sf):
    rows = table(spark, sf, "events").select("event_type", "value")
    med = rows.groupBy("event_type").agg(F.median("value").alias("med"))
    off = rows.join(med, "event_type")
    return off.groupBy("event_type").agg(
        F.round(F.first("med"), 4).alias("median"), F.round(F.median(F.abs(F.col("value") - F.col("med"))), 4).alias("mad"),
        F.round(F.percentile("value", 0.75) - F.percentile("value", 0.25), 4).alias("iqr"),
    )


@query("growth_verdict", """WITH d AS (SELECT event_type, CAST(date_part('day', ts) AS BIGINT) AS day, count(*) AS n FROM events GROUP BY ALL),
g AS (SELECT *, n - lag(n) OVER (PARTITION BY event_type ORDER BY day) AS step FROM d)
SELECT event_type, count(*) AS points, round((arg_max(n, day) - arg_min(n, day)) / (max(day) - min(day))::DOUBLE, 6) AS slope, coalesce(bool_and(step >= 0), false) AS monotone FROM g GROUP BY event_type""")
def growth_verdict(spark, sf):
    d = table(spark, sf, "events").groupBy("event_type", F.dayofmonth("ts").cast("long").alias("day")).agg(F.count("*").alias("n"))
    g = d.withColumn("step", F.col("n") - F.lag("n").over(Window.partitionBy("event_type").orderBy("day")))
    slope = (F.max_by("n", "day") - F.min_by("n", "day")) / (F.max("day") - F.min("day"))
    return g.groupBy("event_type").agg(F.count("*").alias("points"), F.round(slope, 6).alias("slope"), F.coalesce(F.bool_and(F.col("step") >= 0), F.lit(False)).alias("monotone"))


@query("co_mention_pairs", """WITH m AS (SELECT l_orderkey AS context, l_suppkey AS entity, l_linenumber AS place FROM lineitem),
p AS (SELECT x.context, x.entity AS a, y.entity AS b, min(abs(x.place - y.place)) AS distance FROM m x JOIN m y ON x.context = y.context AND x.entity < y.entity AND abs(x.place - y.place) <= 2 GROUP BY ALL)
SELECT context, a, b, CAST(distance AS BIGINT) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY distance, a, b) AS rk FROM p) WHERE rk <= 3""")
def co_mention_pairs(spark, sf):
    m = items(spark, sf).select(F.col("l_orderkey").alias("context"), F.col("l_suppkey").alias("entity"), F.col("l_linenumber").alias("place"))
    return relations.co_mentions(m, 2, 3).select("context", "a", "b", F.col("distance").cast("long"))


@query("co_mention_support", """WITH m AS (SELECT DISTINCT l_orderkey AS context, l_suppkey AS entity FROM lineitem)
SELECT x.entity AS a, y.entity AS b, count(*) AS support FROM m x JOIN m y ON x.context = y.context AND x.entity < y.entity GROUP BY ALL HAVING count(*) >= 5""")
def co_mention_support(spark, sf):
    lines = items(spark, sf).select(F.col("l_orderkey").alias("context"), F.col("l_suppkey").alias("entity"))
    n = lines.count()
    m = dealt(lines, n, "context").distinct()
    pairs = m.withColumnRenamed("entity", "a").join(m.withColumnRenamed("entity", "b"), "context").filter("a < b").select("a", "b")
    return dealt(pairs, 3 * n, "a", "b").groupBy("a", "b").agg(F.count("*").alias("support")).filter("support >= 5")


VOTES = """v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 1 WHEN l_quantity < 10 THEN -1 ELSE 0 END AS d, CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS t,
  CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS c, CASE l_linestatus WHEN 'O' THEN 1 ELSE -1 END AS x FROM lineitem),
s AS (SELECT *, round(coalesce((0.6 * d + 1.0 * t + 0.7 * c + 1.4 * x)::DOUBLE / nullif(0.6 * abs(d) + 1.0 * abs(t) + 0.7 * abs(c) + 1.4 * abs(x), 0)::DOUBLE, 0), 6) AS score, abs(d) + abs(t) + abs(c) + abs(x) AS decisive FROM v)"""


def votes():
    when = scores.first_that
    return {
        "distance": when((F.col("l_quantity") > 40, 1), (F.col("l_quantity") < 10, -1), otherwise=0), "types": when((F.col("l_discount") >= 0.05, 1), otherwise=0),
        "cue": when((F.col("l_returnflag") == "A", 1), (F.col("l_returnflag") == "R", -1), otherwise=0), "external": when((F.col("l_linestatus") == "O", 1), otherwise=-1),
    }


@query("ensemble_states", f"""WITH {VOTES} SELECT CASE WHEN decisive < 2 THEN 'INSUFFICIENT' WHEN abs(score) < 0.15 THEN 'UNDECIDED' WHEN score >= 0.75 THEN 'STRONG' WHEN score >= 0.45 THEN 'PARTIAL' WHEN score < 0 THEN 'AGAINST' ELSE 'WEAK' END AS state, count(*) AS n, round(avg(score), 4) AS mean FROM s GROUP BY 1""")
def ensemble_states(spark, sf):
    v = votes()
    score, decisive = relations.ensemble(v), sum(F.abs(x) for x in v.values())
    rows = items(spark, sf).select(score.alias("score"), relations.ensemble_state(score, decisive).alias("state"))
    return rows.groupBy("state").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"))


@query("claim_decisions", """WITH f AS (SELECT *, l_quantity <= 0 OR l_extendedprice IS NULL AS bad, l_discount = 0 AS nodisc, l_returnflag = 'R' AS ret, l_tax > 0.06 AS tax FROM lineitem)
SELECT CASE WHEN bad THEN 'REJECT_INVALID' WHEN nodisc AND ret THEN 'ABSTAIN' WHEN ret OR tax THEN 'REVIEW' ELSE 'ACCEPT' END AS decision,
  array_to_string(list_sort(list_filter([CASE WHEN bad THEN 'invalid_amount' END, CASE WHEN nodisc AND ret THEN 'no_evidence' END, CASE WHEN ret THEN 'returned' END, CASE WHEN tax THEN 'high_tax' END, CASE WHEN l_linestatus = 'O' THEN 'still_open' END], lambda x: x IS NOT NULL)), ',') AS codes, count(*) AS n FROM f GROUP BY ALL""")
def claim_decisions(spark, sf):
    ret = F.col("l_returnflag") == "R"
    outcome, found = relations.decision({
        "invalid_amount": ("invalid", (F.col("l_quantity") <= 0) | F.col("l_extendedprice").isNull()), "no_evidence": ("abstain", (F.col("l_discount") == 0) & ret),
        "returned": ("review", ret), "high_tax": ("review", F.col("l_tax") > 0.06), "still_open": ("info", F.col("l_linestatus") == "O"),
    })
    return items(spark, sf).groupBy(outcome.alias("decision"), F.array_join(found, ",").alias("codes")).agg(F.count("*").alias("n"))


@query("greedy_matches", """WITH g AS (SELECT l_orderkey AS key, l_linenumber AS gold_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nth FROM lineitem WHERE l_returnflag <> 'R'),
p AS (SELECT l_orderkey AS key, l_linenumber AS predicted_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nth FROM lineitem WHERE l_linestatus = 'F' OR l_returnflag = 'R')
SELECT count(*) FILTER (gold_id IS NOT NULL AND predicted_id IS NOT NULL) AS tp, count(*) FILTER (gold_id IS NULL) AS fp, count(*) FILTER (predicted_id IS NULL) AS fn FROM g FULL JOIN p ON g.key = p.key AND g.nth = p.nth""")
def greedy_matches(spark, sf):
    rows = items(spark, sf)
    side = lambda where, name: rows.filter(where).select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias(name))
    m = relations.greedy_by_key(side("l_returnflag <> 'R'", "gold_id"), side("l_linestatus = 'F' OR l_returnflag = 'R'", "predicted_id"), "key")
    g, p = F.col("gold_id").isNotNull(), F.col("predicted_id").isNotNull()
    return m.agg(F.count_if(g & p).alias("tp"), F.count_if(~g).alias("fp"), F.count_if(~p).alias("fn"))


@query("fact_keys", """SELECT CASE WHEN l_returnflag = 'N' THEN least('s' || l_suppkey, 'p' || l_partkey) ELSE 's' || l_suppkey END || '|' || CASE WHEN l_returnflag = 'N' THEN greatest('s' || l_suppkey, 'p' || l_partkey) ELSE 'p' || l_partkey END || '|' || l_returnflag AS key, count(*) AS n
FROM lineitem GROUP BY 1 HAVING count(*) > 1""")
def fact_keys(spark, sf):
    s, p = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    key = relations.fact_key(s, p, F.col("l_returnflag"), F.col("l_returnflag") == "N")
    return items(spark, sf).groupBy(key.alias("key")).agg(F.count("*").alias("n")).filter("n > 1")


@query("duplicate_rate", """WITH c AS (SELECT l_partkey AS gold, count(DISTINCT l_suppkey) AS k FROM lineitem GROUP BY 1), o AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS k FROM lineitem GROUP BY 1)
SELECT round(sum(greatest(0, k - 1)) / count(*)::DOUBLE, 6) AS duplicate_rate, (SELECT round(avg(CASE WHEN k > 1 THEN 1.0::DOUBLE ELSE 0 END), 6) FROM o) AS over_merge_rate FROM c""")
def duplicate_rate(spark, sf):
    rows = items(spark, sf)
    a = rows.groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("k")).agg(F.round(F.sum(F.greatest(F.lit(0), F.col("k") - 1)) / F.count("*"), 6).alias("duplicate_rate"))
    b = rows.groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("k")).agg(F.round(F.avg((F.col("k") > 1).cast("double")), 6).alias("over_merge_rate"))
    return a.join(b)


@query("predicate_winner", """WITH c AS (SELECT o_custkey, o_orderpriority, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT *, round(s / sum(s) OVER (PARTITION BY o_custkey), 6) AS share FROM c),
r AS (SELECT *, row_number() OVER w AS rk, lead(share) OVER w AS next FROM t WINDOW w AS (PARTITION BY o_custkey ORDER BY share DESC, o_orderpriority))
SELECT o_custkey, o_orderpriority AS winner, share, CASE WHEN next IS NOT NULL AND round(share - next, 6) < 0.15 THEN 'AMBIGUOUS' ELSE 'CLEAR' END AS verdict FROM r WHERE rk = 1""")
def predicate_winner(spark, sf):
    c = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.sum("o_totalprice").alias("s"))
    t = c.withColumn("share", F.round(F.col("s") / F.sum("s").over(Window.partitionBy("o_custkey")), 6))
    w = Window.partitionBy("o_custkey").orderBy(F.desc("share"), "o_orderpriority")
    r = t.withColumn("rk", F.row_number().over(w)).withColumn("next", F.lead("share").over(w)).filter("rk = 1")
    ambiguous = F.col("next").isNotNull() & (F.round(F.col("share") - F.col("next"), 6) < 0.15)
    return r.select("o_custkey", F.col("o_orderpriority").alias("winner"), "share", F.when(ambiguous, "AMBIGUOUS").otherwise("CLEAR").alias("verdict"))


@query("interval_overlap_join", """WITH a AS (SELECT event_id, user_id, ts AS s, ts + INTERVAL 30 MINUTE AS e FROM events WHERE event_type = 'click'), b AS (SELECT event_id, user_id, ts AS s, ts + INTERVAL 30 MINUTE AS e FROM events WHERE event_type = 'error')
SELECT a.event_id AS click_id, b.event_id AS error_id FROM a JOIN b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e""")
def interval_overlap_join(spark, sf):
    """Intervals are cut into cells of the longest interval, so the join is on equal cells rather than on a range."""
    from ledgerloom.operators.intervals import overlaps

    e = table(spark, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("start"), "event_type").withColumn("end", F.col("start") + 30 * 60 * 1_000_000)
    a, b = (e.filter(F.col("event_type") == k) for k in ("click", "error"))
    return overlaps(a, b, "user_id", 30 * 60 * 1_000_000).select(F.col("a.event_id").alias("click_id"), F.col("b.event_id").alias("error_id"))


@query("last_before_join", """SELECT e.event_id AS error_id, max(c.event_id) AS click_id FROM events e LEFT JOIN events c ON c.user_id = e.user_id AND c.event_type = 'click' AND (c.ts < e.ts OR (c.ts = e.ts AND c.event_id < e.event_id))
WHERE e.event_type = 'error' AND (c.ts IS NULL OR c.ts = (SELECT max(x.ts) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'click' AND (x.ts < e.ts OR (x.ts = e.ts AND x.event_id < e.event_id)))) GROUP BY e.event_id""")
def last_before_join(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    click = F.when(F.col("event_type") == "click", F.col("event_id"))
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", F.last(click, ignorenulls=True).over(w).alias("click_id"))
    return rows.filter("event_type = 'error'").select(F.col("event_id").alias("error_id"), "click_id")


@query("job_counts", """SELECT o_orderstatus AS status, o_orderpriority AS kind, count(*) AS n, CAST(epoch_us(min(o_orderdate)) AS BIGINT) AS oldest FROM orders GROUP BY ALL""")
def job_counts(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n"), F.unix_micros(F.min("o_orderdate").cast("timestamp")).alias("oldest"))


@query("job_claim", """SELECT kind, o_orderkey FROM (SELECT o_orderpriority AS kind, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderdate, o_orderkey) AS rk FROM orders WHERE o_orderstatus = 'O') WHERE rk <= 5""")
def job_claim(spark, sf):
    w = Window.partitionBy("kind").orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey")
    rows = table(spark, sf, "orders").filter("o_orderstatus = 'O'").withColumn("kind", F.col("o_orderpriority"))
    return rows.withColumn("rk", F.row_number().over(w)).filter("rk <= 5").select("kind", "o_orderkey")


@query("stale_jobs", """SELECT CASE WHEN l_linenumber >= 5 THEN 'failed' ELSE 'pending' END AS next_status, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' AND l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1""")
def stale_jobs(spark, sf):
    rows = items(spark, sf).filter((F.col("l_linestatus") == "O") & (F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")))
    return rows.groupBy(F.when(F.col("l_linenumber") >= 5, "failed").otherwise("pending").alias("next_status")).agg(F.count("*").alias("n"))


@query("import_dry_run", """WITH r AS (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber) AS nth FROM lineitem)
SELECT CASE WHEN l_partkey % 17 = 0 THEN 'INVALID' WHEN l_partkey % 13 = 0 THEN 'CONFLICT' WHEN nth > 1 THEN 'DUPLICATE' WHEN l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') THEN 'WOULD_UPDATE' ELSE 'WOULD_CREATE' END AS outcome, count(*) AS n FROM r GROUP BY 1""")
def import_dry_run(spark, sf):
    nth = F.row_number().over(Window.partitionBy("l_orderkey", "l_partkey").orderBy("l_linenumber"))
    known = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("known")).distinct()
    rows = items(spark, sf).select("l_orderkey", "l_partkey", nth.alias("nth")).join(known, "l_orderkey", "left")
    outcome = scores.first_that((F.col("l_partkey") % 17 == 0, "INVALID"), (F.col("l_partkey") % 13 == 0, "CONFLICT"), (F.col("nth") > 1, "DUPLICATE"), (F.col("known"), "WOULD_UPDATE"), otherwise="WOULD_CREATE")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("budget_check", """WITH m AS (SELECT event_type AS scenario, round(quantile_cont(value, 0.95), 4) AS measured FROM events GROUP BY 1), b(scenario, most) AS (VALUES ('click', 30.0), ('error', 1000.0), ('view', 10.0), ('missing', 1.0))
SELECT scenario, CASE WHEN measured IS NULL THEN 'missing_measure' WHEN most IS NULL THEN 'missing_budget' WHEN measured > most THEN 'over_budget' ELSE 'ok' END AS verdict FROM m FULL JOIN b USING (scenario)""")
def budget_check(spark, sf):
    m = table(spark, sf, "events").groupBy(F.col("event_type").alias("scenario")).agg(F.round(F.percentile("value", 0.95), 4).alias("measured"))
    b = spark.createDataFrame([("click", 30.0), ("error", 1000.0), ("view", 10.0), ("missing", 1.0)], "scenario string, most double")
    verdict = scores.first_that((F.col("measured").isNull(), "missing_measure"), (F.col("most").isNull(), "missing_budget"), (F.col("measured") > F.col("most"), "over_budget"), otherwise="ok")
    return m.join(b, "scenario", "full").select("scenario", verdict.alias("verdict"))


@query("pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS mean_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf):
    rows = items(spark, sf).filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.count("*").alias("n")
    )


@query("latest_wins_upsert", """SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, CAST(epoch_us(min(ts)) AS BIGINT) AS created_at FROM events GROUP BY user_id, event_type""")
def latest_wins_upsert(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.unix_micros(F.min("ts").cast("timestamp")).alias("created_at"))

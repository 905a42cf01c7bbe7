"""Queries on the graph, the ledger and visibility."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ledgerloom.functions import scores, text as T
from ledgerloom.operators import graph, ledger, policy, resolve
from ledgerloom.plans.text_queries import fold, toks
from ledgerloom.session import shared_dir
from ledgerloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


NODES = """nodes AS (
  SELECT prefix || ':' || k AS node_id, prefix AS kind, name, 'w' || (w % 5) AS workspace, CASE WHEN k % 11 <> 0 THEN round(k * 37 % 100 / 100.0::DOUBLE, 6) END AS confidence,
    CASE k % 6 WHEN 0 THEN 'public' WHEN 1 THEN 'player' WHEN 2 THEN 'reference' WHEN 3 THEN 'narrator' WHEN 4 THEN 'secret' END AS visibility, k
  FROM (SELECT 'customer' AS prefix, c_custkey::BIGINT AS k, c_name AS name, c_nationkey AS w FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, s_nationkey FROM supplier
    UNION ALL SELECT 'nation', n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 'region', r_regionkey, r_name, r_regionkey FROM region))"""
EDGES = """edges AS (
  SELECT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst, 'LOCATED_IN' AS rel FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'BASED_IN' FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'PART_OF' FROM nation)"""
LEDGER = """ledger AS (
  SELECT event_id AS seq, user_id || ':' || event_type AS assertion_id, user_id AS subject, event_type AS predicate, ts AS recorded_at,
    CASE WHEN value < 5 THEN 'PLANNED' WHEN value < 40 THEN 'ACTIVE' WHEN value < 60 THEN 'CONTRADICTED' WHEN value < 80 THEN 'ENDED' WHEN value < 90 THEN 'SUPERSEDED' ELSE 'RETRACTED' END AS status,
    round(least(1.0::DOUBLE, value / 100), 6) AS confidence FROM events)"""
LAST = "last AS (SELECT * EXCLUDE rk FROM (SELECT *, row_number() OVER (PARTITION BY assertion_id ORDER BY recorded_at DESC, seq DESC) AS rk FROM ledger) WHERE rk = 1)"


def entries(spark, sf):
    return ledger.entries(table(spark, sf, "events"))


def instant(day: int):
    return F.lit(f"2024-01-{day:02d} 00:00:00").cast("timestamp_ntz")


# ---- graph

@query("graph_entity_types", f"WITH {NODES} SELECT kind, workspace, count(*) AS n FROM nodes GROUP BY ALL")
def graph_entity_types(spark, sf):
    return graph.nodes(spark, sf).groupBy("kind", "workspace").agg(F.count("*").alias("n"))


@query("graph_workspaces", f"WITH {NODES} SELECT DISTINCT workspace FROM nodes WHERE workspace IS NOT NULL")
def graph_workspaces(spark, sf):
    return graph.nodes(spark, sf).select("workspace").filter("workspace IS NOT NULL").distinct()


@query("graph_quality_counts", f"""WITH {NODES} SELECT count(*) AS total, count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence >= 0.5 AND confidence < 0.8) AS medium,
  count(*) FILTER (confidence < 0.5) AS low, count(*) FILTER (confidence IS NULL) AS unknown, count(*) FILTER (visibility IS NULL) AS no_visibility FROM nodes""")
def graph_quality_counts(spark, sf):
    return graph.quality_counts(graph.nodes(spark, sf))


@query("graph_source_facets", f"""WITH {NODES} SELECT workspace, kind, coalesce(visibility, '(none)') AS visibility, CAST(grouping_id(workspace, kind, visibility) AS BIGINT) AS level, count(*) AS n
  FROM (SELECT workspace, kind, coalesce(visibility, '(none)') AS visibility FROM nodes) GROUP BY GROUPING SETS ((workspace), (workspace, kind), (workspace, visibility))""")
def graph_source_facets(spark, sf):
    rows = graph.nodes(spark, sf).withColumn("visibility", F.coalesce("visibility", F.lit("(none)")))
    sets = [[F.col("workspace")], [F.col("workspace"), F.col("kind")], [F.col("workspace"), F.col("visibility")]]
    out = rows.groupingSets(sets, "workspace", "kind", "visibility").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))
    # A facet that is rolled up is null; DuckDB's text keeps the null too.
    return out.select("workspace", "kind", F.when(F.col("level").bitwiseAND(F.lit(1)) == 0, F.col("visibility")).otherwise(F.lit("(none)")).alias("visibility"), F.col("level").cast("long"), "n")


SQL["graph_source_facets"] = SQL["graph_source_facets"].replace("SELECT workspace, kind, coalesce(visibility, '(none)') AS visibility, CAST(grouping", "SELECT workspace, kind, coalesce(v, '(none)') AS visibility, CAST(grouping").replace("grouping_id(workspace, kind, visibility)", "grouping_id(workspace, kind, v)").replace("coalesce(visibility, '(none)') AS visibility FROM nodes", "coalesce(visibility, '(none)') AS v FROM nodes").replace("(workspace, visibility))", "(workspace, v))")


@query("graph_search", f"WITH {NODES} SELECT node_id, name, kind FROM nodes WHERE contains(lower(name), '00001') AND workspace = 'w2'")
def graph_search(spark, sf):
    return graph.search(graph.nodes(spark, sf), "00001", "w2").select("node_id", "name", "kind")


@query("graph_listing", f"WITH {NODES} SELECT node_id, confidence FROM nodes WHERE kind = 'supplier' AND confidence >= 0.4 AND visibility IN ('public', 'player')")
def graph_listing(spark, sf):
    return graph.nodes(spark, sf).filter("kind = 'supplier' AND confidence >= 0.4 AND visibility IN ('public', 'player')").select("node_id", "confidence")


@query("graph_page", f"""WITH {NODES}, c AS (SELECT * FROM nodes WHERE kind = 'customer') SELECT node_id, name, CAST(place AS BIGINT) AS place, (SELECT count(*) FROM c) AS total
  FROM (SELECT *, row_number() OVER (ORDER BY name, node_id) AS place FROM c) WHERE place BETWEEN 51 AND 75""")
def graph_page(spark, sf):
    rows = graph.nodes(spark, sf).filter("kind = 'customer'").select("node_id", "name")
    return graph.page(rows, ["name", "node_id"], 3, 25)


@query("graph_truncated_view", f"""WITH {NODES}, {EDGES}, kept AS (SELECT node_id FROM nodes ORDER BY node_id LIMIT 300)
  SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM kept) AS shown_nodes, (SELECT count(*) FROM edges) AS n_edges,
    (SELECT count(*) FROM edges WHERE src IN (SELECT node_id FROM kept) AND dst IN (SELECT node_id FROM kept)) AS shown_edges""")
def graph_truncated_view(spark, sf):
    rows, links = graph.nodes(spark, sf), graph.edges(spark, sf)
    kept = rows.orderBy("node_id").limit(300)
    one = lambda frame, name: frame.agg(F.count("*").alias(name))
    return one(rows, "n_nodes").join(one(kept, "shown_nodes")).join(one(links, "n_edges")).join(one(graph.within(links, kept), "shown_edges"))


@query("graph_incident_edges", f"""WITH {EDGES} SELECT src AS node_id, dst AS other, rel, 'out' AS side FROM edges WHERE src IN ('nation:3', 'region:1')
  UNION ALL SELECT dst, src, rel, 'in' FROM edges WHERE dst IN ('nation:3', 'region:1')""")
def graph_incident_edges(spark, sf):
    wanted = spark.createDataFrame([("nation:3",), ("region:1",)], "node_id string")
    return graph.incident(graph.edges(spark, sf), wanted)


@query("graph_degree", f"WITH {EDGES} SELECT node_id, count(*) AS degree, count(DISTINCT rel) AS n_rels FROM (SELECT src AS node_id, rel FROM edges UNION ALL SELECT dst, rel FROM edges) GROUP BY node_id")
def graph_degree(spark, sf):
    links = graph.edges(spark, sf)
    both = links.select(F.col("src").alias("node_id"), "rel").union(links.select("dst", "rel"))
    return both.groupBy("node_id").agg(F.count("*").alias("degree"), F.countDistinct("rel").alias("n_rels"))


@query("graph_workspace_edges", f"""WITH {NODES}, {EDGES} SELECT a.workspace, count(*) AS n_edges FROM edges JOIN nodes a ON src = a.node_id JOIN nodes b ON dst = b.node_id AND a.workspace = b.workspace GROUP BY 1""")
def graph_workspace_edges(spark, sf):
    n = graph.nodes(spark, sf).select("node_id", "workspace")
    rows = graph.edges(spark, sf).join(n.toDF("src", "workspace"), "src").join(n.toDF("dst", "workspace"), ["dst", "workspace"])
    return rows.groupBy("workspace").agg(F.count("*").alias("n_edges"))


@query("graph_two_hops", f"""WITH {EDGES} SELECT b.dst AS region, a.rel, count(*) AS n FROM edges a JOIN edges b ON a.dst = b.src GROUP BY ALL""")
def graph_two_hops(spark, sf):
    e = graph.edges(spark, sf)
    return e.select("dst", "rel").join(e.select(F.col("src").alias("dst"), F.col("dst").alias("region")), "dst").groupBy("region", "rel").agg(F.count("*").alias("n"))


@query("graph_ambiguous_names", "SELECT p_name AS name, count(*) AS n, min(p_partkey) AS first_part FROM part GROUP BY p_name HAVING count(*) > 1")
def graph_ambiguous_names(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part")).filter("n > 1")


@query("graph_duplicate_names", f"""SELECT p_brand AS workspace, {fold('p_name')} AS folded, count(*) AS n, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY CAST(p_partkey AS VARCHAR)) AS nodes FROM part GROUP BY 1, 2 HAVING count(*) > 1""")
def graph_duplicate_names(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("workspace"), F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("node_id"))
    return graph.duplicate_names(rows)


@query("graph_origin_conflicts", "SELECT p_name AS name, count(DISTINCT p_brand) AS n_origins, array_to_string(list_sort(list_distinct(list(p_brand))), ',') AS origins FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
def graph_origin_conflicts(spark, sf):
    rows = table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.array_sort(F.collect_set("p_brand")).alias("o"))
    return rows.filter(F.size("o") > 1).select("name", F.size("o").cast("long").alias("n_origins"), F.array_join("o", ",").alias("origins"))


@query("graph_orphan_edges", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey) OR NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)")
def graph_orphan_edges(spark, sf):
    return orphans(table(spark, sf, "lineitem"), table(spark, sf, "orders"), table(spark, sf, "part"))


def orphans(lines, orders, parts):
    o = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("has_order")).distinct()
    p = parts.select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("has_part")).distinct()
    both = lines.select("l_orderkey", "l_linenumber", "l_partkey").join(o, "l_orderkey", "left").join(p, "l_partkey", "left")
    return both.filter("has_order IS NULL OR has_part IS NULL").select("l_orderkey", "l_linenumber", "l_partkey")


@query("graph_orphans_after_deletion", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') OR l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 45)")
def graph_orphans_after_deletion(spark, sf):
    """Lines left without an order or a part once filled orders and large parts are gone."""
    return orphans(table(spark, sf, "lineitem"), table(spark, sf, "orders").filter("o_orderstatus <> 'F'"), table(spark, sf, "part").filter("p_size <= 45"))


@query("graph_components")
def graph_components(spark, sf):
    """Parts that suppliers have in common are one component."""
    links = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1_000_000_000).alias("b")).distinct()
    return graph.components(links, shared_dir(spark))


@query("visibility_decisions", f"""WITH {NODES}, r AS (SELECT *, CASE WHEN k % 4 = 0 THEN k % 20 END AS revealed_in FROM nodes)
  SELECT reason, count(*) AS n FROM (SELECT CASE WHEN visibility IS NULL THEN 'visibility_invalid' WHEN workspace NOT IN ('w1', 'w2', 'w3') THEN 'workspace_not_allowed' WHEN revealed_in > 9 THEN 'not_revealed'
    WHEN node_id IN ('customer:4', 'supplier:10') THEN 'known' WHEN visibility IN ('secret', 'narrator') THEN 'secret_not_allowed' ELSE 'level_allowed' END AS reason FROM r) GROUP BY reason""")
def visibility_decisions(spark, sf):
    k = F.split("node_id", ":")[1].cast("long")
    rows = graph.nodes(spark, sf).withColumn("revealed_in", F.when(k % 4 == 0, k % 20))
    viewer = policy.Viewer(("w1", "w2", "w3"), sees_reference=True, max_session=9, knows=("customer:4", "supplier:10"))
    return policy.judged(rows, viewer).groupBy("reason").agg(F.count("*").alias("n"))


@query("visible_edges", f"""WITH {NODES}, {EDGES}, v AS (SELECT node_id FROM nodes WHERE visibility IN ('public', 'player') AND workspace IN ('w0', 'w1', 'w2', 'w3', 'w4'))
  SELECT rel, count(*) AS n FROM edges WHERE src IN (SELECT node_id FROM v) AND dst IN (SELECT node_id FROM v) GROUP BY rel""")
def visible_edges(spark, sf):
    rows = graph.nodes(spark, sf).withColumn("revealed_in", F.lit(None).cast("long"))
    shown = policy.judged(rows, policy.Viewer(("w0", "w1", "w2", "w3", "w4"))).filter("visible")
    return graph.within(graph.edges(spark, sf), shown).groupBy("rel").agg(F.count("*").alias("n"))


@query("visibility_migration", f"""WITH {NODES}, {EDGES}, l(level, rank) AS (VALUES ('public', 0), ('player', 1), ('reference', 2), ('narrator', 3), ('secret', 4)),
  r AS (SELECT node_id, coalesce(rank, 4) AS rank FROM nodes LEFT JOIN l ON level = visibility)
  SELECT l.level AS visibility, rel, count(*) AS n FROM edges JOIN r a ON src = a.node_id JOIN r b ON dst = b.node_id JOIN l ON l.rank = greatest(a.rank, b.rank) GROUP BY ALL""")
def visibility_migration(spark, sf):
    v = graph.nodes(spark, sf).select("node_id", "visibility")
    rows = graph.edges(spark, sf).join(v.toDF("src", "va"), "src").join(v.toDF("dst", "vb"), "dst")
    return rows.groupBy(policy.most_restrictive(F.col("va"), F.col("vb")).alias("visibility"), "rel").agg(F.count("*").alias("n"))


# ---- ledger

@query("ledger_latest", f"WITH {LEDGER}, {LAST} SELECT assertion_id, seq, status, confidence FROM last")
def ledger_latest(spark, sf):
    return ledger.latest(entries(spark, sf)).select("assertion_id", "seq", "status", "confidence")


@query("ledger_as_of", f"WITH {LEDGER.replace('FROM events', 'FROM events WHERE ts <= TIMESTAMP ' + repr('2024-01-10 00:00:00'))}, {LAST} SELECT assertion_id, seq, status FROM last")
def ledger_as_of(spark, sf):
    return ledger.as_of(entries(spark, sf), instant(10)).select("assertion_id", "seq", "status")


@query("ledger_live_by_predicate", f"WITH {LEDGER}, {LAST} SELECT predicate, status, count(*) AS n FROM last WHERE status NOT IN ('SUPERSEDED', 'RETRACTED') GROUP BY ALL")
def ledger_live_by_predicate(spark, sf):
    return ledger.live(ledger.latest(entries(spark, sf))).groupBy("predicate", "status").agg(F.count("*").alias("n"))


VERSIONS = "v AS (SELECT *, row_number() OVER w AS revision, recorded_at AS valid_from, lead(recorded_at) OVER w AS valid_to FROM ledger WINDOW w AS (PARTITION BY assertion_id ORDER BY recorded_at, seq))"


@query("ledger_versions", f"WITH {LEDGER}, {VERSIONS} SELECT assertion_id, CAST(revision AS BIGINT) AS revision, seq, CAST(epoch_us(valid_from) AS BIGINT) AS valid_from, CAST(epoch_us(valid_to) AS BIGINT) AS valid_to FROM v")
def ledger_versions(spark, sf):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    return ledger.versions(entries(spark, sf)).select("assertion_id", "revision", "seq", us("valid_from"), us("valid_to"))


@query("ledger_valid_at", f"WITH {LEDGER}, {VERSIONS} SELECT assertion_id, CAST(revision AS BIGINT) AS revision FROM v WHERE valid_from <= TIMESTAMP '2024-01-15 00:00:00' AND (valid_to IS NULL OR TIMESTAMP '2024-01-15 00:00:00' < valid_to)")
def ledger_valid_at(spark, sf):
    return ledger.valid(ledger.versions(entries(spark, sf)), instant(15)).select("assertion_id", "revision")


@query("ledger_transitions", f"""WITH {LEDGER}, s AS (SELECT status, lag(status) OVER (PARTITION BY assertion_id ORDER BY recorded_at, seq) AS before FROM ledger),
  t(a, b) AS (VALUES {', '.join(map(str, ledger.TRANSITIONS))})
  SELECT before || '>' || status AS move, before = status OR EXISTS (SELECT 1 FROM t WHERE a = before AND b = status) AS legal, count(*) AS n FROM s WHERE before IS NOT NULL GROUP BY ALL""")
def ledger_transitions(spark, sf):
    return ledger.transitions(entries(spark, sf)).groupBy("move", "legal").agg(F.count("*").alias("n"))


@query("ledger_chain_verify", "SELECT CAST(0 AS BIGINT) AS broken, count(*) AS entries FROM events")
def ledger_chain_verify(spark, sf):
    chain = ledger.chained(entries(spark, sf))
    return ledger.broken_links(chain).agg(F.count("*").alias("broken")).join(chain.agg(F.count("*").alias("entries")))


@query("ledger_digest", f"WITH {LEDGER}, {LAST} SELECT subject, count(*) AS version, sha256(string_agg(assertion_id || '=' || status, ',' ORDER BY assertion_id || '=' || status)) AS state_hash FROM last GROUP BY subject")
def ledger_digest(spark, sf):
    return ledger.digest(ledger.latest(entries(spark, sf)))


@query("ledger_contradictions", f"WITH {LEDGER}, {LAST}, l AS (SELECT * FROM last WHERE status NOT IN ('SUPERSEDED', 'RETRACTED')) SELECT x.subject, x.assertion_id AS a, y.assertion_id AS b FROM l x JOIN l y ON x.subject = y.subject AND x.assertion_id < y.assertion_id AND abs(x.confidence - y.confidence) > 0.5")
def ledger_contradictions(spark, sf):
    return ledger.contradictions(ledger.live(ledger.latest(entries(spark, sf))))


@query("ledger_gaps", f"""WITH {LEDGER}, g AS (SELECT subject, recorded_at - lag(recorded_at) OVER (PARTITION BY subject ORDER BY recorded_at, seq) AS d FROM ledger)
  SELECT subject, 1 + count(*) FILTER (d > INTERVAL 600 MINUTES) AS sessions, count(*) FILTER (d > INTERVAL 600 MINUTES) AS gaps FROM g GROUP BY subject""")
def ledger_gaps(spark, sf):
    return ledger.gaps(entries(spark, sf), 600)


@query("ledger_event_range", f"WITH {LEDGER} SELECT seq, assertion_id FROM ledger WHERE recorded_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 00:00:00'")
def ledger_event_range(spark, sf):
    return entries(spark, sf).filter(F.col("recorded_at").between(instant(5), instant(6))).select("seq", "assertion_id")


@query("ledger_identity_duplicates", f"WITH {LEDGER}, {LAST} SELECT subject, status, count(*) AS n FROM last WHERE status NOT IN ('SUPERSEDED', 'RETRACTED') GROUP BY subject, status HAVING count(*) > 1")
def ledger_identity_duplicates(spark, sf):
    return ledger.live(ledger.latest(entries(spark, sf))).groupBy("subject", "status").agg(F.count("*").alias("n")).filter("n > 1")


@query("ledger_daily_status", f"WITH {LEDGER} SELECT strftime(recorded_at, '%Y-%m-%d') AS day, status, count(*) AS n, round(avg(confidence), 6) AS mean FROM ledger GROUP BY ALL")
def ledger_daily_status(spark, sf):
    return entries(spark, sf).groupBy(F.date_format("recorded_at", "yyyy-MM-dd").alias("day"), "status").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"))


@query("ledger_event_keys", r"""SELECT event_type, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) // 10 AS decile, count(*) AS n FROM events GROUP BY ALL""")
def ledger_event_keys(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").groupBy("event_type", F.floor(k / 10).alias("decile")).agg(F.count("*").alias("n"))


# ---- resolution

ENTITIES = """e AS (SELECT p_partkey AS entity_id, p_name AS name, array_to_string(list_reverse(string_split(p_name, ' ')), ' ') AS alias FROM part),
m AS (SELECT p_partkey AS mention_id, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN array_to_string(list_reverse(string_split(p_name, ' ')), ' ') ELSE p_name || 's' END AS surface FROM part)"""
SIMILAR = """CASE WHEN a = b THEN 1.0 ELSE round(greatest(0.75 * (1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE)
  + 0.25 * len(list_intersect(ga, gb))::DOUBLE / len(list_distinct(list_concat(ga, gb))), len(list_intersect(ta, tb))::DOUBLE / len(list_distinct(list_concat(ta, tb)))), 6) END"""
GRAMS = "list_distinct(list_transform(range(1, length('  ' || {0} || '  ') - 1), lambda i: substring('  ' || {0} || '  ', i, 3)))"


@query("name_resolution", f"""WITH {ENTITIES}, p AS (
  SELECT mention_id, entity_id, a, b, string_split(a, ' ') AS ta, string_split(b, ' ') AS tb, {GRAMS.format('a')} AS ga, {GRAMS.format('b')} AS gb, {fold('alias')} AS al
  FROM (SELECT *, {fold('surface')} AS a, {fold('name')} AS b FROM m, e)),
s AS (SELECT mention_id, entity_id, greatest(CASE WHEN a = b THEN 1.0 ELSE 0 END, CASE WHEN a = al THEN 0.95 ELSE 0 END, CASE WHEN len(list_intersect(ta, tb)) > 0 AND {SIMILAR} >= 0.5 THEN round(0.88 * {SIMILAR}, 6) ELSE 0 END) AS score FROM p),
r AS (SELECT *, row_number() OVER w AS rk, lead(score) OVER w AS next FROM s WHERE score > 0 WINDOW w AS (PARTITION BY mention_id ORDER BY score DESC, entity_id))
SELECT mention_id, entity_id, CAST(score AS DOUBLE) AS score, CAST(round(score - coalesce(next, 0), 6) AS DOUBLE) AS margin,
  CASE WHEN next IS NOT NULL AND round(score - next, 6) < 0.1 THEN 'REVIEW' WHEN score >= 0.9 THEN 'LINK' WHEN score >= 0.6 THEN 'REVIEW' ELSE 'CREATE_NEW' END AS action FROM r WHERE rk = 1""")
def name_resolution(spark, sf):
    """Every part as a mention against every part as an entity."""
    part = table(spark, sf, "part")
    turned = F.array_join(F.reverse(F.split("p_name", " ")), " ")
    known = part.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.array(turned).alias("aliases"))
    k = F.col("p_partkey") % 3
    seen = part.select(F.col("p_partkey").alias("mention_id"), scores.first_that((k == 0, F.upper("p_name")), (k == 1, turned), otherwise=F.concat("p_name", F.lit("s"))).alias("surface"))
    return resolve.resolved(seen, known)


# The name that whole tables had before name_resolution read them too.
name_resolution_all = query("name_resolution_all", SQL["name_resolution"])(name_resolution)


@query("mention_group_type", """WITH s AS (SELECT p_name AS name, p_type AS kind, sum(round(p_size / 50.0::DOUBLE, 6)) AS total, min(round(p_size / 50.0::DOUBLE, 6)) AS weakest FROM part GROUP BY ALL)
SELECT name, arg_min(kind, (-round(total, 6), kind)) AS kind, round(max(total), 4) AS total, round(min(weakest), 6) AS confidence FROM s GROUP BY name""")
def mention_group_type(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.round(F.col("p_size") / 50, 6).alias("c"))
    return resolve.group_type(rows, "name", "kind", "c")


@query("name_similarity_pairs", f"""WITH n AS (SELECT DISTINCT p_name AS name FROM part), x AS (SELECT l.name AS one, r.name AS two, {fold('l.name')} AS a, {fold('r.name')} AS b FROM n l JOIN n r ON l.name < r.name),
p AS (SELECT *, string_split(a, ' ') AS ta, string_split(b, ' ') AS tb, {GRAMS.format('a')} AS ga, {GRAMS.format('b')} AS gb FROM x)
SELECT one, two, CAST({SIMILAR} AS DOUBLE) AS likeness FROM p WHERE {SIMILAR} >= 0.6 AND len(list_intersect(ta, tb)) > 0""")
def name_similarity_pairs(spark, sf):
    n = table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    keyed = n.select("name", F.explode(T.token_set(F.col("name"))).alias("token"))
    pairs = keyed.withColumnRenamed("name", "one").join(keyed.withColumnRenamed("name", "two"), "token").filter("one < two").select("one", "two").distinct()
    return pairs.withColumn("likeness", T.similarity(F.col("one"), F.col("two"))).filter("likeness >= 0.6")

"""Joins, aggregates, windows, limits and set operations over the fixture tables.

lineitem stands for typed edges (order = commit, part = bug, supplier = CVE, return flag = link type), orders for
commits, conversations for threads, events for runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultlens.bindings.registry import query
from faultlens.operators import joins, ranking, upsert
from faultlens.session import table as t


def commits(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "orders").select(
        F.col("o_orderkey").alias("hash"), F.col("o_custkey").alias("author"), F.col("o_orderpriority").alias("subsystem"),
        F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderstatus").alias("origin"),
    )


def edges(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("bug"), F.col("l_suppkey").alias("cve"), F.col("l_returnflag").alias("link_type")).distinct()


_C = "commits AS (SELECT o_orderkey AS hash, o_custkey AS author, o_orderpriority AS subsystem, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS origin FROM orders)"
_E = 'edges AS (SELECT DISTINCT l_orderkey AS "commit", l_partkey AS bug, l_suppkey AS cve, l_returnflag AS link_type FROM lineitem)'


# --- joins


@query("j01_edge_to_commit", f'WITH {_C}, {_E} SELECT e.bug, c.hash, c.subsystem, e.link_type FROM edges e JOIN commits c ON e."commit" = c.hash')
def _(s, d):
    return edges(s, d).join(commits(s, d), F.col("commit") == F.col("hash")).select("bug", "hash", "subsystem", "link_type")


@query("j02_hash_lookup", "WITH r AS (SELECT DISTINCT user_id AS ref FROM events) SELECT count(c.c_custkey) AS matched, count(*) - count(c.c_custkey) AS unmatched FROM r LEFT JOIN customer c ON c.c_custkey = r.ref * 11")
def _(s, d):
    refs = t(s, d, "events").select((F.col("user_id") * 11).alias("c_custkey")).distinct()
    matched, unmatched = joins.lookup(refs, t(s, d, "customer").select("c_custkey"), ["c_custkey"])
    a, b = matched.agg(F.count(F.lit(1)).alias("matched")), unmatched.agg(F.count(F.lit(1)).alias("unmatched"))
    return a.join(F.broadcast(b))


@query("j03_semi_join", "SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def _(s, d):
    return t(s, d, "conversations").join(t(s, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("conv_id")), "conv_id", "left_semi").select("conv_id", "turn", "role")


@query("j04_missing_upstream", "SELECT DISTINCT c_custkey AS missing FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'P')")
def _(s, d):
    return joins.missing_keys(t(s, d, "customer"), "c_custkey", t(s, d, "orders").where("o_orderstatus = 'P'"), "o_custkey")


@query("j05_dangling_edges", f"""WITH {_E} SELECT DISTINCT e.* FROM edges e WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = e."commit" AND o.o_orderstatus = 'O')
 OR NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = e.bug AND p.p_size > 10)""")
def _(s, d):
    open_ = t(s, d, "orders").where("o_orderstatus = 'O'")
    return joins.dangling_edges(edges(s, d), {"commit": (open_, "o_orderkey"), "bug": (t(s, d, "part").where("p_size > 10"), "p_partkey")})


@query("j06_any_reference_is_prefix", """SELECT DISTINCT o.o_orderkey FROM orders o WHERE list_bool_or([starts_with(CAST(o.o_orderkey AS VARCHAR), r) FOR r IN ['12', '7', '', '305'] IF r <> ''])""")
def _(s, d):
    refs = F.array(*[F.lit(r) for r in ("12", "7", "", "305")])
    return t(s, d, "orders").where(F.exists(refs, lambda r: (r != "") & F.col("o_orderkey").cast("string").startswith(r))).select("o_orderkey").distinct()


@query("j07_explode_and_equal", """WITH r AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
 SELECT DISTINCT r.user_id, c.c_custkey FROM r JOIN customer c ON c.c_custkey = r.k""")
def _(s, d):
    refs = t(s, d, "events").select("user_id", F.from_json("props", "k bigint")["k"].alias("k")).select("user_id", F.explode(F.array("k")).alias("c_custkey")).where("c_custkey is not null")
    return refs.join(t(s, d, "customer").select("c_custkey"), "c_custkey").select("user_id", "c_custkey").distinct()


@query("j08_glob_theta_join", """WITH g(pattern, rx) AS (VALUES ('Brand#1*', '^Brand#1.*$'), ('*3', '^.*3$'), ('Brand#55', '^Brand#55$'))
 SELECT p_partkey, pattern FROM part JOIN g ON regexp_matches(p_brand, rx)""")
def _(s, d):
    parts = t(s, d, "part").select("p_partkey", "p_brand")
    found = [parts.where(joins.glob_match(F.col("p_brand"), g)).select("p_partkey", F.lit(g).alias("pattern")) for g in ("Brand#1*", "*3", "Brand#55")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("j09_people_by_section", """SELECT n.n_name AS section, coalesce((SELECT string_agg(c.c_name, ', ' ORDER BY c.c_name) FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_mktsegment = 'BUILDING'), '(none)') AS people FROM nation n""")
def _(s, d):
    people = t(s, d, "customer").where("c_mktsegment = 'BUILDING'").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list("c_name")), ", ").alias("people"))
    n = t(s, d, "nation")
    return n.join(people, n["n_nationkey"] == people["c_nationkey"], "left").select(F.col("n_name").alias("section"), F.coalesce("people", F.lit("(none)")).alias("people"))


@query("j10_lineage_both_ways", f"""WITH {_E}, h AS (SELECT "commit" AS a, bug AS b FROM edges WHERE link_type = 'R')
 SELECT a AS node, b AS other, 'forward' AS direction FROM h UNION ALL SELECT b, a, 'backward' FROM h""")
def _(s, d):
    return joins.both_directions(edges(s, d).where("link_type = 'R'"), "commit", "bug")


@query("j11_edge_with_both_ends", f"""WITH {_E} SELECT e."commit" AS commit_id, o.o_orderpriority AS subsystem, p.p_name AS bug_title, s.s_name AS cve_name
 FROM edges e JOIN orders o ON o.o_orderkey = e."commit" JOIN part p ON p.p_partkey = e.bug JOIN supplier s ON s.s_suppkey = e.cve WHERE e.link_type = 'A'""")
def _(s, d):
    e = edges(s, d).where("link_type = 'A'")
    return (
        e.join(t(s, d, "orders"), F.col("commit") == F.col("o_orderkey")).join(t(s, d, "part"), F.col("bug") == F.col("p_partkey")).join(t(s, d, "supplier"), F.col("cve") == F.col("s_suppkey"))
        .select(F.col("commit").alias("commit_id"), F.col("o_orderpriority").alias("subsystem"), F.col("p_name").alias("bug_title"), F.col("s_name").alias("cve_name"))
    )


@query("j12_pair_import", """WITH p AS (SELECT DISTINCT l_orderkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'N')
 SELECT DISTINCT p.l_orderkey AS commit_id, q.p_partkey AS bug_id, 0.92 AS confidence FROM p JOIN part q ON q.p_name = p.p_name""")
def _(s, d):
    """Pairs are distinct as they come, but for bugs with several names: only those pairs are compared with each other."""
    pairs = t(s, d, "lineitem").where("l_returnflag = 'N'").join(t(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_name").distinct()
    named = t(s, d, "part").where("p_name is not null").select("p_name", "p_partkey").distinct()
    names = named.groupBy("p_partkey").agg(F.min("p_name").alias("p_name"), F.count(F.lit(1)).alias("n"))
    several = named.join(names.where("n > 1").select("p_partkey"), "p_partkey", "left_semi")
    of = lambda bugs: pairs.join(bugs, "p_name").select(F.col("l_orderkey").alias("commit_id"), F.col("p_partkey").alias("bug_id"), F.lit(0.92).alias("confidence"))
    return of(names.where("n = 1").drop("n")).unionByName(of(several).distinct())


@query("j14_series_siblings", """SELECT a.event_id, b.event_id AS sibling FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND CAST(a.ts AS DATE) = CAST(b.ts AS DATE) AND a.event_id < b.event_id""")
def _(s, d):
    e = t(s, d, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    b = e.withColumnRenamed("event_id", "sibling")
    return e.join(b, ["user_id", "event_type", "day"]).where("event_id < sibling").select("event_id", "sibling")


@query("j15_signature_in_four_tables", """WITH u AS (SELECT 'customer' AS origin, c_custkey AS id, c_nationkey AS sig FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier
 UNION ALL SELECT 'nation', n_nationkey, n_nationkey FROM nation UNION ALL SELECT 'part', p_partkey, p_size FROM part)
 SELECT origin, id, sig FROM (SELECT *, row_number() OVER (PARTITION BY origin, sig ORDER BY id) AS rn FROM u WHERE sig IN (3, 7, 20)) WHERE rn <= 5""")
def _(s, d):
    parts = [("customer", "c_custkey", "c_nationkey"), ("supplier", "s_suppkey", "s_nationkey"), ("nation", "n_nationkey", "n_nationkey"), ("part", "p_partkey", "p_size")]
    every = None
    for name, key, sig in parts:
        one = t(s, d, name).select(F.lit(name).alias("origin"), F.col(key).cast("long").alias("id"), F.col(sig).cast("long").alias("sig")).where(F.col("sig").isin(3, 7, 20))
        every = one if every is None else every.unionByName(one)
    return ranking.top_n(every, ["origin", "sig"], [F.col("id")], 5).drop("rn")


@query("j17_prefix_resolution", """WITH h AS (SELECT doc_id, sha256(text) AS hash FROM documents), r AS (SELECT doc_id AS ref_id, left(hash, 7 + CAST(doc_id % 6 AS INTEGER)) AS ref FROM h)
 SELECT r.ref_id, h.doc_id FROM r JOIN h ON starts_with(h.hash, r.ref)""")
def _(s, d):
    h = t(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    refs = h.select(F.col("doc_id").alias("ref_id"), F.expr("left(hash, 7 + int(doc_id % 6))").alias("ref"))
    return joins.resolve_prefixes(refs, "ref", h, "hash").select("ref_id", "doc_id")


@query("j19_judge_merge", """WITH a AS (SELECT doc_id, CAST(quality AS DOUBLE) AS v FROM labels WHERE toxic = 0), b AS (SELECT doc_id, CAST(toxic AS DOUBLE) AS v FROM labels WHERE quality = 1)
 SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.v AS a, b.v AS b, coalesce((a.v + b.v) / 2, a.v, b.v) AS v FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def _(s, d):
    one = t(s, d, "labels")
    a = one.where("toxic = 0").select("doc_id", F.col("quality").cast("double").alias("v"))
    b = one.where("quality = 1").select("doc_id", F.col("toxic").cast("double").alias("v"))
    return joins.outer_merge(a, b, "doc_id", "v")


@query("j20_local_and_archive_hits", """WITH a AS (SELECT conv_id AS k, max(turn) AS s, min(role) AS body FROM conversations GROUP BY 1), b AS (SELECT doc_id AS k, n_chars % 9 AS s, lang AS body FROM documents)
 SELECT coalesce(a.k, b.k) AS k, greatest(a.s, b.s) AS score, coalesce(a.body, b.body) AS body FROM a FULL JOIN b ON a.k = b.k""")
def _(s, d):
    a = t(s, d, "conversations").groupBy(F.col("conv_id").alias("k")).agg(F.max("turn").alias("score"), F.min("role").alias("body"))
    b = t(s, d, "documents").select(F.col("doc_id").alias("k"), (F.col("n_chars") % 9).alias("score"), F.col("lang").alias("body"))
    return joins.merge_hits(a, b, "k")


@query("j23_stub_backfill", """SELECT o.o_custkey AS upstream, 'stub ' || CAST(min(o.o_orderkey) AS VARCHAR) AS subject, DATE '1970-01-01' AS day FROM orders o
 WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = o.o_custkey) GROUP BY 1""")
def _(s, d):
    missing = t(s, d, "orders").join(t(s, d, "events").select(F.col("user_id").alias("o_custkey")), "o_custkey", "left_anti")
    return missing.groupBy(F.col("o_custkey").alias("upstream")).agg(F.concat(F.lit("stub "), F.min("o_orderkey").cast("string")).alias("subject")).withColumn("day", F.lit("1970-01-01").cast("date"))


@query("jx_as_of", """SELECT e.event_id, c.value AS last_click FROM (SELECT * FROM events WHERE event_type = 'purchase') e
 ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2) c ON e.user_id = c.user_id AND e.ts >= c.ts""")
def _(s, d):
    e = t(s, d, "events")
    clicks = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_click"))
    return joins.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, ["user_id"], "ts", "last_click").select("event_id", "last_click")


# --- aggregates


@query("a01_counts", "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS authors FROM orders GROUP BY 1")
def _(s, d):
    return t(s, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("authors"))


@query("a03_author_by_subsystem", f"WITH {_C} SELECT author, subsystem, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM commits GROUP BY 1, 2 HAVING count(*) >= 3")
def _(s, d):
    return commits(s, d).groupBy("author", "subsystem").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day")).where("n >= 3")


@query("a04_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(s, d):
    return t(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("a05_conditional", """SELECT user_id, max(CASE WHEN event_type <> 'error' THEN ts END) AS last_ok, CAST(sum(CASE WHEN event_type = 'error' AND ts >= TIMESTAMP '2024-01-16' THEN 1 ELSE 0 END) AS BIGINT) AS errors,
 count(*) AS runs FROM events GROUP BY 1""")
def _(s, d):
    bad = (F.col("event_type") == "error") & (F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz"))
    return t(s, d, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") != "error", F.col("ts"))).alias("last_ok"), F.sum(bad.cast("long")).alias("errors"), F.count(F.lit(1)).alias("runs"))


@query("a07_ordered_listing", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def _(s, d):
    return t(s, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "; ").alias("names"))


@query("a08_identifier_frequency", r"""SELECT tok, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '[a-z]+_[a-z_]+|[A-Z]{4,}')) AS tok FROM pages) WHERE length(tok) > 3 AND tok NOT IN ('HTML', 'DOCTYPE') GROUP BY 1 ORDER BY n DESC, tok LIMIT 20""")
def _(s, d):
    tok = F.explode(F.regexp_extract_all("html", F.lit("[a-z]+_[a-z_]+|[A-Z]{4,}"), F.lit(0))).alias("tok")
    return t(s, d, "pages").select(tok).where("length(tok) > 3 and tok not in ('HTML', 'DOCTYPE')").groupBy("tok").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tok").limit(20)


@query("a18_union_of_sets", "SELECT l_suppkey, list_sort(list(DISTINCT l_returnflag)) AS flags FROM lineitem GROUP BY 1")
def _(s, d):
    return t(s, d, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"))


@query("a26_drift", """WITH c AS (SELECT 'orders' AS name, (SELECT count(*) FROM orders) AS a, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS b UNION ALL SELECT 'customers', (SELECT count(*) FROM customer), (SELECT count(DISTINCT o_custkey) FROM orders))
 SELECT name, a, b, round(abs(a - b) * 100.0 / b, 4) AS drift, CASE WHEN abs(a - b) * 100.0 / b > 20 THEN 'fail' WHEN abs(a - b) * 100.0 / b > 5 THEN 'warn' ELSE 'ok' END AS state FROM c""")
def _(s, d):
    one = lambda name, a, b: a.join(F.broadcast(b)).select(F.lit(name).alias("name"), "a", "b")
    n = F.count(F.lit(1)).alias("a")
    rows = one("orders", t(s, d, "orders").agg(n), t(s, d, "lineitem").agg(F.countDistinct("l_orderkey").alias("b"))).unionByName(
        one("customers", t(s, d, "customer").agg(n), t(s, d, "orders").agg(F.countDistinct("o_custkey").alias("b")))
    )
    drift = F.abs(F.col("a") - F.col("b")) * 100.0 / F.col("b")
    return rows.select("name", "a", "b", F.round(drift, 4).alias("drift"), F.when(drift > 20, "fail").when(drift > 5, "warn").otherwise("ok").alias("state"))


@query("a27_majority_vote", """WITH c AS (SELECT conv_id, regexp_replace(trim(role), '\\s+', ' ', 'g') AS v, count(*) AS n, min(turn) AS first FROM conversations GROUP BY 1, 2)
 SELECT conv_id, v, n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, first) AS rn FROM c) WHERE rn = 1""")
def _(s, d):
    c = t(s, d, "conversations").groupBy("conv_id", F.regexp_replace(F.trim("role"), r"\s+", " ").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first"))
    return ranking.first_of(c, ["conv_id"], [F.desc("n"), F.col("first")]).select("conv_id", "v", "n")


@query("a28_resign_changes", """WITH a AS (SELECT doc_id, CASE WHEN n_chars % 5 = 0 THEN '' ELSE lang END AS v FROM documents), b AS (SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN '' WHEN n_chars % 3 = 0 THEN source ELSE lang END AS v FROM documents)
 SELECT CASE WHEN a.v = b.v THEN 'unchanged' WHEN a.v = '' THEN 'new' WHEN b.v = '' THEN 'cleared' ELSE 'changed' END AS change_type, count(*) AS n FROM a JOIN b USING (doc_id) GROUP BY 1""")
def _(s, d):
    docs = t(s, d, "documents")
    old = docs.select("doc_id", F.when(F.col("n_chars") % 5 == 0, "").otherwise(F.col("lang")).alias("v"))
    new = docs.select("doc_id", F.when(F.col("n_chars") % 7 == 0, "").when(F.col("n_chars") % 3 == 0, F.col("source")).otherwise(F.col("lang")).alias("v"))
    return upsert.changes(old, new, "doc_id", "v")


@query("ax_cube_and_percentiles", """SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, grouping(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def _(s, d):
    return t(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.grouping_id().alias("level"))


@query("ax_pivot", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def _(s, d):
    out = t(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return out.select("o_orderpriority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


# --- windows


@query("w01_top_n_per_group", "SELECT o_custkey, o_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS rn FROM orders) WHERE rn <= 5")
def _(s, d):
    return ranking.top_n(t(s, d, "orders"), ["o_custkey"], [F.desc_nulls_last("o_orderdate"), F.col("o_orderkey")], 5).select("o_custkey", "o_orderkey", "rn")


@query("w02_distinct_on", "SELECT DISTINCT ON (user_id) user_id, event_id FROM events ORDER BY user_id, ts DESC, event_id")
def _(s, d):
    return ranking.first_of(t(s, d, "events"), ["user_id"], [F.desc("ts"), F.col("event_id")]).select("user_id", "event_id")


@query("w03_max_normalised", "SELECT event_id, round(value / CASE WHEN max(value) OVER (PARTITION BY event_type) = 0 THEN 1 ELSE max(value) OVER (PARTITION BY event_type) END, 6) AS score FROM events")
def _(s, d):
    e = t(s, d, "events")
    return e.select("event_id", F.round(ranking.max_normalised(e, "event_type", "value"), 6).alias("score"))


@query("w05_errors_since_success", """SELECT user_id, CAST(count(*) FILTER (seen = 0) AS BIGINT) AS run_length FROM (SELECT user_id, sum(CASE WHEN event_type NOT IN ('error', 'view') THEN 1 ELSE 0 END)
 OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS seen FROM events) GROUP BY 1""")
def _(s, d):
    return ranking.leading_run(t(s, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], ~F.col("event_type").isin("error", "view"))


@query("w06_latest_per_group", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS last_event, max(ts) AS last_ts FROM events GROUP BY 1")
def _(s, d):
    return t(s, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"), F.max("ts").alias("last_ts"))


@query("w07_rank_score", "SELECT conv_id, turn, round(1 - (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) * 1.0 / count(*) OVER (PARTITION BY conv_id), 6) AS score FROM conversations")
def _(s, d):
    return t(s, d, "conversations").select("conv_id", "turn", F.round(ranking.rank_score(["conv_id"], [F.col("turn")]), 6).alias("score"))


@query("wx_lag_and_ntile", "SELECT event_id, lag(event_id) OVER w AS before, ntile(4) OVER w AS quarter, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS kind FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(s, d, "events").select("event_id", F.lag("event_id").over(w).alias("before"), F.ntile(4).over(w).alias("quarter"), F.dense_rank().over(Window.partitionBy("user_id").orderBy("event_type")).alias("kind"))


@query("t04_calls_in_the_last_hour", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS calls FROM events")
def _(s, d):
    hour = F.expr("count(1) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW)")  # to the microsecond
    return t(s, d, "events").select("event_id", hour.alias("calls"))


# --- order, limits, sets


@query("o01_top_k", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100")
def _(s, d):
    return t(s, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(100)


@query("o05_oldest_fixes", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey LIMIT 20")
def _(s, d):
    return t(s, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey").limit(20)


@query("o06_first_kind_by_priority", """WITH p(kind, place) AS (VALUES ('error', 1), ('purchase', 2), ('signup', 3), ('click', 4), ('view', 5))
 SELECT user_id, arg_min(event_type, place) AS kind FROM events JOIN p ON p.kind = event_type GROUP BY 1""")
def _(s, d):
    order = F.array(*[F.lit(k) for k in ("error", "purchase", "signup", "click", "view")])
    return t(s, d, "events").groupBy("user_id").agg(F.min_by("event_type", F.array_position(order, F.col("event_type"))).alias("kind"))


@query("o13_summary_queue", "SELECT conv_id, count(*) AS messages FROM conversations GROUP BY 1 HAVING count(*) >= 4 ORDER BY messages DESC, conv_id LIMIT 100")
def _(s, d):
    return t(s, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages")).where("messages >= 4").orderBy(F.desc("messages"), "conv_id").limit(100)


@query("u02_bag_union_of_routes", """SELECT 'commit' AS route, o_orderkey AS id, o_orderpriority AS title FROM orders UNION ALL SELECT 'bug', p_partkey, p_name FROM part UNION ALL SELECT 'cve', s_suppkey, s_name FROM supplier""")
def _(s, d):
    one = lambda route, name, key, title: t(s, d, name).select(F.lit(route).alias("route"), F.col(key).alias("id"), F.col(title).alias("title"))
    return one("commit", "orders", "o_orderkey", "o_orderpriority").unionByName(one("bug", "part", "p_partkey", "p_name")).unionByName(one("cve", "supplier", "s_suppkey", "s_name"))


@query("u03_set_algebra", "SELECT 'both' AS side, k FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'only', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)")
def _(s, d):
    a, b = t(s, d, "customer").select(F.col("c_custkey").alias("k")), t(s, d, "orders").select(F.col("o_custkey").alias("k"))
    return a.intersect(b).select(F.lit("both").alias("side"), "k").unionByName(a.subtract(b).select(F.lit("only").alias("side"), "k"))


@query("u05_todo_minus_done", "SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 150)")
def _(s, d):
    e = t(s, d, "events")
    return e.where("event_type = 'error'").select("user_id").join(e.where("event_type = 'signup' and value > 150").select("user_id"), "user_id", "left_anti").distinct()


@query("u06_first_injection_wins", f"""WITH {_E}, s AS (SELECT 1 AS step, "commit" AS hash FROM edges WHERE link_type = 'R' UNION ALL SELECT 2, "commit" FROM edges WHERE link_type = 'A' UNION ALL SELECT 3, "commit" FROM edges)
 SELECT hash, min(step) AS step FROM s WHERE hash NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1""")
def _(s, d):
    e = edges(s, d)
    steps = [e.where(c).select(F.lit(i + 1).alias("step"), F.col("commit").alias("hash")) for i, c in enumerate(("link_type = 'R'", "link_type = 'A'", "true"))]
    every = steps[0].unionByName(steps[1]).unionByName(steps[2])
    present = t(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("hash"))
    return every.join(present, "hash", "left_anti").groupBy("hash").agg(F.min("step").alias("step"))


# --- upserts and increments


@query("s37_coalesce_merge", """WITH a AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_nationkey < 12 THEN c_mktsegment END AS seg FROM customer WHERE c_mktsegment <> 'BUILDING'),
 b AS (SELECT c_custkey AS k, 'x' || c_name AS name, CASE WHEN c_nationkey > 5 THEN lower(c_mktsegment) END AS seg FROM customer WHERE c_acctbal > 0)
 SELECT coalesce(a.k, b.k) AS k, coalesce(a.name, b.name) AS name, coalesce(b.seg, a.seg) AS seg FROM a FULL JOIN b ON a.k = b.k""")
def _(s, d):
    c = t(s, d, "customer")
    a = c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.when(F.col("c_nationkey") < 12, F.col("c_mktsegment")).alias("seg"))
    b = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.concat(F.lit("x"), "c_name").alias("name"), F.when(F.col("c_nationkey") > 5, F.lower("c_mktsegment")).alias("seg"))
    return upsert.upsert(a, b, ["k"], coalesce=("seg",))


@query("s38_overwrite_merge", """WITH a AS (SELECT p_partkey AS k, p_size AS size, p_brand AS brand FROM part WHERE p_size < 40), b AS (SELECT p_partkey AS k, p_size + 1 AS size, 'new' AS brand FROM part WHERE p_size > 10)
 SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN a.size ELSE b.size END AS size, coalesce(a.brand, b.brand) AS brand FROM a FULL JOIN b ON a.k = b.k""")
def _(s, d):
    p = t(s, d, "part")
    a = p.where("p_size < 40").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))
    b = p.where("p_size > 10").select(F.col("p_partkey").alias("k"), (F.col("p_size") + 1).alias("size"), F.lit("new").alias("brand"))
    return upsert.upsert(a, b, ["k"], overwrite=("size",))


@query("s39_insert_if_absent", "SELECT DISTINCT user_id AS k FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)")
def _(s, d):
    return upsert.insert_if_absent(t(s, d, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("k")), t(s, d, "events").select(F.col("user_id").alias("k")), ["k"])


@query("s42_latest_checkpoint", "SELECT user_id, arg_max(props, (ts, event_id)) AS checkpoint FROM events WHERE event_type <> 'error' GROUP BY 1")
def _(s, d):
    runs = t(s, d, "events").withColumn("status", F.when(F.col("event_type") == "error", "error").otherwise("ok"))
    return upsert.latest_checkpoint(runs, "user_id", "status", "ts", "props", "event_id")


@query("t03_seen_set_increment", """SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20' AND (event_type = 'purchase' OR user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND ts <= TIMESTAMP '2024-01-03'))""")
def _(s, d):
    e = t(s, d, "events")
    seen = e.where("event_type = 'signup' and ts <= timestamp_ntz'2024-01-03'").select("user_id").distinct()
    return upsert.incremental(e, seen, "user_id", "ts", F.lit("2024-01-20").cast("timestamp_ntz"), F.col("event_type") == "purchase").select("event_id")


# --- filters


@query("f_predicates", """SELECT p_partkey, left(p_name, 12) AS short FROM part WHERE p_size = ANY([1, 5, 9, 30]) AND p_name NOT LIKE 'stub%' AND p_type ILIKE '%steel%' OR length(p_name) > 40 OR (p_size BETWEEN 48 AND 50 AND regexp_matches(p_brand, '(?i)^brand#[1-3]'))""")
def _(s, d):
    a = F.col("p_size").isin(1, 5, 9, 30) & ~F.col("p_name").startswith("stub") & F.col("p_type").ilike("%steel%")
    b = (F.length("p_name") > 40) | (F.col("p_size").between(48, 50) & F.col("p_brand").rlike("(?i)^brand#[1-3]"))
    return t(s, d, "part").where(a | b).select("p_partkey", F.left("p_name", F.lit(12)).alias("short"))


@query("f_array_membership", "WITH g AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY 1) SELECT l_orderkey, list_contains(flags, 'R') AS has_r, list_has_any(flags, ['A', 'N']) AS a_or_n FROM g")
def _(s, d):
    g = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    return g.select("l_orderkey", F.array_contains("flags", "R").alias("has_r"), F.arrays_overlap("flags", F.array(F.lit("A"), F.lit("N"))).alias("a_or_n"))


@query("f_fixes_by_subsystem", """SELECT o_orderkey FROM orders WHERE (starts_with(lower(o_orderpriority), '1-') OR starts_with(lower(o_orderpriority), '2-')) AND contains(lower(o_orderpriority), 'h') AND o_orderdate > TIMESTAMP '1995-01-01'""")
def _(s, d):
    low = F.lower("o_orderpriority")
    return t(s, d, "orders").where((low.startswith("1-") | low.startswith("2-")) & low.contains("h") & (F.col("o_orderdate") > F.lit("1995-01-01").cast("timestamp_ntz"))).select("o_orderkey")

"""Evaluation, health, integrity, graph, logs and hardware over fixture tables and literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.bindings.registry import Derived, query
from faultlens.functions import hardware, logs, text
from faultlens.operators import graph, joins, quality
from faultlens.session import table as t
from faultlens.sources import readers
from faultlens.streaming import events as streams

_R = "r AS (SELECT d.doc_id, d.lang, l.quality, l.toxic, CASE WHEN d.n_chars % 5 = 0 THEN NULL ELSE d.n_chars % 100 / 100.0 END AS recall FROM documents d JOIN labels l USING (doc_id))"


def _results(s, d):
    docs = t(s, d, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(t(s, d, "labels"), "doc_id").withColumn("recall", F.when(F.col("n_chars") % 5 != 0, (F.col("n_chars") % 100) / 100.0))


@query("a09_to_a11_rates", f"WITH {_R} SELECT round(coalesce(avg(recall), 0), 3) AS recall, round(avg(CAST(quality = 1 AS DOUBLE)), 6) AS accuracy, round(avg(CASE WHEN quality = 1 THEN CAST(toxic = 1 AS DOUBLE) END), 6) AS error_when_right FROM r")
def _(s, d):
    return _results(s, d).agg(F.round(F.coalesce(F.avg("recall"), F.lit(0.0)), 3).alias("recall"), quality.share(F.col("quality") == 1).alias("accuracy"), quality.share(F.when(F.col("quality") == 1, F.col("toxic") == 1)).alias("error_when_right"))


@query("a13_by_category", f"WITH {_R} SELECT lang, count(*) AS n, count(recall) AS scored, round(coalesce(avg(recall), 0), 3) AS mean_recall, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 3) AS correct_share FROM r GROUP BY 1")
def _(s, d):
    return quality.by_category(_results(s, d).withColumn("right", F.col("quality") == 1), "lang", "recall", "right")


@query("a14_phase_coverage", """WITH g AS (SELECT user_id, list(DISTINCT event_type) FILTER (value >= 20) AS e FROM events GROUP BY 1)
 SELECT user_id, coalesce(list_has_any(e, ['view', 'click']), false) AS look, coalesce(list_has_any(e, ['purchase']), false) AS buy, coalesce(list_has_any(e, ['signup', 'error']), false) AS join_,
 round((CAST(coalesce(list_has_any(e, ['view', 'click']), false) AS INT) + CAST(coalesce(list_has_any(e, ['purchase']), false) AS INT) + CAST(coalesce(list_has_any(e, ['signup', 'error']), false) AS INT)) / 3.0, 6) AS coverage FROM g""")
def _(s, d):
    e = t(s, d, "events").withColumn("failed", F.col("value") < 20)
    return quality.phases(e, "user_id", "event_type", "failed", {"look": ["view", "click"], "buy": ["purchase"], "join_": ["signup", "error"]})


@query("a20_recall_at_10", """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders), f AS (SELECT o_custkey, list(CAST(o_orderkey AS VARCHAR)) FILTER (rn <= 10) AS found FROM o GROUP BY 1),
 x AS (SELECT o_custkey, list(CAST(o_orderkey AS VARCHAR)) AS want FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
 SELECT f.o_custkey, round(len(list_intersect(found, want)) * 1.0 / len(want), 6) AS recall FROM f LEFT JOIN x USING (o_custkey)""")
def _(s, d):
    o = t(s, d, "orders").withColumn("id", F.col("o_orderkey").cast("string"))
    recent = F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_timestamp("o_orderdate")).alias("at"), "o_orderkey", "id"))), lambda x: x["id"])
    g = o.groupBy("o_custkey").agg(recent.alias("found"), F.collect_list(F.when(F.col("o_orderstatus") == "P", F.col("id"))).alias("want"))
    return g.select("o_custkey", F.round(quality.recall_at(F.col("found"), F.col("want")), 6).alias("recall"))


@query("x61_ingest_health", """WITH s AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS seen FROM events),
 h AS (SELECT user_id, max(CASE WHEN event_type <> 'error' THEN ts END) AS last_success, count(*) FILTER (seen = 0) AS n FROM s GROUP BY 1)
 SELECT user_id, last_success, n AS consecutive_errors, n >= 3 AS circuit_open, CASE WHEN n >= 3 THEN CAST(least(480, 30 * pow(2, n - 3)) AS INTEGER) ELSE 0 END AS backoff_minutes, coalesce(last_success < TIMESTAMP '2024-02-12', true) AS is_stale,
 CASE WHEN n >= 3 THEN 'circuit_open' WHEN coalesce(last_success < TIMESTAMP '2024-02-12', true) THEN 'stale' WHEN n > 0 THEN 'degraded' ELSE 'ok' END AS status FROM h""")
def _(s, d):
    bad = F.col("event_type") == "error"
    return quality.health(t(s, d, "events"), "user_id", ~bad, bad, "ts", "event_id", F.lit("2024-02-26").cast("timestamp_ntz"))


@query("g19_invariants", """SELECT 'order_has_customer' AS "check", count(*) AS violations, count(*) = 0 AS passed FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
 UNION ALL SELECT 'edge_unique', count(*), count(*) = 0 FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'status_domain', count(*), count(*) = 0 FROM orders WHERE o_orderstatus NOT IN ('F', 'O', 'P')
 UNION ALL SELECT 'discount_range', count(*), count(*) = 0 FROM lineitem WHERE l_discount < 0 OR l_discount > 0.1 UNION ALL SELECT 'text_present', count(*), count(*) = 0 FROM documents WHERE text IS NULL OR text = ''""")
def _(s, d):
    o, item = t(s, d, "orders"), t(s, d, "lineitem")
    return quality.invariants({
        "order_has_customer": o.join(t(s, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti"),
        "edge_unique": item.groupBy("l_orderkey", "l_linenumber").count().where("count > 1"),
        "status_domain": o.where(~F.col("o_orderstatus").isin("F", "O", "P")),
        "discount_range": item.where("l_discount < 0 or l_discount > 0.1"),
        "text_present": t(s, d, "documents").where("text is null or text = ''"),
    })


@query("g20_fidelity_audit", """WITH e AS (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity FROM lineitem), n AS (SELECT least(200, count(*)) AS n FROM e JOIN orders ON o_orderkey = l_orderkey)
 SELECT 'edge_to_priced_order' AS audit, n, 1.0::DOUBLE AS passed_share, true AS ok, []::VARCHAR[] AS examples FROM n WHERE NOT EXISTS (SELECT 1 FROM orders WHERE NOT o_totalprice > 0)""")
def _(s, d):
    e = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").distinct().join(t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return quality.fidelity(e, ["l_orderkey", "l_linenumber"], F.col("o_totalprice") > 0, "edge_to_priced_order")


@query("x46_bind_claims", """WITH w AS (SELECT conv_id, turn, role, list_distinct([x FOR x IN regexp_extract_all(lower(text), '[a-z0-9_]{4,}') IF x NOT IN ('with', 'that')]) AS w FROM conversations),
 p AS (SELECT c.conv_id AS case_id, c.turn AS claim_id, e.turn AS evidence_id, CASE WHEN len(c.w) = 0 THEN 0.0 ELSE len(list_intersect(c.w, e.w)) / len(c.w) END AS share FROM w c JOIN w e ON e.conv_id = c.conv_id AND c.role = 'assistant' AND e.role = 'user'),
 b AS (SELECT *, row_number() OVER (PARTITION BY case_id, claim_id ORDER BY share DESC, evidence_id) AS rn FROM p) SELECT case_id, claim_id, evidence_id, CAST(round(share, 6) AS DOUBLE) AS share, share >= 0.2 AS verified FROM b WHERE rn = 1""")
def _(s, d):
    c = t(s, d, "conversations")
    of = lambda role, id_: c.where(F.col("role") == role).select(F.col("conv_id").alias("case_id"), F.col("turn").alias(id_), text.significant_tokens(F.col("text"), ["with", "that"]).alias("tokens"))
    return quality.bind_claims(of("assistant", "claim_id"), of("user", "evidence_id"))


@query("g01_thread_roots", "SELECT conv_id, turn, conv_id * 100000 AS root FROM conversations")
def _(s, d):
    c = t(s, d, "conversations")
    low = c.groupBy("conv_id").agg(F.min("turn").alias("first"))
    m = c.join(low, "conv_id").select("conv_id", "turn", (F.col("conv_id") * 100000 + F.col("turn") - F.col("first")).alias("id"), F.when(F.col("turn") > F.col("first"), F.col("conv_id") * 100000 + F.col("turn") - F.col("first") - 1).alias("parent"))
    return m.join(graph.thread_roots(m, "id", "parent"), "id").select("conv_id", "turn", "root")


@query("g03_bug_links", """WITH r AS (SELECT DISTINCT user_id AS source, CAST(json_extract_string(props, '$.k') AS BIGINT) AS ref FROM events) SELECT DISTINCT source, p_partkey AS target, 'trailer' AS link_type, 0.95 AS confidence FROM r JOIN part ON p_partkey = ref""")
def _(s, d):
    refs = t(s, d, "events").select(F.col("user_id").alias("source"), F.from_json("props", "k bigint")["k"].alias("ref")).distinct()
    return graph.link(refs, "ref", t(s, d, "part").select("p_partkey", F.col("p_partkey").alias("target")), "p_partkey", "trailer", 0.95)


@query("g18_graph_edges", """SELECT 'FIXES' AS relation, 'Commit' AS source_label, CAST(l_orderkey AS VARCHAR) AS source, 'Bug' AS target_label, CAST(l_partkey AS VARCHAR) AS target FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus <> 'P' AND p_size > 5""")
def _(s, d):
    e = t(s, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    vertices = {"Commit": (t(s, d, "orders").where("o_orderstatus <> 'P'"), "o_orderkey", ["o_orderpriority"]), "Bug": (t(s, d, "part").where("p_size > 5"), "p_partkey", ["p_name"])}
    return graph.property_graph(vertices, {"FIXES": (e, "Commit", "l_orderkey", "Bug", "l_partkey")})[1]


@query("t01_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(s, d):
    return streams.windowed_counts(t(s, d, "events"), "ts", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("s20_crash_pages", r"""SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages""")
def _(s, d):
    return readers.crash_pages(t(s, d, "pages"), "page_id", "html").select("page_id", "title")


@query("s29_json_field", "SELECT user_id, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def _(s, d):
    return t(s, d, "events").groupBy("user_id").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


LOGS = Derived("id long, log string", [
    ("[  1.0] usb ok\n[  2.0] BUG: KASAN: use-after-free in foo_{a}\n[  2.1] Call Trace:\n[  2.2]  foo_{a}+0x1/0x2\n[  2.3]  bar+0x3/0x4\n\n[  3.0] Out of memory: Killed process {k} (java) total-vm:1kB",),
    ("Kernel panic - not syncing: Fatal {a}\n\nwatchdog: BUG: soft lockup - CPU#{k} stuck\n\nINFO: task kworker_{a}:9 blocked for more than 120 seconds.",),
    ("nothing here {k}",), ("",), (None,), ("WARNING: possible circular locking dependency {a}\nx\n\nmce: [Hardware Error]: Machine Check\nnvme0: I/O 1 timeout",),
])


@query("x28_log_events", LOGS.expected("id, nth, kind, summary, call_trace", {
    0: ["id, 0, 'bug', 'BUG: KASAN: use-after-free in foo_' || a, ['foo_' || a || '+0x1/0x2', 'bar+0x3/0x4']", "id, 1, 'oom', 'OOM kill: pid=' || k || ' (java)', []"],
    1: ["id, 0, 'panic', 'Kernel panic: Fatal ' || a, []", "id, 1, 'softlockup', 'Soft lockup on CPU#' || k, []", "id, 2, 'bug', 'Hung task: kworker_' || a || ':9 blocked 120s', []"],
    5: ["id, 0, 'lockdep', 'WARN: possible circular locking dependency ' || a, []"],
}))
def _(s, d):
    return logs.extract_events(LOGS.df(s, d), "id", "log").select("id", "nth", "kind", "summary", "call_trace")


@query("x34_x48_triage", f"""WITH {LOGS.sql('l')} SELECT id, [x FOR x IN [CASE WHEN regexp_matches(log, '(?i)Hardware Error') THEN 'hardware_error' END, CASE WHEN regexp_matches(log, '(?im)\\bMachine Check\\b|^mce:') THEN 'mce' END] IF x IS NOT NULL] AS signals,
 CASE WHEN regexp_matches(log, '(?i)Hardware Error') THEN 'hardware' ELSE 'kernel' END AS route FROM l WHERE log IS NOT NULL""")
def _(s, d):
    found = logs.labels(F.col("log"), logs.HARDWARE)
    return LOGS.df(s, d).where("log is not null").select("id", found.alias("signals"), logs.route(found, F.lit("oom"), F.lit(False), F.col("log"), F.lit(True)).alias("route"))


STATUS = Derived("id long, status string", [("0xbe00000000800400",), ("9c00{h}",), ("8000000000008000",), ("0",), ("b200{h}",), ("8800{h}",)])


@query("x38_machine_check", f"""WITH {STATUS.sql('s')}, h AS (SELECT id, lpad(regexp_replace(lower(status), '^0x', ''), 16, '0') AS x FROM s), n AS (SELECT id, CAST('0x' || left(x, 8) AS BIGINT) AS hi, CAST('0x' || right(x, 4) AS BIGINT) AS code FROM h)
 SELECT id, (hi >> 31) & 1 = 1 AS valid, (hi >> 31) & 1 = 1 AND (hi >> 29) & 1 = 1 AS uncorrected, CAST(code AS INTEGER) AS error_code, CASE WHEN (hi >> 31) & 1 = 1 THEN CASE WHEN (hi >> 25) & 1 = 1 THEN 'fatal' WHEN (hi >> 29) & 1 = 1 THEN 'uncorrected' ELSE 'corrected' END END AS severity FROM n""")
def _(s, d):
    return STATUS.df(s, d).select("id", hardware.mci_status(F.col("status")).alias("m")).select("id", "m.valid", "m.uncorrected", "m.error_code", "m.severity")


TAINTS = Derived("id long, value string", [("4096",), ("G W",), ("16",), ("Tainted: P M",), ("0",)])


@query("x36_taint", TAINTS.expected("id, letter, meaning, hardware", {
    0: ["id, 'O', 'Out-of-tree module loaded', false"], 1: ["id, 'G', 'Proprietary module loaded', false", "id, 'W', 'Kernel warning triggered', false"], 2: ["id, 'M', 'Machine Check Exception occurred', true"],
    3: ["id, 'P', 'unknown', false", "id, 'M', 'Machine Check Exception occurred', true"],
}))
def _(s, d):
    return TAINTS.df(s, d).select("id", F.explode(hardware.taint(F.col("value"))).alias("f")).select("id", "f.*")


@query("x37_device_major", "SELECT p_partkey, CASE p_size WHEN 1 THEN 'ramdisk' WHEN 2 THEN 'fd (floppy)' WHEN 3 THEN 'ide0 / pata' WHEN 7 THEN 'loop' WHEN 8 THEN 'sd (SCSI/SATA/USB disk)' WHEN 9 THEN 'md (software RAID)' WHEN 11 THEN 'sr (SCSI CD-ROM)' WHEN 22 THEN 'ide1' WHEN 43 THEN 'nbd (network block device)' ELSE 'unknown' END AS driver FROM part")
def _(s, d):
    return t(s, d, "part").select("p_partkey", hardware.device_major(F.col("p_size"), F.lit("block"))["driver"].alias("driver"))


@query("a19_ordered_hash_merge", "SELECT o_custkey, list(h ORDER BY first) AS hashes FROM (SELECT o_custkey, sha256(o_orderpriority) AS h, min(o_orderkey) AS first FROM orders GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    g = t(s, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.sha2(F.col("o_orderpriority"), 256).alias("h")))).alias("a"))
    half = F.floor(F.size("a") / 2).cast("int")
    known, more = F.slice("a", F.lit(1), half), F.slice("a", half + 1, F.size("a"))
    kept = text.merge_hashes(F.array().cast("array<string>"), F.transform(known, lambda x: x["h"]))
    return g.select("o_custkey", text.merge_hashes(kept, F.transform(more, lambda x: x["h"])).alias("hashes"))


@query("g12_owners", """SELECT n_name, string_agg(c_name, ', ' ORDER BY c_name) AS people FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_name LIKE '%1' GROUP BY 1""")
def _(s, d):
    n = t(s, d, "nation").where(joins.glob_match(F.col("n_name"), "*1"))
    c = t(s, d, "customer")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.array_join(F.array_sort(F.collect_list("c_name")), ", ").alias("people"))

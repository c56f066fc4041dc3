"""Further lookups, links and roll-ups over the fixture tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from faultlens.bindings.registry import Derived, query
from faultlens.functions import hardware, logs, stack, symbols, text
from faultlens.operators import graph, joins, quality, ranking, upsert, vectors
from faultlens.session import table as t
from faultlens.streaming import events as streams

DIFFS = Derived("hash string, diff string", [("diff --git a/net/x{k}.c b/net/x{k}.c\n@@ -1,2 +3,4 @@ int do_{a}(void)\n+a\ndiff --git a/m.h b/m.h\n@@ -1 +1 @@ #define TWO_{k} 2\n",), ("none {k}",)])
SUBJECTS = Derived("id long, subject string, body string", [
    ("Revert \"net: add {a}\"", "This reverts commit {h}."), ("tcp: fix deadlock {a}", "WARNING: possible circular locking dependency"), ("mm: oom_kill fix", "x{a}"),
    ("sched: fix", None), ("docs {a}", "kernel panic seen"), (None, None),
])
SEL = Derived("key long, line string", [("{k} | 01/02/2024 | 10:00:00 | Memory #0x01 | Uncorrectable ECC | Asserted",), ("{k} | 01/03/2024 | 11:00:00 | Memory | Correctable ECC | Asserted",), ("{k} | 01/03/2024 | 11:00:00 | Fan | ok",)])
# the same with the key in digits: in letters, key 4302 reads edac, which is a domain's word
PLAIN_SUBJECTS = Derived("id long, subject string, body string", [tuple(v and v.replace("{a}", "{k}") for v in form) for form in SUBJECTS.forms])
JUDGE = Derived("case_id long, a boolean, b boolean", [(True, True), (True, False), (None, False), (None, None), (False, False)])
MESSAGE_IDS = Derived("id long, raw string", [("<a{k}@b.org>.",), ("x@y",), ("no-at{k}",), ("a {k}@c.de",), ("(q{a}@r.st)",), (None,)])
FIXES = Derived("id long, url string, note string", [("https://git.org/c/abcdef1{h}", "fixed in 1234567"), ("https://x.org/?id=7{h}abc", "nothing"), ("https://x.org/", "see commit 99{h}aa and patch 8888888")])


@query("j16_harvested_hashes", """WITH h AS (SELECT DISTINCT l_orderkey AS hash FROM lineitem WHERE l_suppkey = 3), p AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
 SELECT o.o_orderkey, o.o_orderpriority, 0.95 AS score FROM orders o JOIN h ON h.hash = o.o_orderkey WHERE o.o_orderkey NOT IN (SELECT * FROM p)""")
def _(s, d):
    harvested = t(s, d, "lineitem").where("l_suppkey = 3").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    present = t(s, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey")
    return t(s, d, "orders").join(harvested.join(present, "o_orderkey", "left_anti"), "o_orderkey", "left_semi").select("o_orderkey", "o_orderpriority", F.lit(0.95).alias("score"))


@query("j18_reverts", f"""WITH {SUBJECTS.sql('x')} SELECT id, regexp_extract(subject, '^Revert "(.*)"', 1) AS reverted_subject, regexp_extract(body, '(?i)reverts commit ([0-9a-f]{{12,40}})', 1) AS reverted FROM x WHERE starts_with(subject, 'Revert "')""")
def _(s, d):
    x = SUBJECTS.df(s, d).where(F.col("subject").startswith('Revert "'))
    return x.select("id", F.regexp_extract("subject", '^Revert "(.*)"', 1).alias("reverted_subject"), F.regexp_extract("body", "(?i)reverts commit ([0-9a-f]{12,40})", 1).alias("reverted"))


@query("j22_best_overlap", r"""WITH w AS (SELECT conv_id, turn, role, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{4,}')) AS w FROM conversations WHERE text IS NOT NULL),
 p AS (SELECT a.conv_id, a.turn AS claim, b.turn AS evidence, len(list_intersect(a.w, b.w)) * 1.0 / len(a.w) AS share FROM w a JOIN w b ON a.conv_id = b.conv_id WHERE a.role = 'assistant' AND b.role = 'user' AND len(a.w) > 0)
 SELECT conv_id, claim, evidence, round(share, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, claim ORDER BY share DESC, evidence) AS rn FROM p) WHERE rn = 1""")
def _(s, d):
    c = t(s, d, "conversations").where("text is not null").withColumn("tokens", text.significant_tokens(F.col("text"), []))
    of = lambda role, id_: c.where(F.col("role") == role).select(F.col("conv_id").alias("case_id"), F.col("turn").alias(id_), "tokens")
    found = quality.bind_claims(of("assistant", "claim").where(F.size("tokens") > 0).withColumnRenamed("claim", "claim_id"), of("user", "evidence_id"))
    return found.select(F.col("case_id").alias("conv_id"), F.col("claim_id").alias("claim"), F.col("evidence_id").alias("evidence"), "share")


@query("x11_clean_message_ids", f"""WITH {MESSAGE_IDS.sql('m')}, c AS (SELECT id, regexp_replace(regexp_replace(trim(raw), '^<+|>+$', '', 'g'), '[.,;:''")\\]}}>]+$', '') AS v FROM m) SELECT id, CASE WHEN length(v) BETWEEN 5 AND 998 AND contains(v, '@') AND NOT regexp_matches(v, '\\s') THEN v END AS message_id FROM c""")
def _(s, d):
    return MESSAGE_IDS.df(s, d).select("id", text.clean_message_id(F.col("raw")).alias("message_id"))


@query("x13_fix_hashes", FIXES.expected("id, hashes", {0: ["id, list_sort(['1234567', 'abcdef1' || h])"], 1: ["id, ['7' || h || 'abc']"], 2: ["id, list_sort(['8888888', '99' || h || 'aa'])"]}))
def _(s, d):
    return FIXES.df(s, d).select("id", text.fix_hashes(F.array("url"), F.col("note")).alias("hashes"))


@query("x20_timestamps", "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(ts AS DATE) END AS day FROM events")
def _(s, d):
    raw = F.when(F.col("event_type") == "error", F.lit("  ")).otherwise(F.col("ts").cast("string"))
    return t(s, d, "events").select("event_id", F.to_date(text.timestamp_or_null(raw)).alias("day"))


@query("x23_diff_symbols", DIFFS.expected("hash, file, symbol, kind", {0: ["k, 'm.h', 'TWO_' || k, 'macro'", "k, 'net/x' || k || '.c', 'do_' || a, 'function'"], 1: ["k, '__NONE__', '__NONE__', 'sentinel'"]}))
def _(s, d):
    return symbols.diff_symbols(DIFFS.df(s, d), "hash", "diff")


PATCHES = Derived("id long, kind string, diff string", [
    ("mail", "diff --git a/x{g}.c b/x{g}.c\n--- a/x{g}.c\n+++ b/x{g}.c\n@@ -1 +1 @@\n ctx\n-old  line\n+new line"), ("commit", "diff --git a/x{g}.c b/x{g}.c\n@@ -90 +91 @@\n other\n-old line\n+new\tline"),
    ("commit", "diff --git a/y{g}.c b/y{g}.c\n@@ -1 +1 @@\n-old line\n+new line"), ("mail", "no diff {k}"),
])


@query("g07_patch_to_commit", f"""WITH {PATCHES.sql('p')}, l AS (SELECT id, kind, [regexp_replace(x, '\\s+', '', 'g') FOR x IN string_split(diff, chr(10)) IF regexp_matches(x, '^(diff --git |[+-])') AND NOT regexp_matches(x, '^(---|\\+\\+\\+) ')] AS b FROM p),
 f AS (SELECT id, kind, array_to_string(b, chr(10)) AS fp FROM l WHERE len(b) > 0) SELECT m.id AS patch, c.id AS commit_id, 1.0 AS confidence FROM f m JOIN f c ON m.fp = c.fp WHERE m.kind = 'mail' AND c.kind = 'commit'""")
def _(s, d):
    f = PATCHES.df(s, d).withColumn("fp", symbols.patch_fingerprint(F.col("diff"))).where("fp is not null")
    mail, commit = f.where("kind = 'mail'").select(F.col("id").alias("patch"), "fp"), f.where("kind = 'commit'").select(F.col("id").alias("commit_id"), "fp")
    return mail.join(commit, "fp").select("patch", "commit_id", F.lit(1.0).alias("confidence"))


@query("x27_fault_domains", PLAIN_SUBJECTS.expected("id, domain, confidence", {1: ["id, 'deadlock', 0.8::DOUBLE", "id, 'network', 0.8"], 2: ["id, 'oom', 0.8"], 3: ["id, 'sched_anomaly', 0.8"], 4: ["id, 'panic', 0.6"]}))
def _(s, d):
    return PLAIN_SUBJECTS.df(s, d).select("id", F.explode(logs.domain_tags(F.col("subject"), F.col("body"))).alias("g")).select("id", "g.*")


@query("x41_event_log", f"WITH {SEL.sql('x')} SELECT trim(split_part(line, '|', 1)) AS id, CASE WHEN regexp_matches(lower(line), 'uncorrect') THEN 'Critical' WHEN regexp_matches(lower(line), 'correct') THEN 'Warning' ELSE 'Info' END AS severity FROM x")
def _(s, d):
    return SEL.df(s, d).select(hardware.event_log(F.col("line")).alias("e")).select("e.id", "e.severity")


@query("x43_clock_skew", "SELECT event_id, CASE WHEN abs(date_diff('second', TIMESTAMP '2024-01-10', date_trunc('second', ts))) < 86400 THEN abs(date_diff('second', TIMESTAMP '2024-01-10', date_trunc('second', ts))) END AS skew FROM events")
def _(s, d):
    return t(s, d, "events").select("event_id", hardware.clock_skew(F.col("ts").cast("timestamp"), F.lit("2024-01-10").cast("timestamp")).alias("skew"))


@query("x59_dual_judgement", f"WITH {JUDGE.sql('j')} SELECT case_id, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN a = b THEN a END AS verdict FROM j")
def _(s, d):
    a, b = F.col("a"), F.col("b")
    return JUDGE.df(s, d).select("case_id", F.when(a.isNull(), b).when(b.isNull(), a).when(a == b, a).alias("verdict"))


@query("a12_by_goal", """SELECT d.source, count(*) AS n, round(avg(CAST(quality = 1 AS DOUBLE)), 6) AS good, round(avg(CAST(toxic = 1 AS DOUBLE)), 6) AS bad FROM documents d JOIN labels USING (doc_id) GROUP BY 1""")
def _(s, d):
    return t(s, d, "documents").select("doc_id", "source").join(t(s, d, "labels"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), quality.share(F.col("quality") == 1).alias("good"), quality.share(F.col("toxic") == 1).alias("bad"))


@query("a15_hits_by_route", "SELECT source AS route, count(*) AS n FROM documents WHERE n_chars > 500 GROUP BY 1")
def _(s, d):
    return t(s, d, "documents").where("n_chars > 500").groupBy(F.col("source").alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query("a16_severity_breakdown", "SELECT count(*) FILTER (event_type NOT IN ('error', 'signup')) AS corrected, count(*) FILTER (event_type = 'signup') AS uncorrected, count(*) FILTER (event_type = 'error') AS fatal FROM events")
def _(s, d):
    kind = F.when(F.col("event_type") == "error", "fatal").when(F.col("event_type") == "signup", "uncorrected").otherwise("corrected")
    return t(s, d, "events").agg(*[F.count_if(kind == k).alias(k) for k in ("corrected", "uncorrected", "fatal")])


@query("a17_ecc_trend", """SELECT user_id, count(*) FILTER (event_type = 'view') AS ce, count(*) FILTER (event_type = 'error') AS ue, CASE WHEN count(*) FILTER (event_type = 'error') > 15 THEN 'critical' WHEN count(*) FILTER (event_type = 'view') > 100 THEN 'increasing' ELSE 'stable' END AS trend FROM events GROUP BY 1""")
def _(s, d):
    g = t(s, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("ce"), F.count_if(F.col("event_type") == "error").alias("ue"))
    return g.withColumn("trend", hardware.ecc_trend(F.col("ce"), F.greatest(F.col("ue") - 15, F.lit(0))))


@query("a22_coverage", """WITH g AS (SELECT l_orderkey, list(DISTINCT l_linestatus || l_returnflag) AS used FROM lineitem GROUP BY 1) SELECT l_orderkey, round(len(list_intersect(used, ['OA', 'ON', 'FR'])) / 3.0, 6) AS coverage FROM g""")
def _(s, d):
    g = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat("l_linestatus", "l_returnflag")).alias("used"))
    want = F.array(F.lit("OA"), F.lit("ON"), F.lit("FR"))
    return g.select("l_orderkey", F.round(F.size(F.array_intersect("used", want)) / 3.0, 6).alias("coverage"))


@query("a24_judge_agreement", """SELECT count(*) AS n, round(avg(CAST(quality AS DOUBLE)), 6) AS mean_a, round(avg(CAST(toxic AS DOUBLE)), 6) AS mean_b, count(*) FILTER (abs(quality - toxic) >= 0.5) AS tiebreaks FROM labels""")
def _(s, d):
    return t(s, d, "labels").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("quality").cast("double")), 6).alias("mean_a"), F.round(F.avg(F.col("toxic").cast("double")), 6).alias("mean_b"), F.count_if(F.abs(F.col("quality") - F.col("toxic")) >= 0.5).alias("tiebreaks"))


@query("a29_groundedness", """WITH g AS (SELECT conv_id, count(*) FILTER (role = 'assistant') AS claims, count(*) FILTER (role = 'assistant' AND length(text) > 100) AS verified, count(*) FILTER (role = 'system') > 0 AS skipped FROM conversations GROUP BY 1)
 SELECT conv_id, CASE WHEN skipped THEN 'n/a' WHEN claims = 0 THEN 'speculative' WHEN verified * 2 >= claims THEN 'grounded' ELSE 'speculative' END AS label FROM g""")
def _(s, d):
    says = F.col("role") == "assistant"
    g = t(s, d, "conversations").groupBy("conv_id").agg(F.count_if(says).alias("claims"), F.count_if(says & (F.length("text") > 100)).alias("verified"), F.when(F.count_if(F.col("role") == "system") > 0, "other").otherwise("answered").alias("verdict"))
    return g.select("conv_id", quality.groundedness(F.col("verified"), F.col("claims"), F.col("verdict")).alias("label"))


@query("w04_top_k_by_route", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 10")
def _(s, d):
    return ranking.top_n(t(s, d, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 10).select("source", "doc_id")


@query("w08_first_seen", "SELECT user_id, list(event_type ORDER BY first) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    first = t(s, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return first.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"]).alias("kinds"))


@query("o09_newest_then_shown", "SELECT o_orderkey, day FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25)")
def _(s, d):
    return t(s, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25).select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@query("o14_most_specific_first", "SELECT p_brand, p_type FROM (SELECT DISTINCT p_brand, p_type FROM part WHERE p_brand LIKE 'Brand#1%') ORDER BY length(p_type) DESC, p_type, p_brand LIMIT 8")
def _(s, d):
    return t(s, d, "part").where(F.col("p_brand").startswith("Brand#1")).select("p_brand", "p_type").distinct().orderBy(F.desc(F.length("p_type")), "p_type", "p_brand").limit(8)


@query("g04_cve_links", """SELECT DISTINCT l_orderkey AS source, s_suppkey AS target, 'fix' AS link_type, 0.9 AS confidence FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linestatus = 'O'""")
def _(s, d):
    refs = t(s, d, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("source"), F.col("l_suppkey").alias("ref"))
    return graph.link(refs, "ref", t(s, d, "supplier").select("s_suppkey", F.col("s_suppkey").alias("target")), "s_suppkey", "fix", 0.9)


@query("g08_one_hop", """WITH h AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem WHERE l_returnflag = 'R') SELECT a AS node, b AS other, 'forward' AS direction FROM h UNION ALL SELECT b, a, 'backward' FROM h""")
def _(s, d):
    h = t(s, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey").distinct()
    return joins.both_directions(h, "l_orderkey", "l_partkey")


@query("g13_similar_by_signature", """WITH s AS (SELECT doc_id, left(sha256(text), 16) AS sig FROM documents) SELECT a.doc_id, count(*) - 1 AS similar FROM s a JOIN s b USING (sig) GROUP BY 1""")
def _(s, d):
    sig = t(s, d, "documents").select("doc_id", F.left(F.sha2("text", 256), F.lit(16)).alias("sig"))
    n = sig.groupBy("sig").agg((F.count(F.lit(1)) - 1).alias("similar"))
    return sig.join(n, "sig").select("doc_id", "similar")


@query("g16_unprocessed_with_sentinel", """SELECT o_orderkey AS hash, coalesce(min(l_returnflag), '__NONE__') AS symbol FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 45 WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7) GROUP BY 1""")
def _(s, d):
    done = t(s, d, "lineitem").where("l_linenumber = 7").select(F.col("l_orderkey").alias("o_orderkey"))
    todo = t(s, d, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")
    found = t(s, d, "lineitem").where("l_quantity > 45").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_returnflag").alias("symbol"))
    return todo.join(found, "o_orderkey", "left").select(F.col("o_orderkey").alias("hash"), F.coalesce("symbol", F.lit("__NONE__")).alias("symbol"))


def _signature(text: str) -> str:
    """SQL of a trace's signature, step by step with the lists of the column functions."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    opens = " OR ".join([f"trim(l) IN ({', '.join(map(quoted, stack.MARKERS))})", *(f"starts_with(trim(l), {quoted(o)})" for o in stack.OPENINGS)])
    line = "l"
    for pattern in stack.VOLATILE:
        line = f"regexp_replace({line}, {quoted(pattern)}, '', 'g')"
    words = rf"flatten([[x FOR x IN regexp_extract_all(trim({line}), '[\p{{L}}\p{{N}}_]+') IF regexp_full_match(x, '[a-z_][a-z0-9_]{{3,}}')] FOR l IN string_split_regex(coalesce({text}, ''), '\r?\n') IF NOT ({opens})])"
    return f"[x FOR x IN {words} IF x NOT IN ({', '.join(map(quoted, stack.PLUMBING + stack.NO_FRAMES))})]"


@query("g17_signatures_of_texts", f"""WITH n AS (SELECT conv_id, turn, {_signature('text')} AS w FROM conversations), f AS (SELECT conv_id, turn, [x FOR x, i IN w IF list_position(w, x) = i][1:4] AS k FROM n)
 SELECT conv_id, turn, CASE WHEN len(k) < 3 THEN '' ELSE left(sha256(array_to_string(k, '|')), 32) END AS signature FROM f""")
def _(s, d):
    return t(s, d, "conversations").select("conv_id", "turn", stack.signature(F.col("text")).alias("signature"))


@query("t02_high_watermark", "SELECT event_type, max(ts) AS watermark, count(*) FILTER (ts > TIMESTAMP '2024-01-20') AS fresh FROM events GROUP BY 1")
def _(s, d):
    late = F.col("ts") > F.lit("2024-01-20").cast("timestamp_ntz")
    return t(s, d, "events").groupBy("event_type").agg(F.max("ts").alias("watermark"), F.count_if(late).alias("fresh"))


@query("t05_read_through_cache", """SELECT c.conv_id, c.turn, CASE WHEN l.doc_id IS NULL THEN 'miss' ELSE 'hit' END AS cache FROM conversations c LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = c.conv_id""")
def _(s, d):
    cache = t(s, d, "labels").where("quality = 1").select("doc_id").distinct()
    c = t(s, d, "conversations")
    return c.join(cache, c["conv_id"] == cache["doc_id"], "left").select("conv_id", "turn", F.when(F.col("doc_id").isNull(), "miss").otherwise("hit").alias("cache"))


@query("tx_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 n AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM e) SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS finish, user_id, count(*) AS n FROM n GROUP BY user_id, nth""")
def _(s, d):
    found = streams.session_counts(t(s, d, "events"), "ts", "user_id", gap="6 hours")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "finish")})


@query("s27_merged_sections", "SELECT c_mktsegment AS name, min(c_name) AS first_name, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY 1")
def _(s, d):
    return t(s, d, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.min("c_name").alias("first_name"), F.countDistinct("c_nationkey").alias("nations"))


@query("s43_remembered_outcomes", """WITH r AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'transient' WHEN event_type = 'click' THEN 'ok' WHEN event_type = 'view' THEN 'not_found' ELSE 'server_error' END AS result FROM events WHERE event_id % 2 = 0),
 was AS (SELECT event_id, 'ok' AS result FROM events WHERE event_id % 3 = 0) SELECT coalesce(r.event_id, was.event_id) AS event_id, coalesce(r.result, was.result) AS result FROM (SELECT * FROM r WHERE result <> 'transient') r FULL JOIN was ON was.event_id = r.event_id""")
def _(s, d):
    e = t(s, d, "events")
    kind = F.col("event_type")
    result = upsert.outcome(F.when(kind == "click", 200).when(kind == "view", 404).otherwise(503), F.when(kind == "error", "reset"))
    return upsert.remembered(e.where("event_id % 3 = 0").select("event_id", F.lit("ok").alias("result")), e.where("event_id % 2 = 0").select("event_id", result.alias("result")), "event_id", "result")


@query("s58_backfill_todo", "SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def _(s, d):
    state = t(s, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"))
    return upsert.todo(t(s, d, "lineitem").select(F.col("l_orderkey").alias("id")), state, "id")


LABELS = Derived("id long, labels string", [("bug,sig/Kernel{a},sig/Net",), ("Sig/Storage{k}",), ("kind/bug",), ("",)])


@query("x18_first_label", f"WITH {LABELS.sql('l')} SELECT id, nullif(lower(regexp_extract(labels, '(?i)(?:^|,)sig/([^,]+)', 1)), '') AS subsystem FROM l")
def _(s, d):
    return LABELS.df(s, d).select("id", text.first_label(F.split("labels", ","), r"(?i)^sig/(.+)$").alias("subsystem"))


@query("x53_since_cutoff", """SELECT event_id, ts - CASE event_id % 4 WHEN 0 THEN INTERVAL 6 HOUR WHEN 1 THEN INTERVAL 7 DAY ELSE INTERVAL 24 HOUR END AS cutoff FROM events""")
def _(s, d):
    since = F.element_at(F.array(F.lit("6h"), F.lit("7d"), F.lit("soon"), F.lit("h")), (F.col("event_id") % 4).cast("int") + 1)
    return t(s, d, "events").select("event_id", text.since_cutoff(since, F.col("ts")).alias("cutoff"))


@query("x64_evidence_lines", r"""SELECT doc_id, '[' || doc_id || '] score=' || printf('%.2f', doc_id / 10) || ' | ' || coalesce(source, '') || CASE WHEN lang = 'en' THEN ' | lang=en' ELSE '' END || coalesce(chr(10) || '    ' || replace(left(nullif(text, ''), 300), chr(10), ' '), '') AS shown FROM documents""")
def _(s, d):
    lang = F.when(F.col("lang") == "en", "en")
    return t(s, d, "documents").select("doc_id", text.evidence_lines(F.col("doc_id"), F.col("doc_id") / 10, F.col("source"), F.col("text"), lang=lang).alias("shown"))


@query("o10_newest_lines", "SELECT event_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50")
def _(s, d):
    return t(s, d, "events").where("event_type = 'error'").select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(50)


@query("s57_referenced_ids", r"""SELECT DISTINCT unnest(regexp_extract_all(url, '([0-9]+)', 1)) AS ref FROM pages""")
def _(s, d):
    return t(s, d, "pages").select(F.explode(F.regexp_extract_all("url", F.lit("([0-9]+)"), F.lit(1))).alias("ref")).distinct()


@query("s48_feedback_export", "SELECT doc_id, quality FROM labels WHERE quality = 1 ORDER BY doc_id DESC")
def _(s, d):
    return t(s, d, "labels").where("quality = 1").select("doc_id", "quality").orderBy(F.desc("doc_id"))


@query("f18_dynamic_filters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000 AND NOT starts_with(o_orderpriority, '5')")
def _(s, d):
    clauses = {"status": F.col("o_orderstatus") == "O", "price": F.col("o_totalprice") > 1000, "unset": None, "priority": ~F.col("o_orderpriority").startswith("5")}
    df = t(s, d, "orders")
    for c in clauses.values():
        df = df if c is None else df.where(c)
    return df.select("o_orderkey")


@query("vx_nearest_vectors", """WITH e AS (SELECT vec_id, embedding AS v FROM embeddings), q AS (SELECT vec_id AS q, v AS qv FROM e WHERE vec_id % 100 = 0),
 p AS (SELECT q, vec_id, round(list_dot_product(CAST(qv AS DOUBLE[]), CAST(v AS DOUBLE[])), 4) AS score FROM q CROSS JOIN e WHERE vec_id <> q)
 SELECT q, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rn FROM p) WHERE rn <= 5""")
def _(s, d):
    e = t(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return vectors.nearest(e, F.col("vec_id") % 100 == 0, "vec_id", "v", 5, 4).select(F.col("query").alias("q"), "vec_id")  # the stated query set, against all rows

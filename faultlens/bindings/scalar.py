"""Scalar functions over texts derived from whole fixture tables (none has commits or logs) and over their columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.bindings.registry import Derived, query
from faultlens.functions import stack, symbols, text
from faultlens.session import table as t

BODIES = Derived("id long, body string", [
    ("net: fix leak {k}\n\nFixes: 1a2B3{h} (\"old\")\nFixes: deadbeef\nReported-by: A Person {a} <a{k}@x.org>\nCloses: https://bugzilla.kernel.org/show_bug.cgi?id={k}\nLink: https://lore.kernel.org/netdev/20240101.{k}-2@mail.org/\nSee bsc#77{k}, bug 9 and CVE-2024-1234",),
    ("mainline inclusion\nfrom mainline-v6.1\ncommit ABCDEF{h}\ncategory: bugfix\n\n--------------\n\nreal text\nReviewed-by: R {a} <r@v.org>\nTested-by: T Ester <t{k}@e.org>",),
    ("stable inclusion\nfrom stable-v5.10.3\ncommit 1111{h}\n---\n\n[ Upstream commit 2222{h} ]\ncve-2023-99999 CVE-2023-99999",),
    ("driver{a} inclusion\ncommit {h}\n----\ntext",),
    ("Merge pull request from {a}\n",),
    ("",),
    (None,),
    ("stable inclusion\ncommit {h}\n",),
    ("trackers: https://tracker-a.org/kernel/issues/i12{a} and https://tracker-b.org/kernel/issues/{k} twice https://tracker-b.org/kernel/issues/{k}",),
])
SUBJECTS = Derived("id long, subject string", [("[PATCH v3 2/7] net: {a}",), ("[RFC PATCH] {a}",), ("Re: z",), ("[patch 1/{k}] w",), ("[PATCH net-next v{k}] q",), (None,)])
QUESTIONS = Derived("id long, q string", [
    ("How does the OOM killer in v6.6 relate to CVE-2024-{k}6926 and commit {h}?",), ("what is this",), ("mainline tcp_{a} crash, tcp_{a} again on 5.10",), ("\"Quoted\" words 'and' Words {a} quoted a1 16.60",),
])
CONTEXTS = Derived("id long, context string", [
    ("static int tcp_{a}(struct sock *sk)",), ("#define WRITE_{k}(x) foo",), ("struct nla_{a} ifla_{a}[IFLA_MAX+1] = {",), ("if (x == y)",), ("config = 3",), ("SOME_MACRO_LIST",), ("",), ("return foo_{a} == 3",),
    ("struct Tcp{k}State",), ("while (do_{a}(b))",), ("my_{a} = init",), (None,),
])
FILES = Derived("id long, file string", [("net/ipv{g}/tcp.c",), ("net/ipv{g}/udp.c",), ("net/ipv4/tcp.c",), ("net/ipv6/tcp.c",), ("Makefile",), ("drivers/net/ethernet/intel/e{k}/x.c",), ("net/{a}.c",)], "lineitem", "l_orderkey", "(l_orderkey % 3 * 2 + l_linenumber % 2 + CAST(l_linenumber = 7 AS INT) * 4)")

_HEX = "[0-9a-f]{7,40}"


@query("x01_fixes_trailers", f"""WITH {BODIES.sql('b')} SELECT id, [lower(x) FOR x IN regexp_extract_all(coalesce(body, ''), '(?im)^Fixes:\\s+({_HEX})', 1)] AS fixes,
 [trim(x) FOR x IN regexp_extract_all(coalesce(body, ''), '(?im)^Reported-by:[^\\S\\n]*(\\S[^\\n]*)', 1)] AS reported FROM b""")
def _(s, d):
    return BODIES.df(s, d).select("id", text.fixes(F.col("body")).alias("fixes"), text.reported_by(F.col("body")).alias("reported"))


@query("x03_url_trailers", f"""WITH {BODIES.sql('b')} SELECT id, regexp_extract_all(coalesce(body, ''), '(?im)^Closes:\\s*(https?://\\S+)', 1) AS closes, regexp_extract_all(coalesce(body, ''), '(?im)^Link:\\s*(https?://\\S+)', 1) AS links FROM b""")
def _(s, d):
    return BODIES.df(s, d).select("id", text.trailer_urls(F.col("body"), "Closes").alias("closes"), text.trailer_urls(F.col("body"), "Link").alias("links"))


@query("x04_review_trailers", f"""WITH {BODIES.sql('b')}, m AS (SELECT id, unnest(regexp_extract_all(coalesce(body, ''), '(?im)^(?:Reviewed|Acked|Tested|Signed-off|Reported)-by:[^\\n]*<[^>\\n]+>')) AS line FROM b)
 SELECT id, lower(regexp_extract(line, '^([A-Za-z-]+)-by', 1)) AS kind, trim(regexp_extract(line, ':([^<]*)<', 1)) AS name, regexp_extract(line, '<([^>]+)>', 1) AS email FROM m""")
def _(s, d):
    return BODIES.df(s, d).select("id", F.explode(text.review_trailers(F.col("body"))).alias("r")).select("id", "r.kind", F.trim("r.name").alias("name"), "r.email")


@query("x05_patch_tag", f"""WITH {SUBJECTS.sql('b')} SELECT id, regexp_matches(subject, '(?i)\\[[^\\]]*PATCH[^\\]]*\\]') AS is_patch, TRY_CAST(nullif(regexp_extract(subject, '(?i)\\[[^\\]]*\\bv(\\d+)[^\\]]*\\]', 1), '') AS INTEGER) AS version,
 TRY_CAST(nullif(regexp_extract(subject, '\\[[^\\]]*\\b(\\d+)/(\\d+)\\]', 1), '') AS INTEGER) AS number, TRY_CAST(nullif(regexp_extract(subject, '\\[[^\\]]*\\b(\\d+)/(\\d+)\\]', 2), '') AS INTEGER) AS total FROM b""")
def _(s, d):
    return SUBJECTS.df(s, d).select("id", text.patch_tag(F.col("subject")).alias("p")).select("id", "p.*")


@query("x06_inclusion_header", f"""WITH {BODIES.sql('b')}, z AS (SELECT id, coalesce(body, '') AS body, regexp_split_to_array(coalesce(body, ''), '(?m)^-{{3,}}[^\\S\\n]*$') AS p FROM b),
 m AS (SELECT id, body, lower(nullif(regexp_extract(p[1], '(?im)^([\\w\\-]+)\\s+inclusion\\s*\\n(?:from\\s+\\S+\\s*\\n)?commit\\s+({_HEX})\\b', 1), '')) AS tag, lower(nullif(regexp_extract(p[1], '(?im)^([\\w\\-]+)\\s+inclusion\\s*\\n(?:from\\s+\\S+\\s*\\n)?commit\\s+({_HEX})\\b', 2), '')) AS head,
 lower(nullif(regexp_extract(coalesce(p[2], ''), '\\[\\s*[Uu]pstream\\s+commit\\s+({_HEX})\\s*\\]', 1), '')) AS up FROM z)
 SELECT id, CASE WHEN regexp_matches(body, '(?im)^Merge pull request') THEN 'merge' WHEN tag IS NULL THEN 'no_header' WHEN tag IN ('mainline', 'stable') THEN 'backport' ELSE 'native' END AS kind, tag, head,
 CASE WHEN tag = 'stable' THEN up END AS upstream, CASE WHEN tag = 'mainline' THEN head WHEN tag = 'stable' THEN coalesce(up, head) END AS best FROM m""")
def _(s, d):
    return BODIES.df(s, d).select("id", text.inclusion(F.col("body")).alias("i")).select("id", "i.*")


@query("x08_subsystem", f"""WITH {FILES.sql('f')}, dirs AS (SELECT id, min(regexp_replace(file, '[^/]*$', '')) AS a, max(regexp_replace(file, '[^/]*$', '')) AS b FROM f WHERE contains(file, '/') GROUP BY 1),
 n AS (SELECT id, a, (SELECT coalesce(max(i), 0) FROM range(1, 200) r(i) WHERE left(a, i) = left(b, i) AND i <= least(length(a), length(b))) AS n FROM dirs)
 SELECT k.id, nullif(array_to_string(list_slice(string_split(regexp_replace(left(n.a, n.n), '/+$', ''), '/'), 1, 3), '/'), '') AS subsystem FROM (SELECT DISTINCT id FROM f) k LEFT JOIN n ON n.id = k.id""")
def _(s, d):
    return FILES.df(s, d).groupBy("id").agg(F.collect_list("file").alias("files")).select("id", text.subsystem(F.col("files")).alias("subsystem"))


@query("x09_bug_references", f"""WITH {BODIES.sql('b')} SELECT DISTINCT id, ref, link_type FROM (SELECT id, unnest(regexp_extract_all(body, 'bugzilla\\.kernel\\.org/show_bug\\.cgi\\?id=(\\d+)', 1)) AS ref, 'closes' AS link_type FROM b
 UNION ALL SELECT id, unnest(regexp_extract_all(body, '(?i)(?:bsc#|BZ-|bz#|bug #?)(\\d+)', 1)), 'fixes' FROM b)""")
def _(s, d):
    return BODIES.df(s, d).select("id", F.explode(text.bug_refs(F.col("body"))).alias("r")).select("id", F.col("r.id").alias("ref"), "r.link_type")


@query("x10_message_ids", f"""WITH {BODIES.sql('b')} SELECT id, unnest(regexp_extract_all(body, '(?i)https?://lore\\.kernel\\.org/[^\\s]+/([^/\\s>]+@[^/\\s>]+)', 1)) AS message_id FROM b""")
def _(s, d):
    return BODIES.df(s, d).select("id", F.explode(text.message_ids(F.col("body"))).alias("raw")).select("id", text.clean_message_id(F.col("raw")).alias("message_id")).where("message_id is not null")


@query("x12_issue_ids", f"""WITH {BODIES.sql('b')} SELECT id, list_sort(list_distinct([upper(x) FOR x IN regexp_extract_all(body, '(?i)tracker-a\\.org/kernel/issues/([A-Z0-9]+)', 1)])) AS a, list_sort(list_distinct(regexp_extract_all(body, '(?i)tracker-b\\.org/kernel/issues/(\\d+)', 1))) AS b FROM b WHERE body IS NOT NULL""")
def _(s, d):
    body = F.col("body")
    return BODIES.df(s, d).where("body is not null").select("id", F.array_sort(text.issue_ids(body, r"tracker-a\.org/kernel", "[A-Z0-9]+")).alias("a"), F.array_sort(text.issue_ids(body, r"tracker-b\.org/kernel", r"\d+")).alias("b"))


@query("x14_question_parse", f"""WITH {QUESTIONS.sql('b')} SELECT id, list_sort(list_distinct([upper(x) FOR x IN regexp_extract_all(q, '(?i)CVE-\\d{{4}}-\\d{{4,7}}')])) AS cves, regexp_extract_all(q, '\\b[0-9a-f]{{7,40}}\\b') AS hashes,
 CASE WHEN regexp_matches(q, '(^|[^\\d.])v?6\\.6([^\\d]|$)') THEN 'LTS-6.6' WHEN regexp_matches(q, '(^|[^\\d.])v?5\\.10([^\\d]|$)') THEN 'LTS-5.10' WHEN regexp_matches(q, '(?i)\\bmainline\\b') THEN 'mainline' END AS version FROM b""")
def _(s, d):
    q = F.col("q")
    return QUESTIONS.df(s, d).select("id", text.cve_ids(q).alias("cves"), text.hashes(q).alias("hashes"), text.version_label(q).alias("version"))


@query("x15_keywords", f"""WITH {QUESTIONS.sql('b')} SELECT id, list_slice([x FOR x IN regexp_extract_all(lower(q), '[a-z_][a-z0-9_]{{2,}}') IF x NOT IN ({", ".join(repr(w) for w in text.QUESTION_STOP_WORDS)})], 1, 15) AS words FROM b""")
def _(s, d):
    return QUESTIONS.df(s, d).select("id", text.keywords(F.col("q")).alias("words"))


@query("x16_status_map", "WITH b AS (SELECT DISTINCT event_type FROM events) SELECT event_type, CASE upper(event_type) WHEN 'ERROR' THEN 'failed' WHEN 'VIEW' THEN 'new' ELSE lower(event_type) END AS status FROM b")
def _(s, d):
    return t(s, d, "events").select("event_type").distinct().select("event_type", text.mapped(F.col("event_type"), {"ERROR": "failed", "VIEW": "new"}).alias("status"))


@query("x19_versions_in_text", r"SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, '\bv?(\d+\.\d+(?:\.\d+)?)\b', 1))) AS versions FROM pages")
def _(s, d):
    return t(s, d, "pages").select("page_id", text.versions(F.col("html")).alias("versions"))


@query("x21_symbols", CONTEXTS.expected("id, symbol, kind", {
    0: ["id, 'tcp_' || a, 'function'"], 1: ["id, 'WRITE_' || k, 'macro'"], 2: ["id, 'ifla_' || a, 'struct'"], **{i: ["id, NULL, 'unknown'"] for i in (3, 4, 6, 11)}, 5: ["id, 'SOME_MACRO_LIST', 'unknown'"],
    7: ["id, 'foo_' || a, 'unknown'"], 8: ["id, 'Tcp' || k || 'State', 'unknown'"], 9: ["id, 'do_' || a, 'function'"], 10: ["id, 'my_' || a, 'struct'"],
}))
def _(s, d):
    return CONTEXTS.df(s, d).select("id", symbols.symbol(F.col("context")).alias("s")).select("id", "s.*")


_TRACE = "[  {t}.3] Call Trace:\n <TASK>\n [  {t}.4]  foo_{a}+0x{o}/0x34 [mod]\n baz_qux+0x1/0x2\n ? dump_stack+0x1/0x2\n third_fn+0x9/0x10 fs/x.c:123\n"
TRACES = Derived("id long, trace string", [(_TRACE.replace("{t}", "12").replace("{o}", "12"),), (_TRACE.replace("{t}", "55").replace("{o}", "99"),), ("nothing {a}",), (None,)])
_BLOCK = "' [  {0}.4]  foo_' || a || '+0x{1}/0x34 [mod]' || chr(10) || ' baz_qux+0x1/0x2' || chr(10) || ' ? dump_stack+0x1/0x2' || chr(10) || ' third_fn+0x9/0x10 fs/x.c:123'"
_SIGNED = "left(sha256('foo_' || a || '|baz_qux|third_fn'), 32)"


@query("x24_stack_signature", TRACES.expected("id, signature, block", {0: [f"id, {_SIGNED}, {_BLOCK.format(12, 12)}"], 1: [f"id, {_SIGNED}, {_BLOCK.format(55, 99)}"], 2: ["id, '', NULL"], 3: ["id, '', NULL"]}))
def _(s, d):
    return TRACES.df(s, d).select("id", stack.signature(F.col("trace")).alias("signature"), stack.extract_trace(F.col("trace")).alias("block"))


@query("x45_overlap_of_texts", r"""WITH l AS (SELECT item_id, text FROM benchmark), d AS (SELECT doc_id, text FROM documents),
 a AS (SELECT item_id, list_distinct([x FOR x IN regexp_extract_all(lower(text), '[a-z0-9_]{4,}') IF x NOT IN ('with', 'that')]) AS w FROM l), b AS (SELECT doc_id, list_distinct([x FOR x IN regexp_extract_all(lower(text), '[a-z0-9_]{4,}') IF x NOT IN ('with', 'that')]) AS w FROM d)
 SELECT a.item_id, b.doc_id, round(len(list_intersect(a.w, b.w)) * 1.0 / len(a.w), 6) AS share FROM a JOIN b ON a.item_id = b.doc_id WHERE len(a.w) > 0""")
def _(s, d):
    a = t(s, d, "benchmark").select("item_id", F.col("text").alias("claim"))
    b = t(s, d, "documents").select("doc_id", "text")
    stop = ["with", "that"]
    return a.join(b, F.col("item_id") == F.col("doc_id")).where(F.size(text.significant_tokens(F.col("claim"), stop)) > 0).select("item_id", "doc_id", F.round(text.overlap(F.col("claim"), F.col("text"), stop), 6).alias("share"))


@query("x60_content_ids", "SELECT conv_id, turn, left(sha256(coalesce(text, '') || chr(1) || role), 32) AS event_id FROM conversations")
def _(s, d):
    return t(s, d, "conversations").select("conv_id", "turn", F.substring(F.sha2(F.concat(F.coalesce("text", F.lit("")), F.lit("\1"), "role"), 256), 1, 32).alias("event_id"))


@query("x63_level_rank", "SELECT event_id, CASE upper(event_type) WHEN 'ERROR' THEN 3 ELSE 1 END AS level FROM events")
def _(s, d):
    return t(s, d, "events").select("event_id", text.level_rank(F.col("event_type")).alias("level"))


@query("x54_thread_format", """SELECT conv_id, left(string_agg(role || ': ' || left(text, 800), chr(10) ORDER BY turn), 12000) AS said FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE text IS NOT NULL) WHERE rn <= 50 GROUP BY 1""")
def _(s, d):
    from faultlens.operators.ranking import top_n

    c = top_n(t(s, d, "conversations").where("text is not null"), ["conv_id"], [F.col("turn")], 50)
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), F.left("text", F.lit(800))).alias("line"))))
    return c.groupBy("conv_id").agg(F.left(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), F.lit(12000)).alias("said"))

"""Full-text search over documents, conversations and pages."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from faultlens.bindings.registry import query
from faultlens.plans import routes, search
from faultlens.plans.segments import SegmentIndex
from faultlens.session import checkpointed, shared_folder
from faultlens.session import table as t

_written: dict[tuple[str, str, str], SegmentIndex] = {}


def _once(s, d, name: str, make) -> SegmentIndex:
    """An index that is written to the shared folder once an application and read by every query."""
    at = (s.sparkContext.applicationId, d, name)
    if at not in _written:
        _written[at] = make(f"{shared_folder(s)}/{name}-{uuid4().hex[:12]}")
    return _written[at]


def index(s, d) -> SegmentIndex:
    return _once(s, d, "search-index", lambda place: SegmentIndex.write(t(s, d, "documents"), "doc_id", "text", place))


def changed_index(s, d) -> SegmentIndex:
    """Documents that came in steps: nine tenths at first, the others later; then a tenth is changed and a tenth deleted."""

    def make(place: str) -> SegmentIndex:
        docs = t(s, d, "documents").select("doc_id", "text")
        tenth = lambda k: docs.where(F.pmod("doc_id", F.lit(10)) == k)
        first = SegmentIndex.write(docs.where(F.pmod("doc_id", F.lit(10)) != 1), "doc_id", "text", place)
        changed = tenth(2).withColumn("text", F.concat(F.lit("the que "), F.reverse(F.coalesce("text", F.lit("")))))
        return first.update(tenth(1)).update(changed).update(deleted=tenth(3))

    return _once(s, d, "changed-index", make)


_TOK = r"""tok AS (SELECT doc_id, lang, source, string_split_regex(lower(text), '[^\p{L}\p{N}_]+') AS t0 FROM documents), docs AS (SELECT doc_id, lang, source, [x FOR x IN t0 IF x <> ''] AS t FROM tok)"""


def _bm25(words: list[str]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""{_TOK}, stats AS (SELECT count(*) AS n, avg(len(t)) AS avg_dl FROM docs), p AS (SELECT doc_id, term, len(t) AS dl, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM docs) WHERE term IN ({listed}) GROUP BY doc_id, term, len(t)),
 df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
 bm AS (SELECT doc_id, count(*) AS matched, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avg_dl))) AS score FROM p JOIN df USING (term) CROSS JOIN stats GROUP BY 1)"""


@query("r01_term_statistics", f"WITH {_TOK} SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(t) AS term FROM docs) GROUP BY 1")
def _(s, d):
    return index(s, d).all.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))


@query("r02_all_words", f"WITH {_bm25(['the', 'was', 'onha'])} SELECT doc_id, round(score, 6) AS score FROM bm WHERE matched = 3")
def _(s, d):
    return index(s, d).bm25(["the", "was", "onha"], match_all=True).select("doc_id", F.round("score", 6).alias("score"))


@query("r04_any_word_top", f"WITH {_bm25(['die', 'que', 'tion', 'the'])} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, doc_id LIMIT 50")
def _(s, d):
    out = index(s, d).bm25(["die", "que", "tion", "the"])
    return out.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


@query("r04_block_max_top", f"WITH {_bm25(['die', 'que', 'tion', 'onha'])} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, doc_id LIMIT 50")
def _(s, d):
    return index(s, d).top_k(["die", "que", "tion", "onha"], 50)


_CHANGED = "now AS (SELECT doc_id, CASE WHEN doc_id % 10 = 2 THEN 'the que ' || reverse(coalesce(text, '')) ELSE text END AS text, lang, source FROM documents WHERE doc_id % 10 <> 3), "


@query("r01_changed_index", f"WITH {_CHANGED}{_bm25(['the', 'que', 'onha']).replace('FROM documents', 'FROM now')} SELECT doc_id, matched, round(score, 6) AS score FROM bm")
def _(s, d):
    return changed_index(s, d).bm25(["the", "que", "onha"]).select("doc_id", "matched", F.round("score", 6).alias("score"))


@query("r01_changed_index_top", f"WITH {_CHANGED}{_bm25(['the', 'que', 'onha']).replace('FROM documents', 'FROM now')} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, doc_id LIMIT 40")
def _(s, d):
    return changed_index(s, d).top_k(["the", "que", "onha"], 40)


_TIER_WORDS = ["the", "of", "er", "tionthe", "zzzz"]


@query("r05_tiers", f"""WITH {_TOK}, f AS (SELECT doc_id, CASE WHEN list_has_all(t, ['the','of','er','tionthe','zzzz']) THEN 5 WHEN list_has_all(t, ['the','of','er','tionthe']) THEN 4 WHEN list_has_all(t, ['the','of','er']) THEN 3 WHEN list_has_all(t, ['the','of']) THEN 2 WHEN list_contains(t, 'the') THEN 1 ELSE 0 END AS prefix,
 list_has_any(t, ['the','of','er','tionthe','zzzz']) AS hit FROM docs), c AS (SELECT max(k) AS tier FROM range(1, 6) r(k) WHERE (SELECT count(*) FROM f WHERE prefix >= k) >= 3)
 SELECT doc_id, CAST(prefix AS INTEGER) AS prefix, CAST(coalesce(tier, 0) AS INTEGER) AS tier FROM f CROSS JOIN c WHERE hit AND (coalesce(tier, 0) = 0 OR prefix >= tier)""")
def _(s, d):
    return index(s, d).tiers(_TIER_WORDS).select("doc_id", "prefix", "tier")


@query("r06_filtered_route", f"WITH {_bm25(['the', 'of'])} SELECT b.doc_id, round(score, 6) AS score, left(d.text, 500) AS body FROM bm b JOIN documents d USING (doc_id) WHERE d.lang = 'en' AND NOT starts_with(d.text, 'The') ORDER BY round(score, 6) DESC, doc_id LIMIT 100")
def _(s, d):
    docs = t(s, d, "documents")
    hits = index(s, d).bm25(["the", "of"])
    kept = docs.where((F.col("lang") == "en") & ~F.col("text").startswith("The"))
    return hits.join(kept, "doc_id").select("doc_id", F.round("score", 6).alias("score"), F.left("text", F.lit(500)).alias("body")).orderBy(F.desc("score"), "doc_id").limit(100)


@query("r03_cover_density", None)
def _(s, d):
    return index(s, d).cover_rank(["the", "of"])


_HITS = """hits AS (SELECT 'bug' AS route, p_partkey AS id, CAST(p_size AS DOUBLE) AS score, CAST(p_size % 3 AS INTEGER) AS tier FROM part WHERE p_size > 45 UNION ALL SELECT 'cve', s_suppkey, CAST(s_suppkey % 17 AS DOUBLE), 0 FROM supplier UNION ALL SELECT 'commit', o_orderkey, CAST(o_orderkey % 29 AS DOUBLE), 1 FROM orders WHERE o_orderstatus = 'P')"""


@query("r15_inject_and_merge", f"""WITH {_HITS}, e AS (SELECT DISTINCT l_partkey AS bug, l_suppkey AS cve, l_orderkey AS target FROM lineitem WHERE l_returnflag = 'R'),
 top AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY score DESC, id) AS k FROM hits),
 cve_ AS (SELECT t.score * 0.9 AS score, e.target AS id, 1 AS step FROM top t JOIN (SELECT DISTINCT cve, target FROM e) e ON e.cve = t.id WHERE t.route = 'cve' AND k <= 10),
 bug_ AS (SELECT score, id, step FROM (SELECT t.score * 0.9 AS score, e.target AS id, 2 AS step, row_number() OVER (PARTITION BY t.id ORDER BY e.target) AS r FROM top t JOIN (SELECT DISTINCT bug, target FROM e) e ON e.bug = t.id WHERE t.route = 'bug' AND k <= 10) WHERE r <= 5),
 every AS (SELECT route, id, score, tier, 0 AS step FROM hits UNION ALL SELECT 'commit', id, score, 0, step FROM cve_ UNION ALL SELECT 'commit', id, score, 0, step FROM bug_),
 once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY route, id ORDER BY step, score DESC) AS rn FROM every) WHERE rn = 1),
 n AS (SELECT route, id, step, score / CASE WHEN max(score) OVER (PARTITION BY route) = 0 THEN 1 ELSE max(score) OVER (PARTITION BY route) END * (1 + 0.25 * tier) AS final FROM once)
 SELECT route, id, step, round(final, 6) AS final FROM n ORDER BY round(final, 6) DESC, route, id LIMIT 100""")
def _(s, d):
    hits = (
        t(s, d, "part").where("p_size > 45").select(F.lit("bug").alias("route"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("score"), (F.col("p_size") % 3).cast("int").alias("tier"))
        .unionByName(t(s, d, "supplier").select(F.lit("cve").alias("route"), F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 17).cast("double").alias("score"), F.lit(0).alias("tier")))
        .unionByName(t(s, d, "orders").where("o_orderstatus = 'P'").select(F.lit("commit").alias("route"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 29).cast("double").alias("score"), F.lit(1).alias("tier")))
    )
    e = t(s, d, "lineitem").where("l_returnflag = 'R'")
    by = lambda c: e.select(F.col(c).alias("source"), F.col("l_orderkey").alias("target"))
    hits = checkpointed(hits)  # they are read three times
    more = [search.inject(hits, by("l_suppkey"), "cve", 0.9, 1), search.inject(hits, by("l_partkey"), "bug", 0.9, 2, per_source=5)]
    return search.merged(hits, more).select("route", "id", "step", F.round("final", 6).alias("final"))


@query("r09_exact_ids_first", f"WITH {_bm25(['the'])}, x AS (SELECT doc_id, 1.0 AS score, 0 AS place FROM documents WHERE doc_id IN (3, 5, 8) UNION ALL SELECT * FROM (SELECT doc_id, round(score, 6), 1 FROM bm ORDER BY round(score, 6) DESC, doc_id LIMIT 7)) SELECT doc_id, CAST(score AS DOUBLE) AS score, place FROM x")
def _(s, d):
    docs = t(s, d, "documents")
    exact = docs.where(F.col("doc_id").isin(3, 5, 8)).select("doc_id", F.lit(1.0).alias("score"), F.lit(0).alias("place"))
    rest = index(s, d).bm25(["the"]).select("doc_id", F.round("score", 6).alias("score"), F.lit(1).alias("place")).orderBy(F.desc("score"), "doc_id").limit(7)
    return exact.unionByName(rest)


@query("r13_per_token_fallback", f"""WITH {_TOK}, h AS (SELECT w.tok, doc_id, len([x FOR x IN t IF x = w.tok]) AS tf FROM docs CROSS JOIN (VALUES ('the'), ('que'), ('und')) w(tok) WHERE list_contains(t, w.tok)),
 r AS (SELECT tok, doc_id, tf FROM (SELECT *, row_number() OVER (PARTITION BY tok ORDER BY tf DESC, doc_id) AS rn FROM h) WHERE rn <= 3) SELECT doc_id, CAST(max(tf) AS BIGINT) AS tf FROM r GROUP BY 1""")
def _(s, d):
    from faultlens.operators.ranking import top_n

    found = index(s, d).postings(["the", "que", "und"])
    return top_n(found, ["term"], [F.desc("tf"), F.col("doc_id")], 3).groupBy("doc_id").agg(F.max("tf").alias("tf"))


_KIND = ["commit", "bug", "cve", "mail"]  # of a document: its doc_id modulo 4
_ASKED = ["the", "of", "zzzz"]
_LINKS = {
    "commit_message": "SELECT DISTINCT CAST(l_partkey * 4 + 3 AS STRING) AS message, CAST(l_suppkey * 4 AS STRING) AS commit FROM lineitem WHERE l_returnflag = 'R'",
    "commit_cve": "SELECT DISTINCT CAST(l_partkey * 4 + 2 AS STRING) AS cve, CAST(l_suppkey * 4 AS STRING) AS commit FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1",
    "commit_bug": "SELECT DISTINCT CAST(l_partkey * 4 + 1 AS STRING) AS bug, CAST(l_suppkey * 4 AS STRING) AS commit FROM lineitem WHERE l_returnflag = 'N'",
    "commit_fixes": "SELECT DISTINCT CAST(l_partkey * 4 AS STRING) AS fixer, CAST(l_suppkey * 4 AS STRING) AS fixed FROM lineitem WHERE l_linenumber < 4",
    "commit_revert": "SELECT DISTINCT CAST(l_partkey * 4 AS STRING) AS reverter, CAST(l_suppkey * 4 AS STRING) AS reverted FROM lineitem WHERE l_linenumber > 6",
}


def _route_hits(s, d, limit):
    docs = t(s, d, "documents")
    at = (index(s, d), docs, "source", "text")
    made = {}
    for i, name in enumerate(_KIND):
        kept = F.col("doc_id") % 4 == i
        kept = kept & (F.col("lang") != "fr") if name == "commit" else kept
        made[name] = lambda name=name, kept=kept: routes.tiered(name, at, _ASKED, limit, kept)
    return routes.fan_out(made | {"failing": lambda: made["no such route"]()})


def _route_sql(limit: int) -> str:
    return f"""{_bm25(_ASKED)}, k AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'commit' WHEN 1 THEN 'bug' WHEN 2 THEN 'cve' ELSE 'mail' END AS route, source AS title, left(text, 500) AS body,
 list_has_any(t, ['the', 'of', 'zzzz']) AS hit, CASE WHEN list_has_all(t, ['the', 'of', 'zzzz']) THEN 3 WHEN list_has_all(t, ['the', 'of']) THEN 2 WHEN list_contains(t, 'the') THEN 1 ELSE 0 END AS prefix FROM documents JOIN (SELECT doc_id, t FROM docs) USING (doc_id) WHERE doc_id % 4 > 0 OR lang <> 'fr'),
 c AS (SELECT route, max(p) AS tier FROM (SELECT a.route, p, count(*) AS n FROM k a, range(1, 4) x(p) WHERE prefix >= p GROUP BY 1, 2) WHERE n >= 3 GROUP BY 1),
 hits AS (SELECT route, CAST(doc_id AS VARCHAR) AS id, round(score, 6) AS score, tier, title, body FROM (SELECT k.*, bm.score, coalesce(c.tier, 0) AS tier, row_number() OVER (PARTITION BY route ORDER BY round(bm.score, 6) DESC, doc_id) AS rn FROM k JOIN bm USING (doc_id) LEFT JOIN c USING (route) WHERE hit AND (c.tier IS NULL OR prefix >= c.tier)) WHERE rn <= {limit})"""


@query("r14_fan_out", f"WITH {_route_sql(30)} SELECT route, id, score, CAST(tier AS INTEGER) AS tier, title, body FROM hits")
def _(s, d):
    return _route_hits(s, d, 30)[0]


_STEPS = [("mail", "commit_message", "message", "commit"), ("cve", "commit_cve", "cve", "commit"), ("bug", "commit_bug", "bug", "commit"), ("commit", "commit_fixes", "fixer", "fixed"), ("commit", "commit_revert", "reverter", "reverted")]


def _linked_sql() -> str:
    out = ", ".join(f"{n} AS ({q})" for n, q in _LINKS.items())
    out += ", real AS (SELECT CAST(doc_id AS VARCHAR) AS other, source AS title FROM documents WHERE doc_id % 4 = 0), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY score DESC, id) AS b FROM hits) WHERE b <= 10)"
    parts = []
    for step, (route, table, a, b) in enumerate(_STEPS, 1):
        factor = 0.9 if step < 4 else 0.85
        edges = f"SELECT {a} AS node, {b} AS other FROM {table}" + (f" UNION SELECT {b}, {a} FROM {table}" if step > 3 else "")
        most = {3: "WHERE r <= 5", 4: "WHERE r <= 50", 5: "WHERE r <= 20"}.get(step, "")
        by = "PARTITION BY node ORDER BY e.other" if step == 3 else "ORDER BY h.score DESC, node, e.other"
        parts.append(f"SELECT other AS id, score * {factor} AS score, title, {step} AS step FROM (SELECT e.other, h.score, real.title, row_number() OVER ({by}) AS r FROM best h JOIN ({edges}) e ON e.node = h.id AND h.route = '{route}' JOIN real ON real.other = e.other) {most}")
    return out + ", linked AS (" + " UNION ALL ".join(parts) + ")"


@query("r16_linked_and_fused", f"""WITH {_route_sql(30)}, {_linked_sql()}, fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY step, score DESC) AS f FROM linked WHERE id NOT IN (SELECT id FROM hits WHERE route = 'commit')) WHERE f = 1),
 every AS (SELECT route, id, score, tier, title, body, 0 AS step FROM hits UNION ALL SELECT 'commit', id, score, NULL, title, '', step FROM fresh)
 SELECT route, id, round(score / max(score) OVER (PARTITION BY route) * (1 + 0.25 * coalesce(tier, 0)), 6) AS final, step, title, body FROM every""")
def _(s, d):
    docs, item = t(s, d, "documents"), t(s, d, "lineitem")
    tables = {n: item.where(q.partition(" WHERE ")[2]).selectExpr(*q.partition("SELECT DISTINCT ")[2].partition(" FROM ")[0].split(", ")).distinct() for n, q in _LINKS.items()}
    tables["commits"] = docs.where("doc_id % 4 = 0").select(F.col("doc_id").cast("string").alias("hash"), F.col("source").alias("subject"), F.lit(None).cast("date").alias("commit_date"))
    hits, _ = _route_hits(s, d, 30)
    return routes.fused(hits, routes.linked_commits(hits, tables))

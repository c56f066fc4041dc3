"""Tables that are kept and changed in part, reports on runs, reranked hits, a stored call graph."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

import faultlens.bindings.relational  # noqa: F401  (its SQL is used below)
from faultlens.bindings.registry import ORACLE, Derived, query
from faultlens.operators import callgraph
from faultlens.operators.bucketed import BucketedTable
from faultlens.operators.reports import Run
from faultlens.plans import rerank
from faultlens.session import shared_folder
from faultlens.session import table as t


def _place(s, name: str) -> str:
    return f"{shared_folder(s)}/{name}-{uuid4().hex[:12]}"


@query("s40_bucketed_upsert", ORACLE["s37_coalesce_merge"])
def _(s, d):
    """The same rows in two batches, the second delivered twice."""
    c = t(s, d, "customer")
    a = c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.when(F.col("c_nationkey") < 12, F.col("c_mktsegment")).alias("seg"))
    b = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.concat(F.lit("x"), "c_name").alias("name"), F.when(F.col("c_nationkey") > 5, F.lower("c_mktsegment")).alias("seg"))
    kept, few = BucketedTable.create(a, ["k"], _place(s, "bucketed"), 16), F.col("k") % 16 == 3
    return kept.apply(1, b.where(few), coalesce=("seg",)).apply(2, b.where(~few), coalesce=("seg",)).apply(2, b.where(~few), coalesce=("seg",)).read()


@query("s64_run_report", """SELECT 'long_texts' AS step, count(*) AS rows_in, count(*) FILTER (length(text) >= 200 AND lang = 'en') AS rows_out, count(*) FILTER (NOT coalesce(length(text) >= 200, false)) AS quarantined FROM documents
 UNION ALL SELECT 'sources', count(*), count(DISTINCT source), 0 FROM documents WHERE length(text) >= 200 AND lang = 'en'""")
def _(s, d):
    run, place = Run(s, "r", _place(s, "reports")), _place(s, "run")
    some = run.step("long_texts", t(s, d, "documents"), lambda rows: rows.where("lang = 'en'"), f"{place}/1", F.length("text") < 200)
    run.step("sources", some, lambda rows: rows.where("source is not null").select("source").distinct(), f"{place}/2")
    report, _ = run.close()
    return report.select("step", "rows_in", "rows_out", "quarantined")


@query("o03_rerank", """WITH h AS (SELECT conv_id, turn, coalesce(left(text, 1024), '') AS body, first_value(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn) AS question, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
 s AS (SELECT *, CASE WHEN n > 4 AND place <= 6 THEN (length(body) * 7 + length(question) * 3) % 101 / 101 END AS score FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round(score, 6) DESC NULLS LAST, place) AS rank FROM s WHERE n <= 4 OR place <= 6)
 SELECT conv_id, turn, CAST(rank AS INTEGER) AS rank, round(score, 6) AS rerank_score FROM r WHERE rank <= 3 OR n <= 4""")
def _(s, d):
    from pyspark.sql import Window

    def likeness(pairs: list[tuple[str, str]]) -> list[float]:
        return [(len(text) * 7 + len(question) * 3) % 101 / 101 for question, text in pairs]

    w = Window.partitionBy("conv_id").orderBy("turn")
    hits = t(s, d, "conversations").select("conv_id", "turn", "text", F.first(F.coalesce("text", F.lit(""))).over(w).alias("question"), F.row_number().over(w).alias("place"))
    return rerank.reranked(hits, lambda: likeness, ["conv_id"], "question", "text", "place", keep=3, threshold=4, cap=6).select("conv_id", "turn", "rank", F.round("rerank_score", 6).alias("rerank_score"))


CODE = Derived("file long, text string", [
    ("int f(void) { if (x) f{g}(a); return g(f{g} (b)); }",), ("static void f(int a) { while (f2(a)) h_{a}(f{k}(0)); }",), ("#define F(x) g(x)",), (None,), ("f(); /* sizeof(x) */ switch (z) { f7(f7(1)); }",),
])


@query("s61_call_graph", f"""WITH {CODE.sql('c')}, s AS (SELECT file, 'f' || CAST(file % 40 AS VARCHAR) AS symbol, text FROM c), e AS (SELECT file, symbol AS caller, unnest(regexp_extract_all(coalesce(text, ''), '\\b([A-Za-z_]\\w*)\\s*\\(', 1)) AS called FROM s),
 g AS (SELECT file, caller, called, count(*) AS times FROM e WHERE called NOT IN ('if', 'while', 'sizeof', 'switch') AND called <> caller GROUP BY 1, 2, 3), a AS (SELECT DISTINCT symbol FROM s),
 h AS (SELECT 'callers' AS direction, a.symbol, caller AS other, file, times FROM a JOIN g ON called = a.symbol UNION ALL SELECT 'callees', a.symbol, called, file, times FROM a JOIN g ON caller = a.symbol),
 r AS (SELECT *, row_number() OVER (PARTITION BY direction, symbol ORDER BY other, file) AS place FROM h) SELECT direction, symbol, CAST(place AS INTEGER) AS place, other, file, times FROM r WHERE place <= 50""")
def _(s, d):
    code = CODE.df(s, d).select("file", F.concat(F.lit("f"), F.col("file") % 40).alias("symbol"), "text")
    graph, asked = callgraph.CallGraph.write(code, _place(s, "calls")), code.select("symbol")
    one = lambda direction: graph.look_up(asked, direction).withColumn("direction", F.lit(direction))
    return one("callers").unionByName(one("callees"))


@query("g01_threads_in_batches", """WITH m AS (SELECT conv_id, concat(conv_id, '-', turn) AS id, CASE WHEN turn % 5 <> 1 THEN TIMESTAMP '2024-01-01' + to_minutes(CAST(turn AS INT)) END AS d FROM conversations)
 SELECT min(id) AS thread, count(DISTINCT id) AS message_count, min(d) AS date_start, max(d) AS date_end FROM m GROUP BY conv_id""")
def _(s, d):
    """Turns that come in three batches without order, each answering the turn before."""
    from pyspark.sql import Window

    from faultlens.operators.threads import Threads

    name = F.concat_ws("-", "conv_id", "turn")
    before = F.lag(name).over(Window.partitionBy("conv_id").orderBy("turn"))
    date = F.when(F.col("turn") % 5 != 1, F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("turn")))
    mail = t(s, d, "conversations").select(name.alias("id"), F.array(before).alias("refs"), date.alias("date"))
    kept = Threads(s, _place(s, "threads"))
    for batch in range(3):
        kept.add(batch, mail.where(F.pmod(F.xxhash64("id"), F.lit(3)) == batch))
    return kept.summary().withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("date_start", "date_end")})

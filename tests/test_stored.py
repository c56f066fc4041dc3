"""Buckets that stay as they are, reranking with scorers that fail, reports of failing steps, call graphs that are down."""

import pathlib

import pytest
from pyspark.sql import functions as F

from faultlens.operators import callgraph
from faultlens.operators.bucketed import BucketedTable
from faultlens.operators.reports import Run
from faultlens.plans import rerank


def test_upsert_leaves_other_buckets_alone(spark, tmp_path):
    rows = {i: (i, f"n{i}", None if i % 2 else i) for i in range(60)}
    schema = "k int, name string, v int"
    table = BucketedTable.create(spark.createDataFrame(list(rows.values()), schema), ["k"], f"file://{tmp_path}/t", 8)
    files = lambda: {p.name: p.stat().st_mtime_ns for p in pathlib.Path(tmp_path, "t", "data").rglob("*.parquet")}
    new = spark.createDataFrame([(3, "new", 33), (100, "more", None), (None, "no key", 1)], schema)
    before = files()
    after = table.apply(1, new, overwrite=("v",))
    assert before.items() <= files().items() and len(after.versions) == 8
    touched = [b for b, v in after.versions.items() if v == 1]
    assert 1 <= len(touched) <= 3 and all(after.versions[b] == 0 for b in after.versions if b not in touched)
    want = rows | {3: (3, "n3", 33), 100: (100, "more", None), None: (None, "no key", 1)}
    got = lambda x: sorted((tuple(r) for r in x.read().collect()), key=str)
    assert got(after) == sorted(want.values(), key=str) == got(BucketedTable(spark, f"file://{tmp_path}/t"))
    held = files()
    assert after.apply(1, new, overwrite=("v",)) is after and files() == held
    last = after.apply(5, spark.createDataFrame([(None, "x", 9)], schema), coalesce=("v",))
    assert got(last) == sorted((want | {None: (None, "no key", 9)}).values(), key=str)
    empty = BucketedTable.create(spark.createDataFrame([], schema), ["k"], f"file://{tmp_path}/e")
    assert got(empty) == [] and got(empty.apply(1, new)) == sorted([(3, "new", 33), (100, "more", None), (None, "no key", 1)], key=str)


def test_rerank(spark):
    hits = spark.createDataFrame([("q", i, "x" * i, i + 1) for i in range(6)] + [("r", 0, "only", 1), ("r", 1, None, 2)], "question string, id int, text string, place int")
    run = lambda make, **o: [(r["question"], r["id"], r["rank"], r["rerank_score"]) for r in rerank.reranked(hits, make, ["question"], "question", "text", "place", keep=3, threshold=2, **o).orderBy("question", "rank").collect()]
    by_length = lambda: lambda pairs: [float(len(t)) for _, t in pairs]
    rest = [("r", 0, 1, None), ("r", 1, 2, None)]
    assert run(by_length) == [("q", 5, 1, 5.0), ("q", 4, 2, 4.0), ("q", 3, 3, 3.0), *rest]
    first = [("q", 0, 1, None), ("q", 1, 2, None), ("q", 2, 3, None), *rest]

    def broken():
        raise OSError("no model")

    assert run(broken) == run(lambda: lambda pairs: 1 / 0) == first
    assert [r[1] for r in run(by_length, enabled=False)] == [0, 1, 2, 3, 4, 5, 0, 1] and [r[1] for r in run(by_length, cap=4)][:3] == [3, 2, 1]
    assert [r[:3] for r in run(lambda: lambda pairs: [])] == [r[:3] for r in first]  # no scores: all are 0
    assert [r[1] for r in run(lambda: lambda pairs: [2.0] * 99)][:3] == [0, 1, 2]


def test_reports(spark, tmp_path):
    run = Run(spark, "nightly", f"file://{tmp_path}/log")
    rows = spark.range(10).withColumn("v", F.when(F.col("id") != 4, F.col("id")))
    good = run.step("clean", rows, lambda r: r.where("id <> 7"), f"file://{tmp_path}/a", F.col("v") > 8)
    assert sorted(r["id"] for r in good.collect()) == [0, 1, 2, 3, 5, 6, 8]
    exact = run.step("exact", rows, lambda r: r, f"file://{tmp_path}/b", F.col("v") > 8, exact=True)
    assert exact.count() == 8
    with pytest.raises(Exception, match="nope|NOPE|cannot be resolved|UNRESOLVED"):
        run.step("broken", rows, lambda r: r.select("nope"), f"file://{tmp_path}/c")
    assert len(run.call("look", lambda n: spark.range(n), n=3)) == 3
    with pytest.raises(ValueError):
        run.call("fail", lambda: (_ for _ in ()).throw(ValueError("x")))
    report, calls = run.close()
    got = [(r["step"], r["rows_in"], r["rows_out"], r["quarantined"], r["outcome"]) for r in report.collect()]
    assert got == [("clean", 10, 7, 2, "ok"), ("exact", 10, 8, 2, "ok"), ("broken", None, None, None, "failed")]
    assert [(r["name"], r["rows"], r["outcome"]) for r in calls.collect()] == [("look", 3, "ok"), ("fail", None, "failed")]
    assert spark.read.json(f"file://{tmp_path}/log/report").count() == 3


def test_call_graph_and_its_fallback(spark, tmp_path):
    code = spark.createDataFrame([("a.c", "main", "if (x) go(go(1)); main(2);"), ("b.c", "go", "stop (3); sizeof(y)"), ("c.c", "other", "go()"), ("d.c", "none", None)], "file string, symbol string, text string")
    graph = callgraph.CallGraph.write(code, f"file://{tmp_path}/g")
    asked = spark.createDataFrame([("go",), (" go ",), ("",), (None,), ("unknown",)], "symbol string")
    rows = lambda df: [(r["symbol"], r["other"], r["file"], r["times"]) for r in df.orderBy("place").collect()]
    assert rows(graph.look_up(asked, "callers")) == [("go", "main", "a.c", 2), ("go", "other", "c.c", 1)]
    assert rows(graph.look_up(asked, "callees")) == [("go", "stop", "b.c", 1)]
    plan = graph.look_up(asked, "callers")._jdf.queryExecution().executedPlan().toString()
    assert "caller:string" in plan and "text:string" not in plan
    for healthy in (True, False):
        health = spark.createDataFrame([(healthy,)], "healthy boolean")
        found = callgraph.look_up(asked, graph, code, health, "callers")
        assert rows(found) == [("go", "main", "a.c", 2), ("go", "other", "c.c", 1)] and {r["degraded"] for r in found.collect()} == {not healthy}
    assert callgraph.look_up(asked, None, code, spark.createDataFrame([], "healthy boolean"), "callees").first()["degraded"]

"""Routes over a small index: tiers, exact ids, the mail merge, fallbacks, failing routes, order."""

import pytest

from faultlens.plans import routes
from faultlens.plans.search import Index


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [("A1", "net", "tcp leak in net"), ("A2", "net", "tcp leak again"), ("A3", "[stub upstream x]", "tcp leak leak"), ("A4", None, "tcp leak late"), ("A5", "fs", "ext leak"), ("A6", "x", None), ("A7", "", "")]
    df = spark.createDataFrame(rows, "id string, subject string, body string")
    return Index.write(df, "id", "body", f"file://{tmp_path_factory.mktemp('i')}/index"), df, "subject", "body"


def ids(df):
    return [r["id"] for r in df.collect()]


def test_tiers(docs):
    hits = routes.commits(docs, ["tcp", "leak"], 10)
    assert sorted(ids(hits)) == ["A1", "A2", "A4"] and {r["tier"] for r in hits.collect()} == {2}
    assert sorted(ids(routes.tiered("commit", docs, ["ext", "tcp"], 10))) == ["A1", "A2", "A3", "A4", "A5"]
    assert ids(routes.tiered("commit", docs, [], 10)) == [] == ids(routes.tiered("commit", docs, ["none"], 10))


def test_exact_ids_come_first(docs):
    got = routes.exact_first("cve", docs, ["a5", "a9"], ["tcp"], 3).collect()
    assert [(r["id"], r["score"], r["tier"]) for r in got][:1] == [("A5", 1.0, None)] and len(got) == 3
    assert ids(routes.exact_first("cve", docs, ["a1", "a5"], ["tcp"], 1)) in (["A1", "A5"], ["A5", "A1"])


def test_mail_keeps_local_text_and_the_larger_score(spark, docs):
    local = spark.createDataFrame([("mail", "m", 0.2, 2, "t", "whole"), ("mail", "n", 0.4, 2, "u", "b")], routes.HITS)
    archive = spark.createDataFrame([("m", "T", "cut", 1), ("o", "O", "s", 2)], "message string, title string, snippet string, place int")
    got = [tuple(r) for r in routes.mail(local, archive, 10).select("id", "score", "tier", "body").collect()]
    assert got == [("m", 1.0, 2, "whole"), ("n", 1.0, 2, "b"), ("o", 0.5, None, "s")]
    assert ids(routes.mail(local.limit(0), archive.limit(0), 10)) == []


def test_fallbacks(spark, docs):
    code = spark.createDataFrame([("code", "1", 1.0, 0, "a.rst", "x"), ("code", "2", 1.0, 0, "a.c", "x")], routes.HITS)
    assert ids(routes.documentation(docs, ["ext"], 5, code)) == ["A5"] and ids(routes.documentation(docs, ["zz", "e"], 5, code)) == ["1"]
    search = lambda words, limit: routes.tiered("code", docs, words, limit) if len(words) == 1 else routes.tiered("code", docs, [], limit)
    assert ids(routes.word_by_word(search, ["ext", "again"], 4)) == ["A5", "A2"]
    assert ids(routes.word_by_word(search, ["ext"], 4)) == ["A5"]


def test_fan_out_and_links(spark, docs):
    hits, failed = routes.fan_out({"commit": lambda: routes.commits(docs, ["tcp"], 1), "bad": lambda: docs[1].select("nothing"), "worse": lambda: spark.range(1).selectExpr("raise_error('x') as y")})
    assert hits.count() == 1 and set(failed) == {"bad", "worse"}
    with pytest.raises(RuntimeError):
        routes.fan_out({"bad": lambda: docs[1].select("nothing")})
    hits = spark.createDataFrame([("mail", "m", 2.0, 1, "", ""), ("bug", "7", 1.0, None, "", ""), ("commit", "A1", 4.0, 2, "", "")], routes.HITS)
    edges = {
        "commits": docs[1].selectExpr("id as hash", "subject", "date'2024-01-01' as commit_date"), "commit_message": [("m", "A1"), ("m", "A2"), ("m", "A3")], "commit_cve": [],
        "commit_bug": [("7", "A2"), ("7", "A4")], "commit_fixes": [("A5", "A1")], "commit_revert": [("A1", "A5"), ("A1", "A6")],
    }
    names = {"commit_message": "message", "commit_cve": "cve", "commit_bug": "bug", "commit_fixes": "fixer", "commit_revert": "reverter"}
    tables = {n: spark.createDataFrame(e, f"{names[n]} string, {({'fixer': 'fixed', 'reverter': 'reverted'}).get(names[n], 'commit')} string") if n in names else e for n, e in edges.items()}
    got = [(r["route"], r["id"], r["final"], r["step"]) for r in routes.fused(hits, routes.linked_commits(hits, tables)).collect()]
    assert got == [("commit", "A1", 1.5, 0), ("mail", "m", 1.25, 0), ("bug", "7", 1.0, 0), ("commit", "A5", 0.85, 4), ("commit", "A6", 0.85, 5), ("commit", "A2", 0.45, 1), ("commit", "A4", 0.225, 3)]
    assert ids(routes.fused(hits)) == ["A1", "m", "7"]

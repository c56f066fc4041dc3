"""Queries and functions that were wrong or grew too fast on larger tables."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from faultlens import catalog


def written(spark, folder, **tables):
    """A folder of tables, and a connection that sees them."""
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    return con


def both(spark, con, folder, name):
    rows = [tuple(r) for r in catalog.queries()[name](spark, str(folder)).collect()]
    return sorted(rows), sorted(con.execute(catalog.oracle_sql()[name]).fetchall())


# --- j12_pair_import


def test_pairs_of_bugs_with_several_names(spark, tmp_path):
    parts = [(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, "b"), (4, None), (5, "c")]
    items = [(10, 1, "N"), (10, 3, "N"), (11, 2, "N"), (11, 4, "N"), (12, 5, "R"), (13, 5, "N"), (13, 5, "N")]
    con = written(spark, tmp_path, part=(parts, "p_partkey long, p_name string"), lineitem=(items, "l_orderkey long, l_partkey long, l_returnflag string"))
    found, expected = both(spark, con, tmp_path, "j12_pair_import")
    assert [r[:2] for r in found] == [r[:2] for r in expected] and len(found) == 6
    plan = catalog.queries()["j12_pair_import"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan()
    assert plan.getClass().getSimpleName() == "Union"  # no comparison of all pairs above the joins


# --- t04_calls_in_the_last_hour


def test_the_hour_is_exact_to_the_microsecond(spark, tmp_path):
    at = lambda *t: datetime.datetime(2024, 1, 1, *t)
    rows = [(1, 7, at(10, 0, 0, 400)), (2, 7, at(11, 0, 0, 500)), (3, 7, at(11, 0, 0, 400)), (4, 8, at(11)), (5, 7, at(12, 0, 0, 450))]
    con = written(spark, tmp_path, events=(rows, "event_id long, user_id long, ts timestamp_ntz"))
    found, expected = both(spark, con, tmp_path, "t04_calls_in_the_last_hour")
    assert found == expected == [(1, 1), (2, 2), (3, 2), (4, 1), (5, 2)]


# --- x27_fault_domains


def test_no_key_reads_as_a_domain(spark, tmp_path):
    """Key 4302 is edac in letters."""
    con = written(spark, tmp_path, orders=([(k,) for k in (4302, 4303, 4304, 4305, 4306, 4307)], "o_orderkey long"))
    found, expected = both(spark, con, tmp_path, "x27_fault_domains")
    assert found == expected


def test_edac_in_a_subject_is_hardware(spark):
    from faultlens.functions import logs

    (row,) = spark.range(1).select(logs.domain_tags(F.lit("net: add edac"), F.lit("")).alias("t")).collect()
    assert "hardware" in [t["domain"] for t in row["t"]]


# --- vx_nearest_vectors


def test_nearest_as_a_plain_loop(spark):
    import random

    from faultlens.operators import vectors

    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, 0.5, -1.25, rng.random()]) for _ in range(6)]) for i in range(300)] + [(i, [0.5] * 6) for i in range(300, 330)]
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [9.0]), (403, [9.0]), (404, []), (500, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    found = sorted(tuple(r) for r in vectors.nearest(df, F.col("id") % 100 == 0, "id", "v", 5, 2).collect())
    q = df.where("id % 100 = 0").select(F.col("id").alias("query"), F.col("v").alias("qv"))
    dot = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    expected = {}
    for r in df.join(q, F.col("id") != F.col("query")).select("query", "id", F.round(dot, 2).alias("score")).collect():
        expected.setdefault(r["query"], []).append(((r["score"] is None, -(r["score"] or 0)), r["id"], r["score"]))
    assert found == sorted((a, i, s) for a, of in expected.items() for _, i, s in sorted(of)[:5])


def test_nearest_makes_no_row_for_each_pair(spark):
    plan = catalog.queries()["vx_nearest_vectors"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "MapInArrow" in plan


# --- x08_subsystem, x24_stack_signature


@pytest.mark.parametrize("name", ["subsystem", "extract_trace"])
def test_shared_parts_are_computed_once(spark, name):
    from faultlens.functions import stack, text

    c = {"subsystem": lambda: text.subsystem(F.col("x")), "extract_trace": lambda: stack.extract_trace(F.col("x"))}[name]()
    df = spark.createDataFrame([], "x array<string>" if name == "subsystem" else "x string")
    tree = df.select(c.alias("y"))._jdf.queryExecution().optimizedPlan().expressions().toString().lower()
    assert tree.count("[^/]*$" if name == "subsystem" else "rlike") == 1


# --- the stored index


def test_buckets_grow_with_the_words(spark, tmp_path, monkeypatch):
    from faultlens.plans import segments

    monkeypatch.setattr(segments, "BUCKET_TOKENS", 100)
    docs = spark.createDataFrame([(i, "some words of a text " * 5) for i in range(200)], "doc_id long, text string")
    made = segments.SegmentIndex.write(docs, "doc_id", "text", f"file://{tmp_path}/index")
    assert made.segments[0].buckets >= 40
    assert made.postings(["words"]).count() == 200 and made.top_k(["words", "text"], 3).count() == 3


# --- g19_all_invariants


def moved(spark, name):
    """What the shuffles of a query are dealt by."""
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    return [line.split("Exchange hashpartitioning(", 1)[1] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]


def test_invariants_move_no_edge_by_its_hash(spark):
    """Edges are dealt by what their commit's hash is made from; of further ends only counts move."""
    found = moved(spark, "g19_all_invariants")
    assert found and not [x for x in found if x.startswith(("commit#", "fixer#", "reverter#"))]
    assert not [x for x in found if "source#" in x or "match_method#" in x or "kind#" in x]


def test_ends_are_counted_by_row(spark):
    from faultlens.operators import integrity

    known = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "hash string")
    rows = [(x, y, s) for x in ("a", "b", "n", None) for y in ("a", "m", None) for s in ("s", None)] + [("a", "m", "s")] * 3
    edges = spark.createDataFrame(rows, "fixer string, fixed string, source string")
    own = [c for c in integrity.checks() if c.table == "commit_fixes"]
    found = {r["check"]: r["violations"] for r in integrity._violations({"commits": known, "commit_fixes": edges}, "commit_fixes", own).collect()}
    ok = {"a", "b"}
    assert found == {"both_ends_known": sum(x not in ok or y not in ok for x, y, _ in rows), "source_present": sum(s is None for *_, s in rows)}


# --- g20_all_audits


def test_audits_move_no_edge_by_its_hash(spark):
    found = moved(spark, "g20_all_audits")
    assert found and not [x for x in found if x.startswith(("commit#", "fixer#", "reverter#", "hash#"))]


def test_hashes_are_packed_and_unpacked(spark):
    from faultlens.operators import integrity

    values = ["a" * 40, "0123456789abcdef" * 2 + "01234567", "A" * 40, "a" * 39, "a" * 41, "a" * 20, "\0" * 20, "", "\u00e9\u20ac", "g" * 40, None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, h string")
    packed = rows.select("i", integrity._packed(F.col("h")).alias("p")).collect()
    assert [len(r["p"]) for r in packed[:2]] == [20, 20] and len({bytes(r["p"]) for r in packed if r["p"] is not None}) == len(values) - 1
    for by in ("i", "h"):
        assert sorted(tuple(r) for r in integrity.dealt_packed(rows, by, "h").collect()) == list(enumerate(values))


# --- g10_regressions


def test_regressions_move_little(spark):
    """Neither edges by all their columns, nor what was found by the request again and again."""
    found = moved(spark, "g10_regressions")
    assert found and not [x for x in found if x.startswith(("reverter#", "asked#", "hash#"))]


def test_requests_of_one_commit_get_the_same(spark):
    from faultlens.operators import lookups

    a, b, c = "a" * 40, "a" * 12 + "b" * 28, "c" * 40
    commits = spark.createDataFrame([(a, "x", 1, None), (b, "y", 2, ["aaaaaaab", "aaaaaaaa"]), (c, "z", 3, ["a" * 13, "cccccc"])], "hash string, subject string, commit_date int, fixes_refs array<string>")
    reverts = spark.createDataFrame([(c, a, "body"), (c, a, "body"), (b, a[:12], None), (c, a[:11], "no"), (c, "abc", "subject"), (c, "ABC", "no"), ("gone", a, "no"), (c, None, "no")], "reverter string, reverted string, source string")
    asked = spark.createDataFrame([(x,) for x in ("a" * 7, " " + a.upper(), a, a, b[:14], "abc", "abcd", "", None)], "hash string")
    got = sorted((r["asked"], r["full"], r["hash"][0], r["subject"], r["kind"]) for r in lookups.resolved_regression_fixes(asked, commits, reverts).collect())
    of_a = [(a, "a", "y", "fix"), (a, "a", "y", "revert/?"), (a, "c", "z", "fix"), (a, "c", "z", "revert/body")]
    of_b = [(b, "a", "y", "fix"), (b, "a", "y", "revert/?"), (b, "c", "z", "revert/body")]
    expected = [(x, *row) for x in ("a" * 7, " " + a.upper(), a) for row in of_a] + [(b[:14], *row) for row in of_b] + [("abc", "abc", "c", "z", "revert/subject")]
    assert got == sorted(expected)

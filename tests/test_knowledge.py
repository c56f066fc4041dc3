"""Invariants, audits and lookups on small tables with nulls, blanks, repeated rows and nothing at all."""

import pytest
from pyspark.sql import functions as F

from faultlens.operators import integrity, lookups

A, B, C = "a" * 40, "b" * 40, "c" * 40
SCHEMAS = {
    "commits": "hash string, subject string, body string, subsystem string, origin string, upstream_commit string, affected_versions array<string>, fixes_refs array<string>, day string",
    "bugs": "bug_id int, external_id string", "cves": "cve_id string, score double, fix_commits array<string>", "crashes": "crash_id string, title string, status string", "messages": "message_id string",
    "commit_cve": "commit string, cve string, source string", "commit_bug": "commit string, bug int, source string", "commit_message": "commit string, message string, match_method string",
    "commit_fixes": "fixer string, fixed string, source string", "commit_revert": "reverter string, reverted string, source string", "crash_commit": "crash string, commit string",
    "commit_symbol": "commit string, symbol string, file string, kind string",
}
ROWS = {
    "commits": [
        (A, "net: x", "Fixes: bbbbbbbb (y)\nsee https://t/o/r/issues/I1AB and issues\nm@h", "net", "vendor", B, ["6.6"], ["bbbbbbbb", ""], "2024-01-02"),
        (B, "net: y", None, None, "mainline", None, None, None, "2023-01-01"),
        (B, "net: y", None, "Link: z", "mainline", "xyz", [], [], None),
        (C, 'Revert "net: y"', "This reverts commit bbbbbbbbbbbb.", "a", "vendor", "d" * 40, [], None, "2024-03-01"),
    ],
    "bugs": [(1, "i1ab"), (2, None)], "cves": [("CVE-1", 10.5, [A.upper()]), ("CVE-2", None, None)], "crashes": [("k", "t", None)], "messages": [("m@h",), (None,)],
    "commit_cve": [(A, "CVE-1", "nvd"), (A, "CVE-2", None), (None, "CVE-1", "nvd")], "commit_bug": [(A, 1, "issue_a"), (A, 2, "trailer"), (B, None, "x")],
    "commit_message": [(A, "m@h", "link_trailer"), (B, "m@h", "link_trailer"), (B, "gone", "other")], "commit_fixes": [(A, B, "trailer"), (A, None, None)],
    "commit_revert": [(C, B, "subject"), (C, A, "body"), (C, B, None)], "crash_commit": [("k", A), ("k", A), ("gone", A)],
    "commit_symbol": [(A, "tcp_x", "net/t.c", "function"), (A, "__NONE__", "x", "sentinel"), (A, "if", "a.c", "macro"), (A, "ok", "no file", "odd")],
}


def base(spark, rows):
    made = {n: spark.createDataFrame(rows.get(n, []), s) for n, s in SCHEMAS.items()}
    return made | {"commits": made["commits"].withColumn("commit_date", F.to_date("day"))}


@pytest.fixture(scope="module")
def tables(spark):
    return base(spark, ROWS)


def test_invariants(tables):
    got = {(r["table"], r["check"]): r["violations"] for r in integrity.invariants(tables).collect()}
    assert len(got) == 21
    assert {k: n for k, n in got.items() if n} == {
        ("commits", "subsystem_without_blanks"): 1, ("commits", "upstream_is_a_full_hash"): 1, ("commits", "vendor_commit_has_versions"): 1, ("commits", "hash_unique"): 1,
        ("commits", "upstream_commit_known"): 1, ("commit_cve", "commit_known"): 1, ("commit_cve", "source_present"): 1, ("commit_bug", "bug_known"): 1, ("commit_message", "message_known"): 1,
        ("commit_fixes", "both_ends_known"): 1, ("commit_fixes", "source_present"): 1, ("crash_commit", "crash_known"): 1, ("commit_symbol", "kind_known"): 1,
        ("commit_symbol", "sentinel_shape"): 1, ("cves", "score_in_range"): 1,
    }


def test_audits(tables):
    whole = {r["audit"]: r for r in integrity.audited(tables, sample=None).collect()}
    assert {k: (r["n"], r["held"]) for k, r in whole.items()} == {
        "commits.subsystem": (3, 1), "commit_cve": (3, 1), "commit_message": (3, 1), "commit_bug": (2, 1), "commit_fixes": (1, 1), "commit_revert": (5, 2), "commit_symbol": (2, 1),
    }
    assert whole["commit_cve"]["examples"] == ["CVE-1", f"{A}/CVE-2"] and not whole["commit_cve"]["ok"]
    assert [r["n"] for r in integrity.audited(tables, sample=1).collect()] == [1] * 7


def test_nothing(spark):
    empty = base(spark, {})
    assert {(r["violations"], r["passed"]) for r in integrity.invariants(empty).collect()} == {(0, True)}
    assert {(r["n"], r["passed_share"], r["ok"], tuple(r["examples"])) for r in integrity.audited(empty).collect()} == {(0, None, True, ())}


def test_lookups(spark, tables):
    ask = lambda rows, schema: spark.createDataFrame(rows, schema)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    c = tables["commits"]
    asked = ask([(" BBBBBBBBB ", "6.6"), (B, "6.6"), (B, "5.10"), (B, "6.6"), ("bbb", "6.6"), (None, "6.6")], "upstream string, version string")
    assert {(r["upstream"], r["version"]): r["hash"] for r in lookups.backport_status(asked, c).collect() if r["backported"]} == {(" BBBBBBBBB ", "6.6"): A, (B, "6.6"): A}
    got = lookups.regression_fixes(ask([("bbbbbbb",), (A,), ("",), (None,)], "hash string"), c, tables["commit_revert"])
    assert rows(got.select("asked", "hash", "kind")) == sorted([("bbbbbbb", A, "fix"), ("bbbbbbb", C, "revert/subject"), ("bbbbbbb", C, "revert/?"), (A, C, "revert/body")], key=repr)
    since = F.lit("2024-01-01").cast("date")
    got = lookups.commits_touching(ask([("tcp_x", None), ("tcp_x", "5.10"), ("__NONE__", None)], "symbol string, version string"), tables["commit_symbol"], c, since)
    assert rows(got.select("symbol", "place", "hash")) == [("tcp_x", 1, A)]
    assert rows(lookups.crashes_fixed(ask([(A[:12],), (None,)], "hash string"), tables["crash_commit"], tables["crashes"])) == [(A[:12], "k", "t", None)]
    globs = ask([("N", "net/", "F"), ("T", "net/t*.c", "F"), ("O", "net/", "F"), ("O", "net/t.c", "X"), ("K", "*.c", "F"), ("D", r"net/\E.c", "F")], "section string, pattern string, kind string")
    people = ask([("T", "p", None, "M"), ("T", None, "q@h", None)], "section string, name string, email string, role string")
    got = lookups.owners(ask([("/net/t.c",), ("a b",), (None,)], "path string"), globs, people)
    assert [tuple(r)[2:] for r in sorted(got.collect(), key=lambda r: r["place"])] == [("T", "net/t*.c", "? <q@h>; p <->"), ("N", "net/", "(no maintainer listed)"), ("K", "*.c", "(no maintainer listed)")]
    trace = "Call Trace:\n alpha_one+0x1/0x2\n beta_two+0x1/0x2\n gamma_three+0x1/0x2\n"
    own = ask([(trace, 7, "x")], "t string, key int, title string").withColumn("stack_signature", lookups.stack.signature(F.col("t")))
    got = lookups.similar_crashes(ask([("q", "seen today:\n" + trace), ("e", ""), ("n", None)], "id string, trace string"), {"bugs": (own, "key", "title")})
    assert rows(got.select("id", "origin", "key", "title")) == [("q", "bugs", "7", "x")]
    series = ask([("b", "s", 2, 2), ("a", "s", 1, 2), ("0", "s", None, 2), ("z", "", 1, 1), ("y", None, 1, 1)], "message string, series string, number int, total int")
    assert [(r["message"], r["is_asked"]) for r in lookups.patch_series(ask([("b",), ("z",), ("y",)], "message string"), series).orderBy(F.asc_nulls_last("number")).collect()] == [("a", False), ("b", True), ("0", False)]

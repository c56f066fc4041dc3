import io
import json
import tarfile

from pyspark.sql import functions as F

from faultlens import tools
from faultlens.sources import archives


def store(spark):
    commits = [
        ("aaaaaaaaaaaa1111", "net: fix leak in tcp", "fixes tcp leak", "2024-01-01", ["bbbbbbbb"], ["6.6"], "dddddddddddd", None),
        ("bbbbbbbbbbbb2222", "net: add leak", "tcp leak added", "2023-01-01", [], ["6.6"], None, None),
        ("cccccccccccc3333", 'Revert "net: add leak"', "This reverts commit bbbbbbbbbbbb2222.", "2024-02-01", [], [], None, None),
    ]
    c = spark.createDataFrame(commits, "hash string, subject string, body string, day string, fixes_refs array<string>, affected_versions array<string>, upstream_commit string, patch_id string")
    c = c.withColumn("short_hash", F.substring("hash", 1, 12)).withColumn("commit_date", F.to_date("day"))
    return tools.Store(spark, {
        "commits": c,
        "edges_symbol": spark.createDataFrame([("aaaaaaaaaaaa1111", "tcp_x", "net/tcp.c")], "commit string, symbol string, file string"),
        "maintainers": spark.createDataFrame([("NET", ["a"], ["net/"], []), ("TCP", ["b"], ["net/tcp*.c"], []), ("OLD", ["c"], ["net/"], ["net/tcp.c"])], "name string, people array<string>, files array<string>, excluded array<string>"),
        "diffs": spark.createDataFrame([("aaaaaaaaaaaa1111", "r", "diff --git")], "hash string, repo string, diff string"),
        "patches": spark.createDataFrame([("m1", "s", 1, 2), ("m2", "s", 2, 2)], "message string, series string, number int, total int"),
        "ecc": spark.createDataFrame([("d0", 101, 0), ("d1", 0, 1)], "dimm string, corrected int, uncorrected int"),
        "code": spark.createDataFrame([("f.c", "tcp_x", "tcp_y tcp_y MAX_SIZE a_b"), ("g.c", "up", "if (a) tcp_x (b);")], "file string, symbol string, text string"),
    })


def test_lookups(spark):
    t = tools.registry(store(spark))
    hashes = lambda df: [r["hash"][0] for r in df.collect()]
    assert hashes(t["get_commit_detail"].run("aaaaaaaaaaaa")) == ["a"] == hashes(t["get_commit_detail"].run("aaaaaaa"))
    assert [(r["hash"][0], r["kind"]) for r in t["get_regression_fixes"].run("bbbbbbbbbbbb2222").collect()] == [("a", "fix"), ("c", "revert/body")]
    assert hashes(t["check_backport_status"].run("dddddddddddd", "6.6")) == ["a"] and hashes(t["check_backport_status"].run("dddddddddddd", "5.10")) == []
    assert hashes(t["find_commits_touching_symbol"].run("tcp_x", since_months=1200)) == ["a"]
    assert [r["name"] for r in t["lookup_subsystem_owner"].run("net/tcp.c").collect()] == ["TCP", "NET"]
    assert hashes(t["browse_subsystem_fixes"].run(["net"], "leak")) == ["a"]
    assert [r["token"] for r in t["expand_query_from_symbol"].run("tcp_x").collect()][0] == "tcp_y"
    assert [tuple(r) for r in t["get_commit_diff"].run("aaaaaaa", max_chars=4).collect()] == [("aaaaaaaaaaaa1111", "r", "diff", True)]
    assert [r["symbol"] for r in t["get_function_source"].run("tcp_x").collect()] == ["tcp_x"] and [r["file"] for r in t["get_function_source"].run("MAX_SIZE").collect()] == ["f.c"]
    assert [r["symbol"] for r in t["get_call_graph"].run("tcp_x").collect()] == ["up"] and [r["called"] for r in t["get_call_graph"].run("up", "callees").collect()] == ["tcp_x"]
    assert [(r["message"], r["is_asked"]) for r in t["get_patch_series"].run("m2").collect()] == [("m1", False), ("m2", True)]
    assert [r["trend"] for r in t["get_edac_errors"].run().orderBy("dimm").collect()] == ["increasing", "critical"]
    assert [r["frame"] for r in t["extract_call_trace"].run("Call Trace:\n a_b+0x1/0x2\n\nx").collect()] and t["get_device_major_mapping"].run(8, "block").first()["r"]["driver"]
    assert {r["hash"][0] for r in t["search_commits"].run("tcp leak").collect()} == {"a", "b"}
    assert "get_mce_log" in tools.for_route(t, "hardware") and "get_mce_log" not in tools.for_route(t, "change")
    tools.register_functions(spark)
    assert [tuple(r) for r in spark.sql("select kind, summary from log_events('BUG: x y')").collect()] == [("bug", "BUG: x y")]


def test_searches_and_calls_without_reading_the_tables(spark, tmp_path):
    """With an index and a stored graph, a lookup scans neither the commits nor the code."""
    from faultlens.operators.callgraph import CallGraph
    from faultlens.plans.segments import SegmentIndex

    place = f"file://{tmp_path}"
    commits = [("aa1", "fixes tcp leak"), ("bb2", "tcp leak added"), ("cc3", "docs")]
    code = [("x.c", "up", "tcp_x(1)"), ("y.c", "tcp_x", "down()")]
    spark.createDataFrame(commits, "hash string, body string").write.parquet(f"{place}/commits")
    spark.createDataFrame(code, "file string, symbol string, text string").write.parquet(f"{place}/code")
    tables = {n: spark.read.parquet(f"{place}/{n}") for n in ("commits", "code")}
    plain = tools.registry(tools.Store(spark, tables))
    indexes = {"commits": SegmentIndex.write(tables["commits"], "hash", "body", f"{place}/index")}
    quick = tools.registry(tools.Store(spark, tables, indexes, CallGraph.write(tables["code"], f"{place}/graph")))
    for name, args in (("search_commits", ("tcp leak",)), ("get_call_graph", ("tcp_x",)), ("get_call_graph", ("tcp_x", "callees"))):
        a, b = plain[name].run(*args), quick[name].run(*args)
        assert sorted(tuple(r) for r in a.collect()) == sorted(tuple(r) for r in b.collect()) and a.columns == b.columns
        files = lambda df: {f.rsplit("/", 2)[1] for f in df.inputFiles()}
        assert files(a) & {"commits", "code"} and not files(b) & {"commits", "code"}


def test_feeds(spark, tmp_path):
    (tmp_path / "f.xml").write_text('<feed><entry><title>T</title><link href="https://h/l/a@b.c/"/><updated>2024-01-02T03:04:05Z</updated><summary>s</summary></entry><entry><title>U</title><link href="https://h/x/"/></entry></feed>')
    assert [(r["message_id"], r["title"], r["snippet"]) for r in archives.atom_hits(spark, str(tmp_path / "f.xml")).collect()] == [("a@b.c", "T", "s")]
    tree = tmp_path / "cve" / "2024"
    tree.mkdir(parents=True)
    (tree / "CVE-2024-1000.sha1").write_text("a" * 40 + "\n")
    (tree / "CVE-2024-1000.dyad").write_text("# head\n1:" + "c" * 40 + ":2:" + "b" * 40 + "\n")
    assert [(r["cve_id"], r["hashes"]) for r in archives.published_cves(spark, str(tmp_path / "cve")).collect()] == [("CVE-2024-1000", ["a" * 40, "b" * 40])]
    for i, body in enumerate(([{"id": "q", "category": "k"}], {"cases": [{"id": "q", "category": "k"}]})):
        (tmp_path / f"e{i}.json").write_text(json.dumps(body))
        assert [r["id"] for r in archives.eval_cases(spark, str(tmp_path / f"e{i}.json"), category="k").collect()] == ["q"]
    hits = spark.createDataFrame([(1, "## a/b.c (score: 0.5)\n```c\none\ntwo\n```\n## empty.c\n```\n```\n")], "id int, md string")
    assert [(r["file"], r["score"], r["snippet"]) for r in archives.code_hits(hits, "id", "md").collect()] == [("a/b.c", 0.5, "one\ntwo")]


def test_system_report(spark, tmp_path):
    with tarfile.open(tmp_path / "r.tar.gz", "w:gz") as tar:
        for name, content in (("sos-1/sos_commands/kernel/dmesg", b"1\n2\n3\n"), ("sos-1/hostname", b"box\n")):
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    (tmp_path / "bad.tar.gz").write_bytes(b"no tar")
    got = {r["path"].rsplit("/", 1)[1]: (r["uname"], r["dmesg"], r["hostname"]) for r in archives.system_reports(spark, str(tmp_path / "*.gz"), last_lines=2).collect()}
    assert got == {"r.tar.gz": (None, "2\n3", "box"), "bad.tar.gz": (None, None, None)}


def test_rows(spark):
    raw = spark.createDataFrame([("f" * 40, "A", None, "s", "mainline inclusion\ncommit aaaaaaa1\n---\nFixes: bbbbbbb2", ["net/a.c"]), ("e" * 40, "A", None, "m", "Merge pull request 1", [])], "hash string, author string, date timestamp, subject string, body string, files array<string>")
    (r,) = archives.commit_rows(raw, "vendor").collect()
    assert (r["short_hash"], r["inclusion_type"], r["upstream_commit"], r["fixes_refs"], r["subsystem"], r["closes_refs"]) == ("f" * 12, "backport", "aaaaaaa1", ["bbbbbbb2"], "net", None)
    bug = spark.createDataFrame([(5, "t", "NEW", "", "blocker", "2024-01-01T00:00:00Z", "")], "id int, summary string, status string, resolution string, severity string, creation_time string, last_change_time string")
    (b,) = archives.bug_rows(bug, "x").collect()
    assert (b["external_id"], b["status"], b["severity"], b["updated"]) == ("5", "new", "critical", None)
    ask = spark.createDataFrame([("q", 0.0), ("q", 0.7)], "prompt string, temperature double")
    key = archives.cached_responses(spark.createDataFrame([], "cache_key string, response string, created timestamp"), ask, F.current_timestamp()).where("temperature = 0").first()["cache_key"]
    cache = spark.createDataFrame([(key, "r")], "cache_key string, response string").withColumn("created", F.lit("2024-01-10").cast("timestamp"))
    now = F.lit("2024-01-20").cast("timestamp")
    assert {(r["temperature"], r["response"]) for r in archives.cached_responses(cache, ask, now).collect()} == {(0.0, "r"), (0.7, None)}
    assert archives.cached_responses(cache, ask, now, ttl_days=5).where("response is not null").count() == 0
    assert archives.free_space("/")[1] in ("ok", "low", "stop")

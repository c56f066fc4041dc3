"""Lookups by name over a set of tables: the extension surface. Every tool returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from faultlens.functions import hardware, logs
from faultlens.operators import callgraph, lookups
from faultlens.plans import routes, search
from faultlens.sources import archives


@dataclass(frozen=True)
class Tool:
    name: str
    run: Callable[..., DataFrame]
    routes: tuple[str, ...] = ()


@dataclass
class Store:
    """Tables by name: commits (hash, short_hash, subject, body, commit_date, fixes_refs, affected_versions, patch_id),
    bugs, cves, crashes, messages, log_events, edges_symbol (commit, symbol, file, kind), edges_crash (crash, commit),
    edges_revert (reverter, reverted, source), code (file, symbol, text), diffs (hash, repo, diff), patches (message,
    series, number, total), ecc (corrected, uncorrected), maintainers (name, people, files, excluded). A table with an index is searched through it, without being read; without one
    a search reads and tokenises all of it. Calls go to the stored graph where there is one."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    indexes: dict[str, search.Index] = field(default_factory=dict)  # of the tables that are searched
    graph: callgraph.CallGraph | None = None  # of `code`

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def clamp(limit: int, low: int, high: int) -> int:
    return min(max(limit, low), high)


def _by_hash(df: DataFrame, prefix: str, column: str = "hash") -> DataFrame:
    short = F.col("short_hash") == prefix if len(prefix) == 12 and "short_hash" in df.columns else F.col(column).startswith(prefix.lower())
    return df.where(short)


def _reverts(store: Store) -> DataFrame:
    """Stored edges, or those that bodies of reverting commits state."""
    if "edges_revert" in store.tables:
        return store["edges_revert"]
    stated = F.regexp_extract(F.lower("body"), r"this reverts commit\s+([0-9a-f]{12,40})", 1)
    return store["commits"].select(F.col("hash").alias("reverter"), stated.alias("reverted"), F.lit("body").alias("source")).where("reverted <> ''")


def registry(store: Store) -> dict[str, Tool]:
    s, spark = store, store.spark

    def searcher(table: str, key: str, text: str):
        def run(keywords: str, limit: int = 10) -> DataFrame:
            words, most = keywords.lower().split(), clamp(limit, 1, 100)
            if table in s.indexes:
                return s.indexes[table].tiered_search(words, most)
            return search.tiered_search(s[table], key, text, words, most)

        return run

    def commit_detail(commit_hash: str) -> DataFrame:
        return _by_hash(s["commits"], commit_hash).orderBy("hash").limit(1)

    asked = lambda **values: spark.createDataFrame([tuple(values.values())], ", ".join(f"{c} string" for c in values))

    def backport(upstream: str, version: str) -> DataFrame:
        return lookups.backport_status(asked(upstream=upstream, version=version), s["commits"]).where("backported").drop("backported")

    def regressions(commit_hash: str) -> DataFrame:
        return lookups.regression_fixes(asked(hash=commit_hash), s["commits"], _reverts(s)).orderBy("kind", "hash")

    def touching(symbol: str, version: str | None = None, since_months: int = 36, limit: int = 20) -> DataFrame:
        edges = s["edges_symbol"] if "kind" in s["edges_symbol"].columns else s["edges_symbol"].withColumn("kind", F.lit("unknown"))
        since = F.current_date() - F.lit(since_months * 30)
        return lookups.commits_touching(asked(symbol=symbol, version=version), edges, s["commits"], since, clamp(limit, 5, 50)).orderBy("place")

    def similar(trace: str, limit: int = 10) -> DataFrame:
        kinds = {"crashes": ("crash_id", "title"), "bugs": ("bug_id", "title"), "messages": ("message_id", "subject"), "log_events": ("event_id", "fault_kind")}
        known = {n: (s[n], key, title) for n, (key, title) in kinds.items() if n in s.tables and "stack_signature" in s[n].columns}
        return lookups.similar_crashes(asked(id="", trace=trace), known, clamp(limit, 3, 25)).orderBy("origin", "key")

    def fixed_by(commit_hash: str, limit: int = 10) -> DataFrame:
        return lookups.crashes_fixed(asked(hash=commit_hash), s["edges_crash"], s["crashes"], clamp(limit, 3, 25)).orderBy(F.desc_nulls_last("status"), "crash")

    def owners(path: str) -> DataFrame:
        m = s["maintainers"]
        of = lambda column, kind: m.select(F.col("name").alias("section"), F.explode(column).alias("pattern"), F.lit(kind).alias("kind"))
        people = m.select(F.col("name").alias("section"), F.explode("people").alias("name"), F.lit(None).cast("string").alias("email"), F.lit(None).cast("string").alias("role"))
        found = lookups.owners(asked(path=path), of("files", "F").unionByName(of("excluded", "X")), people)
        return found.orderBy("place").select(F.col("section").alias("name"), "people", F.col("pattern").alias("file"))

    def diff(commit_hash: str, max_chars: int = 5000) -> DataFrame:
        found = _by_hash(s["diffs"], commit_hash).orderBy("hash").limit(1)
        return found.select("hash", "repo", F.left("diff", F.lit(max_chars)).alias("diff"), (F.length("diff") > max_chars).alias("truncated"))

    def source(symbol: str, limit: int = 10) -> DataFrame:
        named = s["code"].where(F.col("symbol") == symbol).select("file", "symbol", "text")
        near = s["code"].where(F.col("text").contains(symbol) & (F.col("symbol") != symbol)).orderBy("file", "symbol").limit(clamp(limit, 1, 50))
        return routes.or_else(named, near.select("file", "symbol", "text"))

    def calls(symbol: str, direction: str = "callers") -> DataFrame:
        if direction not in ("callers", "callees"):
            raise ValueError(f"direction is callers or callees, not {direction}")
        healthy = spark.createDataFrame([(s.graph is not None,)], "healthy boolean")
        found = callgraph.look_up(asked(symbol=symbol), s.graph, s["code"] if s.graph is None else None, healthy, direction, limit=10_000)
        own, other = ("called", "symbol") if direction == "callers" else ("symbol", "called")
        return found.select("file", F.col("other").alias(other), F.col("symbol").alias(own)).select("file", "symbol", "called").distinct().orderBy("file", "symbol", "called")

    def series(message_id: str) -> DataFrame:
        return lookups.patch_series(asked(message=message_id), s["patches"]).orderBy(F.asc_nulls_last("number"), "message")

    def frames(text: str) -> DataFrame:
        return spark.createDataFrame(list(enumerate(logs.call_trace(text), 1)), "nth int, frame string")

    def memory_errors() -> DataFrame:
        return s["ecc"].select("*", hardware.ecc_trend(F.col("corrected"), F.col("uncorrected")).alias("trend"))

    def subsystem_fixes(prefixes: list[str], contains: str = "", limit: int = 10) -> DataFrame:
        low = F.lower("subject")
        starts = F.lit(False)
        for p in prefixes[:8]:
            starts = starts | low.startswith(p.lower() + ":")
        keep = starts & low.contains("fix") & (low.contains(contains.lower()) if contains else F.lit(True))
        return s["commits"].where(keep).orderBy(F.desc_nulls_last("commit_date"), "hash").limit(clamp(limit, 1, 50))

    def expand(symbol: str) -> DataFrame:
        text = F.explode(F.regexp_extract_all("text", F.lit(r"[a-z]+_[a-z0-9_]+|[A-Z][A-Z0-9_]{3,}"), F.lit(0)))
        return s["code"].where(F.col("symbol") == symbol).select(text.alias("token")).where(F.length("token") > 3).groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(20)

    one = lambda v, expr: spark.createDataFrame([(v,)], "v string").select(expr(F.col("v")).alias("r"))
    tools = [
        Tool("search_commits", searcher("commits", "hash", "body")), Tool("search_bugs", searcher("bugs", "bug_id", "description")), Tool("search_cve", searcher("cves", "cve_id", "description")),
        Tool("search_crashes", searcher("crashes", "crash_id", "stack_trace")), Tool("search_mail", searcher("messages", "message_id", "body")), Tool("search_code", searcher("code", "file", "text")),
        Tool("lookup_symbol", lambda symbol: s["code"].where(F.col("symbol") == symbol)), Tool("get_commit_detail", commit_detail), Tool("check_backport_status", backport), Tool("get_regression_fixes", regressions),
        Tool("find_commits_touching_symbol", touching), Tool("find_similar_crashes", similar), Tool("find_crashes_fixed_by_commit", fixed_by), Tool("lookup_subsystem_owner", owners),
        Tool("browse_subsystem_fixes", subsystem_fixes), Tool("expand_query_from_symbol", expand),
        Tool("parse_log", lambda log: logs.extract_events(spark.createDataFrame([(0, log)], "id int, log string"), "id", "log"), ("kernel", "hardware")),
        Tool("parse_taint_flags", lambda v: one(v, hardware.taint), ("hardware",)), Tool("parse_machine_check", lambda v: one(v, hardware.mci_status), ("hardware",)), Tool("get_mce_log", lambda v: one(v, hardware.mcelog), ("hardware",)),
        Tool("get_commit_diff", diff), Tool("get_function_source", source), Tool("get_call_graph", calls), Tool("get_patch_series", series), Tool("extract_call_trace", frames),
        Tool("parse_sosreport", lambda path, last_lines=200: archives.system_reports(spark, path, last_lines)), Tool("get_edac_errors", memory_errors, ("hardware",)),
        Tool("get_device_major_mapping", lambda major, kind="block": asked(kind=kind).select(hardware.device_major(F.lit(major), F.col("kind")).alias("r"))),
        Tool("get_hardware_inventory", lambda v: one(v, hardware.inventory), ("hardware",)), Tool("get_event_log", lambda v: one(v, hardware.event_log), ("hardware",)), Tool("decode_frame", lambda v: one(v, hardware.decoded_frame)),
    ]
    return {t.name: t for t in tools}


def for_route(tools: dict[str, Tool], route: str) -> list[str]:
    """Tools without routes, and those that list this one."""
    return sorted(t.name for t in tools.values() if not t.routes or route in t.routes)


def register_functions(spark: SparkSession) -> None:
    """log_events(text), as a table function for SQL."""

    @udtf(returnType="kind string, summary string, raw string")
    class LogEvents:
        def eval(self, log: str):
            for e in logs.events(log):
                yield e["kind"], e["summary"], e["raw"]

    spark.udtf.register("log_events", LogEvents)

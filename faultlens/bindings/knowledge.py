"""Integrity, audits and graph lookups over a knowledge base that is derived from the whole fixture tables.

Each table of the base is written once, as column expressions that both engines read alike."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.bindings.registry import query
from faultlens.operators import integrity, lookups
from faultlens.session import table as t


def _sha(n: str) -> str:
    return f"sha1(CAST({n} AS STRING))"


# name -> (fixture table, columns, distinct rows). Some rows break each rule on purpose.
BASE: dict[str, tuple[str, list[str], bool]] = {
    "commits": ("orders", [
        f"{_sha('o_orderkey')} AS hash", "o_orderdate AS commit_date",
        "CASE WHEN o_orderkey % 50 = 7 THEN '[stub upstream for it]' WHEN o_orderkey % 10 = 3 THEN concat('Revert \"net: queue ', CAST(o_orderkey - 1 AS STRING), '\"') ELSE concat('net: queue ', CAST(o_orderkey AS STRING)) END AS subject",
        f"concat('Work', chr(10), 'Fixes: ', substr({_sha('o_orderkey - 2')}, 1, 12), ' (\"net\")', chr(10), 'Link: https://h/', CAST(o_orderkey AS STRING), '@mail', chr(10), 'bsc#', CAST(o_orderkey % 200 AS STRING), chr(10), 'This reverts commit ', substr({_sha('o_orderkey - 1')}, 1, 12)) AS body",
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'Link:x' ELSE concat('drivers/', substr(o_orderpriority, 3)) END AS subsystem",
        "CASE WHEN o_orderstatus = 'F' THEN 'vendor' ELSE 'mainline' END AS origin",
        f"CASE WHEN o_orderkey % 89 = 0 THEN 'v6.6' WHEN o_orderstatus = 'F' THEN {_sha('o_orderkey + 1')} END AS upstream_commit",
        "CASE WHEN o_orderkey % 83 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN split('6.6,5.10', ',') ELSE split('6.6', ',') END AS affected_versions",
        f"CASE WHEN o_orderkey % 4 = 0 THEN split('', ',') WHEN o_orderkey % 4 = 1 THEN NULL ELSE split(concat(substr({_sha('o_orderkey - 2')}, 1, 12), ',', substr({_sha('o_orderkey % 50')}, 1, 8)), ',') END AS fixes_refs",
    ], False),
    "bugs": ("part", ["p_partkey AS bug_id", "CAST(p_partkey % 200 AS STRING) AS external_id"], False),
    "cves": ("supplier", ["s_suppkey AS cve_id", "s_acctbal / 900 AS score", f"split(concat(upper({_sha('s_suppkey')}), ',', {_sha('s_suppkey + 10')}), ',') AS fix_commits"], False),
    "crashes": ("customer", ["c_custkey AS crash_id", "c_name AS title", "CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS status"], False),
    "messages": ("orders", ["concat(CAST(o_orderkey AS STRING), '@mail') AS message_id"], False),
    "commit_cve": ("lineitem", [f"{_sha('l_orderkey')} AS commit", "l_suppkey AS cve", "CASE WHEN l_linenumber < 7 THEN l_returnflag END AS source"], True),
    "commit_bug": ("lineitem", [f"{_sha('l_orderkey')} AS commit", "l_partkey + 1 AS bug", "CASE WHEN l_returnflag = 'R' THEN 'trailer' WHEN l_returnflag = 'A' THEN 'issue_b' END AS source"], True),
    "commit_message": ("lineitem", [f"{_sha('l_orderkey')} AS commit", "concat(CAST(l_orderkey - l_linenumber % 2 AS STRING), '@mail') AS message", "CASE WHEN l_linenumber < 5 THEN 'link_trailer' ELSE 'subject' END AS match_method"], True),
    "commit_fixes": ("lineitem", [f"{_sha('l_orderkey')} AS fixer", f"{_sha('l_orderkey - 2 - CAST(l_linenumber = 7 AS INT)')} AS fixed", "CASE WHEN l_returnflag <> 'N' THEN 'trailer' END AS source"], True),
    "commit_revert": ("lineitem", [f"{_sha('l_orderkey')} AS reverter", f"{_sha('l_orderkey - 1 - CAST(l_linenumber = 7 AS INT)')} AS reverted", "CASE l_returnflag WHEN 'R' THEN 'subject' WHEN 'A' THEN 'body' ELSE 'else' END AS source"], True),
    "crash_commit": ("orders", ["o_custkey + 5 AS crash", f"{_sha('o_orderkey')} AS commit"], False),
    "commit_symbol": ("lineitem", [
        f"{_sha('l_orderkey + l_linenumber')} AS commit", "CASE WHEN l_linenumber = 6 THEN '__NONE__' WHEN l_partkey % 40 = 0 THEN 'if' ELSE concat('tcp_', CAST(l_partkey % 40 AS STRING)) END AS symbol",
        "CASE WHEN l_suppkey % 9 = 0 THEN 'net tcp.c' WHEN l_suppkey % 9 = 1 THEN 'Kbuild' ELSE concat('net/t', CAST(l_suppkey % 9 AS STRING), '.c') END AS file",
        "CASE WHEN l_linenumber = 6 THEN 'sentinel' WHEN l_linenumber = 5 THEN 'other' WHEN l_linenumber = 4 THEN 'macro' ELSE 'function' END AS kind",
    ], True),
    "patches": ("conversations", ["concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS message", "CASE WHEN conv_id % 4 > 0 THEN concat('series ', CAST(conv_id % 3 AS STRING)) ELSE '' END AS series", "CASE WHEN turn > 0 THEN turn END AS number", "conv_id AS total"], False),
    "patterns": ("nation", [
        "concat('S', CAST(n_nationkey % 9 AS STRING)) AS section", "CASE n_nationkey % 5 WHEN 0 THEN 'net/' WHEN 1 THEN concat('net/t', CAST(n_nationkey % 9 AS STRING), '*.c') WHEN 2 THEN '*.c' WHEN 3 THEN 'net/*/deep/' ELSE concat('net/t', CAST(n_nationkey % 4 AS STRING), '.c') END AS pattern",
        "CASE n_nationkey % 6 WHEN 5 THEN 'X' WHEN 4 THEN 'N' ELSE 'F' END AS kind",
    ], False),
    "people": ("supplier", ["concat('S', CAST(s_suppkey % 7 AS STRING)) AS section", "s_name AS name", "CASE WHEN s_suppkey % 4 > 0 THEN concat(CAST(s_suppkey AS STRING), '@h') END AS email", "CASE WHEN s_suppkey % 2 = 0 THEN 'M' ELSE 'R' END AS role"], False),
}


class Base(Mapping[str, DataFrame]):
    """The tables as DataFrames, made as they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.at = (spark, sf_dir)

    def __getitem__(self, name: str) -> DataFrame:
        source, columns, once = BASE[name]
        rows = t(*self.at, source).selectExpr(*columns)
        return rows.distinct() if once else rows

    def dealt(self, name: str, column: str, first: int | None = None, repeats: bool = False) -> DataFrame:
        """The table with its rows dealt by a column, or by its first characters. What the columns are made from is moved,
        which is narrower than they are; rows are made distinct where they then lie, if not left with their repeats."""
        source, columns, once = BASE[name]
        made = F.expr(next(c.removesuffix(f" AS {column}") for c in columns if c.endswith(f" AS {column}")))
        rows = t(*self.at, source).repartition(made if first is None else F.left(made, F.lit(first))).selectExpr(*columns)
        return rows.distinct() if once and not repeats else rows

    def __iter__(self) -> Iterator[str]:
        return iter(BASE)

    def __len__(self) -> int:
        return len(BASE)


def _with(*names: str) -> str:
    """The tables as the head of a SQL query."""
    return "WITH " + ", ".join(f"{n} AS (SELECT {'DISTINCT ' if BASE[n][2] else ''}{', '.join(BASE[n][1])} FROM {BASE[n][0]})" for n in names)


def base_query(name: str, tables: list[str], sql: str) -> Callable[[Callable[[Base], DataFrame]], None]:
    def add(f: Callable[[Base], DataFrame]) -> None:
        query(name, f"{_with(*tables)}{sql}")(lambda s, d: f(Base(s, d)))

    return add


_HAS = "EXISTS (SELECT 1 FROM commits c WHERE c.hash = e.{})"
_VIOLATED = [
    ("commits", "subsystem_without_blanks", "FROM commits WHERE contains(subsystem, ' ')"),
    ("commits", "upstream_is_a_full_hash", "FROM commits WHERE NOT regexp_full_match(upstream_commit, '[0-9a-f]{40}')"),
    ("commits", "vendor_commit_has_versions", "FROM commits WHERE origin = 'vendor' AND (affected_versions IS NULL OR len(affected_versions) = 0)"),
    ("commits", "hash_unique", "FROM (SELECT 1 FROM commits GROUP BY hash HAVING count(*) > 1)"),
    ("commits", "upstream_commit_known", "FROM (SELECT DISTINCT upstream_commit AS u FROM commits WHERE origin = 'vendor') e WHERE u IS NOT NULL AND NOT " + _HAS.format("u")),
    *((e, "commit_known", f"FROM {e} e WHERE NOT {_HAS.format('commit')}") for e in ("commit_cve", "commit_bug", "commit_message", "crash_commit", "commit_symbol")),
    ("commit_bug", "bug_known", "FROM commit_bug WHERE bug NOT IN (SELECT bug_id FROM bugs)"),
    ("commit_message", "message_known", "FROM commit_message WHERE message NOT IN (SELECT message_id FROM messages)"),
    ("crash_commit", "crash_known", "FROM crash_commit WHERE crash NOT IN (SELECT crash_id FROM crashes)"),
    ("commit_fixes", "both_ends_known", f"FROM commit_fixes e WHERE NOT {_HAS.format('fixer')} OR NOT {_HAS.format('fixed')}"),
    ("commit_revert", "both_ends_known", f"FROM commit_revert e WHERE NOT {_HAS.format('reverter')} OR NOT {_HAS.format('reverted')}"),
    ("commit_symbol", "kind_known", "FROM commit_symbol WHERE kind NOT IN ('function', 'struct', 'macro', 'unknown', 'sentinel')"),
    ("commit_symbol", "sentinel_shape", "FROM commit_symbol WHERE kind = 'sentinel' AND (symbol <> '__NONE__' OR file <> '__NONE__')"),
    *((e, "source_present", f"FROM {e} WHERE source IS NULL") for e in ("commit_cve", "commit_bug", "commit_fixes")),
    ("cves", "score_in_range", "FROM cves WHERE score < 0 OR score > 10"),
]
_NODES = ["commits", "bugs", "cves", "crashes", "messages", "commit_cve", "commit_bug", "commit_message", "commit_fixes", "commit_revert", "crash_commit", "commit_symbol"]


@base_query("g19_all_invariants", _NODES, " UNION ALL ".join(f""" SELECT '{e}' AS "table", '{c}' AS "check", count(*) AS violations, count(*) = 0 AS passed {rows}""" for e, c, rows in _VIOLATED))
def _(base):
    return integrity.invariants(base)


_LISTED = r"regexp_extract_all(c.body, '(bsc#|BZ-|bz#|bug #?)(\d+)', 2)"
_HELD = [
    ("commits.subsystem", "SELECT hash AS k, NOT regexp_matches(subsystem, '[ \t]') AND length(subsystem) BETWEEN 2 AND 80 AND NOT regexp_matches(subsystem, '^(Link:|Closes:|http|Reported-by:)') AS ok FROM commits WHERE subsystem IS NOT NULL"),
    ("commit_cve", "SELECT concat(commit, '/', cve), list_contains([left(lower(x), 12) FOR x IN fix_commits], left(commit, 12)) FROM commit_cve JOIN cves ON cve_id = cve"),
    ("commit_message", "SELECT concat(commit, '/', message), contains(body, message) FROM commit_message JOIN commits ON hash = commit WHERE match_method = 'link_trailer'"),
    ("commit_bug", f"SELECT concat(commit, '/', bug), coalesce(source = 'trailer', false) AND list_contains({_LISTED}, external_id) FROM commit_bug JOIN bugs ON bug_id = bug JOIN commits c ON c.hash = commit"),
    ("commit_fixes", "SELECT concat(fixer, '/', fixed), starts_with(fixed, regexp_extract(body, 'Fixes: ([0-9a-f]{7,40})', 1)) FROM commit_fixes JOIN commits ON hash = fixer WHERE source = 'trailer'"),
    ("commit_revert", "SELECT concat(reverter, '/', reverted), CASE e.source WHEN 'subject' THEN regexp_matches(a.subject, '^Revert \"') AND contains(b.subject, regexp_extract(a.subject, '^Revert \"(.+)\"', 1)) WHEN 'body' THEN contains(a.body, concat('This reverts commit ', left(reverted, 12))) ELSE false END FROM commit_revert e JOIN commits a ON a.hash = reverter JOIN commits b ON b.hash = reverted"),
    ("commit_symbol", "SELECT concat(commit, '/', symbol, '/', file), NOT contains(file, ' ') AND (contains(file, '/') OR file LIKE '%.c') AND symbol <> 'if' FROM commit_symbol WHERE kind IN ('function', 'struct', 'macro')"),
]


@base_query("g20_all_audits", _NODES, ", j(audit, k, ok) AS (" + " UNION ALL ".join(f"SELECT '{a}', q.* FROM ({rows}) q" for a, rows in _HELD) + """), r AS (SELECT audit, k, row_number() OVER (PARTITION BY audit ORDER BY k) AS rn FROM j WHERE NOT ok)
 SELECT audit, count(*) AS n, count(*) FILTER (WHERE ok) AS held, round(avg(CAST(ok AS DOUBLE)), 6) AS passed_share, avg(CAST(ok AS DOUBLE)) >= 0.95 AS ok, coalesce((SELECT list(k ORDER BY k) FROM r WHERE r.audit = j.audit AND rn <= 5), []) AS examples FROM j GROUP BY audit""")
def _(base):
    return integrity.audited(base, sample=None)


@base_query("g09_backports", ["commits"], """, a AS (SELECT DISTINCT substr(upstream_commit, 1, 12) AS upstream, v AS version FROM commits, (VALUES ('6.6'), ('5.10')) x(v) WHERE length(upstream_commit) = 40 UNION SELECT 'abc', '6.6' UNION SELECT 'ABCDEF0123456', '6.6'),
 f AS (SELECT upstream, version, hash, subject, row_number() OVER (PARTITION BY upstream, version ORDER BY commit_date, hash) AS rn FROM a JOIN commits ON substr(upstream_commit, 1, 12) = upstream AND list_contains(affected_versions, version))
 SELECT upstream, version, hash IS NOT NULL AS backported, hash, subject FROM a LEFT JOIN (FROM f WHERE rn = 1) USING (upstream, version)""")
def _(base):
    commits = base["commits"]
    asked = commits.where("length(upstream_commit) = 40").select(F.left("upstream_commit", F.lit(12)).alias("upstream"), F.explode(F.array(F.lit("6.6"), F.lit("5.10"))).alias("version"))
    odd = commits.sparkSession.createDataFrame([("abc", "6.6"), ("ABCDEF0123456", "6.6")], "upstream string, version string")
    return lookups.backport_status(asked.unionByName(odd), commits)


@base_query("g10_regressions", ["commits", "commit_revert"], """, r AS (SELECT hash, subject, commit_date, unnest(fixes_refs) AS ref FROM commits), p AS (SELECT DISTINCT c.hash AS asked, r.hash, r.subject, r.commit_date FROM commits c JOIN r ON length(ref) >= 7 AND left(c.hash, 8) = left(ref, 8) AND starts_with(c.hash, ref)),
 f AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY commit_date, hash) AS rn FROM p), v AS (SELECT DISTINCT c.hash AS asked, k.hash, k.subject, source FROM commits c JOIN commit_revert ON left(reverted, 12) = left(c.hash, 12) JOIN commits k ON k.hash = reverter),
 w AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY hash, source) AS rn FROM v) SELECT asked, hash, subject, 'fix' AS kind FROM f WHERE rn <= 20 UNION ALL SELECT asked, hash, subject, concat('revert/', source) FROM w WHERE rn <= 20""")
def _(base):
    commits = base["commits"]
    asked = commits.select(F.concat(F.lit(" "), F.upper(F.left("hash", F.lit(20)))).alias("hash"))
    reverts = base.dealt("commit_revert", "reverted", first=lookups.HEAD, repeats=True)  # repeated edges are answered once
    return lookups.resolved_regression_fixes(asked, commits, reverts).select(F.col("full").alias("asked"), "hash", "subject", "kind")


@base_query("g11_touching", ["commits", "commit_symbol"], """, a AS (SELECT * FROM (VALUES ('tcp_1', '6.6'), ('tcp_2', NULL), ('if', '5.10'), ('__NONE__', NULL), ('no', NULL)) v(symbol, version)),
 h AS (SELECT a.symbol, version, hash, file, kind, subject, commit_date, left(hash, 12) AS short FROM a JOIN commit_symbol e ON e.symbol = a.symbol AND kind <> 'sentinel' JOIN commits ON hash = commit WHERE NOT starts_with(subject, '[stub upstream') AND commit_date >= TIMESTAMP '1995-01-01' AND (version IS NULL OR list_contains(affected_versions, version))),
 n AS (SELECT *, row_number() OVER (PARTITION BY symbol, version, short ORDER BY commit_date DESC, hash, file, kind) AS rn FROM h), k AS (SELECT *, row_number() OVER (PARTITION BY symbol, version ORDER BY short) AS place0 FROM n WHERE rn = 1)
 SELECT symbol, version, CAST(row_number() OVER (PARTITION BY symbol, version ORDER BY commit_date DESC, short) AS INTEGER) AS place, hash, file, kind, subject, commit_date FROM k WHERE place0 <= 20""")
def _(base):
    commits = base["commits"]
    asked = commits.sparkSession.createDataFrame([("tcp_1", "6.6"), (" tcp_2", None), ("if", "5.10"), ("__NONE__", None), ("no", None), (" ", None), (None, None)], "symbol string, version string")
    return lookups.commits_touching(asked, base["commit_symbol"], commits, F.lit("1995-01-01").cast("timestamp_ntz"))


@base_query("g12_section_owners", ["patterns", "people", "commit_symbol"], r""", a AS (SELECT DISTINCT file AS path FROM commit_symbol WHERE NOT contains(file, ' ') UNION SELECT '/net/x/deep/y'),
 h AS (SELECT path, section, kind, pattern, row_number() OVER (PARTITION BY path ORDER BY length(pattern) DESC, section, kind, pattern) AS n FROM a JOIN patterns ON kind IN ('F', 'X') AND CASE WHEN pattern LIKE '%/' THEN starts_with(ltrim(path, '/'), pattern) ELSE ltrim(path, '/') LIKE replace(pattern, '*', '%') END),
 k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n) AS place FROM h WHERE n <= 8 AND kind = 'F' AND NOT EXISTS (SELECT 1 FROM h x WHERE x.path = h.path AND x.section = h.section AND x.kind = 'X' AND x.n <= 8)),
 w AS (SELECT section, string_agg(concat(coalesce(name, '?'), ' <', coalesce(email, '-'), '>'), '; ' ORDER BY coalesce(role, ''), coalesce(email, ''), name) AS people FROM people GROUP BY 1)
 SELECT path, CAST(place AS INTEGER) AS place, section, pattern, coalesce(people, '(no maintainer listed)') AS people FROM k LEFT JOIN w USING (section) WHERE place <= 5""")
def _(base):
    files = base["commit_symbol"].select(F.col("file").alias("path"))
    return lookups.owners(files.unionByName(files.sparkSession.createDataFrame([("/net/x/deep/y",), ("",), (None,)], "path string")), base["patterns"], base["people"])


@base_query("g13_crashes_fixed", ["commits", "crash_commit", "crashes"], """, h AS (SELECT hash, crash, title, status, row_number() OVER (PARTITION BY hash ORDER BY status DESC NULLS LAST, crash) AS rn FROM (SELECT DISTINCT hash, crash FROM commits JOIN crash_commit ON left(commit, 12) = left(hash, 12)) JOIN crashes ON crash_id = crash) SELECT hash, crash, title, status FROM h WHERE rn <= 10""")
def _(base):
    return lookups.crashes_fixed(base["commits"].select("hash"), base["crash_commit"], base["crashes"])


@base_query("g14_patch_series", ["patches"], """, o AS (SELECT * FROM patches WHERE series <> ''), h AS (SELECT a.message AS asked, b.message, b.number, b.total, row_number() OVER (PARTITION BY a.message ORDER BY b.number NULLS LAST, b.message) AS rn FROM o a JOIN o b USING (series)) SELECT asked, message, number, total, message = asked AS is_asked FROM h WHERE rn <= 50""")
def _(base):
    return lookups.patch_series(base["patches"].select("message"), base["patches"])

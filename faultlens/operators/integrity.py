"""Integrity of a knowledge base: 21 invariants and 7 audits that derive edges again from their evidence.

`tables` maps names to DataFrames: commits (hash, subject, body, subsystem, origin, upstream_commit,
affected_versions), bugs (bug_id, external_id), cves (cve_id, score, fix_commits), crashes (crash_id), messages
(message_id) and the edges commit_cve (commit, cve, source), commit_bug (commit, bug, source), commit_message (commit,
message, match_method), commit_fixes (fixer, fixed, source), commit_revert (reverter, reverted, source), crash_commit
(crash, commit), commit_symbol (commit, symbol, file, kind).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions import text
from faultlens.operators.ranking import repeatable_sample

Tables = Mapping[str, DataFrame]

# Kinds of symbols, the marker of commits without symbols, and what no symbol or label may be
KINDS = ["function", "struct", "macro", "unknown", "sentinel"]
SENTINEL = "__NONE__"
NO_SYMBOLS = ["if", "else", "for", "while", "return", "do", "goto"]
FILE_ENDINGS = [".c", ".h", ".S", ".rst", ".yaml", ".json", ".sh", ".py", ".txt", ".md"]
TRAILERS = ["Link:", "Closes:", "http", "Reported-by:"]


@dataclass(frozen=True)
class Check:
    """A violation is a row for which `breaks` (SQL) is true, or one with an end (column, table, key) that is unknown.
    An end that is NULL is unknown."""

    table: str
    name: str
    breaks: str = ""
    ends: tuple[tuple[str, str, str], ...] = ()


def _ends(table: str, **ends: str) -> list[Check]:
    keys = {"commits": "hash", "bugs": "bug_id", "cves": "cve_id", "crashes": "crash_id", "messages": "message_id"}
    return [Check(table, f"{column}_known", ends=((column, node, keys[node]),)) for column, node in ends.items()]


def checks(vendor: str = "vendor") -> list[Check]:
    """The 19 that look at single rows and at their ends. vendor: the origin whose commits have versions."""
    both = lambda table, a, b: Check(table, "both_ends_known", ends=((a, "commits", "hash"), (b, "commits", "hash")))
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return [
        Check("commits", "subsystem_without_blanks", "subsystem like '% %'"),
        Check("commits", "upstream_is_a_full_hash", "not upstream_commit rlike '^[0-9a-f]{40}$'"),
        Check("commits", "vendor_commit_has_versions", f"origin = '{vendor}' and (affected_versions is null or cardinality(affected_versions) = 0)"),
        *_ends("commit_cve", commit="commits"),
        *_ends("commit_bug", commit="commits", bug="bugs"),
        *_ends("commit_message", commit="commits", message="messages"),
        both("commit_fixes", "fixer", "fixed"),
        both("commit_revert", "reverter", "reverted"),
        *_ends("crash_commit", commit="commits", crash="crashes"),
        *_ends("commit_symbol", commit="commits"),
        Check("commit_symbol", "kind_known", f"kind not in ({kinds})"),
        Check("commit_symbol", "sentinel_shape", f"kind = 'sentinel' and (symbol <> '{SENTINEL}' or file <> '{SENTINEL}')"),
        *(Check(table, "source_present", "source is null") for table in ("commit_cve", "commit_bug", "commit_fixes")),
        Check("cves", "score_in_range", "score < 0 or score > 10"),
    ]


def dealt(tables: Tables, name: str, column: str) -> DataFrame:
    """The table for a join or grouping by the column. A mapping with a method `dealt` gives rows that already lie by it,
    and so spares moving what it derives from less, or makes distinct, once more."""
    own = getattr(tables, "dealt", None)
    return own(name, column) if own else tables[name]


def _packed(value: Column) -> Column:
    """A full hash as its 20 bytes, anything else behind 21 zero bytes; `_unpacked` gives it back."""
    return F.when(value.rlike("^[0-9a-f]{40}$"), F.unhex(value)).otherwise(F.concat(F.lit(bytes(21)), F.encode(value, "UTF-8")))


def _unpacked(value: Column) -> Column:
    return F.when(F.octet_length(value) == 20, F.lower(F.hex(value))).otherwise(F.decode(F.substring(value, F.lit(22), F.octet_length(value)), "UTF-8"))


def dealt_packed(rows: DataFrame, column: str, *hashes: str, first: int | None = None) -> DataFrame:
    """rows dealt by a column, or by its first characters; hashes move packed."""
    packed = rows.withColumns({h: _packed(F.col(h)) for h in hashes})
    by = _unpacked(F.col(column)) if column in hashes else F.col(column)
    return packed.repartition(by if first is None else F.left(by, F.lit(first))).withColumns({h: _unpacked(F.col(h)) for h in hashes})


def _counted(rows: DataFrame, table: str, found: dict[str, Column]) -> DataFrame:
    """table, check, violations from one aggregate over the rows."""
    every = [F.struct(F.lit(name).alias("check"), n.alias("violations")) for name, n in found.items()]
    return rows.agg(F.array(*every).alias("_c")).select(F.lit(table).alias("table"), F.inline("_c"))


def _violations(tables: Tables, table: str, own: list[Check]) -> DataFrame:
    """Ends are looked up one after the other. Only counts go on from one to the next, by the ends that are still to be
    looked up: of the rows (_n), and for each check of those that break it by now."""
    ends = list(dict.fromkeys(e for c in own for e in c.ends))
    rows = dealt(tables, table, ends[0][0]) if ends else tables[table]
    bad = {c.name: f"_bad{i}" for i, c in enumerate(own)}
    breaks = [F.coalesce(F.expr(c.breaks or "false"), F.lit(False)).cast("long").alias(bad[c.name]) for c in own]
    rows = rows.select(*[column for column, _, _ in ends], F.lit(1).cast("long").alias("_n"), *breaks)
    for at, end in enumerate(ends):
        column, node, key = end
        if at:
            rows = rows.groupBy(*[c for c, _, _ in ends[at:]]).agg(*[F.sum(c).alias(c) for c in ("_n", *bad.values())])
        known = dealt(tables, node, key).select(F.col(key).alias("_known")).distinct()
        rows = rows.join(known, F.col(column) == F.col("_known"), "left")
        rows = rows.withColumns({bad[c.name]: F.when(F.col("_known").isNull(), F.col("_n")).otherwise(F.col(bad[c.name])) for c in own if end in c.ends}).drop("_known")
    return _counted(rows, table, {name: F.coalesce(F.sum(c), F.lit(0)) for name, c in bad.items()})


def invariants(tables: Tables, vendor: str = "vendor") -> DataFrame:
    """table, check, violations, passed: a row for each of the 21.

    All checks of a table share one scan of it; the keys that ends refer to are made distinct once and joined, so a
    key that is stored twice counts no edge twice. An edge's row moves once, its further ends move as counts by end, and
    nothing but counts reaches the last step."""
    by_table: dict[str, list[Check]] = {}
    for c in checks(vendor):
        by_table.setdefault(c.table, []).append(c)
    parts = [_violations(tables, table, own) for table, own in by_table.items()]
    stored = dealt(tables, "commits", "hash").select("hash")
    parts.append(_counted(stored.groupBy("hash").count(), "commits", {"hash_unique": F.count_if(F.col("count") > 1)}))
    claimed = tables["commits"].where(F.col("origin") == vendor).select(F.col("upstream_commit").alias("hash")).where("hash is not null").distinct()
    parts.append(_counted(claimed.join(stored, "hash", "left_anti"), "commits", {"upstream_commit_known": F.count(F.lit(1))}))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.withColumn("passed", F.col("violations") == 0)


def _any(column: Column, method: str, values: list[str]) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | getattr(column, method)(v)
    return out


def _cites_bug(source: Column, body: Column, external: Column) -> Column:
    """Whether a body names the bug as its source writes it: a tracker's issue URL (small and capital letters alike for
    issue_a), or a bug URL or short form for a trailer. Another source is a failure."""
    refs = F.transform(text.bug_refs(body), lambda r: r["id"])
    issues = lambda pattern: text.every(body, rf"(?i)/issues/({pattern})\b")
    return (
        F.when(source == "issue_a", F.exists(issues("I[0-9A-Z]+"), lambda i: F.upper(i) == F.upper(external)))
        .when(source == "issue_b", F.array_contains(issues(r"\d+"), external))
        .when(source == "trailer", F.array_contains(refs, external))
        .otherwise(False)
    )


def audits(tables: Tables) -> dict[str, tuple[DataFrame, list[str], Column]]:
    """Of each audit: rows with all they are judged by, the columns that name a row, and whether it holds.

    Edges are dealt by the end that is joined first; where a second one follows, what was found out at the first goes
    along instead of the texts."""
    edges = lambda table, by: dealt(tables, table, by)
    evidence = lambda prefix, *names: dealt(tables, "commits", "hash").select(F.col("hash").alias(prefix), *[F.col(n).alias(f"{prefix}_{n}") for n in names])
    fixing = dealt(tables, "cves", "cve_id").select(F.col("cve_id").alias("cve"), F.transform("fix_commits", lambda h: F.left(F.lower(h), F.lit(12))).alias("_fixing"))
    bugs = dealt(tables, "bugs", "bug_id").select(F.col("bug_id").alias("bug"), F.col("external_id").cast("string").alias("external_id"))
    cited = F.exists(text.fixes(F.col("fixer_body")), lambda r: F.col("fixed").startswith(r))
    quoted = F.trim(text.first(F.col("reverter_subject"), r'(?i)^Revert\s+"(.+)"'))
    named = F.regexp_like(F.lower("reverter_body"), F.concat(F.lit(r"this reverts commit\s+"), F.left("reverted", F.lit(12))))
    reverts = edges("commit_revert", "reverter").join(evidence("reverter", "subject", "body"), "reverter").select(
        "reverter", "reverted", "source", F.when(F.col("source") == "subject", quoted).alias("_quoted"), F.when(F.col("source") == "body", named).alias("_named")
    )
    label, file, symbol = F.col("subsystem"), F.col("file"), F.col("symbol")
    return {
        "commits.subsystem": (
            tables["commits"].where("subsystem is not null"), ["hash"],
            ~label.rlike("[ \t]") & F.length(label).between(2, 80) & ~_any(label, "startswith", TRAILERS),
        ),
        "commit_cve": (edges("commit_cve", "cve").join(fixing, "cve"), ["commit", "cve"], F.array_contains("_fixing", F.left("commit", F.lit(12)))),
        "commit_message": (
            edges("commit_message", "commit").where("match_method = 'link_trailer'").join(evidence("commit", "body"), "commit"), ["commit", "message"],
            F.col("commit_body").contains(F.col("message")),
        ),
        "commit_bug": (
            dealt_packed(edges("commit_bug", "bug").join(bugs, "bug"), "commit", "commit").join(evidence("commit", "body"), "commit"), ["commit", "bug"],
            _cites_bug(F.col("source"), F.col("commit_body"), F.col("external_id")),
        ),
        "commit_fixes": (edges("commit_fixes", "fixer").where("source = 'trailer'").join(evidence("fixer", "body"), "fixer"), ["fixer", "fixed"], cited),
        "commit_revert": (
            dealt_packed(reverts, "reverted", "reverted", "reverter").join(evidence("reverted", "subject"), "reverted"), ["reverter", "reverted"],
            F.when(F.col("source") == "subject", F.col("reverted_subject").contains(F.col("_quoted"))).when(F.col("source") == "body", F.col("_named")).otherwise(False),
        ),
        "commit_symbol": (
            edges("commit_symbol", "commit").where(F.col("kind").isin("function", "struct", "macro")), ["commit", "symbol", "file"],
            ~file.rlike("[ \t]") & (file.contains("/") | _any(file, "endswith", FILE_ENDINGS)) & ~symbol.isin(NO_SYMBOLS) & (F.length(symbol) >= 2),
        ),
    }


def audited(tables: Tables, sample: int | None = 200, seed: int = 7, threshold: float = 0.95, examples: int = 5) -> DataFrame:
    """audit, n, held, passed_share (NULL without rows), ok (true without rows), examples (first failing keys in order).

    sample: so many rows of each audit, the same on every run; None: all rows, in two aggregates without a sort. Both
    need the keys of the rows, so that they read the same shuffles."""
    out = None
    for name, (rows, key, holds) in audits(tables).items():
        judged = rows.select(F.concat_ws("/", *key).alias("_key"), F.coalesce(holds, F.lit(False)).alias("_ok"))
        if sample is not None:
            judged = repeatable_sample(judged, ["_key"], seed, sample)
        rate = F.avg(F.col("_ok").cast("double"))
        totals = judged.agg(F.count(F.lit(1)).alias("n"), F.count_if("_ok").alias("held"), F.round(rate, 6).alias("passed_share"), F.coalesce(rate >= threshold, F.lit(True)).alias("ok"), F.min(F.when(~F.col("_ok"), F.col("_key"))).alias("_least"))
        failing = judged.where("not _ok").select("_key").orderBy("_key").limit(examples).agg(F.array_sort(F.collect_list("_key")).alias("examples"))
        shown = F.when(F.col("_least").isNull(), F.array().cast("array<string>")).otherwise(F.col("examples")).alias("examples")
        one = totals.join(F.broadcast(failing)).select(F.lit(name).alias("audit"), "n", "held", "passed_share", "ok", shown)
        out = one if out is None else out.unionByName(one)
    return out

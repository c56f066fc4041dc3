"""Lookups in the graph for a table of requests, so that one of them and a million are the same equality joins.

Tables are those of `operators.integrity`; commits have commit_date and fixes_refs besides. Hashes are matched by their
first 12 characters, or by all of a shorter abbreviation of at least 7; what is shorter matches nothing. Requests that
are NULL or blank find nothing. Repeated requests are answered once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions import stack
from faultlens.operators.integrity import dealt_packed
from faultlens.operators.joins import resolve_prefixes
from faultlens.operators.ranking import first_of, top_n

# Fixed value: how subjects of commits begin that only stand in for one that is not stored
STUB = "[stub upstream"


def is_stub(subject: Column) -> Column:
    return F.coalesce(subject.startswith(STUB), F.lit(False))


def _short(value: Column) -> Column:
    return F.left(F.lower(F.trim(value)), F.lit(12))


def backport_status(requests: DataFrame, commits: DataFrame) -> DataFrame:
    """upstream, version -> upstream, version, backported, hash, subject of the earliest commit that brings the upstream
    one into that version."""
    asked = requests.select("upstream", "version").distinct()
    rows = commits.where("upstream_commit is not null").select("upstream_commit", "affected_versions", "commit_date", "hash", "subject")
    found = resolve_prefixes(asked.withColumn("_ref", _short(F.col("upstream"))), "_ref", rows, "upstream_commit").where(F.array_contains("affected_versions", F.col("version")))
    first = first_of(found, ["upstream", "version"], [F.asc_nulls_last("commit_date"), F.col("hash")]).select("upstream", "version", "hash", "subject")
    return asked.join(first, ["upstream", "version"], "left").select("upstream", "version", F.col("hash").isNotNull().alias("backported"), "hash", "subject")


HEAD = 7


def _head(value: Column) -> Column:
    """What two hashes have in common if one of them begins with the other: rows are dealt by it."""
    return F.left(value, F.lit(HEAD))


def _same(a: Column, b: Column) -> Column:
    """a = b, written so that it becomes no further key of a join: both sides lie by their heads already."""
    return a.startswith(b) & b.startswith(a)


def full_hashes(requests: DataFrame, commits: DataFrame) -> DataFrame:
    """hash -> asked, hash: the first stored hash that begins with the request, else the request itself."""
    return _resolved(requests, commits).select("asked", F.col("full").alias("hash"))


def _resolved(requests: DataFrame, commits: DataFrame) -> DataFrame:
    """_head, asked, full, with the rows dealt by _head."""
    ref = F.lower(F.trim("asked"))
    asked = requests.select(F.col("hash").alias("asked")).where(ref != "").repartition(_head(ref)).select(_head(ref).alias("_head"), "asked", ref.alias("_ref")).distinct()
    stored = commits.select(_head(F.col("hash")).alias("_at"), "hash")
    found = asked.join(stored, (F.col("_head") == F.col("_at")) & (F.length("_ref") >= HEAD) & F.col("hash").startswith(F.col("_ref")), "left")
    return found.groupBy("_head", "asked", "_ref").agg(F.min("hash").alias("hash")).select("_head", "asked", F.coalesce("hash", "_ref").alias("full"))


def regression_fixes(requests: DataFrame, commits: DataFrame, reverts: DataFrame, limit: int = 20) -> DataFrame:
    """hash -> asked, hash, subject, kind: commits whose trailer names the asked one (the earliest `limit`), and those
    that revert it (the first `limit`). An asked commit without either has no row."""
    return resolved_regression_fixes(requests, commits, reverts, limit).drop("full")


def resolved_regression_fixes(requests: DataFrame, commits: DataFrame, reverts: DataFrame, limit: int = 20) -> DataFrame:
    """regression_fixes with `full` besides, the hash that the request was taken for.

    Requests and what is found for them lie by the first characters of that hash from one join to the next; only reverts
    go to their commits and back, with both hashes packed."""
    asked = _resolved(requests, commits)
    refs = commits.select("hash", "subject", "commit_date", F.explode("fixes_refs").alias("_ref")).where(F.length("_ref") >= HEAD).withColumn("_at", _head(F.col("_ref")))
    fixing = asked.join(refs, (F.col("_head") == F.col("_at")) & F.col("full").startswith(F.col("_ref"))).dropDuplicates(["_head", "asked", "hash"])
    fixing = top_n(fixing, ["_head", "asked"], [F.asc_nulls_last("commit_date"), F.col("hash")], limit).select("asked", "full", "hash", "subject", F.lit("fix").alias("kind"))
    back = reverts.select(_head(F.col("reverted")).alias("_at"), F.left("reverted", F.lit(12)).alias("_short"), F.col("reverter").alias("hash"), "source")
    near = asked.join(back, (F.col("_head") == F.col("_at")) & _same(F.left("full", F.lit(12)), F.col("_short"))).select("_head", "full", "hash", "source").distinct()
    undone = dealt_packed(near.drop("_head"), "hash", "full", "hash").join(commits.select("hash", "subject"), "hash")
    undone = dealt_packed(undone, "full", "full", "hash", first=HEAD).withColumn("_head", _head(F.col("full"))).dropDuplicates(["_head", "full", "hash", "source"])
    undone = top_n(undone, ["_head", "full"], [F.col("hash"), F.col("source")], limit).select(F.col("_head").alias("_at"), F.col("full").alias("_full"), "hash", "subject", F.concat(F.lit("revert/"), F.coalesce("source", F.lit("?"))).alias("kind"))
    undone = asked.join(undone, (F.col("_head") == F.col("_at")) & _same(F.col("full"), F.col("_full")))
    return fixing.unionByName(undone.select("asked", "full", "hash", "subject", "kind"))


def commits_touching(requests: DataFrame, edges: DataFrame, commits: DataFrame, since: Column, limit: int = 20) -> DataFrame:
    """symbol, version (NULL: any) -> symbol, version, place, hash, file, kind, subject, commit_date.

    One row for each 12 first characters of a hash, its newest commit; the first `limit` of these by those characters
    are kept, and `place` counts them from the newest. Stubs and sentinels are left out."""
    e = edges.where("kind <> 'sentinel'").select("symbol", F.col("commit").alias("hash"), "file", "kind")
    c = commits.where(~is_stub(F.col("subject")) & (F.col("commit_date") >= since)).select("hash", "subject", "commit_date", "affected_versions")
    asked = requests.select(F.trim("symbol").alias("symbol"), "version").where("symbol <> ''").distinct()
    hit = e.join(asked, "symbol").join(c, "hash").where(F.col("version").isNull() | F.array_contains("affected_versions", F.col("version")))
    hit = hit.select("*", F.coalesce("version", F.lit("")).alias("_v"), F.left("hash", F.lit(12)).alias("_short"))
    newest = first_of(hit, ["symbol", "_v", "_short"], [F.desc("commit_date"), F.col("hash"), F.col("file"), F.col("kind")])
    kept = top_n(newest, ["symbol", "_v"], [F.col("_short")], limit).drop("rn")
    shown = top_n(kept, ["symbol", "_v"], [F.desc("commit_date"), F.col("_short")], limit)
    return shown.select("symbol", "version", F.col("rn").alias("place"), "hash", "file", "kind", "subject", "commit_date")


SALTS = 16


def _anchors(path: Column) -> Column:
    """The path itself and every folder above it, each with its slash, and the empty one."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i - 1), "/"), F.when(i > 1, "/").otherwise("")))
    return F.array_distinct(F.concat(above, F.array(path)))


def _anchor(pattern: Column) -> Column:
    """What every path that fits has among its anchors: the pattern, or its longest folder before the first star."""
    literal = F.regexp_extract(pattern, r"^([^*]*)", 1)
    return F.when(literal == pattern, pattern).otherwise(F.regexp_extract(literal, r"^(.*/)", 1))


def owners(requests: DataFrame, patterns: DataFrame, people: DataFrame, fetched: int = 8, shown: int = 5) -> DataFrame:
    """path -> path, place, section, pattern, people.

    patterns: section, pattern, kind (F or X); people: section, name, email, role. A pattern that ends in a slash takes
    everything below it, elsewhere a star takes any run of characters. The `fetched` longest matches of a path are
    looked at; a section with an X among them is out, and the first `shown` F patterns stay. A path meets the patterns of
    each folder above it, at any depth, by equality; only those with a star are tried further. Paths of one folder are
    dealt over SALTS copies of its patterns."""
    asked = requests.select("path", F.ltrim(F.trim("path"), F.lit("/")).alias("_p")).where(F.col("_p").rlike("^[^ ]+$")).distinct()
    asked = asked.withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")).withColumn("_anchor", F.explode(_anchors(F.col("_p"))))
    globs = patterns.where("kind in ('F', 'X')").select("section", "pattern", "kind", _anchor(F.col("pattern")).alias("_anchor"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    like = F.replace(F.regexp_replace("pattern", "([!%_])", "!$1"), F.lit("*"), F.lit("%"))
    fits = F.when(F.endswith("pattern", F.lit("/")), F.col("_p").startswith(F.col("pattern"))).otherwise(F.like("_p", like, F.lit("!")))
    hit = asked.join(globs, ["_anchor", "_salt"]).where(fits)
    best = top_n(hit, ["path"], [F.desc(F.length("pattern")), F.col("section"), F.col("kind"), F.col("pattern")], fetched).withColumnRenamed("rn", "_at")
    out = best.where("kind = 'X'").select("path", "section").distinct()
    kept = top_n(best.where("kind = 'F'").join(out, ["path", "section"], "left_anti"), ["path"], [F.col("_at")], shown)
    one = F.concat(F.coalesce("name", F.lit("?")), F.lit(" <"), F.coalesce("email", F.lit("-")), F.lit(">"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("role", F.lit("")), F.coalesce("email", F.lit("")), one.alias("who")))), lambda x: x["who"])
    every = people.groupBy("section").agg(F.array_join(listed, "; ").alias("people"))
    named = kept.join(every, "section", "left")
    return named.select("path", F.col("rn").alias("place"), "section", "pattern", F.coalesce("people", F.lit("(no maintainer listed)")).alias("people"))


def crashes_fixed(requests: DataFrame, crash_commit: DataFrame, crashes: DataFrame, limit: int = 10) -> DataFrame:
    """hash -> hash, crash, title, status: crashes that the commit, or another with its 12 first characters, fixes."""
    asked = requests.select("hash", _short(F.col("hash")).alias("_short")).where("_short <> ''").distinct()
    e = crash_commit.select("crash", F.left("commit", F.lit(12)).alias("_short")).distinct()
    hit = asked.join(e, "_short").join(crashes.select(F.col("crash_id").alias("crash"), "title", "status"), "crash")
    return top_n(hit, ["hash"], [F.desc_nulls_last("status"), F.col("crash")], limit).select("hash", "crash", "title", "status")


def similar_crashes(requests: DataFrame, sources: dict[str, tuple[DataFrame, str, str]], limit: int = 10) -> DataFrame:
    """id, trace -> id, signature, origin, key, title: reports of each source with the signature of the trace, or of the
    trace that stands in a longer text. sources: name -> (table with stack_signature, its key, its title). Texts
    without a signature find nothing."""
    block = F.coalesce(stack.extract_trace(F.col("trace")), F.col("trace"))
    asked = requests.select("id", stack.signature(block).alias("stack_signature")).where("stack_signature <> ''")
    out = None
    for name, (rows, key, title) in sources.items():
        known = rows.select("stack_signature", F.col(key).cast("string").alias("key"), F.col(title).cast("string").alias("title"))
        hit = top_n(asked.join(known, "stack_signature"), ["id"], [F.col("key")], limit)
        one = hit.select("id", F.col("stack_signature").alias("signature"), F.lit(name).alias("origin"), "key", "title")
        out = one if out is None else out.unionByName(one)
    return out


def patch_series(requests: DataFrame, patches: DataFrame, limit: int = 50) -> DataFrame:
    """message -> asked, message, number, total, is_asked: all patches of the asked one's series, in order.

    patches: message, series, number, total; without a series (NULL or empty) nothing is found."""
    own = patches.where("series <> ''").select("message", "series", "number", "total")
    asked = requests.select(F.trim("message").alias("asked")).distinct().join(own.select(F.col("message").alias("asked"), "series"), "asked")
    first = top_n(own, ["series"], [F.asc_nulls_last("number"), F.col("message")], limit)
    return asked.join(first, "series").select("asked", "message", "number", "total", (F.col("message") == F.col("asked")).alias("is_asked"))

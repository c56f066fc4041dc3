"""Retrieval by routes: a ranked search of each kind of entity, fan-out, linked commits, one merged order.

Every route gives hits: route, id (string), score, tier (NULL where the route has none), title, body (at most 500
characters). Its limit bounds what it returns; only ids and scores are moved before that.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.operators.joins import both_directions
from faultlens.operators.lookups import is_stub
from faultlens.operators.ranking import max_normalised, rank_score, top_n
from faultlens.plans.search import Index
from faultlens.session import checkpointed

HITS = "route string, id string, score double, tier int, title string, body string"
# Endings of files that hold documentation
DOC_ENDINGS = [".rst", ".txt", ".md"]
Docs = tuple[Index, DataFrame, str, str]  # index, rows, columns of title and body; the index names the key


def _hits(route: str, found: DataFrame, key: str, rows: DataFrame, title: str, body: str) -> DataFrame:
    """found (key, score, tier) with titles and bodies. Spark broadcasts the few hits where their size allows."""
    texts = rows.select(F.col(key), F.coalesce(F.col(title).cast("string"), F.lit("")).alias("title"), F.left(F.coalesce(body, F.lit("")), F.lit(500)).alias("body"))
    return found.join(texts, key).select(F.lit(route).alias("route"), F.col(key).cast("string").alias("id"), F.round("score", 6).alias("score"), F.col("tier").cast("int").alias("tier"), "title", "body")


def tiered(route: str, docs: Docs, words: list[str], limit: int, kept: Column | None = None) -> DataFrame:
    """The chosen tier's rows by score. kept: only rows for which it is true, chosen before the tier."""
    index, rows, title, body = docs
    if not words:
        return rows.sparkSession.createDataFrame([], HITS)
    found = index.tiered_search(words, limit, None if kept is None else rows.where(kept))
    return _hits(route, found, index.key, rows, title, body)


def commits(docs: Docs, words: list[str], limit: int, version: str | None = None, subject: str = "subject", versions: str = "affected_versions") -> DataFrame:
    """Tiers over commits that are no stubs and, if asked, affect a version."""
    kept = ~is_stub(F.col(subject))
    return tiered("commit", docs, words, limit, kept if version is None else kept & F.array_contains(versions, version))


def exact_first(route: str, docs: Docs, ids: list[str], words: list[str], limit: int) -> DataFrame:
    """Rows of the named ids with score 1 and no tier, then tiers in what room is left; a row may come in both."""
    index, rows, title, body = docs
    named = rows.where(F.col(index.key).cast("string").isin([i.upper() for i in ids])).select(index.key, F.lit(1.0).alias("score"), F.lit(None).cast("int").alias("tier"))
    exact = _hits(route, named, index.key, rows, title, body)
    n = exact.agg(F.count(F.lit(1)).alias("n"))  # one row
    rest = top_n(tiered(route, docs, words, limit), ["route"], [F.desc("score"), F.col("id")], limit)
    return exact.unionByName(rest.join(F.broadcast(n)).where(F.col("rn") + F.col("n") <= limit).drop("rn", "n"))


def mail(local: DataFrame, archive: DataFrame, limit: int) -> DataFrame:
    """Local hits and hits of an archive (message, title, snippet, place: from 1) by message: both are scaled to 1, the
    larger score wins, and the local text and tier stay."""
    scored = archive.select(F.lit("mail").alias("route"), F.col("message").alias("id"), rank_score([], [F.col("place")]).alias("score"), F.lit(None).cast("int").alias("tier"), "title", F.col("snippet").alias("body"))
    both = local.withColumn("_from", F.lit(0)).unionByName(scored.withColumn("_from", F.lit(1)))
    both = both.withColumn("score", max_normalised(both, "_from", "score"))
    pick = lambda c: F.min_by(c, "_from").alias(c)
    once = both.groupBy("route", "id").agg(F.max("score").alias("score"), pick("tier"), pick("title"), pick("body"))
    return once.orderBy(F.desc(F.round("score", 6)), "id").limit(limit)


def or_else(first: DataFrame, other: DataFrame) -> DataFrame:
    """first, or other if first has no rows; decided within the plan."""
    n = first.limit(1).agg(F.count(F.lit(1)).alias("_n"))  # one row
    return first.unionByName(other.join(F.broadcast(n)).where("_n = 0").drop("_n"))


def documentation(docs: Docs, words: list[str], limit: int, code: DataFrame | None = None) -> DataFrame:
    """Rows with any of the first ten words of two characters or more; without any, code hits of documentation files."""
    index, rows, title, body = docs
    asked = [w.replace("'", "").replace(":", "") for w in words if len(w) >= 2][:10]
    found = index.bm25(asked).orderBy(F.desc(F.round("score", 6)), index.key).limit(limit).withColumn("tier", F.lit(None).cast("int"))
    hits = _hits("docs", found, index.key, rows, title, body)
    if code is None:
        return hits
    endings = F.lit(False)
    for e in DOC_ENDINGS:
        endings = endings | F.col("title").endswith(e)
    return or_else(hits, code.where(endings).withColumn("route", F.lit("docs")))


def word_by_word(search: Callable[[list[str], int], DataFrame], words: list[str], limit: int) -> DataFrame:
    """search(words, limit); if that is empty and there are several words, each of the first six by itself, at least
    two hits a word, a hit of one title and opening (50 characters) once, by its first word."""
    whole, single = search(words, limit), words[:6]
    if len(words) < 2:
        return whole
    parts = None
    for i, w in enumerate(single):
        one = search([w], max(2, limit // len(single))).withColumn("_word", F.lit(i))
        parts = one if parts is None else parts.unionByName(one)
    once = top_n(parts.withColumn("_head", F.left("body", F.lit(50))), ["title", "_head"], [F.col("_word"), F.desc("score"), F.col("id")], 1)
    return or_else(whole, once.orderBy("_word", F.desc("score"), "id").limit(limit).select(*whole.columns))


def fan_out(routes: Mapping[str, Callable[[], DataFrame]]) -> tuple[DataFrame, dict[str, Exception]]:
    """All routes at once, each run to its end; (hits of those that succeeded, errors of the others). A hit list is as
    long as its route's limit, so what is kept between is small."""
    if not routes:
        raise ValueError("no routes")

    def run(make: Callable[[], DataFrame]) -> DataFrame | Exception:
        try:
            return checkpointed(make())
        except Exception as e:  # a route that fails contributes nothing; its error is returned
            return e

    with ThreadPoolExecutor(len(routes)) as pool:
        done = dict(zip(routes, pool.map(run, routes.values()), strict=True))
    failed = {name: r for name, r in done.items() if isinstance(r, Exception)}
    good = [r for r in done.values() if isinstance(r, DataFrame)]
    if not good:
        raise RuntimeError(f"every route failed: {failed}")
    out = good[0]
    for more in good[1:]:
        out = out.unionByName(more)
    return out, failed


def linked_commits(hits: DataFrame, tables: Mapping[str, DataFrame], sources: int = 10, per_bug: int = 5) -> DataFrame:
    """route, id, score, tier, title, body, step: commits that links lead to from the `sources` best hits of each route.

    Steps: 1 messages, 2 vulnerabilities, 3 bugs (each only its `per_bug` newest commits), with 0.9 of the hit's score;
    4 fixes (at most 50) and 5 reverts (at most 20), both ways from commits, with 0.85. Stubs are left out. The same
    commit may come in several steps; `fused` keeps the first."""
    best = top_n(hits, ["route"], [F.desc("score"), F.col("id")], sources).select("route", F.col("id").alias("node"), "score")
    real = tables["commits"].where(~is_stub(F.col("subject"))).select(F.col("hash").alias("other"), F.coalesce("subject", F.lit("")).alias("title"), "commit_date")
    from_ = lambda table, column: tables[table].select(F.col(column).cast("string").alias("node"), F.col("commit").alias("other")).distinct()
    pairs = lambda table, a, b: both_directions(tables[table], a, b).select("node", "other").distinct()
    out = None
    for step, (route, edges, factor) in enumerate([
        ("mail", from_("commit_message", "message"), 0.9), ("cve", from_("commit_cve", "cve"), 0.9), ("bug", from_("commit_bug", "bug"), 0.9),
        ("commit", pairs("commit_fixes", "fixer", "fixed"), 0.85), ("commit", pairs("commit_revert", "reverter", "reverted"), 0.85),
    ], 1):
        found = edges.join(F.broadcast(best.where(F.col("route") == route)), "node").join(real, "other")  # ten rows at most
        if route == "bug":
            found = top_n(found, ["node"], [F.desc_nulls_last("commit_date"), F.col("other")], per_bug)
        if step > 3:
            found = found.orderBy(F.desc("score"), "node", "other").limit(50 if step == 4 else 20)
        one = found.select(F.lit("commit").alias("route"), F.col("other").alias("id"), (F.col("score") * factor).alias("score"), F.lit(None).cast("int").alias("tier"), "title", F.lit("").alias("body"), F.lit(step).alias("step"))
        out = one if out is None else out.unionByName(one)
    return out


def fused(hits: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """route, id, final, step, title, body: hits (step 0), then linked commits that are not among them by their
    first step, scaled to 1 by route, with a quarter more for each step of the tier, in one order. All hits stay, also
    such as a route gives twice."""
    base = hits.withColumn("step", F.lit(0))
    if linked is not None:
        here = hits.where("route = 'commit'").select("id")
        fresh = top_n(linked.join(here, "id", "left_anti"), ["id"], [F.col("step"), F.desc("score")], 1).drop("rn")
        base = base.unionByName(fresh)
    final = max_normalised(base, "route", "score") * (1 + 0.25 * F.coalesce("tier", F.lit(0)))
    scored = base.withColumn("final", F.round(final, 6))
    return scored.select("route", "id", "final", "step", "title", "body").orderBy(F.desc("final"), "route", "id", "step")

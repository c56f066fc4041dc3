"""Evaluation roll-ups, ingest health, integrity invariants and fidelity audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.operators.ranking import leading_run, repeatable_sample, top_n


def share(condition: Column) -> Column:
    """Mean of a condition over the rows where it is not NULL."""
    return F.round(F.avg(condition.cast("double")), 6)


def recall_at(found: Column, expected: Column, k: int = 10, head: int = 12) -> Column:
    """Share of expected ids among the first k found, by their first `head` characters; NULL without expected ids."""
    cut = lambda a: F.array_distinct(F.transform(a, lambda x: F.substring(x, 1, head)))
    want = cut(expected)
    return F.when(F.size(want) > 0, F.size(F.array_intersect(cut(F.slice(found, 1, k)), want)) / F.size(want))


def by_category(results: DataFrame, category: str, recall: str, correct: str) -> DataFrame:
    """n, scored, mean_recall (NULLs left out, 0 without any), correct_share (of all rows)."""
    right = F.coalesce(F.col(correct), F.lit(False)).cast("double")
    return results.groupBy(category).agg(
        F.count(F.lit(1)).alias("n"), F.count(recall).alias("scored"), F.round(F.coalesce(F.avg(recall), F.lit(0.0)), 3).alias("mean_recall"), F.round(F.avg(right), 3).alias("correct_share")
    )


def groundedness(verified: Column, claims: Column, verdict: Column) -> Column:
    return F.when(verdict != "answered", "n/a").when(claims == 0, "speculative").when(verified * 2 >= claims, "grounded").otherwise("speculative")


def health(runs: DataFrame, source: str, ok: Column, error: Column, at: str, tie: str, now: Column, stale_days: int = 14) -> DataFrame:
    """source, last_success, consecutive_errors, circuit_open, backoff_minutes, is_stale, status.

    Errors are counted from the newest run to the first that is none; from 3 on the circuit is open for 30 minutes,
    doubling up to 480."""
    run = leading_run(runs, source, [F.desc(at), F.desc(tie)], ~error)
    last = runs.groupBy(source).agg(F.max(F.when(ok, F.col(at))).alias("last_success"))
    n = F.col("run_length")
    backoff = F.when(n >= 3, F.least(F.lit(480), 30 * F.pow(F.lit(2), F.least(n - 3, F.lit(10))).cast("int"))).otherwise(0)
    return health_status(last.join(run, source).select(source, "last_success", n.alias("consecutive_errors"), (n >= 3).alias("circuit_open"), backoff.alias("backoff_minutes")), now, stale_days)


def health_status(found: DataFrame, now: Column, stale_days: int = 14) -> DataFrame:
    """found (last_success, consecutive_errors, circuit_open) with is_stale and status."""
    stale = F.col("last_success").isNull() | (F.col("last_success") < now - F.expr(f"interval {stale_days} days"))
    status = F.when(F.col("circuit_open"), "circuit_open").when(stale, "stale").when(F.col("consecutive_errors") > 0, "degraded").otherwise("ok")
    return found.withColumn("is_stale", stale).withColumn("status", status)


def invariants(checks: dict[str, DataFrame]) -> DataFrame:
    """check, violations, passed: each check is a table of violations."""
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations", (F.col("violations") == 0).alias("passed"))
        out = one if out is None else out.unionByName(one)
    return out


def fidelity(edges: DataFrame, key: list[str], holds: Column, name: str, sample: int = 200, seed: int = 7, threshold: float = 0.95) -> DataFrame:
    """audit, n, passed_share, ok, examples: a repeatable sample re-derived; up to 5 failing keys as examples."""
    picked = repeatable_sample(edges, key, seed, sample).withColumn("_ok", F.coalesce(holds, F.lit(False)))
    bad = F.slice(F.array_sort(F.collect_list(F.when(~F.col("_ok"), F.concat_ws("/", *key)))), 1, 5)
    rate = F.avg(F.col("_ok").cast("double"))
    return picked.agg(F.count(F.lit(1)).alias("n"), F.round(rate, 6).alias("passed_share"), (rate >= threshold).alias("ok"), bad.alias("examples")).select(F.lit(name).alias("audit"), "*")


def phases(trace: DataFrame, case: str, tool: str, error: str, tools_of: dict[str, list[str]]) -> DataFrame:
    """case, one boolean a phase, coverage: a phase is reached by any call of its tools without an error."""
    good = trace.where(~F.coalesce(F.col(error), F.lit(False))).groupBy(case).agg(F.collect_set(tool).alias("_t"))
    every = trace.select(case).distinct().join(good, case, "left")
    flags = {p: F.coalesce(F.arrays_overlap("_t", F.array(*[F.lit(x) for x in names])), F.lit(False)) for p, names in tools_of.items()}
    total = sum((f.cast("int") for f in flags.values()), F.lit(0))
    return every.select(case, *[f.alias(p) for p, f in flags.items()], F.round(total / len(flags), 6).alias("coverage"))


FREQUENT = 200


def best_evidence(claims: DataFrame, evidence: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """case_id, claim_id, evidence_id, common: for each claim (case_id, claim_id, tokens) the evidence of its case
    (case_id, evidence_id, tokens) with the most tokens in common; of equal ones the smallest id, also where none has any.
    Claims of cases without evidence have no row. A null list has no tokens.

    Tokens that at most `frequent` pieces of evidence of a case have bring claims and evidence together one by one. The
    others only make signatures, of which a case has far fewer than texts: signatures meet signatures, and the smallest
    id stands for a signature. A text that has rarer tokens in common as well is compared in full by the first way,
    so the best of both ways is the best of all. No claim meets evidence that it shares no token with."""
    none = F.array().cast("array<string>")
    every = lambda df, id_: df.select("case_id", id_, F.array_distinct(F.coalesce("tokens", none)).alias("tokens"))
    each = lambda df, id_: every(df, id_).select("case_id", id_, F.explode("tokens").alias("token"))
    known, asked = each(evidence, "evidence_id"), each(claims, "claim_id")
    df = known.groupBy("case_id", "token").agg((F.count(F.lit(1)) > frequent).alias("often"))
    known, asked = known.join(df, ["case_id", "token"]), asked.join(df, ["case_id", "token"])
    sign = lambda rows, id_: rows.groupBy("case_id", id_).agg(F.array_sort(F.collect_list(F.when(F.col("often"), F.col("token")))).alias("sign"))
    known_signs, asked_signs = sign(known, "evidence_id"), sign(asked, "claim_id")
    rare = known.where("not often").join(asked.where("not often").drop("often"), ["case_id", "token"]).groupBy("case_id", "claim_id", "evidence_id").agg(F.count(F.lit(1)).alias("n"))
    full = (
        rare.join(asked_signs.withColumnRenamed("sign", "asked"), ["case_id", "claim_id"]).join(known_signs.withColumnRenamed("sign", "known"), ["case_id", "evidence_id"])
        .select("case_id", "claim_id", "evidence_id", (F.col("n") + F.size(F.array_intersect("asked", "known"))).alias("common"))
    )
    stands = known_signs.where(F.size("sign") > 0).groupBy("case_id", F.col("sign").alias("known")).agg(F.min("evidence_id").alias("evidence_id"))
    kinds = asked_signs.where(F.size("sign") > 0).select("case_id", F.col("sign").alias("asked")).distinct()
    meet = stands.select("case_id", "known", "evidence_id", F.explode("known").alias("token")).join(kinds.select("case_id", "asked", F.explode("asked").alias("token")), ["case_id", "token"])
    counted = meet.groupBy("case_id", "asked", "known").agg(F.count(F.lit(1)).alias("common"), F.min("evidence_id").alias("evidence_id"))
    best = top_n(counted, ["case_id", "asked"], [F.desc("common"), F.col("evidence_id")], 1).select("case_id", F.col("asked").alias("sign"), "common", "evidence_id")
    by_sign = asked_signs.join(best, ["case_id", "sign"]).select("case_id", "claim_id", "evidence_id", "common")
    least = every(evidence, "evidence_id").groupBy("case_id").agg(F.min("evidence_id").alias("evidence_id"))
    nothing = claims.select("case_id", "claim_id").join(least, "case_id").select("case_id", "claim_id", "evidence_id", F.lit(0).cast("long").alias("common"))
    found = full.unionByName(by_sign).unionByName(nothing)
    return found.groupBy("case_id", "claim_id").agg(F.min_by(F.struct("evidence_id", "common"), F.struct(-F.col("common"), "evidence_id")).alias("b")).select("case_id", "claim_id", "b.*")


def bind_claims(claims: DataFrame, evidence: DataFrame, least: float = 0.2, frequent: int = FREQUENT) -> DataFrame:
    """Each claim's best evidence within its case: case_id, claim_id, evidence_id, share (of the claim's tokens), verified."""
    size = claims.select("case_id", "claim_id", F.size(F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>")))).alias("n"))
    share = F.when(F.col("n") == 0, 0.0).otherwise(F.col("common") / F.col("n"))
    found = best_evidence(claims, evidence, frequent).join(size, ["case_id", "claim_id"]).withColumn("share", share)
    return found.select("case_id", "claim_id", "evidence_id", F.round("share", 6).alias("share"), (F.col("share") >= least).alias("verified"))

import random

from pyspark.sql import functions as F

from faultlens.operators import graph, joins, quality, ranking, upsert
from faultlens.plans import search


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, "a", None, ["x"]), (2, "b", "s", None)], "k int, name string, sub string, v array<string>")
    new = spark.createDataFrame([(2, "B", None, ["y"]), (3, "c", "t", ["z"])], "k int, name string, sub string, v array<string>")
    once = upsert.upsert(old, new, ["k"], coalesce=("sub",), union=("v",))
    rows = sorted(tuple(r) for r in once.collect())
    assert rows == [(1, "a", None, ["x"]), (2, "b", "s", ["y"]), (3, "c", "t", ["z"])]
    assert sorted(tuple(r) for r in upsert.upsert(once, new, ["k"], coalesce=("sub",), union=("v",)).collect()) == rows
    assert sorted(r["name"] for r in upsert.upsert(old, new, ["k"], overwrite=("name",)).collect()) == ["B", "a", "c"]
    assert [r["k"] for r in upsert.insert_if_absent(old, new.unionByName(new), ["k"]).collect()] == [3]


def test_prefix_join_matches_a_loop(spark):
    rng = random.Random(5)
    targets = ["".join(rng.choice("ab") for _ in range(12)) for _ in range(60)]
    refs = [t[: rng.randint(5, 12)] for t in targets] + ["zzzzzzz", ""]
    got = joins.resolve_prefixes(spark.createDataFrame([(r,) for r in refs], "r string"), "r", spark.createDataFrame([(t,) for t in targets], "t string"), "t")
    assert sorted((r["r"], r["t"]) for r in got.collect()) == sorted((r, t) for r in refs for t in targets if len(r) >= 7 and t.startswith(r))


def test_threads_do_not_depend_on_arrival(spark):
    parents = {i: (i - 1 if i % 7 else None) for i in range(60)} | {100: 999, 101: 100}
    rows = list(parents.items())
    random.Random(1).shuffle(rows)
    got = {r["k"]: r["root"] for r in graph.thread_roots(spark.createDataFrame(rows, "k long, p long"), "k", "p").collect()}
    assert got == {i: i - i % 7 for i in range(60)} | {100: 100, 101: 100}


def test_threads_of_cycles(spark):
    parents = {1: 2, 2: 1, 10: 11, 11: 12, 12: 10, 5: 10, 4: 5, 30: 30, 31: 30, 40: None, 41: 40} | {100 + i: 100 + (i + 1) % 37 for i in range(37)} | {90: 120}
    rows = [(k, p) for k, p in parents.items()]
    got = {r["k"]: r["root"] for r in graph.thread_roots(spark.createDataFrame(rows, "k long, p long"), "k", "p").collect()}
    assert got == {1: 1, 2: 1, 10: 10, 11: 10, 12: 10, 5: 10, 4: 10, 30: 30, 31: 30, 40: 40, 41: 40} | {100 + i: 100 for i in range(37)} | {90: 100}
    assert graph.thread_roots(spark.createDataFrame([], "k long, p long"), "k", "p").collect() == []


def test_single_pass_tiers_equal_the_loop(spark):
    rng = random.Random(9)
    words = ["aa", "bb", "cc", "dd"]
    for _ in range(6):
        texts = [" ".join(w for w in words if rng.random() < 0.55) for _ in range(rng.randint(1, 14))]
        docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
        got = {(r["id"], r["tier"]) for r in search.tiers(docs, "id", "text", words).collect()}
        tier = next((k for k in range(len(words), 0, -1) if sum(set(words[:k]) <= set(t.split()) for t in texts) >= 3), 0)
        hit = [i for i, t in enumerate(texts) if (set(words[:tier]) <= set(t.split()) if tier else t.strip())]
        assert got == {(i, tier) for i in hit}


def test_cover_density():
    assert search.cover_density([[1], [2]]) == 1.0 and search.cover_density([[1], [5]]) == 2 / 5
    assert search.cover_density([[1, 4], [2, 5]]) > search.cover_density([[1], [2]]) and search.cover_density([[1], []]) == 0.0


def test_as_of_and_runs(spark):
    left = spark.createDataFrame([("a", 5), ("a", 9), ("b", 1)], "k string, t int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 8, "y")], "k string, t int, v string")
    assert sorted(tuple(r) for r in joins.as_of(left, right, ["k"], "t", "v").collect()) == [("a", 5, "x"), ("a", 9, "y"), ("b", 1, None)]
    runs = spark.createDataFrame([("s", 1, "ok"), ("s", 2, "error"), ("s", 3, "error"), ("u", 1, "ok")], "s string, at int, st string")
    assert dict(map(tuple, ranking.leading_run(runs, "s", [F.desc("at")], F.col("st") != "error").collect())) == {"s": 2, "u": 0}
    health = {r["s"]: r for r in quality.health(runs.withColumn("at", F.timestamp_seconds(F.col("at"))), "s", F.col("st") == "ok", F.col("st") == "error", "at", "st", F.lit("1970-01-02").cast("timestamp")).collect()}
    assert health["s"]["status"] == "degraded" and health["u"]["status"] == "ok"


def test_audit_and_claims(spark):
    e = spark.range(500).withColumn("ok", F.col("id") % 50 != 0)
    a, b = (quality.fidelity(x, ["id"], F.col("ok"), "n", sample=100).first() for x in (e, e.repartition(7)))
    assert a == b and a["n"] == 100 and 0.9 < a["passed_share"] <= 1
    claims = spark.createDataFrame([(1, 1, ["alpha", "beta", "gamma"]), (1, 2, ["nothing", "shared"]), (1, 3, []), (2, 1, ["alpha"])], "case_id int, claim_id int, tokens array<string>")
    evidence = spark.createDataFrame([(1, 8, ["delta"]), (1, 7, ["alpha", "beta"]), (1, 9, None)], "case_id int, evidence_id int, tokens array<string>")
    got = {r["claim_id"]: (r["evidence_id"], r["share"], r["verified"]) for r in quality.bind_claims(claims, evidence).collect()}
    assert got == {1: (7, 0.666667, True), 2: (7, 0.0, False), 3: (7, 0.0, False)}


def test_best_evidence_equals_looking_at_all_pairs(spark):
    rng = random.Random(8)
    common = [f"c{i}" for i in range(8)]
    make = lambda n: [(rng.randrange(2), i, [rng.choice(common) for _ in range(rng.randrange(4))] + [f"w{rng.randrange(120)}" for _ in range(rng.randrange(3))]) for i in range(n)]
    claims, evidence = make(150), make(170)
    want = set()
    for case, i, words in claims:
        best = min((-len(set(words) & set(w)), j) for c, j, w in evidence if c == case)
        want.add((case, i, best[1], -best[0]))
    a = spark.createDataFrame(claims, "case_id int, claim_id int, tokens array<string>")
    b = spark.createDataFrame(evidence, "case_id int, evidence_id int, tokens array<string>")
    for frequent in (0, 3, 1000):
        assert {tuple(r) for r in quality.best_evidence(a, b, frequent).collect()} == want


def test_a_large_case_does_not_pair_all_its_texts(spark):
    """20,000 claims and as much evidence of one case, of a few frequent words each: words meet by signatures."""
    n = 20_000
    words = F.array(*[F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(12))) for k in range(3)], F.concat(F.lit("u"), F.pmod(F.xxhash64("id", F.lit(9)), F.lit(9000))))
    claims = spark.range(n).select(F.lit(1).alias("case_id"), F.col("id").alias("claim_id"), words.alias("tokens"))
    evidence = spark.range(n, 2 * n).select(F.lit(1).alias("case_id"), F.col("id").alias("evidence_id"), words.alias("tokens"))
    found = quality.best_evidence(claims, evidence)
    rows = found.collect()
    assert len(rows) == n
    sets = {r["evidence_id"]: set(r["tokens"]) for r in evidence.collect()}
    asked = {r["claim_id"]: set(r["tokens"]) for r in claims.collect()}
    for r in rows[:25]:
        best = min((-len(asked[r["claim_id"]] & w), j) for j, w in sets.items())
        assert (r["evidence_id"], r["common"]) == (best[1], -best[0])


def test_owners_by_the_folders_above_a_path(spark):
    from faultlens.operators import lookups

    rng = random.Random(2)
    names = ["a", "b", "net", "fs.c", "x_y"]
    paths = sorted({"drivers/" + "/".join(rng.choice(names) for _ in range(rng.randrange(1, 5))) for _ in range(180)} | {"/net/a/b", "top.c", "fs.c", "net/", "a b", ""})
    globs = ["drivers/", "drivers/net/", "drivers/*/net", "drivers/a*", "*.c", "fs.c", "net/", "*/x_y", "drivers/b/fs.c", "drivers/net/a/", "drivers/net/*", "no/such/", "drivers/b/*.c", "*"]
    patterns = [(f"S{i % 9}", g, "X" if i % 6 == 5 else "F") for i, g in enumerate(globs)]

    def fits(p, g):
        import re

        return p.startswith(g) if g.endswith("/") else re.fullmatch(".*".join(map(re.escape, g.split("*"))), p) is not None

    want = set()
    for path in paths:
        p = path.strip(" ").lstrip("/")
        if not p or " " in p:
            continue
        hits = sorted(((-len(g), s, k, g) for s, g, k in patterns if fits(p, g)))[:8]
        out = {s for _, s, k, _ in hits if k == "X"}
        kept = [(s, g) for _, s, k, g in hits if k == "F" and s not in out][:5]
        want |= {(path, i, s, g) for i, (s, g) in enumerate(kept, 1)}
    asked = spark.createDataFrame([(p,) for p in paths], "path string")
    people = spark.createDataFrame([], "section string, name string, email string, role string")
    found = lookups.owners(asked, spark.createDataFrame(patterns, "section string, pattern string, kind string"), people)
    assert {tuple(r) for r in found.select("path", "place", "section", "pattern").collect()} == want


def test_index_equals_search_without_one(spark, tmp_path):
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "Ff"]) for _ in range(rng.randint(0, 30))) for _ in range(80)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    index = search.Index.write(docs, "id", "text", str(tmp_path / "index"))
    assert [r["n_docs"] for r in index.stats.collect()] == [82]
    for words in (["aa"], ["aa", "ff", "zz"], ["bb", "cc", "dd", "ee"]):
        rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
        for match_all in (False, True):
            assert rows(index.bm25(words, match_all)) == rows(search.bm25(docs, "id", "text", words, match_all))
        assert rows(index.tiers(words)) == rows(search.tiers(docs, "id", "text", words))
        assert rows(index.tiered_search(words, 10)) == rows(search.tiered_search(docs, "id", "text", words, 10))
        assert rows(index.cover_rank(words)) == rows(search.cover_rank(docs, "id", "text", words))
    kept = docs.where("id % 2 = 0")
    assert all(r["id"] % 2 == 0 for r in index.tiered_search(["aa", "bb"], 50, kept).collect())

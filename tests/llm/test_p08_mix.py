import math

from quern.llm import p08_mix as p


def test_balance_meets_targets_and_caps(spark):
    rows = [(k, s, 1 + (k * 7919) % 97) for k in range(3000) for s in ("a", "b", "c")]
    tokens = spark.createDataFrame([(k * 3 + i % 3, s, t) for i, (k, s, t) in enumerate(rows)] + [(90001, None, 5), (90002, "z", 50)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.6, 2), ("b", 0.1, 1), ("c", 0.3, 4), ("none", 0.0, 1), ("gone", 0.01, 3), (None, 0.5, 1), ("nul", None, None)], "source string, weight double, max_repeat int")
    solved = p.balance(p._counted(tokens), targets)
    got = {r.source: r for r in solved.collect()}
    total = sum(t for *_, t in rows) + 55
    assert not got["gone"].reachable and got["none"].reachable and got["nul"].reachable
    have = total / 3
    assert got["a"].reachable == (0.6 * total <= 2 * have)
    for s in "bc":
        g = got[s]
        mass = sum(t * min(g.cap, math.exp(g.multiplier * t / g.mean)) for _, q, t in rows if q == s)
        assert abs(mass - g.target) < 1e-6 * total
    mixed = p.copies(tokens, solved)
    assert mixed.where("copies < 0 or copies > 4 or (source = 'b' and copies > 1)").count() == 0
    shares = {r[0]: r[1] for r in mixed.groupBy("source").agg({"doc_id": "count"}).collect()}
    assert set(shares) == {"a", "b", "c"}
    b = sum(r.tokens * r.copies for r in mixed.where("source = 'b'").collect())
    assert abs(b / got["b"].target - 1) < 0.1


def test_dual_finds_what_sums_say(spark):
    # short documents beside long ones: rates of the short ones reach the cap last
    rows = [(s, t, 1 + t % 3) for s in "abcdefgh" for t in (0, 1, 2, 50, 400, 1000)]
    counted = spark.createDataFrame(rows, "source string, tokens long, docs long")
    whole = sum(t * n for _, t, n in rows) / 8
    weights = {"a": 1 / 8, "b": 3 / 8, "c": 2 / 8, "d": 1.999 / 8, "e": 2.001 / 8, "f": 1e-4, "g": 0.0, "h": 0.5 / 8}
    targets = spark.createDataFrame([(s, w, 2) for s, w in weights.items()] + [("zero", 0.1, 0), ("nodocs", 0.1, 9)], "source string, weight double, max_repeat int")
    got = {r.source: r for r in p.balance(counted, targets).collect()}
    apart = {r.source: r for r in p.balance(counted, targets, held_rows=0).collect()}
    assert {s: (r.reachable, round(r.multiplier, 9)) for s, r in apart.items()} == {s: (r.reachable, round(r.multiplier, 9)) for s, r in got.items()}
    for s, w in weights.items():
        assert got[s].reachable == (w * 8 * whole <= 2 * whole * (1 + 1e-9)), s
        if got[s].reachable and w > 0:
            mass = sum(t * n * min(2.0, math.exp(min(60.0, got[s].multiplier * t / got[s].mean))) for q, t, n in rows if q == s)
            assert abs(mass - got[s].target) <= 1e-6 * got[s].target and abs(got[s].gap) <= 1e-6 * got[s].target
    assert not got["zero"].reachable and not got["nodocs"].reachable and got["b"].gap < 0


def test_empty_and_null(spark):
    docs = spark.createDataFrame([(1, "a", None, 1), (2, "a", "", 1), (3, None, "x y", 1), (4, "a", "word " * 30000, 1)], "doc_id long, source string, text string, tokens int")
    counts = {r.doc_id: r.tokens for r in p.token_counts(docs).collect()}
    assert counts[1] == counts[2] == 0 and counts[3] == 2 and counts[4] >= 30000
    none = p.token_counts(docs.limit(0))
    t = spark.createDataFrame([("a", 1.0, 2)], "source string, weight double, max_repeat int")
    assert p.balance(p._counted(none), t).collect()[0].reachable
    assert p.balance(p._counted(none), t.limit(0)).count() == 0


def test_tables(spark, data):
    assert p.p8_found(spark, data).columns == ["source"]
    shares = p.p8_shares(spark, data).collect()
    assert len(shares) == 24 and all(r.reached_share <= r.target_share + 0.05 for r in shares if not r.reachable)

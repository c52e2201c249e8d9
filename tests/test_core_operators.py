from tandemetry.functions.stats import benjamini_hochberg, spearman
from tandemetry.operators import conversation, intervals


def test_touching_contained_and_degenerate_spans(spark):
    rows = [(1, 0.0, 5.0), (1, 5.0, 9.0), (2, 0.0, 5.0), (2, 5.0 + 1e-7, 9.0), (3, 0.0, 5.0), (3, 5.001, 9.0), (4, 3.0, 3.0), (5, 0.0, 10.0), (5, 2.0, 3.0), (5, 9.0, 12.0)]
    got = intervals.union_spans(spark.createDataFrame(rows, "k long, a double, b double"), ["k"]).collect()
    assert sorted((r.k, r.a, r.b) for r in got) == [(1, 0.0, 9.0), (2, 0.0, 9.0), (3, 0.0, 5.0), (3, 5.001, 9.0), (5, 0.0, 12.0)]


def test_turn_ends_with_its_last_utterance_and_chain_gap_is_inclusive(spark):
    rows = [(1, "child", 0.0, 10.0, 1), (1, "child", 2.0, 3.0, 1), (1, "examiner", 6.0, 7.0, 1), (1, "child", 10.001, 11.0, 1)]
    turns = conversation.turns(spark.createDataFrame(rows, "k long, speaker string, a double, b double, words int"), ["k"])
    assert [(r.speaker, r.b) for r in turns.orderBy("turn").collect()] == [("child", 3.0), ("examiner", 7.0), ("child", 11.0)]
    assert sorted(r.length for r in conversation.chains(turns, ["k"]).collect()) == [1, 2]


def test_no_variance_gives_null_and_ties_share_ranks(spark):
    rows = [(1, 1.0, float(i)) for i in range(5)] + [(2, float(i // 2), float(i // 2)) for i in range(6)] + [(3, None, 1.0)]
    got = {r.k: r.rho for r in spearman(spark.createDataFrame(rows, "k long, x double, y double"), ["k"]).collect()}
    assert got[1] is None and abs(got[2] - 1) < 1e-12 and 3 not in got


def test_false_discovery_control_skips_null(spark):
    rows = [(i, p) for i, p in enumerate([0.01, 0.02, 0.02, None, 0.5])]
    got = {r.i: (r.q, r.m) for r in benjamini_hochberg(spark.createDataFrame(rows, "i long, p double").selectExpr("*", "1 as g"), ["g"], "p", ["i"]).collect()}
    assert got[3] == (None, 4) and got[1][0] == got[2][0] and abs(got[0][0] - 0.08 / 3) < 1e-12

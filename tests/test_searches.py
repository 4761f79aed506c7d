"""Searches over data with dependence: the result is a local optimum that a plain recomputation confirms."""

import itertools
import math

import numpy as np
import pytest

from bayesloom.operators import structure as K
from bayesloom.operators.search import HybridSearch, action_text


def rows(n=600):
    rng = np.random.default_rng(7)
    a = rng.integers(0, 3, n)
    b = np.where(rng.random(n) < 0.9, a, rng.integers(0, 3, n))
    c = rng.integers(0, 2, n)
    d = np.where(rng.random(n) < 0.85, (b + c) % 2, rng.integers(0, 2, n))
    return list(zip(*(x.tolist() for x in (a, b, c, d))))


def bic(data, edges, cards):
    total = 0.0
    for child in range(4):
        pa = sorted(s for s, t in edges if t == child)
        joint, margin = {}, {}
        for r in data:
            k = tuple(r[p] for p in pa)
            joint[k, r[child]] = joint.get((k, r[child]), 0) + 1
            margin[k] = margin.get(k, 0) + 1
        total += sum(n * math.log(n / margin[k]) for (k, _), n in joint.items())
        total -= 0.5 * math.log(len(data)) * math.prod(cards[p] for p in pa) * (cards[child] - 1)
    return total


def acyclic(edges):
    return any(all(order.index(s) < order.index(t) for s, t in edges) for order in itertools.permutations(range(4)))


def test_hill_climb_walks_the_best_moves_to_a_local_optimum(spark):
    data, cards = rows(), {0: 3, 1: 3, 2: 2, 3: 2}
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame(data, "a int, b int, c int, d int")
    got = K.hill_climb(df, names, {n: cards[i] for i, n in enumerate(names)}, "bic")
    edges = {(names.index(s), names.index(t)) for s, t in got}
    score = bic(data, edges, cards)
    assert len(edges) >= 3 and score > bic(data, set(), cards) + 50
    for s, t in itertools.permutations(range(4), 2):
        more = edges | {(s, t)}
        if (s, t) not in edges and (t, s) not in edges and acyclic(more):
            assert bic(data, more, cards) <= score + 1e-4
        if (s, t) in edges:
            turned = edges - {(s, t)} | {(t, s)}
            assert not acyclic(turned) or bic(data, turned, cards) <= score + 1e-4
    first, delta = K.hill_climb_step(K.FamilyScoreCache(df, names, {n: cards[i] for i, n in enumerate(names)}, "bic"), [])
    best = max(bic(data, {e}, cards) for e in itertools.permutations(range(4), 2)) - bic(data, set(), cards)
    assert delta == pytest.approx(best)
    assert bic(data, {(names.index(first[1][0]), names.index(first[1][1]))}, cards) - bic(data, set(), cards) == pytest.approx(best)


def test_in_degree_bound_holds(spark):
    df = spark.createDataFrame(rows(), "a int, b int, c int, d int")
    got = K.hill_climb(df, ["a", "b", "c", "d"], {"a": 3, "b": 3, "c": 2, "d": 2}, "bic", max_indegree=1)
    assert all(sum(t == n for _, t in got) <= 1 for n in "abcd") and got


def test_the_policy_decides_and_its_fallback_is_a_legal_draw():
    hs = HybridSearch(["a", "b", "c", "y"], "y", {}, epsilon=0.0)
    edges = K.naive_structure(["a", "b", "c"], "y")
    state = K.state_key(edges)
    legal = K.neighbours(edges, hs.nodes)
    best = {(state, action_text(legal[1])): 5.0, (state, action_text(legal[0])): 2.0, ("other", action_text(legal[2])): 9.0, (state, "+|y|a"): 99.0}
    assert hs._policy_step(edges, ["a", "b", "c"], best, 0, 0) == legal[1]
    draws = {hs._policy_step(edges, ["a", "b", "c"], {(state, action_text(legal[0])): -1.0}, 0, i) for i in range(200)}
    assert draws == set(legal)
    greedy = HybridSearch(["a", "b", "c", "y"], "y", {}, epsilon=1.0)
    cands = {("+", e) for e in K.mi_ordered_candidates(edges, ["a", "b", "c"])}
    assert {greedy._policy_step(edges, ["a", "b", "c"], best, 0, i) for i in range(100)} == cands


def test_search_with_its_own_discriminator(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows(200))], "row_key int, a int, b int, c int, y int")
    res = HybridSearch(["a", "b", "c", "y"], "y", {"a": 3, "b": 3, "c": 2, "y": 2}, episodes=1, epochs=1, n=1, gan=True).run(df)
    log = res.log.collect()
    assert len(log) == 2 and all(0.4 <= r["ls"] <= 1.0 for r in log)
    assert K.topological_order(res.best_edges, ["a", "b", "c", "y"])


def test_perceptron_stops_early_and_learns(spark):
    from pyspark.ml.feature import VectorAssembler

    from bayesloom.operators.evaluate import classifier, fit_perceptron

    df = spark.createDataFrame([(float(i % 2), float((i // 2) % 2), float(i % 2 ^ (i // 2) % 2)) for i in range(400)], "x double, z double, label double")
    data = VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(df)
    model = fit_perceptron(classifier("mlp", 2, 2), data)
    hits = model.transform(data).filter("prediction = label").count()
    assert hits == 400
    assert fit_perceptron(classifier("mlp", 2, 2), data.limit(1)) is not None


def lockstep(df, **kw):
    cards = {"a": 3, "b": 3, "c": 2, "y": 2}
    return HybridSearch(["a", "b", "c", "y"], "y", cards, **kw).run(df)


def test_episodes_in_lock_step_move_as_they_would_alone(spark):
    """The log of three episodes is that of three runs of one, with their discriminators; jobs follow the steps."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows(300))], "row_key int, a int, b int, c int, y int").persist()
    settings = {"epochs": 2, "n": 1, "epsilon": 0.4, "seed": 11, "gan": True}
    together = lockstep(df, episodes=3, **settings)
    log = [tuple(r) for r in together.log.orderBy("episode", "epoch", "step").collect()]
    alone = []
    for i in range(3):
        alone += [tuple(r) for r in lockstep(df, episodes=1, first_episode=i, **settings).log.orderBy("epoch", "step").collect()]
    assert [r[:5] + r[6:7] for r in log] == [r[:5] + r[6:7] for r in alone]
    assert np.allclose([(r[5], r[7]) for r in log], [(r[5], r[7]) for r in alone])
    assert len({tuple(r[4] for r in log if r[0] == i) for i in range(3)}) > 1  # they do go different ways
    assert together.jobs <= 1 + 2 * (1 + 1)
    assert all(0.4 <= r[7] <= 1.0 for r in log)


def test_the_best_structure_is_the_best_one_reached(spark):
    data = rows()
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "row_key int, a int, b int, c int, y int").persist()
    for seed in (1, 2, 3):
        res = lockstep(df, episodes=1, epochs=1, n=3, epsilon=1.0, gan=False, seed=seed)
        scores = [r["score"] for r in res.candidates.collect()]
        assert len(scores) == 5 and res.best_score == pytest.approx(max(scores), abs=1e-8)
        at = {n: i for i, n in enumerate("abcy")}
        assert bic(data, {(at[s], at[t]) for s, t in res.best_edges}, {0: 3, 1: 3, 2: 2, 3: 2}) == pytest.approx(res.best_score)


def test_batches_start_from_the_average_of_all_snapshots(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows(200))], "row_key int, a int, b int, c int, y int").persist()
    res = lockstep(df, episodes=4, parallel=2, epochs=2, n=1, gan=False, epsilon=0.5)
    snaps = res.snapshots.collect()
    for kind, table, name in (("q", res.q, "q"), ("policy", res.policy, "value")):
        mean = {}
        for r in snaps:
            if r["kind"] == kind:
                mean.setdefault((r["state_key"], r["action"]), []).append(r["value"])
        got = {(r["state_key"], r["action"]): r[name] for r in table.collect()}
        assert got.keys() == mean.keys() and all(got[k] == pytest.approx(sum(v) / len(v)) for k, v in mean.items())
    first = {(r["state_key"], r["action"]): r["value"] for r in snaps if r["kind"] == "q" and r["episode"] < 2 and r["epoch"] == 1}
    later = {(r["state_key"], r["action"]) for r in snaps if r["kind"] == "q" and r["episode"] == 2 and r["epoch"] == 0}
    assert set(first) <= later  # the second batch knows what the first one learned


def test_many_values_few_of_them_seen(spark):
    """A card of 100,000 with a hundredth seen: the lookup is far below the broadcast bound and draws follow the counts."""
    from bayesloom.operators.cpt import fit_cpts
    from bayesloom.operators.sample import BROADCAST_BYTES, ancestral_sample, interval_tables

    card = 100_000
    df = spark.range(20_000).selectExpr("int(id % 3) AS p", "int((id % 1000) * 97 + id % 3) AS x")
    cpts = fit_cpts(df, [("p", "x")], ["p", "x"])
    k, cells, most = interval_tables(cpts, ["p", "x"])["x"]
    assert (k, most) == (3, 1000) and 48 * k + 12 * cells < BROADCAST_BYTES / 100
    s = ancestral_sample(spark, cpts, [("p", "x")], ["p", "x"], {"p": 3, "x": card}, 30_000)
    assert s.join(df.distinct(), ["p", "x"], "left_anti").count() == 0
    want = df.groupBy("p", "x").count().selectExpr("p", "x", "count / 20000 AS f")
    off = s.groupBy("p", "x").count().join(want, ["p", "x"], "full_outer").selectExpr("sum(abs(coalesce(count, 0) / 30000 - f)) / 2 AS tv").first()[0]
    assert off < 0.16  # 3,000 cells of ten draws each
    rare = ancestral_sample(spark, cpts.filter("child = 'p' OR get(pa, 0) < 2"), [("p", "x")], ["p", "x"], {"p": 3, "x": card}, 3000).filter("p = 2")
    assert rare.select("x").distinct().count() > 900  # unseen configuration: uniform over the domain

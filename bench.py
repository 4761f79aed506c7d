"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs over the whole lineitem table (model view `li`); DataFrame results are
executed with the no-op sink, model-sized results are collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bayesloom-bench")
             .config("spark.sql.shuffle.partitions", str(max(8, 2 * cpus)))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from bayesloom.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)

    from bayesloom.operators import counts as C
    from bayesloom.operators import scores as S
    from bayesloom.operators import structure as K
    from bayesloom.operators.cpt import fit_cpts
    from bayesloom.operators.discretise import MixtureDiscretiser
    from bayesloom.operators.evaluate import tstr
    from bayesloom.operators.predict import bn_map_predict
    from bayesloom.operators.sample import ancestral_sample
    from bayesloom.operators.search import HybridSearch
    from bayesloom.operators.select import stratified_split
    from bayesloom.plans.models import KDependenceGenerator
    from bayesloom.sources.tables import model_view

    times = {}

    def run(name, fn):
        t0 = time.time()
        out = fn()
        if hasattr(out, "write"):
            out.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        return out

    v = run("li_view", lambda: model_view(spark, sf_dir, "li"))
    li = v.df.persist()
    li.count()
    cards = v.cards()
    nodes, feats = v.nodes, v.features
    pairs = [(a, (b,)) for i, a in enumerate(nodes) for b in nodes[i + 1:]]
    triples = [(a, (b, c)) for i, a in enumerate(nodes) for j, b in enumerate(nodes[i + 1:], i + 1) for c in nodes[j + 1:]]
    run("multi_cross_table", lambda: C.family_counts(li, pairs + triples))
    edges = run("kdb_structure", lambda: K.kdb_structure(li, feats, v.label, 2))
    run("structure_score_bic", lambda: S.structure_score(li, edges, nodes, cards, "bic"))
    naive = K.naive_structure(feats, v.label)
    run("hill_climb_step", lambda: K.hill_climb_step(K.FamilyScoreCache(li, nodes, cards, "bic"), naive, []))
    run("tree_search", lambda: K.tree_search(li, nodes))
    cpts = run("fit_cpts", lambda: fit_cpts(li, edges, nodes))
    n = li.count()
    run("sample_n", lambda: ancestral_sample(spark, cpts, edges, nodes, cards, n, seed=42))
    run("sample_10n", lambda: ancestral_sample(spark, cpts, edges, nodes, cards, 10 * n, seed=42))
    sp = run("stratified_split", lambda: stratified_split(li, v.label).persist())
    train, test = sp.filter(~F.col("is_test")), sp.filter(F.col("is_test"))
    tr_cpts = fit_cpts(train, edges, nodes)
    run("bn_map_predict", lambda: bn_map_predict(test, tr_cpts, edges, nodes, v.label, cards))
    syn = ancestral_sample(spark, tr_cpts, edges, nodes, cards, train.count(), seed=1).drop("row_id").persist()
    syn.count()
    run("tstr_lr", lambda: tstr(syn, test.select(*nodes), v.label, ("lr",)))
    run("generator_2_epochs", lambda: KDependenceGenerator(k=2, epochs=2).fit(li, feats, v.label, cards).cpts)
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity", "l_extendedprice")
    run("mixture_10_steps", lambda: MixtureDiscretiser.fit(raw, raw.columns, max_iter=10))
    run("hybrid_search_epoch", lambda: HybridSearch(nodes, v.label, cards, episodes=2, epochs=1).run(li).log)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_headline_seconds", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()

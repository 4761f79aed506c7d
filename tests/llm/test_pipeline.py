import collections
import sys

import pytest

import corpus_pipeline
from bayesloom.llm import queries
from bayesloom.llm.shared import materialise

SF = "/root/testdata/sf0.01"


def test_stages_do_what_they_say(spark):
    """Each stage against what its operator says of its own input."""
    from bayesloom.llm import decontaminate, mixing, simhash_golay, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    outs = [docs]
    for _, stage in corpus_pipeline.STAGES:
        outs.append(materialise(stage(spark, outs[-1], SF)))
    ids = [[r["doc_id"] for r in o.select("doc_id").collect()] for o in outs]
    assert all(o.columns == docs.columns for o in outs[:-1])
    model = toxicity.fit(docs, labels)
    toxic = {r["doc_id"] for r in model.score(docs, score="s").filter("s >= 0.5").collect()}
    assert sorted(ids[1]) == sorted(set(ids[0]) - toxic) and toxic
    groups = simhash_golay.near_duplicates(outs[1], ["doc_id"]).collect()
    assert sorted(ids[2]) == sorted({r["component_id"] for r in groups}) and len(ids[2]) < len(ids[1])
    leaks = {r["doc_id"] for r in decontaminate.matches(outs[2], items, ["doc_id"]).collect()}
    assert sorted(ids[3]) == sorted(set(ids[2]) - leaks) and leaks
    times = {r["doc_id"]: r["times"] for r in mixing.mix(outs[3], docs.columns).select("doc_id", "times").collect()}
    per_source = lambda rows: collections.Counter(rows)
    assert set(ids[4]) <= set(ids[3]) and max(per_source(ids[4]).values()) <= 3 and times.keys() == set(ids[3])
    assert sorted(ids[5]) == sorted(ids[4])
    shards = collections.Counter(r["shard"] for r in outs[5].select("shard").collect())
    assert len(shards) == 8 and max(shards.values()) - min(shards.values()) <= 1


def test_registered_names():
    import __spark_entry__ as entry

    assert {n.split("_")[0] for n in queries.REGISTRY} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()


@pytest.mark.parametrize("gone", [["bayesloom.llm", "bayesloom.llm.queries", "corpus_pipeline"], ["bayesloom.llm.queries"], ["corpus_pipeline"]])
def test_entry_without_the_llm_folders(monkeypatch, gone):
    """Folders that are gone, or left empty, take their queries with them and no others."""
    import __spark_entry__ as entry

    import bayesloom

    monkeypatch.delattr(bayesloom.llm, "queries")
    for name in gone:
        monkeypatch.setitem(sys.modules, name, None)
    names = entry.queries()
    assert "pipeline" not in names and len(names) > 50
    assert any(n.startswith("op1_") for n in names) == (gone == ["corpus_pipeline"])

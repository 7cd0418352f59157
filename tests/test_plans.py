"""The long jobs end to end over the smallest tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomrec import queries
from loomrec.operators import leakage, memory, records, rewards
from loomrec.plans import pipelines
from loomrec.sources import tables


@pytest.fixture(scope="module")
def parts(spark, sf_dir):
    items = queries.items(spark, sf_dir).cache()
    inter = tables.order_interactions(queries.table(spark, sf_dir, "lineitem"), queries.table(spark, sf_dir, "orders"))
    mem = memory.initial_item_memories(items).select(F.lit("item").alias("entity_type"), F.col("item_id").alias("entity_id"), "memory")
    return items, inter, mem


def test_evaluate(spark, parts):
    items, inter, mem = parts
    ready = pipelines.prepare(inter, tables.ORDER, items, mem)
    answers = ready.edges.select("user_id").distinct().select("user_id", F.lit('{"facets": [{"facet": "small copper parts", "confidence": 0.5, "supporting_neighbors": []}]}').alias("completion"))
    got = {(r["metric"], r["k"]): r["value"] for r in pipelines.evaluate(ready, items, answers).collect()}
    assert len(got) == 12 and got["hit", 10] == 1.0 and got["hit", 1] <= got["hit", 3] <= got["ndcg", 10] + 1
    blind = pipelines.evaluate(ready, items, answers, retrieval=False)
    assert blind.where("metric = 'hit' and k = 10").first()["value"] == 1.0


def test_freeze_and_reward(spark, parts):
    items, inter, mem = parts
    ready = pipelines.prepare(inter, tables.ORDER, items, mem, blind=True)
    asks = ready.edges.select("user_id").distinct().withColumn("instruction", F.lit("something new"))
    kept, dropped = pipelines.freeze(ready, items, mem, asks)
    kept = kept.cache()
    assert kept.count() + dropped.count() == asks.count() and kept.count() > 0
    assert set(kept.columns) == {c.split(" ")[0] for c in records.SCHEMA.split(", ")} or "reason" in dropped.columns
    assert leakage.record_faults(kept).where("fault <> 'no snippets'").count() == 0
    good = F.concat(F.lit('{"facets": [{"facet": "'), F.element_at(F.map_values("neighbor_snippets"), 1), F.lit('", "confidence": 0.9, "supporting_neighbors": ["'), F.element_at(F.map_keys("neighbor_snippets"), 1), F.lit('", "Item-999999"]}]}'))
    answers = kept.where(F.size("neighbor_snippets") > 0).select("user_id", F.when(F.col("user_id") % 2 == 0, good).otherwise("no idea").alias("completion"))
    out = pipelines.reward(kept, answers).collect()
    assert len(out) == answers.count()
    for r in out:
        assert r["fmt_penalty"] == (0.0 if r["req_id"] % 2 == 0 else 1.0) and abs(r["grounding"] - (1 / 7 if r["req_id"] % 2 == 0 else 0)) < 1e-9
        assert abs(r["total"] - (r["ndcg"] + 0.2 * r["grounding"] - r["len_penalty"] - r["fmt_penalty"])) < 1e-9
        assert r["n_hallucinated"] == (1 if r["req_id"] % 2 == 0 else 0)
    summary = rewards.reward_summary(spark.createDataFrame(out)).first()
    assert summary["n"] == len(out) and 0 < summary["valid_rate"] < 1

"""Least reductions of all shapes of the baseline, at three seeds, through the whole pipeline and its gate."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import tersely
from tersely.functions import text as expressions
from tersely.operators import benchmarks, reports
from tersely.operators.rules import load_folder
from tersely.plans.compaction import compact
from tersely.sources.fixtures import SHAPES, grammar, shape_meta


@pytest.fixture(scope="module", params=[1, 2, 3])
def compacted(spark, request):
    files = load_folder(str(Path(tersely.__file__).parent / "rulesets"))
    texts = grammar(spark, variants=2, seed=request.param).repartition(4, "stem")
    return compact(texts.withColumnRenamed("text", "output").withColumn("command", F.lit(None).cast("string")), files).cache()


def test_every_floor_is_met(spark, compacted):
    worst = compacted.groupBy("stem").agg(F.min("ratio").alias("ratio"))
    gated = {r.stem: (r.ratio, r.min_ratio) for r in benchmarks.gate(worst, shape_meta(spark)).collect()}
    assert len(SHAPES) == 38 and len(gated) == sum(s.expected_layer < 3 and s.min_ratio > 0 for s in SHAPES)
    assert not {k: v for k, v in gated.items() if v[0] < v[1]}


def test_errors_stay_and_nothing_swells(compacted):
    rows = reports.floors(compacted.select(F.col("stem").alias("name"), F.col("output").alias("before"), F.col("compressed").alias("after"), "ratio", F.lit(0.0).alias("floor")))
    assert [r.name for r in rows.filter("not error_kept").collect()] == []
    assert compacted.filter("tokens_after > 10 * tokens_before + 50").count() == 0
    lost = compacted.filter(expressions.error_signals(F.col("compressed")) == 0).filter(expressions.error_signals(F.col("output")) > 0)
    assert [r.stem for r in lost.collect()] == []


def test_the_same_seed_gives_the_same_texts(spark):
    one, two, other = (dict(((r.stem, r.variant), r.text) for r in grammar(spark, 2, s).collect()) for s in (5, 5, 6))
    assert one == two and len(one) == 2 * len(SHAPES) and sum(one[k] != other[k] for k in one) > 60
    assert one["go_panic_trace", 0] != one["go_panic_trace", 1] and "{" not in "".join(t for k, t in one.items() if k[0] != "terraform_plan_apply")

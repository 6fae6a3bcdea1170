"""Sketch answers are made once."""

import __spark_entry__ as entry


def test_answers_are_stored_and_values_do_not_move_to_them(spark, sf_dir):
    plan = entry.queries()["sketched_quantiles"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "kll_" not in plan and "rightHint=(strategy=broadcast)" in plan

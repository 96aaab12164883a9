"""Pixels are many times the frames they are made of, whatever Spark takes them for."""

import re

from spanwell.plans import catalogue

SF = "/root/testdata/sf0.01"


def test_frame_signals_broadcasts_no_pixels(spark):
    plan = catalogue.QUERIES["frame_signals"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"(\w+Join) .*Inner", plan)
    assert joins == ["SortMergeJoin"] * 4

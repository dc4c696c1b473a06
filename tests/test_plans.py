"""Plan shape: what must hold at any scale."""

import io
import uuid
from contextlib import redirect_stdout

import __spark_entry__ as entry
from dayfold.operators import blend as B
from dayfold.operators import history as H
from dayfold.session import scratch_path
from dayfold.sources import adapters as S
from dayfold.sources import readers as RD
from dayfold.sources import sinks as K
import catalog.tables as TB
import pytest
from catalog.learning import predictions
from tests.conftest import DATA


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", [
    "seven_day_screen", "target_history", "power_prior", "stratified_folds", "whole_subject_folds", "calibration_search",
    "neighbour_days", "outer_train_rows", "prior_grid", "subject_zscores"])
def test_no_cartesian_joins(spark, name):
    text = plan(entry.queries()[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_history_shares_one_exchange_and_one_sort(spark):
    text = plan(H.with_history(TB.amounts(spark, DATA), ["amount", "peak"], ["all"]))
    tree = text.split("\n\n")[0]
    # exchanges: day sums, subject; sorts: before filling the calendar, before all windows
    assert tree.count("Exchange") == 2 and tree.count("Sort") == 2


def test_scans_read_only_needed_columns(spark):
    log = S.sensor_logs(spark, DATA)["mscreen"]
    from dayfold.operators.daily import screen_parts

    text = plan(screen_parts(log)[0])
    read = next(line for line in text.splitlines() if line.startswith("ReadSchema"))
    assert "event_id" not in read and "PushedFilters" in text


def test_run_store_is_pruned_by_partition(spark):
    path = scratch_path(spark, "store")
    K.write_table(predictions(spark, DATA), path, ["run", "split"])
    text = plan(RD.load_run(spark.read.parquet(path), "core", "test"))
    assert "PartitionFilters: [isnotnull(run" in text


def test_grid_is_exploded_after_compaction(spark):
    rows = predictions(spark, DATA).where("run = 'core' AND split = 'train'")
    tree = plan(B.calibration_search(rows)).split("\n\n")[0]
    generate = tree.index("Generate")
    assert "HashAggregate" in tree[generate:]


def test_no_job_starts_while_summaries_are_planned(spark):
    from dayfold.operators import daily as D

    sensors = S.sensor_logs(spark, DATA)
    group = f"plan-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "plan")
    try:
        D.merge_parts(D.summary_parts(sensors))
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("name,most", [("hot_group_quantiles", 2), ("day_heart_rate", 3)])
def test_quantiles_read_the_log_twice(spark, name, most):
    """Once for all counts and once for the values of the wanted buckets; a summary also reads its log for plain aggregates."""
    df = entry.queries()[name](spark, DATA)
    df.collect()
    ran = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert ran.count("FileScan parquet") <= most

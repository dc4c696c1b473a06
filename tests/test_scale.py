"""Work that grows with the tables: shuffle partitions follow the rows, shared inputs are made once."""

from pyspark.sql import functions as F

from catalog import all_queries
from dayfold import session
from dayfold.operators import ordered
from dayfold.operators.runs import run_statistics, slice_summaries
from tests.conftest import DATA


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_partitions_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    assert [session.tasks_for(spark.range(n)) for n in (0, 95, 1000)] == [8, 10, 100]


def test_runs_take_their_number_of_tasks(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), "id", (F.col("id") % 7 < 4).cast("int").alias("f"))
    found = {}
    for tasks in (None, 13):
        slices = slice_summaries(df, ["g"], F.col("f"), [F.col("id")], F.floor(F.col("id") / 20), tasks=tasks)
        runs = run_statistics(slices, ["g"], "e", "l", tasks=tasks)
        found[tasks] = sorted(map(tuple, runs.collect()))
        assert (runs.rdd.getNumPartitions() == 13) == (tasks == 13)
    assert found[None] == found[13]


def test_supplier_windows_take_their_number_of_tasks(spark):
    assert "RepartitionByExpression [subject_id" in plan(all_queries()["supplier_history"].spark(spark, DATA))


def test_labels_and_folds_are_made_once(spark):
    """The plan reads what was stored; it has no event columns left to aggregate."""
    for name in ("fold_safe_prior", "ordered_subject_statistics", "selected_with_fallback"):
        assert "event_type" not in plan(all_queries()[name].spark(spark, DATA)), name


def test_daily_table_reads_stored_parts(spark):
    """Sensor parts are stored by plans of their own: what is left merges files and reads no event."""
    for name in ("advanced_interactions", "daily_feature_table"):
        text = plan(all_queries()[name].spark(spark, DATA))
        assert "event_type" not in text and "get_json_object" not in text, name


def test_frames_are_stored_side_by_side(spark):
    frames = [spark.range(n).withColumn("twice", F.col("id") * 2) for n in (3, 0, 7)]
    stored = session.cut_side_by_side(frames)
    assert [sorted(map(tuple, s.collect())) for s in stored] == [sorted(map(tuple, f.collect())) for f in frames]
    assert [s.dtypes for s in stored] == [f.dtypes for f in frames] and session.cut_side_by_side([]) == []


def test_ordered_statistics_broadcast_no_rows(spark, monkeypatch):
    """Slices and folds are about as many as labels, but Spark's estimates are of what was before they were multiplied."""
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return session.cut_lineage(df)

    monkeypatch.setattr(ordered, "cut_lineage", kept)
    found = all_queries()["ordered_subject_statistics"].spark(spark, DATA)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    joins = [line for text in plans for line in text.split("\n") if "Join" in line]
    of = lambda kind, key: [x for x in joins if kind in x and key in x]
    assert len(of("SortMergeJoin", "sleep_date")) == 1 and len(of("SortMergeJoin", "__slice")) == 1 and len(of("SortMergeJoin", "subject_id")) == 3
    assert not of("BroadcastHashJoin", "subject_id")

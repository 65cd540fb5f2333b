"""Physical-plan shape: pushdown, pruning, top-k, partial window limits, no Python UDFs."""

import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from conftest import SMOKE_DIR
from promoscope.operators import cohorts, matrix, themes, verbatims
from promoscope.operators.filters import FilterSpec
from promoscope.operators.upsert import latest_per_key
from promoscope.sources import driver_tables, store, versions
from promoscope.sources.store import survey_table, write_clean
from promoscope.operators import metrics
from promoscope.plans import catalog
from promoscope.plans.catalog import queries


def plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_sprint_filter_prunes_partitions_and_columns(spark):
    rows = survey_table(spark, SMOKE_DIR)
    p = plan(matrix.nps_matrix(rows, "city", "source", FilterSpec(grain="sprint", period="Sprint 13")))
    assert "PartitionFilters: [isnotnull(sprint_part" in p and "Sprint 13" in p
    read_schema = [line for line in p.splitlines() if line.startswith("ReadSchema")]
    assert read_schema and all("feedback" not in line for line in read_schema)


def test_month_filter_pushed_to_scan(spark):
    rows = survey_table(spark, SMOKE_DIR)
    p = plan(matrix.nps_matrix(rows, "city", "source", FilterSpec(grain="month", period="Jan '26")))
    assert "PushedFilters: [IsNotNull(month), EqualTo(month,Jan '26)]" in p


def test_verbatims_use_top_k(spark):
    rows = survey_table(spark, SMOKE_DIR)
    assert "TakeOrderedAndProject" in plan(verbatims.verbatims(rows))


def test_cohort_verbatims_partial_window_limit(spark):
    rows = survey_table(spark, SMOKE_DIR)
    p = plan(cohorts.cohort_verbatims(rows))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_upsert_aggregates_keys_and_order_only(spark):
    rows = survey_table(spark, SMOKE_DIR)
    p = plan(latest_per_key(rows))
    assert "partial_max" in p
    slim = [line for line in p.splitlines() if line.startswith("ReadSchema") and "feedback" not in line]
    assert len(slim) == 1  # the aggregate's scan has no comment


def test_recent_sprints_prune_partitions_at_run_time(spark):
    rows = survey_table(spark, SMOKE_DIR)
    p = plan(verbatims.verbatims(metrics.recent_filter(rows)))
    assert re.search(r"PartitionFilters: \[.*dynamicpruning", p)


def test_matrix_ranks_total_rows_only(spark):
    rows = survey_table(spark, SMOKE_DIR)
    df = matrix.nps_matrix(rows, "city", "sprint_id")
    p = df._jdf.queryExecution().optimizedPlan().toString()
    keys = re.findall(r"windowspecdefinition\((.*?), specifiedwindowframe", p)
    assert keys and not any(re.match(r"_[rc]side", k) for k in keys)


def test_filter_guards_run_with_the_query(spark, monkeypatch):
    rows = survey_table(spark, SMOKE_DIR)
    for action in ("collect", "first", "head", "count", "toPandas"):
        monkeypatch.setattr(type(rows), action, lambda *a, **k: pytest.fail("a driver action"))
    spec = FilterSpec(channels=("Call",), tenures=("Mid (3-6 mo)",))
    df = matrix.nps_matrix(rows, "city", "sprint_id", spec)
    monkeypatch.undo()
    assert df.filter("cell_type = 'grand_total'").first().n < rows.count()


def test_matrix_is_one_grouping_sets_pass(spark):
    rows = survey_table(spark, SMOKE_DIR)
    p = plan(matrix.nps_matrix(rows, "tenure_cut", "sprint_id"))
    assert "Expand" in p
    assert len(re.findall(r"^\(\d+\) Scan parquet", p, re.M)) == 1


def test_theme_changes_scan_once(spark):
    rows = survey_table(spark, SMOKE_DIR)
    df = themes.theme_changes(rows)
    df.collect()
    executed = df._jdf.queryExecution().executedPlan().toString()
    final = executed.split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1


@pytest.mark.parametrize("name", ["clean_survey", "trend_sprint", "matrix_filtered", "verbatims_top",
                                  "upsert_latest", "theme_changes", "cohort_city"])
def test_no_python_udfs(spark, name):
    p = plan(queries()[name](spark, SMOKE_DIR))
    assert "EvalPython" not in p and "PythonUDF" not in p


SINGLE_SCAN = ["nps_overall", "nps_by_source", "nps_by_dimension", "trend_sprint", "band_distribution",
               "period_delta", "period_significance", "period_health", "recent_sprints", "feedback_rate",
               "comment_rates", "dataset_summary", "dim_members", "sprint_counts", "matrix_tenure_sprint",
               "matrix_city_source", "matrix_plan_quarter", "row_summary_sorted",
               "row_summary_ascending", "theme_stats", "themes_by_band", "theme_changes", "theme_changes_pair", "cohort_kpis", "cohort_trend",
               "cohort_tenure", "cohort_city", "cohort_theme", "cohort_verbatims", "rollup_nps",
               "cohort_significance", "verbatims_filtered", "period_direction", "cohort_trend_quarter"]


@pytest.mark.parametrize("name", SINGLE_SCAN)
def test_count_queries_scan_their_input_once(spark, name):
    df = queries()[name](spark, SMOKE_DIR)
    df.write.format("noop").mode("overwrite").save()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1


def test_search_before_or_after_limit(spark):
    rows = survey_table(spark, SMOKE_DIR)
    after = verbatims.verbatims(rows, limit=10, search_text="ation").count()
    before = verbatims.verbatims(rows, limit=10, search_text="ation", search_before_limit=True).count()
    assert after <= 10 and before == 10 and after <= before


@pytest.mark.parametrize("name", ["upsert_rollup", "upsert_versions"])
def test_copies_of_the_table_shuffle_no_row(spark, monkeypatch, name):
    """The stored table goes into the query's own in one stage; what is written of the touched sprints comes
    from the merge's tasks, so no stage of its job only deals the rows anew for the write."""
    tracker, plans = spark.sparkContext.statusTracker(), []

    def watched(df, path, *args, **kwargs):
        group = f"{name} {len(plans)}"
        plans.append(plan(df))
        spark.sparkContext.setJobGroup(group, group)
        try:
            write_clean(df, path, *args, **kwargs)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        if len(plans) == 1:
            assert sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(group)) == 1

    survey_table(spark, SMOKE_DIR)
    for module in (catalog, store, versions):
        monkeypatch.setattr(module, "write_clean", watched)
    assert queries()[name](spark, SMOKE_DIR).count() > 0
    assert len(plans) == 2 and "Exchange" not in plans[0] and "Join" in plans[1]


@pytest.mark.parametrize("name", ["upsert_rollup", "upsert_versions"])
def test_survey_is_written_once_for_a_table_of_ones_own(spark, monkeypatch, name):
    """Without the application's stored table, the rows go into the query's own; with it they come from there."""
    survey_table(spark, SMOKE_DIR)
    stored = sorted(map(repr, queries()[name](spark, SMOKE_DIR).collect()))
    written = []

    def watched(df, path, *args, **kwargs):
        written.append(path)
        write_clean(df, path, *args, **kwargs)

    monkeypatch.setattr(store, "_FRAMES", {})
    for module in (catalog, store, versions):
        monkeypatch.setattr(module, "write_clean", watched)
    assert sorted(map(repr, queries()[name](spark, SMOKE_DIR).collect())) == stored
    assert len(written) == 2  # the table and its touched sprints


def exchanged(plan) -> list[tuple[str, int]]:
    """The columns and the number of the rows of every shuffle that a plan has run."""
    found, kind = [], plan.getClass().getSimpleName()
    if kind == "ShuffleExchangeExec":
        found.append((plan.output().mkString(","), plan.metrics().apply("shuffleRecordsWritten").value()))
    inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else []
    children = plan.children()
    return found + [x for p in inner + [children.apply(i) for i in range(children.size())] for x in exchanged(p)]


def test_resend_shuffles_the_documents_of_its_orders(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = driver_tables.survey_resend(spark, SMOKE_DIR)
        got = df.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    touched = F.col("sprint_id").isin(*driver_tables.RESENT_SPRINTS)
    raw = {r.row_seq: r.feedback for r in driver_tables.survey_raw(spark, SMOKE_DIR).filter(touched).collect()}
    assert {r.row_seq - 1000000000: r.feedback for r in got} == raw and len(got) == len(raw)
    shuffles = exchanged(df._jdf.queryExecution().executedPlan())
    [shuffled] = [n for columns, n in shuffles if columns.startswith("doc_id#")]
    documents = driver_tables.table(spark, SMOKE_DIR, "documents").count()
    assert 0 < sum(f != "" for f in raw.values()) <= shuffled < documents / 4


@pytest.mark.parametrize("bits", [driver_tables.LIKELY_BITS, 1 << 10])
def test_likely_rows_have_all_of_the_keys(spark, monkeypatch, bits):
    monkeypatch.setattr(driver_tables, "LIKELY_BITS", bits)
    df = spark.range(-3000, 90000).unionByName(spark.createDataFrame([(None,)], "id bigint"))
    keys = spark.range(-3000, 120000).filter("pmod(id, 307) = 3").select(F.col("id").cast("int").alias("k"))
    likely = {r[0] for r in driver_tables.keep_likely(df, "id", keys).collect()}
    assert {k for k in range(-3000, 90000) if k % 307 == 3} <= likely
    assert len(likely) < (400 if bits > 1 << 20 else 40000)

"""Physical plans: no all-pairs joins, pruned scans, pushed filters, no row-at-a-time Python."""

import re

import pytest
from pyspark.sql.classic.dataframe import DataFrame

from attribix.plans import catalog
from attribix.session import configure

SF = "/root/testdata/sf0.001"
EAGER = {"embed_logreg", "embed_mlp", "gbt_oof", "gbt_importances", "stacked_vote", "stream_profile", "stream_ingest"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


class Plans(dict):
    """Physical plan of a query with the plans that its checkpoints write, built on first use."""

    def __init__(self, spark):
        super().__init__()
        self.spark = spark
        self.written = []

    def __missing__(self, name):
        self.written.clear()
        last = plan(catalog.QUERIES[name](self.spark, SF))
        self[name] = "\n".join([*self.written, last])
        return self[name]

    def every(self):
        return [(n, self[n]) for n in catalog.QUERIES if n not in EAGER]


@pytest.fixture(scope="module")
def plans(spark):
    """Plans as they are where no side is small: automatic broadcast is off."""
    found, write, key = Plans(configure(spark)), DataFrame.checkpoint, "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)

    def recorded(self, *args, **kwargs):
        found.written.append(plan(self))
        return write(self, *args, **kwargs)

    DataFrame.checkpoint = recorded
    spark.conf.set(key, "-1")
    yield found
    DataFrame.checkpoint = write
    spark.conf.set(key, before)


def test_no_cross_join(plans):
    bad = [n for n, p in plans.every() if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p]
    assert bad == []


def test_no_python_on_the_executors(plans):
    bad = [n for n, p in plans.every() if re.search(r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas|MapInArrow", p)]
    assert bad == []


FEW = {"season", "profile_season", "subject_id", "quality", "lang", "target", "label", "season_type"}


def shuffled_whole(text):
    """Keys of few values on which rows are shuffled that no partial aggregate has made few."""
    lines, bad = text.splitlines(), []
    for at, line in enumerate(lines[:-1]):
        keys = re.search(r"Exchange hashpartitioning\((.*), \d+\), ENSURE", line)
        if not keys:
            continue
        names = {re.sub(r"#\d+L?$", "", k.strip()) for k in re.sub(r"coalesce\((\w+#\d+L?).*?\)|isnull\(.*?\)", r"\1", keys[1]).split(",")}
        below = next((x for x in lines[at + 1 :] if not re.search(r"\+- (\*\(\d+\) )?(Project|Filter|Sort|ReusedExchange|Generate)", x)), "")
        if names <= FEW and not re.search("partial_|Aggregate|functions=|WindowGroupLimit", below):
            bad.append((line.strip()[:100], below.strip()[:100]))
    return bad


@pytest.mark.parametrize(
    "name",
    ["pair_lookup", "team_subject_features", "team_features", "regression_metrics", "team_pair_z", "baseline_delta", "mann_whitney",
     "flag_breakdown", "stratified_split", "holdout_eval", "subject_corr"],
)
def test_no_rows_are_shuffled_on_a_key_of_few_values(plans, name):
    assert shuffled_whole(plans[name]) == []


def test_scans_are_pruned(plans):
    for name, p in plans.every():
        for schema in re.findall(r"lineitem\.parquet.*?ReadSchema: struct<(.*?)>", p):
            assert "l_shipdate" not in schema, name
            assert len(schema.split(",")) <= 9, name


def test_events_are_summed_before_they_are_correlated(plans):
    """The events are read once for the session sums and once for the team of either pass; none is joined to a team's values."""
    assert len(re.findall(r"FileScan parquet.*lineitem\.parquet", plans["audit_event_corr"])) == 3


def test_subject_sessions_are_built_once(plans):
    """One scan of the events for the subject sessions and one for the team in either of its uses, however many readers there are."""
    for name in ("subject_models", "holdout_eval"):
        assert len(re.findall(r"FileScan parquet.*lineitem\.parquet", plans[name])) == 3, name


def test_filters_reach_the_scan(plans):
    assert "EqualTo(l_returnflag,R)" in plans["actor_profile"]
    assert "GreaterThanOrEqual(s_acctbal,0.0)" in plans["join_dim"]
    assert "GreaterThan(n_chars,100)" in plans["set_intersect"]


def test_group_limits_apply_before_the_shuffle(plans):
    assert plans["k_per_class"].count("WindowGroupLimit") == 2
    assert "WindowGroupLimit" in plans["quota_sample"] and "WindowGroupLimit" in plans["tail_velocity"]


def test_no_window_over_a_whole_hot_group(plans):
    """Ordered operators window over (key, bucket); the bare key only sees bucket summaries."""
    for name in ("seq_exact_n", "seq_next_by", "longest_run", "running_best", "stratified_kfold", "pct_range"):
        rows = [line for line in plans[name].splitlines() if "+- Window" in line or "Window [" in line]
        over_key = [line for line in rows if not re.search("__cell|__b_|__head|__top", line)]
        assert over_key == [], name

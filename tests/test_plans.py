"""What the physical plans must and must not contain."""

import datetime as dt
import re

import pytest

from clientela import session as session_module
from clientela.plans import cohort, concentration, frequency, rfm, sales_history
from sampledata import sample_shop

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shop(spark):
    return sample_shop(spark, FOLDER).with_stored_identity()


def plan_of(df, run=False):
    if run:
        df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


@pytest.fixture(autouse=True)
def shuffle_joins(settings):
    settings(autoBroadcastJoinThreshold="-1")


ANALYSES = {
    "frequency": frequency.customer_frequency,
    "count": frequency.customer_count,
    "rfm": lambda shop: rfm.rfm_base(shop, dt.date(2001, 8, 2)),
    "cohort": lambda shop: cohort.cohort_counts(shop, dt.date(1996, 1, 1)),
    "transactions": sales_history.transactions,
    "gaps": sales_history.purchase_gaps,
}


@pytest.mark.parametrize("name", sorted(ANALYSES))
def test_no_single_task_no_python_no_blind_broadcast(shop, name):
    plan = plan_of(ANALYSES[name](shop))
    assert "Python" not in plan and "Broadcast" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    if name != "count":
        assert "SinglePartition" not in plan


def test_identity_has_no_unsplittable_join(spark):
    plan = plan_of(sample_shop(spark, FOLDER).identity)
    kinds = set(re.findall(r"SortMergeJoin .*?, (\w+)", plan))
    assert kinds == {"Inner", "LeftAnti"}


def test_each_fact_is_scanned_once(shop):
    for name in ("frequency", "rfm", "cohort", "gaps"):
        plan = plan_of(ANALYSES[name](shop), run=True)
        scans = re.findall(r"FileScan parquet \[[^\]]*o_orderkey", plan)
        # the sample cuts the app orders and the store sales out of one file: one scan for each
        assert len(scans) == 2, name
    assert "ReusedExchange" in plan_of(sales_history.purchase_gaps(shop), run=True)


def test_scans_read_only_needed_columns(shop):
    plan = plan_of(frequency.customer_count(shop))
    assert "o_totalprice" not in plan and "o_orderdate" not in plan and "first_name" not in plan
    assert "o_orderpriority" not in plan_of(frequency.customer_frequency(shop))


def test_sales_are_summed_before_the_first_shuffle(shop):
    plan = plan_of(rfm.rfm_base(shop, dt.date(2001, 8, 2)))
    below = plan[plan.rindex("partial_sum(units"):]
    assert "Exchange" not in below[: below.index("FileScan")]


def test_drill_down_keys_and_dates_reach_the_scan(spark, make_shop, tmp_path):
    from clientela import schemas
    from clientela.sources.shop import parquet_shop

    small = make_shop(
        [("1", None, "A", "a")], ifood_sales=[("1", 1, "2024-01-01")], store_sales=[("d", 1, "2024-01-01")], kind="timestamp"
    )
    for name in schemas.TABLES:
        frame = getattr(small, name)
        if frame is None:
            frame = spark.createDataFrame([], schemas.TABLES[name])
        frame.write.parquet(str(tmp_path / name))
    stored = parquet_shop(spark, str(tmp_path))
    plan = plan_of(sales_history.customer_transactions(stored, "1"))
    assert re.search(r"PushedFilters: \[[^\]]*(EqualTo|In)\(customer_id", plan)
    dated = plan_of(rfm.rfm_base(stored, dt.date(2024, 1, 1)))
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(created_at", dated)


def test_filters_reach_links_and_sales_before_the_daily_sums(shop):
    plan = plan_of(frequency.customer_frequency(shop, document_number="D6"))
    below = plan[plan.rindex("partial_sum(units"):]
    assert "LeftSemi" in below and "o_custkey" in below
    assert "LeftSemi" in plan_of(frequency.customer_count(shop, document_number="D6"))


def test_page_sorts_only_the_bins_it_lies_in(shop, monkeypatch):
    from clientela.operators import ordered

    def no_write(*_):
        raise AssertionError("the listing was written")

    monkeypatch.setattr(ordered, "materialize", no_write)
    listing = frequency.customer_frequency(shop)
    plan = plan_of(frequency.page(listing, 2, 25))
    assert "SinglePartition" not in plan and "rangepartitioning" not in plan
    limit = int(re.search(r"TakeOrderedAndProject\(limit=(\d+)", plan)[1])
    assert limit < 60  # the page, and what comes before it in its first bin
    assert "_bin" in plan and re.search(r"Filter.*1024", plan)  # below the sort, the totals are held to the bins
    assert "TakeOrderedAndProject(limit=25" in plan_of(frequency.next_page(listing, None, 25))


def test_pages_of_continuations_are_the_listing(shop):
    listing = frequency.customer_frequency(shop).unionByName(frequency.customer_frequency(shop).limit(30))
    whole = [tuple(r) for r in listing.orderBy(*frequency.listing_order()).collect()]
    after, pages = None, []
    while rows := frequency.next_page(listing, after, 40).collect():
        pages += [tuple(r) for r in rows]
        after = frequency.continuation(rows, after)
    assert pages == whole


def jobs_of(spark, build):
    tracker, group = spark.sparkContext.statusTracker(), "counted"
    spark.sparkContext.setJobGroup(group, "count of jobs")
    try:
        build()
        return len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_segments_are_built_in_few_jobs(spark, shop, settings):
    settings(autoBroadcastJoinThreshold="10485760")
    base = rfm.rfm_base(shop, dt.date(2001, 8, 2))
    stored = session_module.materialize(base, "base")
    # one job stores the base, eight cut it
    assert jobs_of(spark, lambda: rfm.rfm_segments(stored)) <= 9


def test_large_orders_do_not_use_one_task(spark, shop):
    base = rfm.rfm_base(shop, dt.date(2001, 8, 2))
    curve = plan_of(concentration.abc_curve(base))
    # only the slice totals, one row per bin, meet in one task
    single = curve.index("SinglePartition")
    assert "HashAggregate(keys=[_bin" in curve[single: single + 600]
    assert curve.count("SinglePartition") == 1
    assert curve.count("Window") == 2 and "rangepartitioning" not in curve


def test_scratch_follows_the_setting(spark, monkeypatch):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    root = session_module.scratch_root(spark)
    if configured:
        assert root == configured.rstrip("/")
    assert session_module.scratch_path(spark, "x").startswith(f"{root}/clientela/x-")


def test_scratch_tables_go_with_their_owner(spark, shop):
    with session_module.scratch_tables(spark):
        path = session_module.scratch_path(spark, "x")
        spark.range(3).write.parquet(path)
        assert spark.read.parquet(path).count() == 3
    assert session_module.list_folders(spark, path.rsplit("/", 1)[0]) == []
    assert "owner-" not in session_module.scratch_path(spark, "x")


def test_scratch_is_refused_on_a_cluster_without_a_shared_folder():
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError):
        session_module.scratch_root(Session())


def sides_of_joins(plan):
    """For each sort-merge join, the operators under the sorts of its two sides."""
    lines = plan.splitlines()
    depth = [re.search(r"\w", line).start() if re.search(r"\w", line) else 0 for line in lines]
    for i, line in enumerate(lines):
        if "SortMergeJoin" in line:
            for j in range(i + 1, len(lines)):
                if depth[j] <= depth[i]:
                    break
                if depth[j] == depth[i] + 3:
                    assert "Sort [" in lines[j]
                    yield line.strip(), lines[j + 1].strip()


SPLITTABLE = {
    **{name: ANALYSES[name] for name in ("frequency", "count", "rfm", "cohort", "transactions", "gaps")},
    "identity": lambda shop: sample_shop(shop.store_customer.sparkSession, FOLDER).identity,
}


@pytest.mark.parametrize("name", sorted(SPLITTABLE))
def test_both_sides_of_every_join_come_from_a_shuffle(shop, name):
    """Adaptive execution splits a hot partition only then."""
    sides = list(sides_of_joins(plan_of(SPLITTABLE[name](shop))))
    assert sides
    for join, side in sides:
        assert "Exchange" in side, (join, side)

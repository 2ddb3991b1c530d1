"""What a run writes and shuffles on its way to the stores."""

import os

import pytest
from pyspark.sql import functions as F

from tidings.operators import archive as ar
from tidings.plans.daily import daily_run, union_sources
from tidings.schema import FRESH_ITEM, ORDER_COLUMNS
from tidings.shared import materialize, settings
from tidings.sources import rows as rw, store as st

BY_SHUFFLE = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


def fresh(spark, *rows):
    """Items of (url or None, published, place), with texts that don't compress."""
    frame = spark.createDataFrame(
        [(url, "src", "Label", f"{url}", url, published, None, os.urandom(4000).hex(), "Cat", [], "o", pos)
         for url, published, pos in rows], FRESH_ITEM)
    return union_sources({"all": frame})


def size(path):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(path) for f in names)


@pytest.mark.parametrize("dies", [False, True])
def test_a_run_leaves_its_summary_only(spark, tmp_path, monkeypatch, dies):
    monkeypatch.setattr("tidings.shared.shared_dir", lambda _: str(tmp_path / "shared"))
    tables = len(spark.catalog.listTables())
    store = st.Store(str(tmp_path / "s"), ledger_buckets=4)
    history = fresh(spark, *[(f"u{n}", f"2020-0{n % 9 + 1}-01", n) for n in range(90)])
    if dies:
        def die(*_):
            raise RuntimeError("lost")
        monkeypatch.setattr(st.Store, "append_run", die)
        with pytest.raises(RuntimeError):
            daily_run(spark, store, history, "2026-07-10", 10, 90)
    else:
        assert daily_run(spark, store, history, "2026-07-10", 10, 90).first().newly_archived == 90
    left = os.listdir(tmp_path / "shared/tidings")
    assert {x.rsplit("-", 1)[0] for x in left} == {"summary"}
    assert size(tmp_path / "shared") < 90 * 8000 / 10
    assert len(spark.catalog.listTables()) <= tables + 1        # the ledger


def test_items_are_picked_without_a_shuffle_of_items(spark, tmp_path, plan_of):
    """Whether the numbers are few or many, and each row with what was chosen for it."""
    items = spark.range(500, numPartitions=7).select(
        F.col("id").cast("string").alias("id"), F.concat(F.lit("text "), F.col("id")).alias("summary"),
        F.lit(None).cast("string").alias("first_seen"))
    both = items.unionByName(items.where("id % 5 = 0"))         # repeated rows have numbers of their own
    rows = rw.Rows(both, str(tmp_path / "rows"))
    try:
        assert rows.all().select(rw.ROW).distinct().count() == 600
        chosen = materialize(rows.all().where("id % 3 = 0").select(rw.ROW, F.lit("2026-07-01").alias("first_seen")),
                             "chosen")
        with settings(spark, BY_SHUFFLE | rw.IN_PLACE):
            picked = rows.pick(chosen)
            plan = plan_of(picked)
            got = sorted((r.id, r.summary, r.first_seen) for r in picked.collect())
        assert "SortMergeJoin" in plan and "Bucketed: true" in plan
        assert not [x for x in plan.split("\n") if "Exchange" in x and "summary" in x]
        assert len([x for x in plan.split("\n") if "Exchange hashpartitioning(__part" in x]) == 1
        assert "Exchange hashpartitioning(__part" not in plan.split("tidings_rows_")[0]
        assert got == sorted((r.id, r.summary, "2026-07-01") for r in both.collect() if int(r.id) % 3 == 0)
    finally:
        rows.close()


def test_rows_that_stay_in_a_month_are_not_shuffled(spark, tmp_path, plan_of):
    """Of a touched month only what is new is joined by key and gathered."""
    columns = "month string, id string, batch bigint, origin string, pos bigint, summary string"
    held = materialize(spark.createDataFrame([("2026-01", f"i{n}", 1, "o", n, "old") for n in range(50)], columns), "held")
    news = materialize(spark.createDataFrame([("2026-01", "i7", 2, "o", 0, "new"), ("2026-01", "x", 2, "o", 1, "x")],
                                             columns), "news")
    places = materialize(held.join(news, ["month", "id"], "left_semi").select("month", "id", *ORDER_COLUMNS), "places")
    untouched, written = ar.upsert_parts(held, news, places=places, unique=True)
    assert "Exchange hashpartitioning" not in plan_of(untouched) + plan_of(written)
    got = {r.id: (r.batch, r.pos, r.summary) for r in untouched.unionByName(written).collect()}
    assert len(got) == 51 and got["i7"] == (1, 7, "new") and got["x"] == (2, 1, "x") and got["i8"] == (1, 8, "old")
    whole = ar.upsert(held, news).collect()
    assert {r.id: (r.batch, r.pos, r.summary) for r in whole} == got and len(whole) == 51


def test_two_runs_over_repeated_items_and_missing_ids(spark, tmp_path):
    store = st.Store(str(tmp_path / "s"), ledger_buckets=4)
    first = fresh(spark, ("a", "2026-07-01", 0), ("a", "2026-07-02", 1), ("old", "2020-01-01", 2), (None, "2026-07-03", 3),
                  (None, "2026-07-04", 4), ("b", "2026-07-05", 5), ("b", "2026-07-05", 5))
    daily_run(spark, store, first, "2026-07-10", 2, 90)
    live = {(r.id is None, r.title, r.published) for r in store.live(spark).collect()}
    assert live == {(True, "None", "2026-07-03"), (False, "b", "2026-07-05")}
    texts = {r.title: r.summary for r in store.live(spark).collect()}
    second = fresh(spark, ("b", "2026-07-09", 0), ("c", "2026-07-09", 1), ("a", "2026-07-02", 2))
    daily_run(spark, store, second, "2026-07-11", 2, 90)
    live = {r.title: r for r in store.live(spark).collect()}
    assert set(live) == {"b", "c"} and live["b"].summary == texts["b"] and live["b"].batch == 1
    assert {r.title: (r.month, r.published, r.first_seen) for r in store.archive(spark).collect()} == {
        "a": ("2026-07", "2026-07-02", "2026-07-10"), "old": ("2020-01", "2020-01-01", "2026-07-10")}


@pytest.mark.parametrize("least, gathered", [(1, 0), (1 << 40, 60)])
def test_a_month_that_fills_a_task_is_written_where_it_lies(spark, tmp_path, monkeypatch, least, gathered):
    """Both ways give the same archive; an archived item that changed keeps its place."""
    monkeypatch.setattr(rw, "SETTLED_BYTES", least)
    store, write, seen = st.Store(str(tmp_path / "s"), ledger_buckets=4), st.write_archive, []

    def counted(items, path):
        seen.append(items.count())
        write(items, path)

    monkeypatch.setattr(st, "write_archive", counted)
    daily_run(spark, store, fresh(spark, *[(f"u{n}", "2020-01-05", n) for n in range(60)]), "2026-07-10", 10, 90)
    assert seen == [gathered]
    daily_run(spark, store, fresh(spark, ("u7", "2020-01-05", 0), ("new", "2020-01-06", 1)), "2026-07-11", 10, 90)
    rows = {r.title: r for r in store.archive(spark).collect()}
    assert len(rows) == 61 and store.archive(spark).count() == 61
    assert (rows["u7"].batch, rows["u7"].pos) == (1, 7) and rows["new"].batch == 2
    assert [tuple(r) for r in store.months(spark).select("month", "version", "count").collect()] == [("2020-01", 2, 61)]

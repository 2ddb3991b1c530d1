"""Stores, sinks and the daily run."""

import json
import os
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from tidings.operators.publish import feed_entries
from tidings.plans.daily import daily_run, union_sources
from tidings.schema import ARCHIVED_ITEM, ITEM, ITEM_COLUMNS, STORED_ITEM
from tidings.shared import materialize, shared_dir
from tidings.sources import sinks, store as st


def item(name, published, batch=1, title=None, first_seen="2026-07-01", summary="s", tags=()):
    return (name, "src", "Label", title or name, f"https://example.com/{name}", published,
            first_seen, summary, "Cat", list(tags), batch, "o", 0)


def stored(spark, rows):
    rows = [r[:-1] + (pos,) for pos, r in enumerate(rows)]
    return spark.createDataFrame(rows, STORED_ITEM)


def fresh(spark, *rows):
    frame = stored(spark, [item(name, published, first_seen=None) for name, published in rows])
    return union_sources({"all": frame.drop("batch")})


def archived(store, spark):
    return {(r.month, r.id): r for r in store.archive(spark).collect()}


def test_an_absent_store_is_empty(spark, tmp_path):
    store = st.Store(str(tmp_path / "nothing"))
    assert store.live(spark).collect() == [] and store.ledger(spark).collect() == []
    assert store.archive(spark).collect() == [] and store.last_run(spark) is None


def test_upsert_rewrites_only_touched_months(spark, tmp_path):
    store = st.Store(str(tmp_path / "s"))

    def incoming(*rows):
        df = stored(spark, [item(n, p, b, t) for n, p, b, t in rows])
        return df.withColumn("month", F.substring("published", 1, 7))

    store.upsert_archive(incoming(("a", "2026-01-05", 1, "old"), ("b", "2026-01-06", 1, "b"),
                                  ("c", "2026-02-01", 1, "c")))
    february = tmp_path / "s/archive/version=1/month=2026-02"
    before = {f: os.stat(february / f).st_mtime_ns for f in os.listdir(february)}
    store.upsert_archive(materialize(
        incoming(("a", "2026-01-05", 2, "new"), ("d", "2026-03-01", 2, "d")), "incoming"))
    rows = archived(store, spark)
    assert {k: r.title for k, r in rows.items()} == {
        ("2026-01", "a"): "new", ("2026-01", "b"): "b", ("2026-02", "c"): "c",
        ("2026-03", "d"): "d"}
    assert {f: os.stat(february / f).st_mtime_ns for f in os.listdir(february)} == before
    assert {f.name for f in (tmp_path / "s/archive/version=2").glob("month=*")} == {
        "month=2026-01", "month=2026-03"}
    store.write_manifest(spark)
    counts = spark.read.json(store.path("manifest")).collect()
    assert {r.month: r["count"] for r in counts} == {"2026-01": 2, "2026-02": 1, "2026-03": 1}


@pytest.mark.parametrize("moment", ["before the months", "half way", "after the months"])
def test_an_upsert_that_died_leaves_the_archive_as_it_was(spark, tmp_path, monkeypatch, moment):
    store = st.Store(str(tmp_path / "s"))

    def incoming(*rows):
        df = stored(spark, [item(n, p, 1, t) for n, p, t in rows])
        return df.withColumn("month", F.substring("published", 1, 7))

    store.upsert_archive(incoming(("a", "2026-01-05", "old"), ("b", "2026-02-06", "b")))
    before, write = archived(store, spark), st.write_archive
    news = materialize(incoming(("a", "2026-01-05", "new"), ("c", "2026-02-01", "c"),
                                ("d", "2026-03-01", "d")), "news")

    def die(items, path):
        if moment == "half way":
            write(items.where("month = '2026-01'"), path)
        elif moment == "after the months":
            write(items, path)
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(st, "write_archive", die)
        with pytest.raises(RuntimeError):
            store.upsert_archive(news)
    assert archived(store, spark) == before
    store.upsert_archive(news)
    assert {k: r.title for k, r in archived(store, spark).items()} == {
        ("2026-01", "a"): "new", ("2026-02", "b"): "b", ("2026-02", "c"): "c",
        ("2026-03", "d"): "d"}


def test_a_history_sent_again_rewrites_no_month(spark, tmp_path):
    store = st.Store(str(tmp_path / "s"))
    history = [("a", "2020-01-01"), ("b", "2020-02-01"), ("c", "2020-02-02")]
    daily_run(spark, store, fresh(spark, *history), "2026-07-10", 10, 90)
    again = daily_run(spark, store, fresh(spark, *history), "2026-07-11", 10, 90).first()
    assert again.newly_archived == 0
    assert not list((tmp_path / "s/archive/version=2").glob("month=*"))
    assert sorted(i for _, i in archived(store, spark)) == ["a", "b", "c"]


def month_rows(spark, *rows):
    df = stored(spark, [item(n, p, b, t) for n, p, b, t in rows])
    return df.withColumn("month", F.substring("published", 1, 7))


def test_a_resent_history_reads_the_index_only(spark, tmp_path, plan_of):
    """No text of either side is a join key or is shuffled, and of the archive only narrow columns are read."""
    from tidings.operators import archive as ar
    store = st.Store(str(tmp_path / "s"))
    rows = materialize(month_rows(spark, *[(f"i{n}", f"2026-0{n % 9 + 1}-01", 1, "t") for n in range(50)]), "rows")
    store.upsert_archive(rows)
    sent = ar.with_digest(rows.withColumn("title", F.when(F.col("id") == "i7", "new").otherwise(F.col("title"))))
    keys = ar.news(store.archive_index(spark), sent)
    assert [tuple(r) for r in keys.collect()] == [("2026-08", "i7", True)]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(ar.news(store.archive_index(spark), sent))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    index = [line for line in plan.split("\n") if "FileScan" in line and "digest#" in line]
    assert len(index) == 1 and "summary" not in index[0] and "title" not in index[0]
    for line in plan.split("\n"):
        if "Join" in line or "Exchange" in line or "HashAggregate" in line:
            assert "summary" not in line and "title" not in line


def test_an_archive_without_digests_is_read_and_written_over(spark, tmp_path):
    """Files of a store that an earlier version of this library wrote."""
    store = st.Store(str(tmp_path / "s"))
    old = month_rows(spark, ("a", "2026-01-05", 1, "a"), ("b", "2026-02-05", 1, "b"))
    st.write_archive(old, store.path("archive/version=1"))
    spark.createDataFrame([(1, "2026-01", 1), (1, "2026-02", 1)], "version bigint, month string, count bigint"
                          ).write.parquet(store.path("commits"))
    assert sorted(archived(store, spark)) == [("2026-01", "a"), ("2026-02", "b")]
    store.upsert_archive(materialize(month_rows(spark, ("a", "2026-01-05", 2, "new")), "incoming"))
    assert {k: r.title for k, r in archived(store, spark).items()} == {
        ("2026-01", "a"): "new", ("2026-02", "b"): "b"}
    store.vacuum(spark, 0)
    assert {k: r.title for k, r in archived(store, spark).items()} == {
        ("2026-01", "a"): "new", ("2026-02", "b"): "b"}


def test_after_ten_upserts_only_versions_in_force_are_listed(spark, tmp_path):
    store = st.Store(str(tmp_path / "s"))
    for n in range(10):
        store.upsert_archive(materialize(month_rows(
            spark, ("a", "2026-01-05", n, f"t{n}"), (f"m{n}", f"2026-0{n % 3 + 2}-01", n, "m")), "incoming"))
        if n == 8:
            planned = store.archive(spark)
            assert store.vacuum(spark) == []          # nothing is older than the retention
    assert len(list((tmp_path / "s/commits").glob("*.parquet"))) == 10
    before = planned.count()                          # a reader planned before the last upsert still finishes
    want = archived(store, spark)
    gone = store.vacuum(spark, 0)
    folders = {f"{v.name}/{m.name}" for v in (tmp_path / "s/archive").iterdir() for m in v.glob("month=*")}
    assert folders == {"version=10/month=2026-01", "version=10/month=2026-02", "version=8/month=2026-03",
                       "version=9/month=2026-04"}
    assert before == 10 and len(gone) == 16
    assert len(list((tmp_path / "s/commits").glob("*.parquet"))) == 1
    assert archived(store, spark) == want
    assert {r.month: r["count"] for r in store.months(spark).collect()} == {
        "2026-01": 1, "2026-02": 4, "2026-03": 3, "2026-04": 3}
    store.upsert_archive(materialize(month_rows(spark, ("z", "2026-09-01", 11, "z")), "incoming"))
    assert ("2026-09", "z") in archived(store, spark) and len(archived(store, spark)) == len(want) + 1
    assert store.vacuum(spark, 0) == []


def test_a_vacuum_that_died_changes_nothing(spark, tmp_path, monkeypatch):
    store = st.Store(str(tmp_path / "s"))
    for n in range(3):
        store.upsert_archive(materialize(month_rows(spark, ("a", "2026-01-05", n, f"t{n}")), "incoming"))
    want = archived(store, spark)
    for moment in ("delete", "_append_commits"):
        with monkeypatch.context() as patch:
            def die(*_):
                raise RuntimeError("lost")
            patch.setattr(*((st.files, moment) if moment == "delete" else (st.Store, moment)), die)
            with pytest.raises(RuntimeError):
                store.vacuum(spark, 0)
        assert archived(store, spark) == want
    store.vacuum(spark, 0)
    assert archived(store, spark) == want


def test_live_folders_of_earlier_runs_go(spark, tmp_path):
    store = st.Store(str(tmp_path / "s"), retain_hours=0)
    for n in range(3):
        daily_run(spark, store, fresh(spark, (f"i{n}", "2026-07-01")), f"2026-07-1{n}", 10, 90)
    assert len(list((tmp_path / "s/live").iterdir())) == 1
    assert {r.id for r in store.live(spark).collect()} == {"i0", "i1", "i2"}


def test_touched_months_prune_partitions(spark, tmp_path, plan_of):
    from tidings.operators.archive import month_items, touched_months
    store = st.Store(str(tmp_path / "s"))
    df = stored(spark, [item("a", "2026-01-05")]).withColumn("month", F.lit("2026-01"))
    store.upsert_archive(df)
    incoming = materialize(df, "incoming")
    assert "dynamicpruning" in plan_of(touched_months(store.archive(spark), incoming))
    plan = plan_of(month_items(store.archive(spark), "2026-01"))
    assert "(month#" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]


def test_a_month_that_holds_most_rows_is_split(spark, tmp_path):
    rows = spark.range(40_000).select(
        F.col("id").cast("string").alias("id"), F.sha2(F.col("id").cast("string"), 512).alias("x"),
        F.when(F.col("id") % 3 > 0, "2026-01").otherwise("2026-02").alias("month"))
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "512k")
    try:
        st.write_archive(rows, str(tmp_path / "a"))
    finally:
        spark.conf.set(key, old)
    files = {m: len(list((tmp_path / f"a/month={m}").glob("*.parquet")))
             for m in ("2026-01", "2026-02")}
    assert files["2026-01"] > 2
    assert spark.read.parquet(str(tmp_path / "a")).count() == 40_000


def test_three_daily_runs(spark, tmp_path):
    store = st.Store(str(tmp_path / "s"))
    first = daily_run(spark, store, fresh(
        spark, ("a", "2026-07-01"), ("b", None), ("old", "2020-01-01"), ("a", "2026-07-09"),
        ("undated", "")), "2026-07-10", 10, 90).first()
    assert first.fetched == {"src": 5}
    assert (first.live, first.net_new, first.outside_window, first.newly_archived) == (3, 3, 1, 1)
    # an undated item is dated by its first sighting, so it is live
    assert {r.id for r in store.live(spark).collect()} == {"a", "b", "undated"}

    second = daily_run(spark, store, fresh(
        spark, ("a", "2026-07-20"), ("old", "2020-01-01"), ("n", "2026-07-20")),
        "2026-07-20", 2, 90).first()
    assert (second.live, second.net_new) == (2, -1)
    live = {r.id: r for r in store.live(spark).collect()}
    assert set(live) == {"n", "b"}  # of b and undated, both dated 2026-07-10, b came first
    rows = archived(store, spark)
    assert rows["2026-07", "a"].published == "2026-07-01"  # the live item was not touched
    assert rows["2020-01", "old"].first_seen == "2026-07-10"  # kept by the ledger

    third = daily_run(spark, store, fresh(spark), "2027-01-01", 10, 90).first()
    assert (third.live, third.outside_window) == (0, 2)
    assert store.live(spark).collect() == [] and third.fetched == {}
    assert {i for _, i in archived(store, spark)} == {"a", "b", "undated", "old", "n"}
    assert {r.id: r.first_seen for r in store.ledger(spark).collect()} == {
        "a": "2026-07-10", "b": "2026-07-10", "old": "2026-07-10", "undated": "2026-07-10",
        "n": "2026-07-20"}
    counts = spark.read.json(store.path("manifest")).collect()
    assert {r.month: r["count"] for r in counts} == {"2026-07": 4, "2020-01": 1}


def test_a_run_that_died_half_way_is_run_again(spark, tmp_path, monkeypatch):
    store = st.Store(str(tmp_path / "s"))
    daily_run(spark, store, fresh(spark, ("a", "2026-07-01")), "2026-07-10", 1, 90)
    again = fresh(spark, ("b", "2026-07-05"), ("old", "2020-01-01"))

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(st.Store, "append_run", die)
        with pytest.raises(RuntimeError):
            daily_run(spark, store, again, "2026-07-11", 1, 90)
    assert {r.id for r in store.live(spark).collect()} == {"a"}  # the dead run does not count
    daily_run(spark, store, again, "2026-07-11", 1, 90)
    assert {r.id for r in store.live(spark).collect()} == {"b"}
    assert sorted(r.id for r in store.ledger(spark).collect()) == ["a", "b", "old"]
    assert sorted(i for _, i in archived(store, spark)) == ["a", "old"]


def test_json_interchange(spark, tmp_path):
    names = ITEM_COLUMNS
    rows = [dict(zip(names, item(n, "2026-07-01", tags=["t"], summary="é…")[:10]))
            for n in ("x", "y", "z")]
    path = tmp_path / "items.json"
    path.write_text(json.dumps(rows, indent=2, ensure_ascii=False), encoding="utf-8")
    items = st.read_items_json(spark, str(path), arrays=True)
    assert [r.id for r in items.orderBy("pos").collect()] == ["x", "y", "z"]
    out = str(tmp_path / "out")
    st.write_items_json(items, out)
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("*.json"))
    assert "é…" in text
    assert spark.read.schema(ITEM).json(out).count() == 3
    back = st.read_items_json(spark, out).select(*names).orderBy("id").collect()
    assert back == items.select(*names).orderBy("id").collect()
    none = items.withColumn("category", F.lit(None).cast("string"))
    st.write_items_json(none, str(tmp_path / "none"))
    assert all('"category":null' in line for p in (tmp_path / "none").glob("*.json")
               for line in p.read_text(encoding="utf-8").splitlines())
    assert st.read_items_json(spark, str(tmp_path / "absent.json")).count() == 0

    seen = tmp_path / "seen.json"
    seen.write_text(json.dumps({"x": "2026-01-01", "y": "2026-01-02"}, indent=2))
    assert sorted(map(tuple, st.read_ledger_json(spark, str(seen)).collect())) == [
        ("x", "2026-01-01"), ("y", "2026-01-02")]
    assert st.read_ledger_json(spark, str(tmp_path / "absent")).count() == 0


@pytest.mark.parametrize("partitions", ["3", "8"])
def test_the_ledger_is_joined_in_place(spark, tmp_path, plan_of, partitions):
    """Only the batch is shuffled, to the ledger's buckets."""
    from tidings.operators.ledger import assign_first_seen
    store = st.Store(str(tmp_path / "s"), ledger_buckets=8)
    assert store.ledger(spark).count() == 0
    for low in (0, 40):
        store.append_ledger(spark.createDataFrame([(f"i{n}", f"2026-01-0{low // 40 + 1}") for n in range(low, low + 50)],
                                                  "id string, first_seen string"))
    assert store.ledger(spark).count() == 100
    batch = materialize(stored(spark, [item("i1", "2026-07-01"), item("i45", "2026-07-01"), item("new", "2026-07-01")]), "b")
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(x) for x in names]
    for name, value in zip(names, ("-1", partitions), strict=True):
        spark.conf.set(name, value)
    try:
        dated = assign_first_seen(batch, store.ledger(spark), "2026-07-30")
        plan = plan_of(dated)
        lines = plan.split("\n")
        scan = next(i for i, line in enumerate(lines) if "SelectedBucketsCount" in line or "Bucketed: true" in line)
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        above, level = [], depth(lines[scan])
        for line in reversed(lines[:scan]):
            if depth(line) < level:
                above.append(line)
                level = depth(line)
        first_join = next(i for i, line in enumerate(above) if "Join" in line)
        assert not any("Exchange" in line for line in above[:first_join + 1])
        assert {r.id: r.first_seen for r in dated.collect()} == {
            "i1": "2026-01-01", "i45": "2026-01-01", "new": "2026-07-30"}
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)


def test_a_ledger_is_compacted_and_old_generations_go(spark, tmp_path, monkeypatch):
    store = st.Store(str(tmp_path / "s"), ledger_buckets=2)
    add = lambda *rows: store.append_ledger(spark.createDataFrame(rows, "id string, first_seen string"))
    add(("a", "2026-01-02"), ("b", "2026-01-02"))
    add(("a", "2026-01-01"), ("c", "2026-01-03"))
    reader = store.ledger(spark)
    monkeypatch.setattr(st, "MAX_BUCKET_FILES", 1)
    assert store.vacuum(spark) == []                   # compacted; the old files stay for their readers
    want = [("a", "2026-01-01"), ("b", "2026-01-02"), ("c", "2026-01-03")]
    assert sorted(map(tuple, store.ledger(spark).collect())) == want
    assert reader.count() == 4
    add(("d", "2026-01-04"))
    monkeypatch.setattr(st, "MAX_BUCKET_FILES", 100)
    assert [p.rsplit("/", 1)[1] for p in store.vacuum(spark, 0)] == ["ledger-0-2"]
    assert sorted(map(tuple, st.Store(store.root).ledger(spark).collect())) == [*want, ("d", "2026-01-04")]
    (tmp_path / "s/ledger-2-2").mkdir()                # a compaction that died
    assert store.ledger(spark).count() == 4


def test_a_ledger_of_an_earlier_version_is_taken_over(spark, tmp_path):
    store = st.Store(str(tmp_path / "s"))
    old = spark.createDataFrame([("a", "2026-01-01")], "id string, first_seen string")
    old.write.parquet(store.path("ledger"))
    assert store.ledger(spark).count() == 1
    store.append_ledger(spark.createDataFrame([("b", "2026-01-02")], "id string, first_seen string"))
    assert sorted(map(tuple, store.ledger(spark).collect())) == [("a", "2026-01-01"), ("b", "2026-01-02")]


def test_a_large_json_ledger_is_read_by_many_tasks(spark, tmp_path):
    """Escapes, braces, commas and quotes in ids; the object is split at its lines."""
    odd = ['a"b', "{x}", "}", "{", "a,b", '","', "tab\there", "line\nbreak", "é\u2028", "\\", '\\"', ""]
    seen = {**{i: "2026-01-01" for i in odd}, **{f"{n:016x}": f"2026-{n % 12 + 1:02d}-01" for n in range(20_000)}}
    for indent, name in ((2, "a"), (0, "b"), (None, "c")):
        (tmp_path / f"{name}.json").write_text(json.dumps(seen, indent=indent, ensure_ascii=False), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        for name in "ab":
            rows = st.read_ledger_json(spark, str(tmp_path / f"{name}.json"))
            assert rows.rdd.getNumPartitions() > 8
            assert {r.id: r.first_seen for r in rows.collect()} == seen
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for whole in (True, False):                        # all on one line
        rows = st.read_ledger_json(spark, str(tmp_path / "c.json"), whole)
        assert {r.id: r.first_seen for r in rows.collect()} == seen
    (tmp_path / "d.json").write_text('{\n"a":\n"2026-01-01"\n}')
    with pytest.raises(Exception, match="no whole entries"):
        st.read_ledger_json(spark, str(tmp_path / "d.json")).collect()
    assert st.read_ledger_json(spark, str(tmp_path / "d.json"), whole=True).count() == 1
    (tmp_path / "e.json").write_text("{}\n")
    assert st.read_ledger_json(spark, str(tmp_path / "e.json")).count() == 0


def test_stores_are_written_newest_first(spark, tmp_path):
    store = st.Store(str(tmp_path / "s"))
    rows = [item(f"i{n}", f"2026-07-{n * 7 % 28 + 1:02d}" if n % 5 else None, first_seen=f"2026-06-{n % 9 + 1:02d}")
            for n in range(60)]
    items = stored(spark, rows).repartition(5)
    path = store.write_live(items, 1)
    sinks.write_site(items, str(tmp_path / "site"), "2026-07-30T00:00:00+00:00")
    keys = sorted(((r[5] or r[6], -p) for p, r in enumerate(rows)), reverse=True)
    want = [rows[-p][0] for _, p in keys]
    for folder, read in ((path, lambda p: [r.id for r in spark.read.parquet(p).collect()]),
                         (str(tmp_path / "site"), lambda p: [json.loads(x)["id"] for x in open(p, encoding="utf-8")])):
        files = sorted(f for f in os.listdir(folder) if f.startswith("part-"))
        assert [i for f in files for i in read(f"{folder}/{f}")] == want


def test_feed_rows_and_document(spark, tmp_path):
    items = stored(spark, [
        item("a", "2026-07-03", summary=""), item("b", "2026-07", title="<B> & more"),
        item("c", None, first_seen=None), item("d", "2026-07-03T10:11:12+05:00")])
    rows = feed_entries(items, 3).collect()
    assert [(r.title, r.description, r.pubDate) for r in rows] == [
        ("[Label] d", "s", "Fri, 03 Jul 2026 10:11:12 +0000"),
        ("[Label] a", None, "Fri, 03 Jul 2026 00:00:00 +0000"),
        ("[Label] <B> & more", "s", None)]
    path = tmp_path / "feed"
    sinks.write_feed(items, str(path))
    (document,) = path.glob("part-*")
    entries = ElementTree.parse(document).getroot().findall("item")
    assert [e.findtext("title") for e in entries] == [
        "[Label] d", "[Label] a", "[Label] <B> & more", "[Label] c"]
    assert [e.findtext("description") for e in entries] == ["s", None, "s", "s"]
    assert [e.find("pubDate") is not None for e in entries] == [True, True, False, False]
    sinks.write_site(items, str(tmp_path / "site"), "2026-07-30T00:00:00+00:00")
    site = spark.read.json(str(tmp_path / "site"))
    assert site.count() == 4 and site.first().generated_at == "2026-07-30T00:00:00+00:00"


def test_shared_dir_is_the_named_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_schemas_line_up():
    assert STORED_ITEM.fieldNames()[:10] == ITEM_COLUMNS
    assert ARCHIVED_ITEM.fieldNames()[-1] == "month"

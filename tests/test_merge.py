"""Properties of merge, retention and archive, on skewed random inputs."""

import random

import pytest
from pyspark.sql import functions as F

from tidings.operators import archive as ar, dedupe, ledger, retention
from tidings.operators.merge import merge
from tidings.operators.publish import filter_source_date, latest_update

AS_OF = "2026-07-30"
ITEMS = "id string, published string, first_seen string, title string, batch long, pos long"
ORDER = ["batch", "pos"]
DATES = [None, "", "2026-07-30", "2026-07-29", "2026-07-29T10:00:00", "2026-05-01", "2026-04-30",
         "2019-01-01"]


def random_items(rng, n, batch, dated):
    """n items; one id holds a third of them."""
    return [{"id": "hot" if rng.random() < 0.33 else f"i{rng.randrange(n)}",
             "published": rng.choice(DATES),
             "first_seen": rng.choice(["2026-06-01", "2026-07-01"]) if dated else None,
             "title": f"{batch}-{pos}", "batch": batch, "pos": pos} for pos in range(n)]


def frame(spark, items):
    return spark.createDataFrame([tuple(i.values()) for i in items], ITEMS)


@pytest.mark.parametrize("seed, cap, age", [(1, 10, 90), (2, 0, 90), (3, 5, 0), (4, 1000, 90),
                                            (5, 0, 0), (6, 1, 1)])
def test_merge_and_retention(spark, seed, cap, age):
    """Properties: one row per id, of the known kind; live and archive share the merged items out,
    and nothing inside the window that is archived is newer than anything live."""
    rng = random.Random(seed)
    existing, fresh = random_items(rng, 60, 0, True), random_items(rng, 120, 1, False)
    seen = {f"i{n}": "2026-01-01" for n in range(0, 120, 3)}
    known = spark.createDataFrame(list(seen.items()), "id string, first_seen string")
    merged = merge(frame(spark, existing), frame(spark, fresh), known, AS_OF, ORDER).cache()
    rows = merged.orderBy(F.desc("sk"), *ORDER).collect()
    ids = [r.id for r in rows]
    assert sorted(ids) == sorted({i["id"] for i in existing + fresh})
    live_ids = {i["id"] for i in existing}
    titles = {i["title"]: i for i in existing + fresh}
    for r in rows:
        assert titles[r.title]["id"] == r.id and (titles[r.title]["batch"] == 0) == (r.id in live_ids)
        if r.id not in live_ids:
            assert r.first_seen == seen.get(r.id, AS_OF)
    added = {r.id: r.first_seen for r in ledger.ledger_additions(merged).collect()}
    assert all(added[i] == AS_OF for i in added if i not in live_ids)
    assert set(ids) - live_ids <= set(seen) | set(added)

    live = retention.live_items(merged, AS_OF, cap, age, ORDER).collect()
    archived = {r.id for r in retention.archive_items(merged, AS_OF, cap, age, ORDER).collect()}
    assert [r.id for r in live] == [i for i in ids if i not in archived]
    oldest = {90: "2026-05-01", 1: "2026-07-29", 0: ""}[age]
    inside = [r.id for r in rows if r.sk >= oldest]
    assert [r.id for r in live] == (inside[:cap] if cap else inside)
    merged.unpersist()


def test_retention_of_nothing(spark):
    items = retention.with_sort_key(frame(spark, []))
    assert retention.with_placement(items, AS_OF, 5, 90, ORDER).collect() == []
    old = retention.with_sort_key(frame(spark, random_items(random.Random(1), 9, 0, True)))
    placed = retention.with_placement(old, "2040-01-01", 5, 90, ORDER)
    assert {r.placement for r in placed.collect()} == {"archive"}


@pytest.mark.parametrize("n", [1, 7, 334, 335, 999, 1000, 5000])
def test_nth_newest_is_exact_when_one_date_dominates(spark, n):
    # Places of all sizes: the upper, the middle and the lower bits of a number decide by turns.
    places = [(p % 2) << 50 | (p % 7) << 25 | p - 500 for p in range(1000)]
    rows = [(f"i{p}", "2026-07-30" if p % 3 else f"2026-01-{p % 28 + 1:02d}T0{p % 5}", None, "t", p % 2, x)
            for p, x in enumerate(places)]
    items = retention.with_sort_key(spark.createDataFrame(rows, ITEMS))
    order = sorted(rows, key=lambda r: (r[4], r[5]))
    order.sort(key=lambda r: r[1], reverse=True)
    want = order[min(n, 1000) - 1]
    assert retention.nth_newest(items, n, ORDER) == (want[1], (want[4], want[5]))
    places = retention.nth_newest(items, n, ["batch", "id"])       # a last column that is no number
    order.sort(key=lambda r: (r[4], r[0]))
    order.sort(key=lambda r: r[1], reverse=True)
    want = order[min(n, 1000) - 1]
    assert places == (want[1], (want[4], want[0]))


def test_the_cap_sorts_no_items(spark, plan_of):
    """The selection groups and sums; a row is placed by a predicate of literals."""
    items = retention.with_sort_key(frame(spark, random_items(random.Random(3), 50, 0, True)))
    plan = plan_of(retention.with_placement(items, AS_OF, 5, 90, ORDER))
    assert not any(x in plan for x in ("Sort", "Window", "TakeOrdered", "Join", "Exchange"))


def test_dedupe_limits_groups_before_the_shuffle(spark, tmp_path, plan_of):
    path = str(tmp_path / "items")
    frame(spark, random_items(random.Random(1), 50, 0, True)).write.parquet(path)
    items = spark.read.parquet(path)
    for plan in (plan_of(dedupe.keep_first(items, ["id"], ORDER)),
                 plan_of(dedupe.keep_last(items, ["id"], ORDER))):
        below = plan[plan.index("Exchange"):]
        assert "row_number(), 1, Partial" in below
    narrow = plan_of(dedupe.keep_first(items, ["id"], ORDER).select("id"))
    assert "title" not in narrow  # still pruned through the window


def test_last_value_stands_at_the_first_place(spark):
    rows = [("a", None, None, "a1", 0, 0), ("b", None, None, "b1", 0, 1),
            ("a", None, None, "a2", 0, 2)]
    got = dedupe.last_value_first_place(spark.createDataFrame(rows, ITEMS), ["id"], ORDER)
    assert [(r.id, r.title, r.pos) for r in got.orderBy("pos").collect()] == [
        ("a", "a2", 0), ("b", "b1", 1)]


def test_ledger_recorded_twice_does_not_multiply(spark):
    items = frame(spark, [{"id": "a", "published": None, "first_seen": None, "title": "t",
                           "batch": 1, "pos": 0}])
    twice = spark.createDataFrame([("a", "2026-02-01"), ("a", "2026-01-01")],
                                  "id string, first_seen string")
    got = ledger.assign_first_seen(items, twice, AS_OF).collect()
    assert [(r.id, r.first_seen, r.known) for r in got] == [("a", "2026-01-01", True)]


def test_upsert_keeps_places_and_takes_the_last_value(spark):
    rng = random.Random(11)
    schema = ITEMS + ", month string"

    def rows(n, batch, unique):
        items, taken = [], set()
        for pos, item in enumerate(random_items(rng, n, batch, True)):
            item["month"] = rng.choice(["2026-01", "2026-01", "2026-02", "undated"])
            if not unique or (item["month"], item["id"]) not in taken:
                taken.add((item["month"], item["id"]))
                items.append(item)
        return items

    archive, incoming = rows(80, 1, True), rows(60, 2, False)
    frames = [spark.createDataFrame([tuple(i.values()) for i in x], schema)
              for x in (archive, incoming)]
    got = ar.upsert(*frames, ORDER).collect()
    assert len(got) == len({(r.month, r.id) for r in got})
    titles = {(r.month, r.id): r.title for r in got}
    assert set(titles) == {(i["month"], i["id"]) for i in archive + incoming}
    for item in archive + incoming:    # the last one written stands
        later = [i for i in incoming if (i["month"], i["id"]) == (item["month"], item["id"])]
        assert titles[item["month"], item["id"]] == (later[-1] if later else item)["title"]
    index, batch = [ar.with_digest(x, ORDER) for x in frames]
    assert ar.news(index, index).count() == 0
    keys = {(i["month"], i["id"]) for i in incoming}
    assert {tuple(r) for r in ar.news(index.limit(0), batch).collect()} == {(*k, False) for k in keys}
    known = {(i["month"], i["id"]) for i in archive}
    one = batch.dropDuplicates(["month", "id"])
    assert {tuple(r) for r in ar.news(index, one).collect()} == {
        (r.month, r.id, (r.month, r.id) in known) for r in one.collect()
        if (r.month, r.id, r.digest) not in {(x.month, x.id, x.digest) for x in index.collect()}}
    places = {(i["month"], i["id"]): i["pos"] for i in archive}
    assert all(r.pos == places[r.month, r.id] for r in got if (r.month, r.id) in places)
    known = {(i["month"], i["id"]) for i in archive}
    new = {(i["month"], i["id"]) for i in incoming} - known
    assert ar.new_count(*frames).first().new_count == len(new)


def test_manifest_puts_undated_first(spark):
    df = spark.createDataFrame([("2026-01",), ("undated",), ("2026-02",), ("2026-01",)],
                               "month string")
    assert [tuple(r) for r in ar.manifest(df).collect()] == [
        ("undated", 1), ("2026-02", 1), ("2026-01", 2)]


def test_latest_update_looks_at_the_full_set(spark):
    rows = [("a", "x", None, "2026-07-01"), ("b", "y", "2026-07-02", "2026-07-30"),
            ("c", "x", "", "2026-07-30"), ("d", "x", "2026-08-01", None)]
    items = spark.createDataFrame(
        rows, "id string, source string, published string, first_seen string")
    assert {r.id for r in latest_update(items).collect()} == {"b", "c"}
    narrowed = filter_source_date(latest_update(items), ["x"])
    assert {r.id for r in narrowed.collect()} == {"c"}
    ranged = filter_source_date(items, None, "2026-07-02", "2026-07-30")
    assert {r.id for r in ranged.collect()} == {"b", "c"}


def test_digests_tell_missing_values_and_lists_apart(spark):
    rows = [("a", None, ["x", "y"], []), (None, "a", ["x", "y"], []), ("a", "", ["x", "y"], []),
            ("a", None, ["x"], ["y"]), ("a", None, [], ["x", "y"]), ("a", None, None, ["x", "y"]),
            ("a", None, ["x", None], []), ("a", None, [None, "x"], []), ("a", None, ["xy"], [])]
    items = spark.createDataFrame(rows, "p string, q string, t array<string>, u array<string>")
    digests = [r[0] for r in items.select(ar.content_digest(items, items.columns)).collect()]
    assert len(set(digests)) == len(rows)

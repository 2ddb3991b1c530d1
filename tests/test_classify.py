import random

import pytest
from pyspark.sql import functions as F

from tidings import fixed_values as fv
from tidings.operators import classify


def by_sql(texts, rules, fallback):
    """The same categories by DuckDB."""
    import duckdb

    from tidings.plans.oracle import category
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, s VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    return [c for c, in con.execute(
        f"SELECT {category('s', rules, fallback)} FROM t ORDER BY i").fetchall()]


def categories(spark, texts, rules=fv.CATEGORY_RULES, fallback=fv.FALLBACK_CATEGORY):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    found = classify.with_category(df, F.col("s"), rules=rules, fallback=fallback)
    return [r.category for r in found.orderBy("i").collect()]


AI, OTHER = "Artificial Intelligence", fv.FALLBACK_CATEGORY
EDGES = [("agent", AI), ("xagent", OTHER), ("éagent", OTHER), ("²agent", OTHER), ("_agent", OTHER),
         ("-agent", AI), ("(Agent)", AI), ("AGENTIC", AI), ("中agent", OTHER), ("٣agent", OTHER),
         ("token\nagent", "Governance"), ("", OTHER), ("𝐚agent", OTHER), ("😀agent", AI),
         ("x" * 5000 + " agent", AI), ("x" * 5000 + "agent", OTHER)]


def test_word_starts_and_case(spark):
    assert categories(spark, [t for t, _ in EDGES]) == [c for _, c in EDGES]


def test_every_keyword_and_mixtures(spark):
    keywords = [k for _, ks in fv.CATEGORY_RULES for k in ks]
    rng = random.Random(3)
    glue = [" ", "x", "é", "-", "_", "\n", ", "]
    texts = keywords + ["".join(rng.choice(glue) + rng.choice(keywords)[:rng.randrange(2, 30)]
                                for _ in range(rng.randrange(1, 6))) for _ in range(1500)]
    assert categories(spark, texts) == by_sql(texts, fv.CATEGORY_RULES, fv.FALLBACK_CATEGORY)


def test_hint_wins_and_unknown_hint_does_not(spark):
    df = spark.createDataFrame(
        [("agent", "apache/spark"), ("agent", "other/repo"), ("agent", None)],
        "s string, hint string")
    found = classify.with_category(df, F.col("s"), F.col("hint")).collect()
    assert [r.category for r in found] == [
        "Data Engineering", "Artificial Intelligence", "Artificial Intelligence"]


def test_no_rules(spark):
    assert categories(spark, ["agent"], rules=[("A", [])], fallback="F") == ["F"]


@pytest.mark.parametrize("per_pattern", [0, 1, 4, 2000])
def test_rule_table_compiled_and_joined_agree(spark, per_pattern):
    """However the table is cut into patterns, and joined (0), the result is the same."""
    rules = [("B", ["the", "theme park", "ing"]), ("A", ["stream", "par"]), ("C", ["ein", "k"])]
    rows = [(p, c, k) for p, (c, ks) in enumerate(rules) for k in ks]
    table = spark.createDataFrame([*rows, (0, "N", None), (0, "E", "")],
                                  "priority int, category string, keyword string")
    texts = ["theme park", "xthe", "stream\nthe", "park", "eins", "Kite", "none", "", "a-ing",
             "the" * 50 + " stream"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    found = (classify.with_table_category(df, "i", "s", table, "F", per_pattern) if per_pattern
             else classify.with_joined_category(df, "i", "s", table, "F"))
    got = [r.category for r in found.orderBy("i").collect()]
    assert got == ["B", "F", "B", "A", "C", "C", "F", "F", "B", "B"]


def test_a_table_too_long_to_compile_is_joined(spark):
    table = spark.createDataFrame([(0, "A", "a"), (1, "B", "b")],
                                  "priority int, category string, keyword string")
    df = spark.createDataFrame([(0, "Beta"), (1, "b a"), (2, "c")], "i int, s string")
    found = classify.with_table_category(df, "i", "s", table, "F", max_compiled=1)
    assert [r.category for r in found.orderBy("i").collect()] == ["B", "A", "F"]


def test_both_paths_ignore_case_alike(spark):
    """Every character of the basic plane that has a case, or is equated with one that has, as a keyword and in
    texts: micro sign and mu, the sigmas, sharp s, dotted and dotless i, the Kelvin sign, combining iota."""
    newer = {*map(chr, (*range(0xA7C0, 0xA7F5), 0x1C89, 0x1C8A, 0x2C2F, 0x2C5F))}     # than the JVM's tables
    cased = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]) if c not in newer
             if c.lower() != c or c.upper() != c or classify.folded(c) != c]
    odd = {*classify.fold_exceptions()[0], *classify.fold_exceptions()[1], "ß", "ẞ", "İ", "ı", "K", "Å", "Σ", "ǅ"}
    keywords = sorted({"x" + c for c in odd} | {"x" + classify.folded(c) for c in odd} | {"x" + c for c in cased[::7]})
    table = spark.createDataFrame([(i, k, k) for i, k in enumerate(keywords)],
                                  "priority int, category string, keyword string")
    texts = [f"a x{c}" for c in sorted({*odd, *cased})] + [f"a X{c}{c}" for c in sorted(odd)] + ["ΟΔΥΣΣΕΥΣ xΣ", "ͅxς"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").repartition(4)
    compiled = classify.with_table_category(df, "i", "s", table, "F")
    joined = classify.with_joined_category(df, "i", "s", table, "F")
    one, two = ([(r.i, r.category) for r in x.orderBy("i").collect()] for x in (compiled, joined))
    assert one == two
    assert sum(c != "F" for _, c in two) > len(odd)


def test_a_table_of_fifty_thousand_keywords(spark, plan_of):
    rng = random.Random(8)
    keywords = [f"{rng.choice('abcdefghij')}{rng.choice('klmno')}{i:05d}" for i in range(50_000)]
    table = spark.createDataFrame([(i, f"c{i % 97}", k) for i, k in enumerate(keywords)],
                                  "priority int, category string, keyword string")
    texts = [" ".join(rng.choice([f"word{rng.randint(0, 10**6)}", rng.choice(keywords), rng.choice(keywords)[:-1]])
                      for _ in range(rng.randint(0, 12))) for _ in range(300)]
    place = {k: i for i, k in enumerate(keywords)}
    want = []
    for text in texts:
        hits = [place[w] for w in text.split() if w in place]
        want.append(f"c{min(hits) % 97}" if hits else "F")
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    found = classify.with_joined_category(df, "i", "s", table, "F")
    assert [r.category for r in found.orderBy("i").collect()] == want
    # Neither the words nor the pieces are shuffled; only the best hit of each text is.
    for line in plan_of(found).split("\n"):
        assert "Exchange" not in line or "hashpartitioning(i" in line or "Broadcast" in line or "Single" in line


def test_one_search_per_text(spark, plan_of):
    df = spark.createDataFrame([("a",)], "s string")
    plan = plan_of(classify.with_category(df, F.col("s")))
    assert plan.count("regexp_extract_all") == 1 and "Exchange" not in plan

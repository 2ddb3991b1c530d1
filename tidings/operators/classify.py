"""Rule-based categories."""

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from tidings import fixed_values as fv
from tidings.shared import materialize

Rules = list[tuple[str, list[str]]]

#: Keywords of one pattern; a longer table becomes several, tried in order of priority.
PATTERN_KEYWORDS = 2_000
#: Keywords of a table that is compiled. A longer one is joined, with the same result.
MAX_COMPILED_KEYWORDS = 100_000
#: Characters of a keyword by which word starts are looked up first.
BEGINNING = 3


def item_text(title: Column, summary: Column) -> Column:
    """The text the rules look at."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit("")))


def alternatives(words: list[str]) -> str:
    """Pattern for any of `words`, with shared beginnings factored out.

    The matcher then rules out most positions on their first letter instead of trying each word.
    """
    by_first: dict[str, list[str]] = {}
    for word in words:
        by_first.setdefault(word[0], []).append(word[1:])
    parts = []
    for first, rests in by_first.items():
        if "" in rests:  # the shortest word decides: ends are open
            parts.append(re.escape(first))
        elif len(rests) == 1:
            parts.append(re.escape(first + rests[0]))
        else:
            parts.append(f"{re.escape(first)}(?:{alternatives(rests)})")
    return "|".join(parts)


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """The places of `text` where a keyword starts a word, as one short string.

    Each place contributes a line with as many characters as the longest keyword has. A match
    consumes no more than the character before the word, so overlapping keywords are all kept. A
    keyword's end is open: stems match. Keywords start with a word character.
    """
    window = max(map(len, keywords))
    place = f"(?isu){fv.WORD_START}(?={alternatives(keywords)})(?=(.{{1,{window}}}))"
    return F.array_join(F.regexp_extract_all(text, F.lit(place), 1), "\n")


def hit_category(hits: Column, rules: Rules, fallback: str) -> Column:
    """First category with a keyword at the start of a line of `hits`."""
    choice = F.when(hits == "", F.lit(fallback))
    for category, keywords in rules:
        choice = choice.when(hits.rlike(f"(?iu)(?:^|\n)(?:{alternatives(keywords)})"),
                             F.lit(category))
    return choice.otherwise(F.lit(fallback))


def with_category(items: DataFrame, text: Column, hint: Column | None = None,
                  rules: Rules = fv.CATEGORY_RULES,
                  hints: dict[str, str] = fv.REPO_CATEGORY_HINTS,
                  fallback: str = fv.FALLBACK_CATEGORY) -> DataFrame:
    """Add `category`: a known hint wins, else the first category with a keyword in `text`.

    However many categories there are, the text is searched once; the ordered tests run on the
    few hits. The hits are staged as a column so that they are not computed per test, and are not
    computed at all where the hint decides.
    """
    rules = [(category, keywords) for category, keywords in rules if keywords]
    hinted = F.lit(None).cast("string") if hint is None else hint_category(hint, hints)
    if not rules:
        return items.withColumn("category", F.coalesce(hinted, F.lit(fallback)))
    keywords = [keyword for _, words in rules for keyword in words]
    staged = items.withColumn("__hinted", hinted).withColumn(
        "__hits", F.when(F.col("__hinted").isNull(), keyword_hits(text, keywords)))
    category = F.coalesce("__hinted", hit_category(F.col("__hits"), rules, fallback))
    return staged.withColumn("category", category).drop("__hinted", "__hits")


def hint_category(hint: Column, hints: dict[str, str] = fv.REPO_CATEGORY_HINTS) -> Column:
    """Category a hint stands for, null when it stands for none."""
    if not hints:
        return F.lit(None).cast("string")
    pairs = [F.lit(x) for pair in hints.items() for x in pair]
    return F.element_at(F.create_map(*pairs), hint)


def usable(rules: DataFrame) -> DataFrame:
    """The rules whose keyword is neither null nor empty."""
    return rules.where(F.coalesce(F.col("keyword"), F.lit("")) != "")


def with_table_category(items: DataFrame, key: str, text: str, rules: DataFrame,
                        fallback: str = fv.FALLBACK_CATEGORY,
                        per_pattern: int = PATTERN_KEYWORDS,
                        max_compiled: int = MAX_COMPILED_KEYWORDS) -> DataFrame:
    """Add `category` by a rule table (priority, category, keyword), compiled into patterns.

    The table is a parameter: up to `max_compiled` rows of it are read; a longer one goes to
    `with_joined_category`, which gives the same. It is cut by priority into patterns of `per_pattern` keywords; the first one with a hit decides,
    so the result doesn't depend on the cut. `key` identifies a row of `items`. Rules without a
    keyword are left out.
    """
    head = (usable(rules).orderBy("priority", "category", "keyword")
            .select("priority", "category", "keyword").limit(max_compiled + 1).collect())
    if len(head) > max_compiled:
        return with_joined_category(items, key, text, rules, fallback)
    staged, found = items, []
    for low in range(0, len(head), per_pattern):
        ordered: dict[tuple[int, str], list[str]] = {}
        for row in head[low:low + per_pattern]:
            ordered.setdefault((row["priority"], row["category"]), []).append(row["keyword"])
        part = [(category, keywords) for (_, category), keywords in ordered.items()]
        hits, before = f"__hits{low}", F.coalesce(*found, F.lit("")) if found else F.lit("")
        staged = staged.withColumn(hits, F.when(before == "", keyword_hits(
            F.col(text), [k for _, keywords in part for k in keywords])))
        staged = staged.withColumn(f"__found{low}", F.when(
            F.coalesce(F.col(hits), F.lit("")) != "", hit_category(F.col(hits), part, fallback)))
        found.append(F.col(f"__found{low}"))
    category = F.coalesce(*found, F.lit(fallback))
    return staged.withColumn("category", category).drop(
        *[c for low in range(0, len(head), per_pattern) for c in (f"__hits{low}", f"__found{low}")])


def folded(char: str) -> str:
    """The letter that stands for a letter when case is ignored: its upper case in lower case, where each is
    one character."""
    upper = char.upper() if len(char.upper()) == 1 else char
    return upper.lower()[0]


@lru_cache(maxsize=1)
def fold_exceptions() -> tuple[str, str]:
    """The characters that `folded` takes for another than their lower case, and what it takes them for.

    Such as the micro sign (mu), the final sigma, the long s and the dotless i; none is beyond the
    basic plane.
    """
    pairs = [(c, folded(c)) for c in map(chr, range(0x10000)) if c.lower() == c and folded(c) != c]
    return "".join(c for c, _ in pairs), "".join(f for _, f in pairs)


def fold_case(text: Column) -> Column:
    """Texts in which letters that differ in case only are equal, as a case-insensitive pattern takes them.

    Character by character, so that lengths stay; the dotted capital I, whose lower case would be two, comes
    first.
    """
    return F.translate(F.lower(F.translate(text, "\u0130", "i")), *fold_exceptions())


def with_joined_category(items: DataFrame, key: str, text: str, rules: DataFrame,
                         fallback: str = fv.FALLBACK_CATEGORY) -> DataFrame:
    """Categories by equi-joins, for rule tables of any size; the same as by `with_table_category`.

    A keyword matches where the text at some word start begins with it, case ignored. So each text yields the
    characters that follow its word starts. Their first few are looked up among the beginnings of keywords, which
    leaves few of them, with the lengths of the keywords that begin so; these pieces are joined to the keywords by
    equality. Both tables are written first, so that Spark knows their size and broadcasts them
    where that is small: then nothing but the few hits is shuffled. The best priority is reduced on the map side.
    """
    keywords = materialize(
        usable(rules).select("priority", "category", fold_case(F.col("keyword")).alias("piece")), "keywords")
    beginnings = materialize(
        keywords.groupBy(F.substring("piece", 1, BEGINNING).alias("beginning"))
        .agg(F.collect_set(F.length("piece")).alias("lengths")), "beginnings")
    sizes = [r[0] for r in beginnings.select(F.length("beginning")).distinct().collect()]   # BEGINNING at most
    longest = keywords.agg(F.max(F.length("piece"))).first()[0]
    if not longest:
        return items.withColumn("category", F.lit(fallback))
    # Where a word starts is told by the text itself: a mark may fold to a letter.
    pattern = f"(?us){fv.WORD_START}(?=(.{{1,{longest}}}))"
    heads = F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), 1), fold_case))
    begun = (
        items.select(key, F.explode(heads).alias("head"))
        .select(key, "head", F.explode(F.array(*[F.lit(n) for n in sizes])).alias("n"))
        .where(F.length("head") >= F.col("n"))
        .select(key, "head", F.col("head").substr(F.lit(1), F.col("n")).alias("beginning")))
    pieces = (
        begun.join(beginnings, "beginning").select(key, "head", F.explode("lengths").alias("n"))
        .where(F.length("head") >= F.col("n"))
        .select(key, F.col("head").substr(F.lit(1), F.col("n")).alias("piece")))
    best = (pieces.join(keywords, "piece").groupBy(key)
            .agg(F.min(F.struct("priority", "category")).alias("best")))
    return (items.join(best, key, "left")
            .withColumn("category", F.coalesce("best.category", F.lit(fallback))).drop("best"))


def with_hint_table(items: DataFrame, hint: str, hints: DataFrame) -> DataFrame:
    """Replace `category` where the table (hint, category) knows the item's hint."""
    known = hints.select(F.col("hint").alias(hint), F.col("category").alias("__hinted"))
    return (items.join(known, hint, "left")
            .withColumn("category", F.coalesce("__hinted", "category")).drop("__hinted"))

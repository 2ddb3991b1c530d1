"""Personal data by weak supervision, in DataFrame functions alone.

Fixed patterns give the base spans, which always stay. Further candidates, strings that may be keys or
passwords, get votes from a shape pattern, a gazetteer of words before them and their context; nobody
labels them. Expectation-maximization over the few vote patterns estimates how reliable each labeler is
and the chance that each pattern is a secret; those chances train the span classifier, a naive Bayes
over the span's own features and votes, which decides.
"""

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tidings.shared import materialize

# The kinds in the order that breaks ties of start, and their patterns. The quantifiers
# are possessive where giving back can't lead to a match, so that no text makes the search slow.
KINDS = ["email", "ip", "card", "phone", "secret"]
EMAIL = (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++"
         r"(?:\.[A-Za-z0-9-]++)++")
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
#: A whole run of digits with single spaces or hyphens, of 14 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])"
          r"[A-Za-z0-9+/_-]{16,}+")
BEFORE_SECRET = (r"(?i)(?:passw|pwd|secret|token|api|key|auth|bearer|credential|contrase|clave|"
                 r"kennwort|schl|mot de passe|cl[eé])")
GIVEN = r"""[=:]\s*["']?$"""
PROSE = r"[A-Za-z]{2,}[,.]?\s$"

SPANS = "array<struct<start:int,end:int,value:string>>"
VOTES = ["shape", "gazetteer", "context"]
ROUNDS = 30


def found(text: Column, pattern: str, guard: Column) -> tuple[Column, Column]:
    """All matches, and the text between them (one more), where the guard holds."""
    return (F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))),
            F.split(text, pattern, -1))


def located(matches: str, between: str) -> Column:
    """Matches with their places in code points, from the lengths of what stands between."""
    begin = f"acc.at + length({between}[i])"
    return F.expr(f"""case when size({matches}) > 0 then aggregate(
        sequence(0, size({matches}) - 1),
        named_struct('at', 0, 'out', cast(array() as {SPANS})),
        (acc, i) -> named_struct(
            'at', {begin} + length({matches}[i]),
            'out', concat(acc.out, array(named_struct(
                'start', {begin}, 'end', {begin} + length({matches}[i]),
                'value', {matches}[i])))),
        acc -> acc.out) else cast(array() as {SPANS}) end""")


def luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, r"[\x20-]", ""))
    doubled = lambda i: F.substring(digits, i, F.lit(1)).cast("int") * (2 - i % 2)
    return F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda total, i: total + F.when(doubled(i) > 9, doubled(i) - 9).otherwise(doubled(i))
    ) % 10 == 0


def phone_digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, r"[^0-9]", "")).between(10, 15)


def checked(matches: str, between: str, no: int, check) -> Column:
    """The spans of one kind whose value passes."""
    return F.transform(
        F.filter(located(matches, between), lambda s: check(s["value"])),
        lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("no"),
                           F.lit(KINDS[no]).alias("kind"), s["end"].alias("end")))


def n_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def with_candidates(docs: DataFrame, text_col: str, base: str, more: str) -> DataFrame:
    """Add `base`, the base spans (start, no, kind, end), and `more`, the other candidates with the
    votes and features. Both names have to be new to the frame."""
    own = [f"{base}_{k}" for k in range(2 * len(KINDS))]
    text = F.coalesce(F.col(text_col), F.lit(""))
    digits = text.rlike("[0-9]")
    guards = [F.contains(text, F.lit("@")), digits, digits, F.contains(text, F.lit("+")), digits]
    columns = {}
    for k, (pattern, guard) in enumerate(zip([EMAIL, IP, CARD, PHONE, SECRET], guards, strict=True)):
        columns[own[2 * k]], columns[own[2 * k + 1]] = found(text, pattern, guard)
    rows = docs.withColumns({c: columns[c] for c in own[::2]})
    rows = rows.withColumns({own[k + 1]: F.when(F.size(own[k]) > 0, columns[own[k + 1]])
                             for k in range(0, len(own), 2)})
    checks = [lambda v: F.lit(True), lambda v: v.rlike(IP_PARTS), luhn, phone_digits]
    spans = [checked(own[2 * k], own[2 * k + 1], k, check) for k, check in enumerate(checks)]
    rows = rows.withColumn(base, F.array_sort(F.concat(*spans)))
    free = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    def described(s: Column) -> Column:
        value, size = s["value"], F.length(s["value"])
        before = F.substring(text, F.greatest(s["start"] - 23, F.lit(1)),
                             F.least(s["start"], F.lit(24)))
        n_digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
        kind = (F.when(value.rlike("^[0-9a-f]+$"), "hex").when(value.rlike("^[0-9A-Z]+$"), "upper")
                .when(value.rlike("^[a-z]+[0-9]+$"), "word").otherwise("mixed"))
        shape = F.when(kind.isin("hex", "upper") & (n_digits * 10 > size), 1).when(
            kind == "word", -1).otherwise(0)
        return F.struct(
            s["start"].alias("start"), F.lit(4).alias("no"), F.lit("secret").alias("kind"),
            s["end"].alias("end"), shape.alias("shape"),
            F.when(before.rlike(BEFORE_SECRET), 1).otherwise(0).alias("gazetteer"),
            F.when(before.rlike(GIVEN), 1).when(before.rlike(PROSE), -1).otherwise(0)
            .alias("context"),
            F.concat(F.lit("charset="), kind).alias("charset"),
            F.concat(F.lit("size="), F.least(F.floor(size / 8), F.lit(8))).alias("size"),
            F.concat(F.lit("digits="), F.floor(n_digits * 5 / size)).alias("digits"))

    return rows.withColumn(more, F.transform(F.filter(located(own[8], own[9]), free), described)
                           ).drop(*own)


@dataclass
class Model:
    """Chance of a secret before any vote, each labeler's vote chances, the classifier's weights."""

    share: float = 0.5
    reliability: dict = field(default_factory=dict)
    bias: float = 0.0
    weights: dict = field(default_factory=dict)


def maximize(patterns: dict[tuple, float]) -> tuple[float, dict, dict]:
    """EM over vote patterns and their counts: share, P(vote | class) of each labeler, P(secret |
    pattern). Begins from the votes themselves; each class keeps one imagined vote of each kind."""
    chance = {p: min(max(0.5 + 0.25 * sum(p), 0.05), 0.95) for p in patterns}
    share, tables = 0.5, {}
    for _ in range(ROUNDS):
        total = sum(patterns.values())
        share = (sum(n * chance[p] for p, n in patterns.items()) + 1) / (total + 2)
        tables = {}
        for i, name in enumerate(VOTES):
            for positive in (True, False):
                weight = {v: 1.0 + (1.0 if (v > 0) == positive and v else 0.0) for v in (-1, 0, 1)}
                for p, n in patterns.items():
                    weight[p[i]] += n * (chance[p] if positive else 1 - chance[p])
                all_of = sum(weight.values())
                tables[name, positive] = {v: w / all_of for v, w in weight.items()}
        for p in patterns:
            yes, no = share, 1 - share
            for i, name in enumerate(VOTES):
                yes *= tables[name, True][p[i]]
                no *= tables[name, False][p[i]]
            chance[p] = yes / (yes + no)
    return share, tables, chance


def features(s: Column) -> Column:
    return F.array(s["charset"], s["size"], s["digits"], *[
        F.concat(F.lit(f"{v}="), s[v]) for v in VOTES])


def fit(candidates: DataFrame, more: str) -> Model:
    """From a frame with the candidates in `more`. Vote patterns and features are few, whatever the
    number of candidates; only their counts come to the driver. No candidates, no secrets."""
    one = candidates.select(F.explode(more).alias("s"))
    votes = one.groupBy(*[F.col(f"s.{v}").alias(v) for v in VOTES]).count().collect()
    if not votes:
        return Model()
    patterns = {tuple(r[v] for v in VOTES): float(r["count"]) for r in votes}
    share, tables, chance = maximize(patterns)
    key = F.concat_ws(",", *[F.col(f"s.{v}") for v in VOTES])
    known = F.create_map(*[F.lit(x) for p, c in chance.items() for x in (",".join(map(str, p)), c)])
    counts = (one.select(F.explode(features(F.col("s"))).alias("feature"), known[key].alias("p"))
              .groupBy("feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
              .collect())
    total = sum(patterns.values())
    yes = sum(n * chance[p] for p, n in patterns.items())
    weights = {r["feature"]: math.log((r["yes"] + 0.5) / (yes + 1))
               - math.log((r["no"] + 0.5) / (total - yes + 1)) for r in counts}
    return Model(share, tables, math.log((yes + 0.5) / (total - yes + 0.5)), weights)


def decided(model: Model, base: str, more: str) -> Column:
    """All spans, sorted: the base ones and the candidates that the classifier takes."""
    plain = lambda s: F.struct(s["start"].alias("start"), s["no"].alias("no"),
                               s["kind"].alias("kind"), s["end"].alias("end"))
    if not model.weights:
        return F.col(base)
    table = F.create_map(*[F.lit(x) for pair in sorted(model.weights.items()) for x in pair])
    score = lambda s: F.aggregate(features(s), F.lit(float(model.bias)),
                                  lambda total, f: total + F.coalesce(table[f], F.lit(0.0)))
    return F.array_sort(F.concat(F.col(base), F.transform(
        F.filter(more, lambda s: score(s) > 0), plain)))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row.

    `spans` lists kind:start:end, in code points, by start and then kind; `base_sha256` is the digest
    of the base ones written alike. A null or empty text has none, and the digest of an empty string.
    Rows that repeat are searched each; no rows, no result; other columns are ignored. Nothing is
    shuffled but vote counts.
    """
    rows = materialize(with_candidates(
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")),
        "text", "base", "more").select("doc_id", "base", "more"), "candidates")
    model = fit(rows, "more")
    counts = [n_of("base", kind) for kind in KINDS[:4]]
    return rows.withColumn("all", decided(model, "base", "more")).select(
        "doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("all")).alias("spans"),
        (F.size("all") - F.size("base")).cast("bigint").alias("n_added"))


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same columns, with each span of the text replaced by its kind in angle brackets.

    Where spans overlap, the text from the first one's start is covered once. A null text stays null.
    """
    names = set(docs.columns)
    fresh = lambda name: next(c for c in (name + "_" * n for n in range(len(names) + 1))
                              if not any(o.startswith(c) for o in names))
    base, more, spans = fresh("spans_base"), fresh("spans_more"), fresh("spans_all")
    marked = with_candidates(docs, text_col, base, more)
    model = fit(materialize(marked.select(F.col(more).alias("more")), "candidates"), "more")
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        kept = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.when(s["end"] > acc["at"], F.concat(F.lit("<"), s["kind"], F.lit(">"))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.concat(acc["out"], kept, mark).alias("out"))

    whole = F.aggregate(spans, start, step, lambda acc: F.concat(
        acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    result = F.when(text.isNotNull() & (F.size(spans) > 0), whole).otherwise(text)
    return marked.withColumn(spans, decided(model, base, more)).withColumn(text_col, result).select(
        *docs.columns)

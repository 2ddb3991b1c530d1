"""Exact join of documents by the Jaccard similarity of their word shingles, as a metric-space join.

The Jaccard distance is a metric. In text nearly every pair is at distance 1, so the hyperplane window
of a document pivot (twice the radius) would hold nearly everything. The pivots here are the parts of
the documents themselves: the shingle universe is cut into m slices by hash, and pivot j of a document
is what it has in slice j, a set at distance 1 - |part| / |document| from it.

* Regions: a document lies in the regions of its nearest pivots, ties by slice.
* Windows: a document within the radius differs in at most k shingles (k follows from the radius and
  the sizes), so of the m parts at most k differ. Among the k + 1 nearest pivots of either document
  there is therefore one common to both; each is replicated to these regions. Sizes are cut into
  windows too, and documents near a boundary are replicated over it.
* Recursion: in a region of several documents some become pivots; all others are measured against
  them. Linked documents fall into one component; regions that still hold several components recurse
  with new pivots, more in each round. The first few link most of a large group, and what is in one
  component is measured no more, so pairs grow with the members of the regions, not with their squares
  as with many pivots at once. The triangle inequality over the first pivot's distances rules pairs out, and so do
  parities: sets whose parities by hashed bit differ in d bits differ in at least d shingles.

Nothing is estimated: every pair within the radius shares a region, and recursion ends when a region
has one component or all its pairs are measured or ruled out.
"""

from dataclasses import dataclass, field
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidings.llm.words import mix, runs, shingle_sets, signed
from tidings.shared import materialize

#: Growth of the size windows; growth of a region's number of pivots from round to round, from 1, and its most.
GROWTH, MORE_PIVOTS, PIVOTS = 1.6, 4, 1024
#: Members of a region that meet its pivots in one task; larger regions are dealt over several.
PART = 4096
#: Steps after which a search for components has gone wrong; each at least halves the longest chain.
MOST_STEPS = 200
#: Stands for a missing id in joins.
NO_ID = -(1 << 63)
#: Words of 64 bits in the parities of a set. With as many bits as a text has shingles, sets that differ in not many
#: more than linked ones do are still told apart.
PARITY = [f"x{i}" for i in range(8)]


@dataclass
class Windows:
    """Size windows for sets that are linked if den * |both| >= num * |either|."""

    num: int
    den: int
    begin: list[int] = field(default_factory=lambda: [1])

    def home(self, n: int) -> int:
        """The window of a set of n as the smaller one of a pair."""
        while self.begin[-1] <= n:
            self.begin.append(max(self.begin[-1] + 1, int(self.begin[-1] * GROWTH)))
        low, high = 0, len(self.begin) - 1
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self.begin[mid] <= n else (low, mid)
        return low

    def differing(self, total: int) -> int:
        """Most shingles in which linked sets of `total` shingles together can differ."""
        return total * (self.den - self.num) // (self.den + self.num)

    def slices(self, w: int) -> int:
        largest = self.begin[w + 1] - 1
        k = self.differing(largest + largest * self.den // self.num)
        return k + 1 + (k + 3) // 4

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """(window, slices, regions to enter) of a set of n."""
        home = self.home(n)
        out = [(home, self.slices(home), self.differing(n + n * self.den // self.num) + 1)]
        smaller = -(-n * self.num // self.den)        # the least partner
        for w in range(home - 1, -1, -1):
            largest = self.begin[w + 1] - 1
            if largest < smaller:
                break
            out.append((w, self.slices(w), self.differing(n + largest) + 1))
        return [x for x in out if x[2] > 1 or x[0] != home or n > self.den // max(
            self.den - self.num, 1)]


def regions(shingles: np.ndarray, windows: Windows) -> np.ndarray:
    """Keys of the regions that a set of sorted shingles lies in or is replicated to."""
    n, keys = len(shingles), []
    if not n or windows.differing(n + n * windows.den // windows.num) == 0:
        return np.empty(0, np.uint64)     # only an equal set is near enough
    mixed = mix(shingles ^ np.uint64(0xA0761D6478BD642F))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    high = (shingles >> np.uint64(32)).astype(np.int64)
    for w, m, enter in windows.of(n):
        bounds = np.searchsorted(high, -(-(np.arange(m + 1) << 32) // m))
        size = np.diff(bounds)
        nearest = np.lexsort((np.arange(m), -size))[:enter]
        content = sums[bounds[1:]] - sums[bounds[:-1]]
        keys.append(mix(content[nearest] + np.uint64((w + 1) * 0xE7037ED1A0B428DB & 0xFFFFFFFFFFFFFFFF)
                        + (nearest.astype(np.uint64) + np.uint64(1))
                        * np.uint64(0x8EBC6AF09C88C6E3)))
    return np.concatenate(keys)


def parities(shingles: np.ndarray) -> np.ndarray:
    bits = len(PARITY) * 64
    odd = np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _describe(size: int, windows: Windows | None = None):
    """Size and two hashes of each row's set; with windows also its parities and regions."""
    def run(batches):
        for batch in batches:
            text = batch.column(2)
            for low, after, _, _ in runs(text, 1 << 19):
                n, first, second, keys, odd = [], [], [], [], []
                for shingles in shingle_sets(text[low:after], size):
                    n.append(len(shingles))
                    first.append(mix(shingles).sum(dtype=np.uint64))
                    second.append(mix(shingles ^ np.uint64(0x589965CC75374CC3)).sum(dtype=np.uint64))
                    if windows:
                        keys.append(regions(shingles, windows))
                        odd.append(parities(shingles))
                columns = [batch.column(0)[low:after], batch.column(1)[low:after], pa.array(np.array(n, np.int64)),
                           signed(np.array(first, np.uint64)), signed(np.array(second, np.uint64))]
                names = ["doc_id", "version", "n", "h1", "h2"]
                if windows:
                    odd = np.array(odd)
                    bounds = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                    columns += [*[signed(np.ascontiguousarray(odd[:, i])) for i in range(len(PARITY))],
                                pa.ListArray.from_arrays(pa.array(bounds), signed(np.concatenate(keys)))]
                    names += [*PARITY, "regions"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def _measure(size: int):
    def run(batches):
        for batch in batches:
            sets = zip(shingle_sets(batch.column(4), size), shingle_sets(batch.column(5), size),
                       strict=True)
            both = np.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in sets], np.int64)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(4)], pa.array(both)],
                names=["a", "b", "n_a", "n_b", "n_both"])
    return run


def measured(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(a, b, n_a, n_b, n_both) of pairs of class ids, from the texts (id, text)."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return (pairs.select("a", "b", "n_a", "n_b").join(left, "a").join(right, "b")
            .select("a", "b", "n_a", "n_b", "text_a", "text_b")
            .mapInArrow(_measure(size), "a bigint, b bigint, n_a bigint, n_b bigint, n_both bigint"))


def is_stars(edges: DataFrame) -> bool:
    """Whether every v has one u and no u is a v: then u is the component of v."""
    twice = edges.groupBy("v").agg(F.count("*").alias("n")).where("n > 1")
    chained = edges.select("v").join(edges.select(F.col("u").alias("v")), "v", "left_semi")
    return twice.isEmpty() and chained.isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ids in links (a, b): the least id reachable.

    Large-star and small-star steps in turn, each written to the shared folder, until the edges are stars;
    the number of steps grows with the logarithm of the longest chain.
    """
    edges = materialize(links.where("a <> b").select(
        F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    for step in range(MOST_STEPS):
        if is_stars(edges):
            stars = edges.select(F.col("v").alias("id"), F.col("u").alias("component"))
            return stars.unionByName(
                edges.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct())
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select(
            "v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.where("v <> u").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(
            least.select("v", F.col("m").alias("u"))).where("v <> u").distinct()
        edges = materialize(small, f"edges-{step}")
    raise RuntimeError("components didn't come to an end")


def link_condition(num: int, den: int):
    return den * F.col("n_both") >= num * (F.col("n_a") + F.col("n_b") - F.col("n_both"))


def all_links(members: DataFrame, sketches: DataFrame, texts: DataFrame, size: int, num: int,
              den: int) -> DataFrame:
    """(id, component) of the classes in `members` (region, id) that have a link.

    `sketches` are sizes and parities (id, n, x0, ...). They come to the members where these meet, so that what
    is kept from round to round is narrow.
    """
    spark = members.sparkSession
    radius = 1 - num / den
    links = None
    comp = None
    state = members.withColumn("d", F.lit(None).cast("double"))
    for step in range(10_000):
        with_comp = state if comp is None else state.join(
            comp.withColumnRenamed("component", "c"), "id", "left")
        c = F.col("id") if comp is None else F.coalesce("c", "id")
        with_comp = with_comp.select("region", "id", "d", c.alias("c"))
        sizes = with_comp.groupBy("region", "c").agg(F.count("*").alias("n_comp"))
        open_regions = sizes.groupBy("region").agg(
            F.count("*").alias("n_comps"), F.sum("n_comp").alias("members"),
            F.max(F.struct("n_comp", "c")).alias("main")).where("n_comps > 1").select(
            "region", "members", F.col("main.c").alias("main"),
            (F.col("members") - F.col("main.n_comp")).alias("others"))
        # The members of a region's largest component needn't be pivots if all others can be. Otherwise any
        # can: a pivot of that component meets the few others only, and may link many of them.
        ranked = materialize(with_comp.join(open_regions, "region"), f"regions-{step}")
        order = Window.partitionBy("region").orderBy(F.xxhash64("id"), "id")
        limit = min(MORE_PIVOTS ** step, PIVOTS)
        any_member = (F.col("others") > limit) & F.lit(limit < PIVOTS)
        pivots = ranked.where(any_member | (F.col("c") != F.col("main"))).withColumn(
            "rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(
            "region", F.col("id").alias("p"), F.col("d").alias("d_p"), F.col("c").alias("c_p"))
        sketched = pivots.join(sketches.select(
            F.col("id").alias("p"), F.col("n").alias("n_p"), *[F.col(x).alias(f"{x}_p") for x in PARITY]), "p")
        differ = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(f"{x}_p"))) for x in PARITY), F.lit(0))
        near = ((F.col("c") != F.col("c_p"))
                & (den * F.least("n", "n_p") >= num * F.greatest("n", "n_p"))
                & ((den + num) * differ <= (den - num) * (F.col("n") + F.col("n_p")))
                & (F.col("d").isNull() | F.col("d_p").isNull()
                   | (F.abs(F.col("d") - F.col("d_p")) <= radius + 1e-9)))
        # Members of a large region are dealt over several tasks, and its pivots go to each of them.
        parts = F.ceil(F.col("members") / PART).cast("int")
        dealt = ranked.join(sketches, "id").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
        met = sketched.join(open_regions.select("region", "members"), "region").withColumn(
            "part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("members")
        pairs = dealt.join(met, ["region", "part"]).where(near).select(
            F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b"),
            F.when(F.col("id") < F.col("p"), F.col("n")).otherwise(F.col("n_p")).alias("n_a"),
            F.when(F.col("id") < F.col("p"), F.col("n_p")).otherwise(F.col("n")).alias("n_b")
        ).distinct()
        found = materialize(measured(pairs, texts, size), f"measured-{step}")
        new = found.where(link_condition(num, den)).select("a", "b")
        links = new if links is None else links.unionByName(new)
        if comp is None or not new.isEmpty():
            comp = materialize(components(links), f"components-{step}")
        # Pivots have met all of their region and leave it.
        rest = ranked.join(pivots.select("region", F.col("p").alias("id")), ["region", "id"],
                           "left_anti")
        if step == 0:
            distance = 1 - F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both"))
            known = found.select("a", "b", distance.alias("known"))
            by_pivot = pivots.select("region", "p")
            rest = (rest.join(by_pivot, "region")
                    .withColumns({"a": F.least("id", "p"), "b": F.greatest("id", "p")})
                    .join(known, ["a", "b"], "left")
                    .select("region", "id", F.col("known").alias("d")))
        state = materialize(rest.select("region", "id", "d"), f"rest-{step}")
        left = state.join(comp.withColumnRenamed("component", "c"), "id", "left").groupBy(
            "region").agg(F.min(F.coalesce("c", "id")).alias("low"),
                          F.max(F.coalesce("c", "id")).alias("high")).where("low < high")
        if left.isEmpty():
            return comp
    raise RuntimeError("regions didn't come to an end")


def row_key(id_col: str, text_col: str) -> dict:
    """What tells rows apart: the id and a hash of the text. Equal rows are decided alike."""
    doc_id, text = F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col), F.lit(""))
    return {"doc": F.coalesce(doc_id, F.lit(NO_ID)), "version": F.xxhash64(text, doc_id.isNull())}


def linked_classes(docs: DataFrame, size: int, num: int, den: int, id_col: str, text_col: str,
                   by_id: bool) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, version, n, h1, h2) and their classes (h1, h2, n, first).

    Rows of equal sets are a class, whatever their ids; classes have numbers of their own, so that neither a
    missing id nor one that comes again hides a set. `first` is the row (missing, doc_id, version) with the
    least id in the component of the class, one without an id last. With `by_id`, classes that
    share an id are linked too.
    """
    key = row_key(id_col, text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), key["version"].alias("version"),
                       F.col(text_col).alias("text"))
    longs = "doc_id bigint, version bigint, n bigint, h1 bigint, h2 bigint"
    described = materialize(rows.mapInArrow(_describe(size), longs), "shingles", compression="zstd")
    # One row per class, by aggregates that combine before the shuffle. The regions, the bulk of it, are made for
    # this shuffle and stay with the class.
    own = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "version")
    whole = rows.mapInArrow(_describe(size, Windows(num, den)), f"{longs}, "
                            + "".join(f"{x} bigint, " for x in PARITY) + "regions array<bigint>")
    classes = materialize(
        whole.where("n > 0").groupBy("h1", "h2", "n").agg(
            F.min(own).alias("first"), *[F.min(x).alias(x) for x in PARITY],
            F.first("regions").alias("regions"))
        .withColumn("id", F.monotonically_increasing_id()), "classes", compression="zstd")
    entries = classes.select(F.explode("regions").alias("region"), "id")
    met = entries.groupBy("region").agg(
        F.min("id").alias("low"), F.max("id").alias("high"),
        F.bit_xor(F.xxhash64("id")).alias("members")).where("low < high")
    # Near texts share most of their regions: of regions with the same members one is enough. What is joined here
    # and below grows with the documents, so the plan is the same at every size: both sides are sorted.
    kept = materialize(met.groupBy("low", "high", "members").agg(F.min("region").alias("region"))
                       .select("region"), "regions")
    members = materialize(entries.join(kept.hint("merge"), "region").select("region", "id"), "members")
    doc = F.coalesce("doc_id", F.lit(NO_ID)).alias("doc")
    met_ids = members.select("id").distinct()
    wanted = materialize(
        classes.select("id", F.coalesce("first.doc_id", F.lit(NO_ID)).alias("doc"), "first.version")
        .join(met_ids, "id", "left_semi"), "wanted")
    sketches = materialize(classes.select("id", "n", *PARITY).join(met_ids, "id", "left_semi"), "sketches")
    texts = materialize(
        rows.select(doc, "version", "text").join(wanted.hint("merge"), ["doc", "version"])
        .groupBy("id").agg(F.min("text").alias("text")), "member-texts", compression="zstd")
    linked = all_links(members, sketches, texts, size, num, den)
    if by_id:
        linked = _with_shared_ids(described, classes, linked)
    placed = classes.join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))
    firsts = placed.groupBy("component").agg(F.min("first").alias("least"))
    named = placed.join(firsts, "component").select("h1", "h2", "n", F.col("least").alias("first"))
    return described, named


def _with_shared_ids(described: DataFrame, classes: DataFrame, linked: DataFrame) -> DataFrame:
    """The components when rows of one id are linked, whatever their texts."""
    several = described.where("doc_id is not null and n > 0").groupBy("doc_id").agg(
        F.min("h1").alias("a1"), F.max("h1").alias("b1"), F.min("h2").alias("a2"), F.max("h2").alias("b2")
    ).where("a1 <> b1 or a2 <> b2").select("doc_id")
    shared = materialize(
        described.select("doc_id", "h1", "h2", "n").join(several, "doc_id", "left_semi").distinct()
        .join(classes.select("id", "h1", "h2", "n"), ["h1", "h2", "n"]).select("doc_id", "id"), "shared-ids")
    if shared.isEmpty():
        return linked
    stars = shared.groupBy("doc_id").agg(F.min("id").alias("b"))
    more = shared.join(stars, "doc_id").select(F.col("id").alias("a"), "b")
    return components(linked.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))


def jaccard_components(docs: DataFrame, size: int, num: int, den: int, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row.

    Documents are linked if the sets of their shingles of `size` lower-cased words have at least
    num / den in common; `component_id` is the least id reachable by links. A text of fewer words is
    one shingle; a null or empty text has none and is linked with nothing. Rows of equal sets are one
    class, which takes part in the join once, so copies cost no pairs. Rows that repeat an id are one
    document with several texts: each of them links it, and all share its component. A row without an id has
    no component unless an id can be reached from it. No rows, no result; other columns are ignored.
    """
    described, named = linked_classes(docs, size, num, den, id_col, text_col, by_id=True)
    return described.select("doc_id", "n", "h1", "h2").join(named, ["h1", "h2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.coalesce("first.doc_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int, num: int, den: int, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """The rows of `docs`, of each component of linked texts only the first: the one with the least id, one
    without an id last.

    Each row is decided for itself: rows that share an id or have none, but not their texts, are
    different rows. Of rows equal in id and text one stays. Rows without words are linked with nothing and all
    stay. All columns are kept.
    """
    described, named = linked_classes(docs, size, num, den, id_col, text_col, by_id=False)
    with_words = described.where("n > 0").select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "version", "h1", "h2", "n")
    first = named.select("h1", "h2", "n", F.coalesce("first.doc_id", F.lit(NO_ID)).alias("first_doc"),
                         F.col("first.version").alias("first_version"))
    gone = materialize(
        with_words.join(first, ["h1", "h2", "n"]).where("doc <> first_doc or version <> first_version")
        .select("doc", "version").distinct(), "duplicates")
    again = materialize(with_words.groupBy("doc", "version").agg(F.count("*").alias("rows"))
                        .where("rows > 1").select("doc", "version"), "repeated")
    names = {x: _free(docs, x) for x in ("doc", "version")}
    keyed = docs.withColumns({names[x]: c for x, c in row_key(id_col, text_col).items()})

    def matching(keys: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        return rows.join(keys.withColumnsRenamed(names).hint("merge"), list(names.values()), how)

    left = matching(gone, "left_anti", keyed)
    if not again.isEmpty():
        once = matching(again, "left_anti", left)
        left = once.unionByName(matching(again, "left_semi", left).dropDuplicates(list(names.values())))
    return left.select(*docs.columns)


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of `docs` has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name

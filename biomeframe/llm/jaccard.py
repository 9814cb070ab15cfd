"""N-gram Jaccard join by vertical partitioning, and the groups its links form.

All n-grams have one global order: by hash, those that a sample of documents shows
to be frequent last and by frequency. Documents with equal n-gram sets are one unit.
The order is cut into fragments. The leading fragment of a unit of size n, its first
n - ceil(t n) + 1 n-grams, yields candidates: two sets of similarity t or more share
one of them. For candidates the order by hash is cut into fragments; the
overlaps inside every fragment are counted separately and summed per pair, which
gives the exact similarity. Pairs that the first fragment rules out skip the others.

Candidates are not all pairs of a group. Per shared n-gram and band of sizes one
member, the centre, meets the others, linearly many pairs; verified links are
merged into components, and only members of different components, in places where
a link is still possible, go on. Where few members are left they meet each
other directly; otherwise new centres are taken until that holds. So a group of
near copies costs as many pairs as it has members, and no link between components
is lost.

Frequent n-grams are aggregated before they are joined, the others have few members
each, and joins on hot units are equi-joins that adaptive execution splits.
The sample only changes the order, so speed, never the result.

Defined results: documents without a word have an empty set, link with nothing and are
their own component; fewer words than n make one n-gram of the whole sequence; null
ids belong to no component and link nothing; each row is a document, and
rows of one id are in the component of all of them only if their texts link; n-grams and sets are compared by
64-bit hashes; a very long text is one row of hashes; 100 * shared = percent * joint links; only id and text are read, so other columns cannot clash; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biomeframe.llm.common import arrow_rows, give_back
from biomeframe.session import materialise

WORDS, PERCENT = 5, 80
# One row in SAMPLE is sampled; an n-gram seen SEEN times there is frequent. At most
# FREQUENT of them, the most frequent, are known to the workers (16 bytes each).
SAMPLE, SEEN, FREQUENT = 16, 4, 1 << 20
FRAGMENTS = 4
# Up to so many members of an n-gram and size band meet each other directly; else so many centres a round.
FEW, CENTRES = 128, 32
# Up to so many rows of ids or pairs (at most 32 bytes each) are broadcast; beyond that they are joined by shuffles.
SMALL = 1_000_000
# Texts that a Python worker holds at a time.
BATCH_ROWS = 512

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += np.uint64(32)
ODD = np.random.default_rng(5).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit hash spread over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(text: str) -> np.ndarray:
    """A hash per word, A-Z lower-cased."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    space = SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(data) else data
    if not len(starts):
        return np.zeros(0, np.uint64)
    spans = np.diff(np.append(starts, len(data)))
    within = np.arange(starts[0], len(data)) - np.repeat(starts, spans)
    values = np.where(space, np.uint64(0), LOWER[data] + np.uint64(1))[starts[0] :]
    sums = np.add.reduceat(values * powers(int(spans.max()))[within], starts - starts[0])
    return mixed(sums)


def ngrams(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct n-gram hashes in ascending order."""
    h = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(h):
        return h
    if len(h) < words:
        whole = (h * ODD[: len(h)]).sum(keepdims=True) + ODD[-1:] * np.uint64(len(h))
        return mixed(whole)
    n = len(h) - words + 1
    return np.unique(mixed(sum(h[k : k + n] * ODD[k] for k in range(words))))


def unit_of(grams: np.ndarray) -> int:
    """64-bit fingerprint of a set, signed."""
    import xxhash

    n = xxhash.xxh3_64_intdigest(grams.tobytes())
    return n - (1 << 64) if n >> 63 else n


def rows_of(docs: DataFrame, fn: Callable[[list, list], Iterator[tuple]], kinds: dict[str, pa.DataType], schema: str) -> DataFrame:
    """``fn`` over id and text lists; it yields tuples in the order of ``kinds``, ids keep their type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out = list(fn(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
                types = [t or batch.column(0).type for t in kinds.values()]
                columns = zip(*out, strict=True) if out else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(kinds)
                )
            # Else each worker keeps the buffers of its largest batch.
            del whole, batch, out, columns
            give_back()

    return docs.mapInArrow(run, schema)


LONGS = pa.list_(pa.int64())


def frequent(docs: DataFrame, words: int, one_in: int) -> np.ndarray:
    """Frequent n-grams, most frequent last, from a sample of rows."""

    def run(_ids: list, texts: list) -> Iterator[tuple]:
        for text in texts:
            yield (ngrams(text, words).view(np.int64),)

    drawn = F.pmod(F.xxhash64("doc_id", F.length("text"), F.substring("text", 1, 64)), F.lit(one_in)) == 0
    grams = rows_of(docs.filter(drawn), run, {"g": LONGS}, "g array<long>").select(F.explode("g").alias("g"))
    seen = grams.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SEEN)
    return seen.orderBy(F.desc("n"), "g").limit(FREQUENT).toArrow().column("g").to_numpy()[::-1]


def leading(docs: DataFrame, common: np.ndarray, words: int, percent: int) -> DataFrame:
    """Per document: doc_id, unit, size, and the leading n-grams, rare ones and frequent ones apart."""
    by_value = np.argsort(common.view(np.uint64))
    values, place = common.view(np.uint64)[by_value], by_value

    def run(ids: list, texts: list) -> Iterator[tuple]:
        for i, text in zip(ids, texts, strict=True):
            g = ngrams(text, words)
            first = len(g) - (percent * len(g) + 99) // 100 + 1 if len(g) else 0
            rare, often = g, g[:0]
            if len(values) and len(g):
                at = np.minimum(np.searchsorted(values, g), len(values) - 1)
                known = values[at] == g
                rare, often = g[~known], g[known][np.argsort(place[at[known]])]
            lead = rare[:first]
            yield i, unit_of(g), len(g), lead.view(np.int64), often[: first - len(lead)].view(np.int64)

    kinds = {"doc_id": None, "unit": pa.int64(), "n": pa.int64(), "rare": LONGS, "often": LONGS}
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows_of(docs, run, kinds, f"doc_id {kind}, unit long, n long, rare array<long>, often array<long>")


def fragments(docs: DataFrame, words: int) -> DataFrame:
    """unit, its size, fragment, the unit's n-grams in it, for every document that has any."""
    cuts = np.array([(k << 64) // FRAGMENTS for k in range(1, FRAGMENTS)], np.uint64)

    def run(_ids: list, texts: list) -> Iterator[tuple]:
        for text in texts:
            g = ngrams(text, words)
            unit = unit_of(g)
            for k, part in enumerate(np.split(g, np.searchsorted(g, cuts))):
                yield unit, k, part.view(np.int64)

    kinds = {"unit": pa.int64(), "fragment": pa.int32(), "grams": LONGS}
    return rows_of(docs, run, kinds, "unit long, fragment int, grams array<long>")


def beside(rows: DataFrame, table: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join a stored table, broadcast if it is counted to be small (the count is in its files' footers)."""
    return rows.join(F.broadcast(table) if table.count() <= SMALL else table, on, how)


def needed(n: Column, m: Column, percent: int) -> Column:
    """Least overlap with which sets of sizes n and m are similar."""
    return F.ceil(percent * (n + m) / F.lit(100.0 + percent) - 1e-9)


def can_link(n: Column, at: Column, m: Column, to: Column, percent: int) -> Column:
    """Whether a shared n-gram at places at and to (from 0) makes sets of sizes n and m candidates.

    Similar sets share an n-gram among the first n - o + 1 and m - o + 1, o being the overlap they need.
    """
    least = needed(n, m, percent)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (at <= n - least) & (to <= m - least)


def banded(rows: DataFrame, percent: int) -> DataFrame:
    """Every member in the band of its own size (``own``) and in the band below it.

    Two sizes that can be similar lie in one band or in neighbouring ones, so a
    band holds all partners, equal or larger, of the members that own it.
    """
    width = float(np.log(100 / percent * 1.000001))
    band = F.floor(F.log(F.col("n").cast("double")) / width).cast("int")
    both = rows.withColumn("_own", band).withColumn("band", F.explode(F.array(F.col("_own"), F.col("_own") - 1)))
    return both.withColumn("own", F.col("band") == F.col("_own")).drop("_own")


def as_smaller(percent: int) -> Column:
    """Whether a member owns its band and its place allows any partner that is not smaller."""
    return F.col("own") & (F.col("at") <= F.col("n") - needed(F.col("n"), F.col("n"), percent))


def open_members(tagged: DataFrame, percent: int) -> DataFrame:
    """Members that can still give a pair, with ``_n`` of them per n-gram and band.

    The smaller set of a pair has its place in the stricter prefix. A band
    without such a member, or within one component, is closed; of the others only
    members stay that the smallest of those could link with.
    """
    small = as_smaller(percent)
    state = tagged.groupBy(*KEY).agg(
        F.min("c").alias("_a"), F.max("c").alias("_b"), F.min(F.when(small, F.col("n"))).alias("_m")
    )
    state = state.filter("_a <> _b AND _m IS NOT NULL").select(*KEY, "_m")
    near = F.col("at") <= F.col("n") - needed(F.col("n"), F.col("_m"), percent)
    kept = materialise(tagged.join(state, KEY).filter(small | near).drop("_m"))
    count = kept.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return kept.join(count, KEY)


def centres(members: DataFrame, lanes: int, percent: int) -> DataFrame:
    """Up to 2 * ``lanes`` members per n-gram and band that are to meet all others there.

    By component, so that the few beside a large component have their turn soon: the
    member with the fewest rarer n-grams, which links with the most others. By unit:
    the smallest, since it alone may keep members in late places open.
    """
    by = lambda column: F.pmod(F.xxhash64(column), F.lit(lanes)).alias("_lane")
    hubs = members.groupBy(*KEY, by("c")).agg(F.min(F.struct("at", "n", "unit", "c")).alias("_h"))
    hubs = hubs.select(*KEY, "_h.unit", "_h.n", "_h.at", "_h.c")
    if lanes == 1:
        return hubs
    small = members.filter(as_smaller(percent)).groupBy(*KEY, by("unit"))
    small = small.agg(F.min(F.struct("n", "at", "unit", "c")).alias("_h"))
    return hubs.unionByName(small.select(*KEY, "_h.unit", "_h.n", "_h.at", "_h.c")).distinct()


def overlaps(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """``o`` per pair (u, v): overlaps counted in each fragment of ``parts``, summed."""
    left = beside(parts.withColumnsRenamed({"unit": "u", "grams": "a"}), pairs.select("u", "v"), "u")
    right = beside(parts.withColumnsRenamed({"unit": "v", "grams": "b"}), pairs.select("u", "v"), "v")
    met = left.join(right, ["u", "v", "fragment"])
    # Documents of one unit give the same count.
    each = met.groupBy("u", "v", "fragment").agg(F.max(F.size(F.array_intersect("a", "b"))).alias("_o"))
    return each.groupBy("u", "v").agg(F.sum("_o").cast("long").alias("o"))


def linked(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, nu, v, nv) that are similar.

    The first fragment is counted for all pairs; those that could not reach the needed
    overlap even if all the rest of the smaller set was shared are dropped; the other
    fragments are counted for what remains.
    """
    first = parts.filter("fragment = 0")
    sizes = first.select("unit", F.size("grams").alias("_s")).distinct()
    rest = lambda of, n: sizes.select(F.col("unit").alias(of), (F.col("_s")).alias(n))
    counted = beside(pairs, materialise(rest("u", "_su")), "u")
    counted = counted.join(rest("v", "_sv"), "v").join(overlaps(pairs, first), ["u", "v"], "left")
    counted = counted.withColumn("_first", F.coalesce("o", F.lit(0))).drop("o")
    most = F.col("_first") + F.least(F.col("nu") - F.col("_su"), F.col("nv") - F.col("_sv"))
    left = materialise(counted.filter(most >= needed(F.col("nu"), F.col("nv"), percent)).drop("_su", "_sv"))
    full = left.join(overlaps(left, parts.filter("fragment > 0")), ["u", "v"], "left")
    total = F.col("_first") + F.coalesce("o", F.lit(0))
    return full.filter(100 * total >= percent * (F.col("nu") + F.col("nv") - total)).select("u", "v")


def merged(links: DataFrame) -> DataFrame:
    """unit, component: the smallest unit that links (u, v) reach, for every linked unit.

    Each step gives every unit the smallest label around it, then that label's own
    label; steps are written, so that none is repeated.
    """
    both = materialise(links.select("u", "v").union(links.select("v", "u")).distinct())
    labels = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label"))
    labels = materialise(labels.select(F.col("u").alias("unit"), "label"))
    while True:
        near = both.join(labels, both["v"] == labels["unit"]).groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["unit"] == near["u"]).select(
            "unit", F.col("label").alias("was"), F.least("label", "near").alias("label")
        )
        jump = labels.select(F.col("unit").alias("label"), F.col("label").alias("next"))
        step = step.join(jump, "label").select("unit", "was", F.least("label", "next").alias("label"))
        step = materialise(step)
        labels = step.select("unit", "label")
        if step.filter("was <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")


# Names of a member's columns, and of the same columns of the member it meets.
OTHER = {"unit": "v", "n": "m", "at": "to", "c": "d"}
# Members meet inside an n-gram and a band of sizes.
KEY = ["gram", "band"]


def distinct_pairs(met: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, nu, v, nv) with u < v, of different components, that can still be similar."""
    able = can_link(F.col("n"), F.col("at"), F.col("m"), F.col("to"), percent)
    ordered = F.col("unit") < F.col("v")
    return (
        met.filter((F.col("unit") != F.col("v")) & (F.col("c") != F.col("d")) & able)
        .select(
            F.least("unit", "v").alias("u"),
            F.when(ordered, F.col("n")).otherwise(F.col("m")).alias("nu"),
            F.greatest("unit", "v").alias("v"),
            F.when(ordered, F.col("m")).otherwise(F.col("n")).alias("nv"),
        )
        .distinct()
    )


def with_units(
    parts: DataFrame | None, pairs: DataFrame, units: DataFrame, rows: DataFrame, words: int
) -> DataFrame:
    """``parts`` with the fragments of the units in ``pairs`` that it lacks, from one document of each."""
    wanted = pairs.select(F.col("u").alias("unit")).union(pairs.select(F.col("v").alias("unit"))).distinct()
    if parts is not None:
        wanted = wanted.join(parts.filter("fragment = 0").select("unit"), "unit", "left_anti")
    ids = beside(units, materialise(wanted), "unit", "left_semi").groupBy("unit").agg(F.min("doc_id").alias("doc_id"))
    texts = beside(rows, materialise(ids.select("doc_id").distinct()), "doc_id", "left_semi")
    more = materialise(fragments(texts, words))
    return more if parts is None else parts.unionByName(more)


class Components:
    """Component per unit, absent units being their own; contracted links are merged into it."""

    def __init__(self) -> None:
        self.table: DataFrame | None = None

    def on(self, rows: DataFrame, unit: str, name: str) -> DataFrame:
        """``rows`` with the component of column ``unit`` as ``name``."""
        if self.table is None:
            return rows.withColumn(name, F.col(unit))
        known = self.table.select(F.col("unit").alias(unit), F.col("component").alias("_known"))
        return rows.join(known, unit, "left").withColumn(name, F.coalesce("_known", unit)).drop("_known")

    def add(self, links: DataFrame) -> None:
        links = materialise(self.on(self.on(links, "u", "cu"), "v", "cv").select("cu", "cv").filter("cu <> cv"))
        if links.isEmpty():
            return
        new = merged(links.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
        if self.table is None:
            self.table = new
            return
        moved = new.select(F.col("unit").alias("component"), F.col("component").alias("_to"))
        old = self.table.join(moved, "component", "left").select("unit", F.coalesce("_to", "component").alias("component"))
        fresh = new.join(self.table, "unit", "left_anti")
        self.table = materialise(old.unionByName(fresh))


def components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable by links) of every document.

    Two documents link when ``100 * shared >= percent * joint`` distinct n-grams.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return _components(rows, words, percent)


def _components(rows: DataFrame, words: int, percent: int) -> DataFrame:
    lead = materialise(leading(rows, frequent(rows, words, SAMPLE), words, percent))
    units = lead.filter("n > 0 AND doc_id IS NOT NULL")
    rare = units.select("unit", "n", F.posexplode("rare").alias("at", "gram"))
    often = units.select("unit", "n", F.size("rare").alias("_from"), F.posexplode("often").alias("at", "gram"))
    often = often.select("unit", "n", (F.col("_from") + F.col("at")).alias("at"), "gram")
    alike = Window.partitionBy("gram")
    rare = (
        rare.withColumns({"_low": F.min("unit").over(alike), "_high": F.max("unit").over(alike)})
        .filter("_low <> _high")
        .drop("_low", "_high")
    )
    places = rare.unionByName(often).groupBy("gram", "unit", "n").agg(F.min("at").cast("long").alias("at"))
    shared = materialise(banded(places, percent))
    found = Components()
    parts: DataFrame | None = None
    rounds = 0
    while True:
        open_rows = materialise(open_members(found.on(shared, "unit", "c"), percent))
        if open_rows.isEmpty():
            break
        # One centre everywhere at first; then several, and all where few members are left.
        many = open_rows.filter(F.col("_n") > (FEW if rounds else 0))
        heads = materialise(centres(many, CENTRES if rounds else 1, percent))
        meets = lambda some: some.select(*KEY, *[F.col(a).alias(b) for a, b in OTHER.items()])
        met = many.join(meets(heads), KEY)
        if rounds:
            few = open_rows.filter(F.col("_n") <= FEW)
            met = met.unionByName(few.join(meets(few.filter(as_smaller(percent))), KEY))
        pairs = materialise(distinct_pairs(met, percent))
        parts = with_units(parts, pairs, units, rows, words)
        found.add(materialise(linked(pairs, parts, percent)))
        shared = many.join(heads.select(*KEY, "unit"), [*KEY, "unit"], "left_anti")
        shared = shared.select(*KEY, "unit", "n", "at", "own")
        rounds += 1
    placed = found.on(lead.select("doc_id", "unit", F.col("n").alias("n_shingles")), "unit", "_c")
    placed = materialise(placed)
    members = placed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    smallest = members.groupBy("_c").agg(F.min("doc_id").alias("_least"))
    own = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return placed.join(smallest, "_c", "left").select(
        "doc_id", "n_shingles", F.when(own, F.col("_least")).otherwise(F.col("doc_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of every component: the smallest id, null last, and of its texts the smallest hash.

    Rows count here, not ids: the texts of a repeated id are judged one by one, rows without an id
    link like others, and of rows with the same id and text one stays. Rows without a word all stay.
    """
    text = F.col(text_col).cast("string")
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"))
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), key.alias("_key"), text.alias("_text"))
    groups = components(rows, "_key", "_text", **how).filter("n_shingles > 0")
    groups = materialise(groups.select(F.col("doc_id").alias("_key"), F.col("component_id").alias("_least")))
    gone = materialise(groups.filter("_key <> _least").select("_key").distinct())
    first = groups.filter("_key = _least").groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    again = materialise(first.filter("_n > 1").select("_key"))
    kept = rows.join(gone, "_key", "left_anti")
    if not again.isEmpty():
        # The other columns may differ: their hash tells which row stays, whatever the order of rows.
        by = F.xxhash64(*[F.col(f"_doc.`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
        one = kept.join(again, "_key", "left_semi").groupBy("_key").agg(F.min_by("_doc", by).alias("_doc"))
        kept = kept.join(again, "_key", "left_anti").select("_doc").unionByName(one.select("_doc"))
    return kept.select(*[F.col(f"_doc.`{c}`") for c in names])

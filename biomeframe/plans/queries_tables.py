"""Queries: names, column roles, normalisation, aggregates, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from biomeframe.functions import names as nm
from biomeframe.functions import scores as sc
from biomeframe.operators import aggregate as ag
from biomeframe.operators import frames as fr
from biomeframe.operators import normalize as no
from biomeframe.operators import ranking as rk
from biomeframe.operators.split import stratified_split
from biomeframe.operators.vectors import index_labels
from biomeframe.plans.registry import query, r6, sql
from biomeframe.session import materialise, shared_dir
from biomeframe.sources import readers as rd
from biomeframe.sources import tables as tb
from biomeframe.sources import writers as wr

KEPT = ["Brand#1", "Brand#3", "brand#12", "Brand#20"]


def shares(spark, sf):
    return no.relative_abundance(tb.counts_long(spark, sf))


def stored_shares(spark, sf):
    """Shares written once, for operators that read them several times."""
    return materialise(shares(spark, sf))


def depths(spark, sf):
    return ag.read_counts(tb.counts_long(spark, sf))


NORM = "regexp_replace(replace(lower({}), ' ', '_'), '^.__?', '', 's')"


@query(
    "taxon_name_norm",
    f"""SELECT p_partkey, {NORM.format("'g__' || p_name")} AS double_prefix,
               {NORM.format("'X_' || p_name")} AS single_prefix, {NORM.format('p_type')} AS plain FROM part""",
)
def taxon_name_norm(spark, sf):
    name, kind = F.col("p_name"), F.col("p_type")
    return tb.table(spark, sf, "part").select(
        "p_partkey",
        nm.norm_taxon(F.concat(F.lit("g__"), name)).alias("double_prefix"),
        nm.norm_taxon(F.concat(F.lit("X_"), name)).alias("single_prefix"),
        nm.norm_taxon(kind).alias("plain"),
    )


@query(
    "feature_dictionary",
    sql(
        f"""SELECT taxon, norm, (ROW_NUMBER() OVER (ORDER BY norm, taxon) - 1)::INTEGER AS idx
            FROM (SELECT taxon, {NORM.format('taxon')} AS norm FROM taxa)""",
        "taxa",
    ),
)
def feature_dictionary(spark, sf):
    return fr.feature_dictionary(tb.counts_long(spark, sf))


@query("drop_taxa", sql("SELECT * FROM counts WHERE taxon NOT IN ('Brand#1', 'Brand#2')", "counts"))
def drop_taxa(spark, sf):
    return fr.drop_taxa(tb.counts_long(spark, sf), ["Brand#1", "Brand#2"])


@query(
    "keep_taxa",
    sql("SELECT * FROM counts WHERE lower(taxon) IN ('brand#1', 'brand#3', 'brand#12', 'brand#20')", "counts"),
)
def keep_taxa(spark, sf):
    return fr.keep_taxa(tb.counts_long(spark, sf), KEPT)


@query(
    "drop_taxa_regex",
    sql("SELECT * FROM counts WHERE NOT regexp_matches(taxon, '#1') AND NOT regexp_matches(taxon, '5$')", "counts"),
)
def drop_taxa_regex(spark, sf):
    return fr.drop_taxa_regex(tb.counts_long(spark, sf), ["#1", "5$"])


@query(
    "project_taxa",
    sql(
        """SELECT sampleID, lower(taxon) AS taxon, count, CASE taxon WHEN 'Brand#7' THEN 0
                  WHEN 'Brand#2' THEN 1 ELSE 2 END AS idx
           FROM counts WHERE taxon IN ('Brand#7', 'Brand#2', 'Brand#11')""",
        "counts",
    ),
)
def project_taxa(spark, sf):
    return fr.project_taxa(tb.counts_long(spark, sf), ["brand#7", "brand#2", "brand#11"])


@query(
    "canonicalise",
    """SELECT c_custkey AS sampleID, c_acctbal AS read_count, c_acctbal, c_mktsegment AS HC_subCST FROM customer""",
)
def canonicalise(spark, sf):
    return fr.canonicalise(
        tb.table(spark, sf, "customer"),
        sample="c_custkey", depth=None, label="c_mktsegment", drop=["c_name", "c_nationkey", "HC_CST"],
    )


@query(
    "validate_unlabelled",
    "SELECT c_custkey AS sampleID FROM customer",
)
def validate_unlabelled(spark, sf):
    return fr.validate(tb.sample_labels(spark, sf), expect_labelled=False)


@query(
    "validate_labelled",
    "SELECT c_custkey AS sampleID, c_mktsegment AS HC_subCST FROM customer",
)
def validate_labelled(spark, sf):
    return fr.validate(tb.sample_labels(spark, sf), expect_labelled=True)


@query(
    "add_sample_ids",
    """SELECT event_id, event_type, ROW_NUMBER() OVER (ORDER BY ts, event_id) - 1 AS sampleID FROM events""",
)
def add_sample_ids(spark, sf):
    events = tb.table(spark, sf, "events").select("event_id", "event_type", "ts")
    return fr.add_sample_ids(events, ["ts", "event_id"]).drop("ts")


@query("read_counts", sql("SELECT sampleID, read_count FROM depths", "depths"))
def read_counts(spark, sf):
    return depths(spark, sf)


VARIANTS = """SELECT p_size AS sampleID, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) END AS taxon,
                     p_partkey AS pos, p_retailprice AS count FROM part"""


@query(
    "dedupe_taxa",
    f"""WITH v AS ({VARIANTS}), first_pos AS (
          SELECT taxon, {NORM.format('taxon')} AS norm, MIN(pos) AS pos FROM v GROUP BY 1),
        kept AS (SELECT taxon FROM first_pos
                 QUALIFY ROW_NUMBER() OVER (PARTITION BY norm ORDER BY pos, taxon) = 1)
        SELECT v.* FROM v JOIN kept ON kept.taxon = v.taxon""",
)
def dedupe_taxa(spark, sf):
    name = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.upper("p_name"))
    long = tb.table(spark, sf, "part").select(
        F.col("p_size").alias("sampleID"),
        name.alias("taxon"),
        F.col("p_partkey").alias("pos"),
        F.col("p_retailprice").alias("count"),
    )
    return fr.dedupe_taxa(long)


@query(
    "trim_taxa",
    """SELECT p_partkey, regexp_replace(p_name || '  ', ' $', '') AS trailing, ltrim('  ' || p_name) AS leading
       FROM part""",
)
def trim_taxa(spark, sf):
    return tb.table(spark, sf, "part").select(
        "p_partkey",
        nm.drop_trailing_blank(F.concat("p_name", F.lit("  "))).alias("trailing"),
        nm.drop_leading_blanks(F.concat(F.lit("  "), "p_name")).alias("leading"),
    )


@query(
    "load_classifications",
    "SELECT doc_id AS sampleID, quality AS subCST FROM labels ORDER BY 1",
)
def load_classifications(spark, sf):
    return fr.load_classifications(tb.table(spark, sf, "labels"), "quality", "doc_id")


@query(
    "index_labels",
    sql(
        """SELECT s.sampleID, (DENSE_RANK() OVER (ORDER BY s.HC_subCST) - 1)::DOUBLE AS label_idx,
                  (SELECT string_agg(CASE WHEN z.HC_subCST = s.HC_subCST THEN '1' ELSE '0' END, '' ORDER BY z.HC_subCST)
                   FROM sizes z) AS one_hot
           FROM samples s""",
        "samples", "sizes",
    ),
)
def index_labels_query(spark, sf):
    from pyspark.ml.functions import vector_to_array

    indexed = index_labels(tb.sample_labels(spark, sf), one_hot=True)
    bits = F.transform(vector_to_array("one_hot"), lambda v: v.cast("int").cast("string"))
    return indexed.select("sampleID", "label_idx", F.array_join(bits, "").alias("one_hot"))


@query(
    "tag_labels",
    sql(
        """SELECT sampleID, HC_subCST || ' train' AS tagged, HC_subCST AS untagged FROM samples""",
        "samples",
    ),
)
def tag_labels(spark, sf):
    tagged = tb.sample_labels(spark, sf).select("sampleID", nm.tag("HC_subCST", "train").alias("tagged"))
    return tagged.withColumn("untagged", nm.untag("tagged"))


@query("of_class", sql("SELECT * FROM samples WHERE HC_subCST = 'BUILDING'", "samples"))
def of_class(spark, sf):
    return fr.of_class(tb.sample_labels(spark, sf), "BUILDING")


@query(
    "nonempty_taxa",
    """WITH v AS (SELECT user_id AS sampleID, event_type AS taxon,
                         SUM(CASE WHEN event_type = 'error' THEN 0 ELSE value END) AS count FROM events GROUP BY 1, 2)
       SELECT sampleID, taxon, ROUND(count, 6) AS count FROM v
       WHERE taxon IN (SELECT taxon FROM v GROUP BY 1 HAVING SUM(count) > 0)""",
)
def nonempty_taxa(spark, sf):
    value = F.when(F.col("event_type") == "error", F.lit(0.0)).otherwise(F.col("value"))
    long = tb.table(spark, sf, "events").groupBy(
        F.col("user_id").alias("sampleID"), F.col("event_type").alias("taxon")
    ).agg(F.sum(value).alias("count"))
    return ag.nonempty_taxa(long).withColumn("count", r6("count"))


# Normalisation


@query("relative_abundance", sql("SELECT sampleID, taxon, ROUND(value, 6) AS value FROM shares", "shares"))
def relative_abundance(spark, sf):
    return shares(spark, sf).withColumn("value", r6("value"))


@query(
    "pseudocount_abundance",
    sql(
        """SELECT s.sampleID, t.taxon, ROUND(COALESCE(v.value, 1e-5), 6) AS value
           FROM (SELECT DISTINCT sampleID FROM counts) s CROSS JOIN taxa t
           LEFT JOIN shares v ON v.sampleID = s.sampleID AND v.taxon = t.taxon""",
        "taxa", "shares",
    ),
)
def pseudocount_abundance(spark, sf):
    return no.pseudocount_abundance(tb.counts_long(spark, sf)).withColumn("value", r6("value"))


@query(
    "log_ratio",
    sql(
        """SELECT sampleID, taxon, ROUND(CASE WHEN value = 1 THEN 'inf'::DOUBLE ELSE value / log10(value) END, 6) + 0
                  AS value FROM shares""",
        "shares",
    ),
)
def log_ratio(spark, sf):
    return no.scale(shares(spark, sf), "log_ratio").withColumn("value", r6("value"))


def _scaled(method, expr):
    body = f"""SELECT v.sampleID, v.taxon, ROUND({expr}, 6) + 0 AS value FROM full_shares v
               JOIN (SELECT taxon, AVG(value) AS m, STDDEV_POP(value) AS sp, MIN(value) AS lo, MAX(value) AS hi
                     FROM full_shares GROUP BY 1) t ON t.taxon = v.taxon"""

    def run(spark, sf):
        scaled = no.scale(stored_shares(spark, sf), method, samples=tb.sample_labels(spark, sf))
        return scaled.withColumn("value", r6("value"))

    return sql(body, "full_shares"), run


for _name, _method, _expr in (
    ("zscore_pop", "zscore", "(v.value - t.m) / t.sp"),
    ("minmax", "minmax", "(v.value - t.lo) / (t.hi - t.lo)"),
    ("stddev_scale", "stddev", "v.value / t.sp"),
):
    _sql, _run = _scaled(_method, _expr)
    query(_name, _sql)(_run)


def training_ids(spark, sf):
    """Training part of the samples; the tables keep the counts of all of them."""
    both = stratified_split(tb.sample_labels(spark, sf), 80, seed=7)
    return both.filter(F.col("split") == "train").drop("split")


def _scaled_subset(method, expr):
    body = f"""SELECT v.sampleID, v.taxon, ROUND({expr}, 6) + 0 AS value FROM train_shares v
               JOIN train_moments t ON t.taxon = v.taxon"""

    def run(spark, sf):
        scaled = no.scale(stored_shares(spark, sf), method, samples=training_ids(spark, sf))
        return scaled.withColumn("value", r6("value"))

    return sql(body, "train_moments"), run


for _name, _method, _expr in (
    ("zscore_subset", "zscore", "(v.value - t.m) / t.sp"),
    ("minmax_subset", "minmax", "(v.value - t.lo) / (t.hi - t.lo)"),
    ("stddev_subset", "stddev", "v.value / t.sp"),
):
    _sql, _run = _scaled_subset(_method, _expr)
    query(_name, _sql)(_run)


@query(
    "zscore_sample_topn",
    sql(
        """, st AS (SELECT taxon, AVG(value) AS m, STDDEV_SAMP(value) AS s FROM full_shares GROUP BY 1),
           top AS (SELECT * FROM st ORDER BY ROUND(m, 12) DESC, lower(taxon), taxon LIMIT 10)
           SELECT v.sampleID, v.taxon, ROUND((v.value - top.m) / top.s, 6) + 0 AS z, 0::BIGINT AS dropped
           FROM full_shares v JOIN top ON top.taxon = v.taxon""",
        "full_shares",
    ),
)
def zscore_sample_topn(spark, sf):
    z = no.zscore_taxa(stored_shares(spark, sf), top_n=10, samples=tb.sample_labels(spark, sf))
    return z.withColumn("z", r6("z"))


EFFORT = """(read_count - AVG(read_count) OVER ()) / STDDEV_SAMP(read_count) OVER ()"""


@query(
    "effort_z",
    sql(f"SELECT sampleID, read_count, ROUND({EFFORT}, 6) + 0 AS effort_z FROM depths", "depths"),
)
def effort_z(spark, sf):
    return no.effort_z(depths(spark, sf)).withColumn("effort_z", r6("effort_z"))


@query(
    "clamp_z",
    sql(
        f"SELECT sampleID, ROUND(GREATEST(-1.5, LEAST(1.5, {EFFORT})), 6) + 0 AS z FROM depths",
        "depths",
    ),
)
def clamp_z(spark, sf):
    z = no.effort_z(depths(spark, sf), name="z")
    return no.clamp_values(z, -1.5, 1.5, "z").select("sampleID", r6("z").alias("z"))


TMM = """
, lib AS (SELECT *, SUM(value) OVER (PARTITION BY sampleID) AS nk FROM shares WHERE value > 0),
grid AS (SELECT s.sampleID, s.nk, t.taxon FROM (SELECT sampleID, ANY_VALUE(nk) AS nk FROM lib GROUP BY 1) s
         CROSS JOIN (SELECT DISTINCT taxon FROM lib) t),
quart AS (SELECT g.sampleID, quantile_cont(COALESCE(l.value, 0), 0.75) / ANY_VALUE(g.nk) AS f75
          FROM grid g LEFT JOIN lib l ON l.sampleID = g.sampleID AND l.taxon = g.taxon GROUP BY 1),
ref_id AS (SELECT sampleID FROM (SELECT sampleID, ROUND(ABS(f75 - (SELECT AVG(f75) FROM quart)), 12) AS gap FROM quart)
           ORDER BY gap, sampleID LIMIT 1),
ref AS (SELECT taxon, value AS yr, nk AS nr FROM lib WHERE sampleID = (SELECT sampleID FROM ref_id)),
ma AS (SELECT l.sampleID, ROUND(log2((value / nk) / (yr / nr)), 12) AS m,
              ROUND(0.5::DOUBLE * log2(value * yr / (nk * nr)), 12) AS a,
              (nk - value) / (nk * value) + (nr - yr) / (nr * yr) AS v
       FROM lib l JOIN ref r ON r.taxon = l.taxon),
ranked AS (SELECT *, COUNT(*) OVER (PARTITION BY sampleID) AS k,
             RANK() OVER (PARTITION BY sampleID ORDER BY m) + (COUNT(*) OVER (PARTITION BY sampleID, m) - 1) / 2.0 AS rm,
             RANK() OVER (PARTITION BY sampleID ORDER BY a) + (COUNT(*) OVER (PARTITION BY sampleID, a) - 1) / 2.0 AS ra
           FROM ma),
lf AS (SELECT sampleID, SUM(m / v) / SUM(1 / v) AS lf FROM ranked
       WHERE rm BETWEEN FLOOR(k * 0.3::DOUBLE) + 1 AND k - FLOOR(k * 0.3::DOUBLE)
         AND ra BETWEEN FLOOR(k * 0.05::DOUBLE) + 1 AND k - FLOOR(k * 0.05::DOUBLE) AND v > 0 GROUP BY 1),
every AS (SELECT q.sampleID, COALESCE(lf.lf, 0) AS lf FROM quart q LEFT JOIN lf ON lf.sampleID = q.sampleID),
factors AS (SELECT sampleID, pow(2.0::DOUBLE, lf - (SELECT AVG(lf) FROM every)) AS factor FROM every)
"""


@query("tmm_factors", sql(TMM + "SELECT sampleID, ROUND(factor, 6) AS factor FROM factors", "shares"))
def tmm_factors(spark, sf):
    return no.tmm_factors(stored_shares(spark, sf)).withColumn("factor", r6("factor"))


@query(
    "tmm",
    sql(
        TMM + """SELECT l.sampleID, l.taxon, ROUND(l.value / (l.nk * f.factor), 6) AS value
                 FROM lib l JOIN factors f ON f.sampleID = l.sampleID""",
        "shares",
    ),
)
def tmm(spark, sf):
    return no.scale(stored_shares(spark, sf), "tmm").withColumn("value", r6("value"))


@query(
    "softmax",
    sql(
        """, e AS (SELECT sampleID, unnest(f) AS x FROM vectors)
           SELECT sampleID, ROUND(MAX(exp(x)) / SUM(exp(x)), 6) AS top FROM e GROUP BY 1""",
        "vectors",
    ),
)
def softmax(spark, sf):
    probs = tb.dense(spark, sf).select("sampleID", sc.softmax("features").alias("p"))
    return probs.select("sampleID", r6(F.array_max("p")).alias("top"))


# Aggregates


@query(
    "class_prevalence",
    sql("SELECT HC_subCST, n, ROUND(n / SUM(n) OVER ()::DOUBLE, 6) AS prevalence FROM sizes", "sizes"),
)
def class_prevalence(spark, sf):
    return ag.class_prevalence(tb.sample_labels(spark, sf)).withColumn("prevalence", r6("prevalence"))


@query(
    "class_weights",
    sql(
        """SELECT l.HC_subCST, COALESCE(n, 0) AS n,
                  ROUND(CASE WHEN n > 0 THEN MAX(n) OVER () / n::DOUBLE ELSE 0 END, 6) AS weight
           FROM (SELECT HC_subCST FROM sizes UNION ALL SELECT 'ABSENT') l LEFT JOIN sizes z ON z.HC_subCST = l.HC_subCST""",
        "sizes",
    ),
)
def class_weights(spark, sf):
    samples = tb.sample_labels(spark, sf)
    universe = [r[0] for r in ag.labels(samples).collect()] + ["ABSENT"]
    return ag.class_weights(samples, universe).withColumn("weight", r6("weight"))


@query("centroid_mean", sql("SELECT HC_subCST, taxon, ROUND(value, 6) AS value FROM centroid", "centroid"))
def centroid_mean(spark, sf):
    out = ag.centroids(shares(spark, sf), tb.sample_labels(spark, sf))
    return out.withColumn("value", r6("value"))


@query(
    "centroid_median",
    sql("SELECT HC_subCST, taxon, ROUND(value, 6) AS value FROM median_centroid", "median_centroid"),
)
def centroid_median(spark, sf):
    out = ag.centroids(stored_shares(spark, sf), tb.sample_labels(spark, sf), "median")
    return out.withColumn("value", r6("value"))


@query("class_labels", sql("SELECT HC_subCST FROM sizes ORDER BY 1", "sizes"))
def class_labels(spark, sf):
    return ag.labels(tb.sample_labels(spark, sf))


SUMMARY = """SELECT taxon, AVG(value) AS mean, AVG((value > 0)::INTEGER) AS prevalence, MAX(value) AS max
             FROM full_shares GROUP BY 1"""


@query(
    "taxon_summary",
    sql(
        f"SELECT taxon, ROUND(mean, 6) AS mean, ROUND(prevalence, 6) AS prevalence, ROUND(max, 6) AS max FROM ({SUMMARY})",
        "full_shares",
    ),
)
def taxon_summary(spark, sf):
    out = ag.taxon_summary(shares(spark, sf), tb.sample_labels(spark, sf))
    return out.select("taxon", *[r6(c).alias(c) for c in ("mean", "prevalence", "max")])


SUBSET = "SELECT taxon, m AS mean, prevalence, hi AS max FROM train_moments"


@query(
    "taxon_summary_subset",
    sql(
        f"SELECT taxon, ROUND(mean, 6) AS mean, ROUND(prevalence, 6) AS prevalence, ROUND(max, 6) AS max FROM ({SUBSET})",
        "train_moments",
    ),
)
def taxon_summary_subset(spark, sf):
    out = ag.taxon_summary(shares(spark, sf), training_ids(spark, sf))
    return out.select("taxon", *[r6(c).alias(c) for c in ("mean", "prevalence", "max")])


@query(
    "top_taxa_subset",
    sql(
        f"""SELECT taxon, ROUND(mean, 6) AS mean, ROUND(prevalence, 6) AS prevalence, ROUND(max, 6) AS max
            FROM ({SUBSET}) ORDER BY ROUND(mean, 12) DESC, lower(taxon), taxon LIMIT 10""",
        "train_moments",
    ),
)
def top_taxa_subset(spark, sf):
    out = rk.top_taxa(shares(spark, sf), 10, "mean", training_ids(spark, sf))
    return out.select("taxon", *[r6(c).alias(c) for c in ("mean", "prevalence", "max")])


def _top(rank_by):
    body = f"""SELECT taxon, ROUND(mean, 6) AS mean, ROUND(prevalence, 6) AS prevalence, ROUND(max, 6) AS max
               FROM ({SUMMARY}) ORDER BY ROUND({rank_by}, 12) DESC, lower(taxon), taxon LIMIT 10"""

    def run(spark, sf):
        out = rk.top_taxa(shares(spark, sf), 10, rank_by, tb.sample_labels(spark, sf))
        return out.select("taxon", *[r6(c).alias(c) for c in ("mean", "prevalence", "max")])

    return sql(body, "full_shares"), run


for _by in ("mean", "prevalence", "max"):
    _sql, _run = _top(_by)
    query(f"top_taxa_{_by}", _sql)(_run)


@query(
    "keep_top_taxa",
    sql(
        f"""SELECT sampleID, taxon, ROUND(value, 6) AS value FROM shares WHERE taxon IN (
              SELECT taxon FROM ({SUMMARY}) ORDER BY ROUND(mean, 12) DESC, lower(taxon), taxon LIMIT 5)""",
        "full_shares",
    ),
)
def keep_top_taxa(spark, sf):
    out = rk.keep_top(stored_shares(spark, sf), 5, "mean", tb.sample_labels(spark, sf))
    return out.withColumn("value", r6("value"))


@query(
    "profile",
    sql(
        """SELECT (SELECT COUNT(*) FROM samples) AS n_samples, (SELECT COUNT(*) FROM taxa) AS n_features,
                  (SELECT COUNT(*) FROM sizes) AS n_classes""",
        "samples", "taxa", "sizes",
    ),
)
def profile(spark, sf):
    return ag.profile(tb.counts_long(spark, sf), tb.sample_labels(spark, sf))


@query(
    "preview",
    sql("SELECT sampleID, read_count FROM depths ORDER BY read_count DESC, sampleID LIMIT 10", "depths"),
)
def preview(spark, sf):
    ordered = depths(spark, sf).withColumn("o", -F.col("read_count"))
    return rk.preview(ordered, 10, ["o", "sampleID"]).drop("o")


@query(
    "sorted_by_id",
    sql("SELECT sampleID, read_count FROM depths ORDER BY sampleID", "depths"),
)
def sorted_by_id(spark, sf):
    return rk.sorted_by_id(depths(spark, sf))


# Layouts


@query(
    "wide_export",
    sql(
        """SELECT sampleID, """
        + ", ".join(
            f"COALESCE(MAX(count) FILTER (WHERE taxon = '{t}'), 0) AS \"{t}\""
            for t in ("click", "error", "purchase", "signup", "view")
        )
        + " FROM users GROUP BY 1",
        "users",
    ),
)
def wide_export(spark, sf):
    return wr.to_wide(tb.event_counts(spark, sf), event_types(spark, sf))


def event_types(spark, sf):
    """The sorted event types: one short name per type."""
    return [r["taxon"] for r in fr.feature_dictionary(tb.event_counts(spark, sf)).orderBy("idx").collect()]


@query(
    "unpivot_import",
    sql(
        """SELECT u.sampleID, t.taxon, t.pos, COALESCE(x.count, 0) AS count
           FROM (SELECT DISTINCT sampleID FROM users) u
           CROSS JOIN (SELECT taxon, (ROW_NUMBER() OVER (ORDER BY taxon) - 1)::INTEGER AS pos
                       FROM (SELECT DISTINCT taxon FROM users)) t
           LEFT JOIN users x ON x.sampleID = u.sampleID AND x.taxon = t.taxon""",
        "users",
    ),
)
def unpivot_import(spark, sf):
    return rd.wide_to_long(wr.to_wide(tb.event_counts(spark, sf), event_types(spark, sf)))


def _scratch(spark, name):
    import uuid

    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(
    "csv_import",
    sql(
        """SELECT u.sampleID::VARCHAR AS sampleID, t.taxon, COALESCE(x.count, 0) AS count
           FROM (SELECT DISTINCT sampleID FROM users) u CROSS JOIN (SELECT DISTINCT taxon FROM users) t
           LEFT JOIN users x ON x.sampleID = u.sampleID AND x.taxon = t.taxon""",
        "users",
    ),
)
def csv_import(spark, sf):
    """Wide export to CSV, read back without schema inference, to long form."""
    path = _scratch(spark, "wide")
    wr.write_csv(wr.to_wide(tb.event_counts(spark, sf), event_types(spark, sf)), path)
    long = rd.wide_to_long(rd.read_wide(spark, path))
    return long.drop("pos")


# Counts of every brand for every nation; a nation without suppliers has none.
NATION_PAIRS = """SELECT n_name AS sampleID, p_brand AS taxon, SUM(l_quantity) AS count FROM lineitem
            JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
            JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""
NATION = f"""SELECT n_name AS sampleID, b.taxon, COALESCE(x.count, 0) AS count FROM nation
             CROSS JOIN (SELECT DISTINCT taxon FROM ({NATION_PAIRS})) b
             LEFT JOIN ({NATION_PAIRS}) x ON x.sampleID = n_name AND x.taxon = b.taxon"""


def nation_counts(spark, sf):
    line = tb.table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    supplier = tb.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nation = tb.table(spark, sf, "nation").select("n_nationkey", "n_name")
    part = tb.table(spark, sf, "part").select("p_partkey", "p_brand")
    return (
        line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("p_brand", "n_name")
        .agg(F.sum("l_quantity").alias("count"))
    )


def _nation_columns(spark, sf):
    names = [r[0] for r in tb.table(spark, sf, "nation").select("n_name").orderBy("n_nationkey").collect()]
    return nation_counts(spark, sf).groupBy("p_brand").pivot("n_name", names).agg(F.sum("count"))


def _filled(long):
    """Blank cells read as null are no counts."""
    return long.withColumn("count", F.coalesce("count", F.lit(0.0)))


@query("transposed_import", f"SELECT * FROM ({NATION})")
def transposed_import(spark, sf):
    """Samples as columns of a CSV file, straight to long form."""
    path = _scratch(spark, "transposed")
    wr.write_csv(_nation_columns(spark, sf), path)
    return _filled(rd.read_transposed(spark, path))


@query("taxon_lines_import", f"SELECT * FROM ({NATION})")
def taxon_lines_import(spark, sf):
    """One taxon per line with an unused second field."""
    path = _scratch(spark, "lines")
    wide = _nation_columns(spark, sf)
    lines = wide.select(F.col("p_brand").alias("Taxon_Name"), F.lit("x").alias("skip"), *wide.columns[1:])
    lines.write.csv(path, header=True, sep="\t", emptyValue="")
    return _filled(rd.read_taxon_lines(spark, path))


def _nation_lines(spark, sf, sep, name, *more):
    """Counts per nation as written lines of text, one per brand, with the fixed columns ``more`` at the end."""
    wide = _nation_columns(spark, sf)
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in wide.columns[1:]]
    path = _scratch(spark, name)
    wide.select(F.concat_ws(sep, "p_brand", *cells, *[F.lit(x) for x in more])).write.text(path)
    return wide.columns[1:], path


def _header_line(spark, path, *lines):
    """The lines of ``path`` below title and header lines, as the one file that the layout asks for."""
    body = spark.read.text(path)
    out = f"{path}-whole"
    head = spark.createDataFrame([("\n".join(lines),)], "value string")
    head.union(body).coalesce(1).write.text(out)
    return out


@query("otu_import", f"SELECT * FROM ({NATION})")
def otu_import(spark, sf):
    """A title line, a ``species`` line with the ids, one line per taxon."""
    ids, path = _nation_lines(spark, sf, ",", "otu")
    title = "Quantities per nation" + "," * len(ids)
    return _filled(rd.read_otu_supplement(spark, _header_line(spark, path, title, ",".join(["species", *ids]))))


@query("ragged_import", f"SELECT sampleID, SUM(count) AS read_count FROM ({NATION}) GROUP BY 1")
def ragged_import(spark, sf):
    """A header one field short, with a column that is no sample."""
    ids, path = _nation_lines(spark, sf, "\t", "ragged", "0")
    return rd.read_ragged_tsv(spark, _header_line(spark, path, "\t".join([*ids, "taxID"])))[1]


@query("meta_rows_import", "SELECT n_name AS sampleID, n_regionkey::VARCHAR AS region FROM nation")
def meta_rows_import(spark, sf):
    """Annotations of the samples, laid out as a line of the counts' file."""
    nation = tb.table(spark, sf, "nation").select("n_name", F.col("n_regionkey").cast("string").alias("region"))
    wide = _nation_columns(spark, sf)
    names = wide.columns[1:]
    label = nation.groupBy(F.lit("region").alias("p_brand")).pivot("n_name", names).agg(F.first("region"))
    path = _scratch(spark, "annotated")
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in names]
    wr.write_csv(label.unionByName(wide.select("p_brand", *texts)), path)
    return rd.read_meta_rows(spark, path, ["region"])


@query(
    "centroids_wide",
    sql(
        """, v AS (SELECT HC_subCST AS sub_CST, taxon, ROUND(value, 6) AS x FROM centroid)
           SELECT * FROM (PIVOT v ON taxon USING FIRST(x) GROUP BY sub_CST)""",
        "centroid",
    ),
)
def centroids_wide(spark, sf):
    """One row per class, one column per taxon, as the centroid file has them."""
    x = stored_shares(spark, sf)
    taxa = [r[0] for r in x.select("taxon").distinct().orderBy("taxon").collect()]
    wide = wr.centroids_wide(ag.centroids(x, tb.sample_labels(spark, sf)), taxa)
    return wide.select("sub_CST", *[r6(F.col(f"`{t}`")).alias(t) for t in taxa])


@query(
    "labelled_tsv_import",
    """SELECT c_custkey::VARCHAR AS sampleID, c_mktsegment AS HC_subCST, c_acctbal AS balance FROM customer""",
)
def labelled_tsv_import(spark, sf):
    """Samples in rows with a diagnosis column and two columns to drop."""
    path = _scratch(spark, "labelled")
    tb.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_nationkey").alias("family_id"),
        F.lit("customer").alias("role"),
        F.col("c_mktsegment").alias("diagnosis_binary"),
        F.col("c_acctbal").alias("balance"),
    ).write.csv(path, header=True, sep="\t")
    return rd.read_tsv_labelled(spark, path)


@query(
    "write_splits",
    sql("SELECT split, HC_subCST, COUNT(*) AS n FROM three_way GROUP BY 1, 2", "three_way"),
)
def write_splits(spark, sf):
    from biomeframe.operators.split import stratified_split

    path = _scratch(spark, "splits")
    wr.write_splits(stratified_split(tb.sample_labels(spark, sf), 60, 20, seed=7), path)
    return spark.read.parquet(path).groupBy("split", "HC_subCST").agg(F.count(F.lit(1)).alias("n"))

"""Queries: splits, cohorts, classification scores, entropy and correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from biomeframe.functions import scores as sc
from biomeframe.operators import aggregate as ag
from biomeframe.operators import metrics as me
from biomeframe.operators import ranking as rk
from biomeframe.operators import sets as st
from biomeframe.operators import split as sp
from biomeframe.operators import stats as ss
from biomeframe.operators.keyed import hash_order, with_position
from biomeframe.operators.normalize import effort_z, relative_abundance
from biomeframe.operators.similarity import classify_centroid, class_list, score_columns
from biomeframe.plans.queries_tables import depths, event_types, shares, stored_shares
from biomeframe.plans.registry import query, r6, sql
from biomeframe.sources import tables as tb
from biomeframe.sources import writers as wr

SEED = 7


def scored(spark, sf, method="mean", x=None):
    """Nearest-centroid scores of every sample."""
    x = stored_shares(spark, sf) if x is None else x
    samples = tb.sample_labels(spark, sf)
    centre = ag.centroids(x, samples, method)
    return classify_centroid(x, centre, labels=class_list(samples))


def pairs(spark, sf, method="mean", x=None):
    return me.align(tb.sample_labels(spark, sf), scored(spark, sf, method, x))


def three_way(spark, sf):
    return sp.stratified_split(tb.sample_labels(spark, sf), 60, 20, seed=SEED)


# Splits


@query("split_two_way", sql("SELECT * FROM two_way", "two_way"))
def split_two_way(spark, sf):
    return sp.stratified_split(tb.sample_labels(spark, sf), 80, seed=SEED)


@query("split_three_way", sql("SELECT * FROM three_way", "three_way"))
def split_three_way(spark, sf):
    return three_way(spark, sf)


@query(
    "split_unlabelled",
    sql(
        """, cut AS (SELECT round_even(0.6::DOUBLE * COUNT(*), 0) AS a, round_even(0.2::DOUBLE * COUNT(*), 0) AS b
                    FROM depths),
           pos AS (SELECT sampleID, ROW_NUMBER() OVER (ORDER BY sampleID) - 1 AS p FROM depths)
           SELECT sampleID, CASE WHEN p < a THEN 'train' WHEN p < a + b THEN 'validation' ELSE 'test' END AS split
           FROM pos, cut""",
        "depths",
    ),
)
def split_unlabelled(spark, sf):
    return sp.split_unlabelled(depths(spark, sf).select("sampleID"), 60, 20)


@query("shuffle", sql("SELECT sampleID, HC_subCST FROM samples", "samples"))
def shuffle(spark, sf):
    """The rows in hash order; their order is checked by ``shuffle_positions``."""
    return sp.shuffle(tb.sample_labels(spark, sf), SEED)


@query(
    "shuffle_positions",
    sql(
        """SELECT sampleID, ROW_NUMBER() OVER (ORDER BY md5('7|' || sampleID), sampleID) - 1 AS position
           FROM samples""",
        "samples",
    ),
)
def shuffle_positions(spark, sf):
    keyed = tb.sample_labels(spark, sf).select("sampleID").withColumn("h", hash_order(SEED, "sampleID"))
    return with_position(keyed, ["h", "sampleID"]).drop("h")


@query(
    "split_audit",
    sql(
        """SELECT HC_subCST, split, ROUND(p_ref, 6) AS p_ref, ROUND(p_split, 6) AS p_split,
                  ROUND(abs_diff, 6) AS abs_diff, ROUND(rel, 6) + 0 AS rel_pct_signed, ROUND(ABS(rel), 6) AS rel_pct,
                  NOT COALESCE(abs_diff > 0.0005, FALSE) AS passes_reference, p_split IS NULL AS class_missing
           FROM audit""",
        "audit",
    ),
)
def split_audit(spark, sf):
    audit = sp.split_audit(three_way(spark, sf), 0.0005)
    numbers = ("p_ref", "p_split", "abs_diff", "rel_pct_signed", "rel_pct")
    return audit.withColumns({c: r6(c) for c in numbers})


@query(
    "split_gate",
    sql(
        """SELECT split, COALESCE(string_agg(HC_subCST, ',' ORDER BY HC_subCST) FILTER (WHERE abs_diff > 0.0005), '')
                  AS offending, ROUND(MAX(abs_diff), 6) AS worst,
                  bool_and(NOT COALESCE(abs_diff > 0.0005, FALSE)) AS passes,
                  bool_or(p_split IS NULL) AS class_missing FROM audit GROUP BY 1""",
        "audit",
    ),
)
def split_gate(spark, sf):
    gate = sp.check_split(three_way(spark, sf), 0.0005)
    return gate.withColumns({"offending": F.array_join("offending", ","), "worst": r6("worst")})


@query(
    "tolerance_report",
    sql(
        """SELECT HC_subCST, split, ROUND(rel, 6) + 0 AS rel_pct_signed, ROUND(ABS(rel), 6) AS rel_pct,
                  ROUND(MAX(rel) OVER (PARTITION BY split), 6) + 0 AS worst_signed,
                  printf('%2.6f%%', rel) AS text FROM audit""",
        "audit",
    ),
)
def tolerance_report(spark, sf):
    report = sp.tolerance_report(three_way(spark, sf))
    return report.withColumns({c: r6(c) for c in ("rel_pct_signed", "rel_pct", "worst_signed")})


@query(
    "permute_feature",
    sql(
        """, one AS (SELECT s.sampleID, v.value FROM samples s JOIN full_shares v
                     ON v.sampleID = s.sampleID AND v.taxon = 'Brand#7'),
           i AS (SELECT sampleID, value, ROW_NUMBER() OVER (ORDER BY sampleID) AS p FROM one),
           h AS (SELECT value AS permuted, ROW_NUMBER() OVER (ORDER BY md5('7|' || sampleID), sampleID) AS p FROM one)
           SELECT i.sampleID, ROUND(i.value, 6) AS value, ROUND(h.permuted, 6) AS permuted FROM i JOIN h ON h.p = i.p""",
        "samples", "full_shares",
    ),
)
def permute_feature(spark, sf):
    one = shares(spark, sf).filter(F.col("taxon") == "Brand#7").drop("taxon")
    every = tb.sample_labels(spark, sf).select("sampleID").join(one, "sampleID", "left")
    moved = sp.permute(every.withColumn("value", F.coalesce("value", F.lit(0.0))), seed=SEED)
    return moved.select("sampleID", r6("value").alias("value"), r6("permuted").alias("permuted"))


# Cohorts


def cohort_counts(spark, sf):
    return tb.counts_long(spark, sf).join(tb.sample_cohorts(spark, sf), "sampleID")


NORM_NAME = "regexp_replace(replace(lower(p_name), ' ', '_'), '^.__?', '', 's')"


@query(
    "common_taxa",
    f"""SELECT {NORM_NAME} AS taxon FROM part GROUP BY 1
        HAVING COUNT(DISTINCT p_type) = (SELECT COUNT(DISTINCT p_type) FROM part) ORDER BY 1""",
)
def common_taxa(spark, sf):
    """Part names found in every part type."""
    rows = tb.table(spark, sf, "part").select(F.col("p_name").alias("taxon"), "p_type")
    return st.shared_taxa(rows, "p_type")


def nation_names(spark, sf, of, key):
    nation = tb.table(spark, sf, "nation")
    return tb.table(spark, sf, of).join(nation, F.col(key) == F.col("n_nationkey")).select("n_name")


@query(
    "common_taxa_two",
    """SELECT replace(lower(n_name), ' ', '_') AS taxon FROM customer JOIN nation ON c_nationkey = n_nationkey
       INTERSECT SELECT replace(lower(n_name), ' ', '_') FROM supplier JOIN nation ON s_nationkey = n_nationkey
       ORDER BY 1""",
)
def common_taxa_two(spark, sf):
    """Nations of customers that are also nations of suppliers."""
    sides = (("customer", "c_nationkey"), ("supplier", "s_nationkey"))
    return st.common_taxa(*[nation_names(spark, sf, t, k).withColumnRenamed("n_name", "taxon") for t, k in sides])


@query(
    "stack_cohorts",
    sql(
        """SELECT 'orders' AS dataset, sampleID, taxon, count, NULL::VARCHAR AS source FROM counts
           UNION ALL SELECT 'events', sampleID, taxon, count, 'web' FROM users""",
        "counts", "users",
    ),
)
def stack_cohorts(spark, sf):
    first = st.tag_cohort(tb.counts_long(spark, sf), "orders")
    second = st.tag_cohort(tb.event_counts(spark, sf), "events").withColumn("source", F.lit("web"))
    return st.stack(first, second)


@query(
    "label_universe",
    """SELECT l AS HC_subCST, COUNT(DISTINCT side) = 2 AS in_both FROM (
         SELECT n_name AS l, 1 AS side FROM customer JOIN nation ON c_nationkey = n_nationkey
         UNION ALL SELECT n_name, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY 1 ORDER BY 1""",
)
def label_universe(spark, sf):
    sides = (("customer", "c_nationkey"), ("supplier", "s_nationkey"))
    return st.label_universe(*[nation_names(spark, sf, t, k).withColumnRenamed("n_name", "HC_subCST") for t, k in sides])


@query(
    "schema_diff",
    sql(
        """, a AS (SELECT DISTINCT taxon FROM counts), b AS (SELECT DISTINCT taxon FROM users)
           SELECT 'taxon' AS kind, taxon AS name, 'first' AS side FROM a WHERE taxon NOT IN (SELECT taxon FROM b)
           UNION ALL SELECT 'taxon', taxon, 'second' FROM b WHERE taxon NOT IN (SELECT taxon FROM a)
           UNION ALL SELECT DISTINCT 'label', HC_subCST, 'first' FROM samples
             WHERE HC_subCST NOT IN (SELECT label::VARCHAR FROM embeddings)
           UNION ALL SELECT DISTINCT 'label', label::VARCHAR, 'second' FROM embeddings
             WHERE label::VARCHAR NOT IN (SELECT HC_subCST FROM samples)""",
        "counts", "users", "samples",
    ),
)
def schema_diff(spark, sf):
    return st.schema_diff(
        tb.counts_long(spark, sf), tb.event_counts(spark, sf), tb.sample_labels(spark, sf), tb.dense(spark, sf)
    )


# Nearest centroid and its scores


@query(
    "centroid_classify",
    sql("SELECT sampleID, subCST, ROUND(score, 6) AS score FROM guess", "guess"),
)
def centroid_classify(spark, sf):
    return scored(spark, sf).select("sampleID", "subCST", r6(F.array_max("scores")).alias("score"))


@query(
    "centroid_similarity",
    sql("SELECT sampleID, cls, ROUND(score, 6) AS score FROM theta", "theta"),
)
def centroid_similarity(spark, sf):
    labels = F.array(*[F.lit(x) for x in class_list(tb.sample_labels(spark, sf))])
    long = scored(spark, sf).select("sampleID", F.posexplode("scores").alias("i", "s"))
    return long.select("sampleID", labels[F.col("i")].alias("cls"), r6("s").alias("score"))


@query(
    "append_predictions",
    sql(
        """SELECT c_custkey AS sampleID, c_name, c_acctbal, g.subCST, """
        + ", ".join(
            f"ROUND((SELECT score FROM theta t WHERE t.sampleID = c_custkey AND t.cls = '{x}'), 6) AS \"{x}_sim\""
            for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
        )
        + " FROM customer JOIN guess g ON g.sampleID = c_custkey",
        "theta", "guess",
    ),
)
def append_predictions(spark, sf):
    rows = tb.table(spark, sf, "customer").select(F.col("c_custkey").alias("sampleID"), "c_name", "c_acctbal")
    labels = class_list(tb.sample_labels(spark, sf))
    wide = score_columns(scored(spark, sf), labels).withColumns({f"{x}_sim": r6(f"{x}_sim") for x in labels})
    return rows.join(wide, "sampleID")


@query("align_predictions", sql("SELECT * FROM pairs", "pairs"))
def align_predictions(spark, sf):
    return pairs(spark, sf)


@query(
    "align_report",
    """SELECT COUNT(*) FILTER (WHERE t IS NOT NULL AND p IS NOT NULL) AS n_matched,
              COUNT(*) FILTER (WHERE p IS NULL) AS n_truth_only, COUNT(*) FILTER (WHERE t IS NULL) AS n_pred_only,
              COUNT(*) FILTER (WHERE t > 1 OR p > 1) AS n_duplicated
       FROM (SELECT doc_id, COUNT(*) AS t FROM documents GROUP BY 1) a
       FULL JOIN (SELECT doc_id, COUNT(*) AS p FROM labels GROUP BY 1) b ON a.doc_id = b.doc_id""",
)
def align_report(spark, sf):
    truth = tb.table(spark, sf, "documents").select(F.col("doc_id").alias("sampleID"))
    return me.align_report(truth, tb.binary_pairs(spark, sf))


@query(
    "accuracy",
    sql(
        "SELECT COUNT(*) AS n, ROUND(AVG((HC_subCST = subCST)::INTEGER) * 100, 6) AS accuracy FROM pairs", "pairs"
    ),
)
def accuracy(spark, sf):
    return me.accuracy(pairs(spark, sf)).withColumn("accuracy", r6("accuracy"))


@query(
    "accuracy_binary",
    "SELECT COUNT(*) AS n, ROUND(AVG((quality = toxic)::INTEGER) * 100, 6) AS accuracy FROM labels",
)
def accuracy_binary(spark, sf):
    return me.accuracy(tb.binary_pairs(spark, sf)).withColumn("accuracy", r6("accuracy"))


@query(
    "confusion",
    sql(
        """SELECT a.c AS HC_subCST, b.c AS subCST, COALESCE(n, 0) AS n FROM universe a CROSS JOIN universe b
           LEFT JOIN cells ON HC_subCST = a.c AND subCST = b.c""",
        "universe",
    ),
)
def confusion(spark, sf):
    return me.confusion(pairs(spark, sf))


@query(
    "confusion_wide",
    """SELECT quality::VARCHAR AS HC_subCST, COUNT(*) FILTER (WHERE toxic = 0) AS "0",
              COUNT(*) FILTER (WHERE toxic = 1) AS "1" FROM labels GROUP BY 1""",
)
def confusion_wide(spark, sf):
    return me.confusion_matrix(tb.binary_pairs(spark, sf), ["0", "1"])


@query(
    "confusion_diff",
    sql(
        """, m AS (SELECT HC_subCST, subCST, COUNT(*) AS n FROM median_pairs GROUP BY 1, 2)
           SELECT COALESCE(c.HC_subCST, m.HC_subCST) AS HC_subCST, COALESCE(c.subCST, m.subCST) AS subCST,
                  COALESCE(c.n, 0) - COALESCE(m.n, 0) AS diff
           FROM cells c FULL JOIN m ON m.HC_subCST = c.HC_subCST AND m.subCST = c.subCST""",
        "cells", "median_pairs",
    ),
)
def confusion_diff(spark, sf):
    x = stored_shares(spark, sf)
    return me.confusion_diff(pairs(spark, sf, x=x), pairs(spark, sf, "median", x))


WEIGHTED = """SELECT SUM(support)::BIGINT AS n, ROUND(SUM(support * p) / SUM(support), 6) AS precision,
                     ROUND(SUM(support * r) / SUM(support), 6) AS recall,
                     ROUND(SUM(support * CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) / SUM(support), 6) AS f1,
                     ROUND(SUM(support * r) / SUM(support), 6) AS accuracy FROM per_class"""


@query("weighted_metrics", sql(WEIGHTED, "per_class"))
def weighted_metrics(spark, sf):
    out = me.weighted_metrics(pairs(spark, sf))
    return out.select("n", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query(
    "per_class_metrics",
    sql(
        """SELECT HC_subCST, ROUND(r, 6) AS recall, ROUND(r, 6) AS accuracy, (r > 0)::INTEGER::DOUBLE AS precision,
                  ROUND(2 * r / (1 + r), 6) AS f1
           FROM (SELECT HC_subCST, AVG((HC_subCST = subCST)::INTEGER) AS r FROM pairs GROUP BY 1)""",
        "pairs",
    ),
)
def per_class_metrics(spark, sf):
    out = me.per_class_metrics(pairs(spark, sf))
    return out.select("HC_subCST", *[r6(c).alias(c) for c in ("recall", "accuracy", "precision", "f1")])


@query(
    "roc_points",
    sql(
        """, u AS (SELECT DISTINCT HC_subCST AS c FROM cells),
           k AS (SELECT c, SUM(n) FILTER (WHERE HC_subCST <> c AND subCST = c) AS fp,
                        SUM(n) FILTER (WHERE HC_subCST <> c) AS neg,
                        SUM(n) FILTER (WHERE HC_subCST = c AND subCST = c) AS tp,
                        SUM(n) FILTER (WHERE HC_subCST = c) AS pos FROM u CROSS JOIN cells GROUP BY 1)
           SELECT c AS HC_subCST, 0 AS point, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr FROM k
           UNION ALL SELECT c, 1, ROUND(COALESCE(fp, 0) / neg::DOUBLE, 6), ROUND(COALESCE(tp, 0) / pos::DOUBLE, 6) FROM k
           UNION ALL SELECT c, 2, 1.0, 1.0 FROM k""",
        "cells",
    ),
)
def roc_points(spark, sf):
    return me.roc_points(pairs(spark, sf)).withColumns({"fpr": r6("fpr"), "tpr": r6("tpr")})


# Components of the embeddings as scores of ten classes; steps of 1/50 make ties.
SCORED = """
    WITH e AS (SELECT label::VARCHAR AS t, unnest(range(10))::VARCHAR AS c, unnest(embedding[1:10])::DOUBLE AS x FROM embeddings),
    m AS (SELECT c AS HC_subCST, floor(x * 50) AS score, COUNT(*) FILTER (WHERE t = c) AS pos, COUNT(*) FILTER (WHERE t <> c) AS neg
          FROM e GROUP BY 1, 2),
    r AS (SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, ROW_NUMBER() OVER w AS point,
                 SUM(pos) OVER (PARTITION BY HC_subCST) AS n_pos, SUM(neg) OVER (PARTITION BY HC_subCST) AS n_neg
          FROM m WINDOW w AS (PARTITION BY HC_subCST ORDER BY score DESC))
"""
DIGITS = [str(i) for i in range(10)]


def component_scores(spark, sf):
    steps = F.transform(F.slice("features", 1, 10), lambda x: F.floor(x * 50).cast("double"))
    return tb.dense(spark, sf).select("HC_subCST", steps.alias("scores"))


@query(
    "roc_curves",
    SCORED + """SELECT HC_subCST, point, score AS threshold, fp / n_neg::DOUBLE AS fpr, tp / n_pos::DOUBLE AS tpr FROM r
                UNION ALL SELECT DISTINCT HC_subCST, 0, NULL, 0, 0 FROM r""",
)
def roc_curves(spark, sf):
    return me.roc_curves(component_scores(spark, sf), DIGITS)


@query(
    "roc_auc",
    SCORED + """SELECT HC_subCST, ANY_VALUE(n_pos)::BIGINT AS n_pos, ANY_VALUE(n_neg)::BIGINT AS n_neg,
                       SUM(neg * (2 * tp - pos))::DOUBLE / (2 * (ANY_VALUE(n_pos)::DOUBLE * ANY_VALUE(n_neg))) AS auc FROM r GROUP BY 1""",
)
def roc_auc(spark, sf):
    return me.roc_auc(component_scores(spark, sf), DIGITS)


@query(
    "centroid_auc",
    sql(
        """, x AS (SELECT t.sampleID, cls AS HC_subCST, ROUND(score, 6) AS score, s.HC_subCST = cls AS hit
                   FROM theta t JOIN samples s ON s.sampleID = t.sampleID),
             p AS (SELECT a.HC_subCST, SUM((a.score > b.score)::INTEGER + 0.5 * (a.score = b.score)::INTEGER)::DOUBLE AS won
                   FROM x a JOIN x b ON a.HC_subCST = b.HC_subCST AND a.hit AND NOT b.hit GROUP BY 1),
             n AS (SELECT HC_subCST, COUNT(*) FILTER (WHERE hit) AS n_pos, COUNT(*) FILTER (WHERE NOT hit) AS n_neg FROM x GROUP BY 1)
           SELECT n.HC_subCST, n_pos, n_neg, ROUND(won / (n_pos::DOUBLE * n_neg), 6) AS auc FROM n JOIN p ON p.HC_subCST = n.HC_subCST""",
        "theta", "samples",
    ),
)
def centroid_auc(spark, sf):
    """Areas of the nearest-centroid similarities; the SQL form counts pairs."""
    samples = tb.sample_labels(spark, sf)
    similar = scored(spark, sf).select("sampleID", F.transform("scores", r6).alias("scores"))
    out = me.roc_auc(samples.join(similar, "sampleID"), class_list(samples))
    return out.withColumn("auc", r6("auc"))


@query(
    "misclassified",
    sql("SELECT sampleID, HC_subCST || ':' || subCST AS miss FROM pairs WHERE HC_subCST <> subCST", "pairs"),
)
def misclassified(spark, sf):
    return me.misclassified(pairs(spark, sf))


PANEL = """
SELECT '{m}' AS method, ROUND(SUM(support * r) / SUM(support), 3) AS accuracy,
       ROUND(SUM(support * CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) / SUM(support), 3) AS f1,
       ROUND(SUM(support * p) / SUM(support), 3) AS precision, ROUND(SUM(support * r) / SUM(support), 3) AS recall
FROM (SELECT c, SUM(s) AS support, CASE WHEN SUM(g) > 0 THEN SUM(h) / SUM(g)::DOUBLE ELSE 0 END AS p,
             CASE WHEN SUM(s) > 0 THEN SUM(h) / SUM(s)::DOUBLE ELSE 0 END AS r
      FROM (SELECT HC_subCST AS c, 1 AS s, 0 AS g, (HC_subCST = subCST)::INTEGER AS h FROM {t}
            UNION ALL SELECT subCST, 0, 1, 0 FROM {t}) GROUP BY 1)
"""


@query(
    "method_panel",
    sql(
        PANEL.format(m="mean", t="pairs") + "UNION ALL" + PANEL.format(m="median", t="median_pairs"),
        "pairs", "median_pairs",
    ),
)
def method_panel(spark, sf):
    x = stored_shares(spark, sf)
    return me.compare_methods({m: pairs(spark, sf, m, x) for m in ("mean", "median")})


def _hits(mode):
    if mode == "unique":
        guesses = "SELECT sampleID, rank, cls FROM ranked"
    else:
        guesses = """SELECT a.sampleID, a.rank, MIN(b.cls) AS cls FROM ranked a
                     JOIN ranked b ON b.sampleID = a.sampleID AND b.score = a.score GROUP BY 1, 2"""
    body = f""", ranked AS (SELECT sampleID, cls, score,
                 ROW_NUMBER() OVER (PARTITION BY sampleID ORDER BY score DESC, cls)::INTEGER AS rank FROM theta),
               g AS ({guesses}),
               h AS (SELECT g.rank, SUM((g.cls = s.HC_subCST)::INTEGER)::BIGINT AS hits
                     FROM g JOIN samples s ON s.sampleID = g.sampleID GROUP BY 1)
               SELECT rank, hits, SUM(hits) OVER (ORDER BY rank)::BIGINT AS cumulative FROM h"""

    def run(spark, sf):
        samples = tb.sample_labels(spark, sf)
        return me.rank_hits(samples.join(scored(spark, sf), "sampleID"), class_list(samples), rank_mode=mode)

    return sql(body, "theta", "samples"), run


for _mode, _name in (("first_index", "rank_hits"), ("unique", "rank_hits_unique")):
    _sql, _run = _hits(_mode)
    query(_name, _sql)(_run)


@query(
    "argmax_label",
    sql(
        """, e AS (SELECT sampleID, unnest(f) AS x, unnest(range(len(f))) AS i FROM vectors)
           SELECT sampleID, i::INTEGER AS idx FROM e QUALIFY ROW_NUMBER() OVER (PARTITION BY sampleID ORDER BY x DESC, i) = 1""",
        "vectors",
    ),
)
def argmax_label(spark, sf):
    return tb.dense(spark, sf).select("sampleID", sc.argmax_index("features").alias("idx"))


@query(
    "ranked_choices",
    sql(
        """, e AS (SELECT sampleID, unnest(f) AS x, unnest(range(len(f))) AS i FROM vectors),
           r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sampleID ORDER BY x DESC, i) AS rank FROM e)
           SELECT sampleID, rank::INTEGER AS rank, i::INTEGER AS idx FROM r""",
        "vectors",
    ),
)
def ranked_choices(spark, sf):
    order = F.posexplode(sc.choices("features", "unique")).alias("p", "idx")
    return tb.dense(spark, sf).select("sampleID", order).select("sampleID", (F.col("p") + 1).alias("rank"), "idx")


@query(
    "lookup_weights",
    sql(
        """SELECT s.sampleID, s.HC_subCST, ROUND((SELECT MAX(n) FROM sizes) / z.n::DOUBLE, 6) AS weight
           FROM samples s JOIN sizes z ON z.HC_subCST = s.HC_subCST""",
        "samples", "sizes",
    ),
)
def lookup_weights(spark, sf):
    samples = tb.sample_labels(spark, sf)
    weights = ag.class_weights(samples).select("HC_subCST", r6("weight").alias("weight"))
    return me.lookup(samples, weights, "HC_subCST").select("sampleID", "HC_subCST", "weight")


@query(
    "order_by_effect",
    sql(
        """SELECT taxon, ROUND(effect, 6) + 0 AS effect, FROM (
             SELECT taxon, AVG(value) - (SELECT AVG(value) FROM full_shares) AS effect FROM full_shares GROUP BY 1)""",
        "full_shares",
    ),
)
def order_by_effect(spark, sf):
    summary = ag.taxon_summary(shares(spark, sf), tb.sample_labels(spark, sf))
    overall = summary.agg(F.avg("mean")).scalar()
    effects = summary.select("taxon", (F.col("mean") - overall).alias("effect"))
    return rk.order_by_effect(effects).withColumn("effect", r6("effect"))


@query(
    "pick_best",
    sql(
        """SELECT HC_subCST, ROUND(r, 6) AS recall FROM (
             SELECT HC_subCST, AVG((HC_subCST = subCST)::INTEGER) AS r FROM pairs GROUP BY 1)
           ORDER BY r DESC, HC_subCST LIMIT 1""",
        "pairs",
    ),
)
def pick_best(spark, sf):
    per_class = me.per_class_metrics(pairs(spark, sf)).select("HC_subCST", "recall")
    return rk.pick_best(per_class, "recall", "HC_subCST").withColumn("recall", r6("recall"))


# Entropy and correlation


def assignment(spark, sf):
    """Users with the share of each event type as class probability."""
    taxa = event_types(spark, sf)
    wide = wr.to_wide(relative_abundance(tb.event_counts(spark, sf)), taxa, "value")
    return wide.withColumnsRenamed({t: f"Pct {t}" for t in taxa})


ENTROPY = """SELECT sampleID, SUM(CASE WHEN value > 0 THEN value * ln(value) ELSE 0 END) AS h FROM user_shares GROUP BY 1"""


@query(
    "assignment_entropy",
    sql(
        f"""SELECT sampleID, ROUND(h, 6) AS h_signed, ROUND(h / ln(5), 6) AS h_norm, ROUND(-h, 6) AS shannon
            FROM ({ENTROPY})""",
        "user_shares",
    ),
)
def assignment_entropy(spark, sf):
    wide = assignment(spark, sf)
    out = ss.assignment_entropy(wide, ss.pct_columns(wide), "zero")
    return out.select("sampleID", *[r6(c).alias(c) for c in ("h_signed", "h_norm", "shannon")])


def effort_and_entropy(spark, sf):
    wide = assignment(spark, sf)
    entropy = ss.assignment_entropy(wide, ss.pct_columns(wide), "zero").select("sampleID", "h_norm", "h_signed")
    effort = effort_z(ag.read_counts(tb.event_counts(spark, sf)), name="effort").select("sampleID", "effort")
    return effort.join(entropy, "sampleID")


@query(
    "correlations",
    sql(
        f""", e AS ({ENTROPY}), d AS (SELECT sampleID, SUM(count) AS n FROM users GROUP BY 1),
            x AS (SELECT (n - AVG(n) OVER ()) / STDDEV_SAMP(n) OVER () AS effort, h / ln(5) AS h_norm, h AS h_signed
                  FROM e JOIN d ON d.sampleID = e.sampleID)
            SELECT 'effort' AS row, 'h_norm' AS "column", ROUND(corr(effort, h_norm), 6) AS corr, COUNT(*) AS n FROM x
            UNION ALL SELECT 'effort', 'h_signed', ROUND(corr(effort, h_signed), 6), COUNT(*) FROM x
            UNION ALL SELECT 'h_norm', 'h_signed', ROUND(corr(h_norm, h_signed), 6), COUNT(*) FROM x""",
        "user_shares", "users",
    ),
)
def correlations(spark, sf):
    out = ss.correlations(effort_and_entropy(spark, sf), ["effort", "h_norm", "h_signed"], digits=(6, 4))
    return out.select("row", "column", "corr", "n")


# The same continued fraction, one half step per round.
P_VALUES = """
    , e AS ({entropy}), d AS (SELECT sampleID, SUM(count) AS n FROM users GROUP BY 1),
    x AS (SELECT (n - AVG(n) OVER ()) / STDDEV_SAMP(n) OVER () AS effort, h / ln(5) AS h_norm, h AS h_signed
          FROM e JOIN d ON d.sampleID = e.sampleID),
    r AS (SELECT 'effort' AS row, 'h_norm' AS col, corr(effort, h_norm) AS r, COUNT(*) AS n FROM x
          UNION ALL SELECT 'effort', 'h_signed', corr(effort, h_signed), COUNT(*) FROM x
          UNION ALL SELECT 'h_norm', 'h_signed', corr(h_norm, h_signed), COUNT(*) FROM x),
    t AS (SELECT row, col, r, n, 1 - r * r AS v, (n - 2) / 2.0::DOUBLE AS h FROM r),
    o AS (SELECT *, v > (h + 1) / (h + 2.5) AS turned FROM t),
    k AS (SELECT row, col, r, n, turned, CASE WHEN turned THEN 0.5 ELSE h END AS a, CASE WHEN turned THEN h ELSE 0.5 END AS b,
                 CASE WHEN turned THEN 1 - v ELSE v END AS y FROM o),
    f(row, col, j, c, d, total) AS (
        SELECT row, col, 1, 1.0::DOUBLE, 1 / (1 - (a + b) * y / (a + 1)), 1 / (1 - (a + b) * y / (a + 1)) FROM k WHERE abs(r) < 1
        UNION ALL
        SELECT row, col, j + 1, 1 + s / c, 1 / (1 + s * d), total * (1 + s / c) / (1 + s * d) FROM (
            SELECT f.*, CASE WHEN (j + 1) % 2 = 0
                        THEN ((j + 1) // 2) * (b - (j + 1) // 2) * y / ((a + 2 * ((j + 1) // 2) - 1) * (a + 2 * ((j + 1) // 2)))
                        ELSE -(a + (j + 1) // 2) * (a + b + (j + 1) // 2) * y / ((a + 2 * ((j + 1) // 2)) * (a + 2 * ((j + 1) // 2) + 1)) END AS s
            FROM f JOIN k USING (row, col) WHERE j < 400)),
    p AS (SELECT row, col, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(y) + b * ln(1 - y)) / a * total AS part
          FROM k JOIN f USING (row, col) WHERE j = 400)
    SELECT row, col AS "column", ROUND(r, 2) AS corr, n,
           ROUND(CASE WHEN abs(r) >= 1 THEN 0 WHEN turned THEN 1 - part ELSE part END, 4) AS p
    FROM k LEFT JOIN p USING (row, col)
"""


@query("correlation_pvalues", sql(P_VALUES.format(entropy=ENTROPY), "user_shares", "users").replace("WITH ", "WITH RECURSIVE ", 1))
def correlation_pvalues(spark, sf):
    return ss.correlations(effort_and_entropy(spark, sf), ["effort", "h_norm", "h_signed"])

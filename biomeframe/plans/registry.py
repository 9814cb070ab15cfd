"""Named queries with their independent SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# Shared sub-queries of the SQL forms.
PARTS = {
    "counts": """
        SELECT o_custkey AS sampleID, p_brand AS taxon, SUM(l_quantity) AS count
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        GROUP BY 1, 2""",
    "shares": """
        SELECT sampleID, taxon, count / SUM(count) OVER (PARTITION BY sampleID) AS value FROM counts""",
    "samples": "SELECT c_custkey AS sampleID, c_mktsegment AS HC_subCST FROM customer",
    "sizes": "SELECT HC_subCST, COUNT(*) AS n FROM samples GROUP BY 1",
    "taxa": "SELECT DISTINCT taxon FROM counts",
    "full_shares": """
        SELECT s.sampleID, t.taxon, COALESCE(v.value, 0.0::DOUBLE) AS value
        FROM samples s CROSS JOIN taxa t LEFT JOIN shares v ON v.sampleID = s.sampleID AND v.taxon = t.taxon""",
    "depths": "SELECT sampleID, SUM(count) AS read_count FROM counts GROUP BY 1",
    "centroid": """
        SELECT s.HC_subCST, v.taxon, SUM(v.value) / ANY_VALUE(z.n) AS value
        FROM shares v JOIN samples s ON v.sampleID = s.sampleID JOIN sizes z ON z.HC_subCST = s.HC_subCST
        GROUP BY 1, 2""",
    "median_centroid": """
        SELECT s.HC_subCST, v.taxon, MEDIAN(v.value) AS value
        FROM full_shares v JOIN samples s ON v.sampleID = s.sampleID GROUP BY 1, 2""",
    "theta": """
        SELECT d.sampleID, d.cls, d.ab / (a.aa + b.bb - d.ab) AS score
        FROM (SELECT v.sampleID, c.HC_subCST AS cls, SUM(v.value * c.value) AS ab
              FROM shares v JOIN centroid c ON c.taxon = v.taxon GROUP BY 1, 2) d
        JOIN (SELECT sampleID, SUM(value * value) AS aa FROM shares GROUP BY 1) a ON a.sampleID = d.sampleID
        JOIN (SELECT HC_subCST, SUM(value * value) AS bb FROM centroid GROUP BY 1) b ON b.HC_subCST = d.cls""",
    "median_theta": """
        SELECT d.sampleID, d.cls, d.ab / (a.aa + b.bb - d.ab) AS score
        FROM (SELECT v.sampleID, c.HC_subCST AS cls, SUM(v.value * c.value) AS ab
              FROM shares v JOIN median_centroid c ON c.taxon = v.taxon GROUP BY 1, 2) d
        JOIN (SELECT sampleID, SUM(value * value) AS aa FROM shares GROUP BY 1) a ON a.sampleID = d.sampleID
        JOIN (SELECT HC_subCST, SUM(value * value) AS bb FROM median_centroid GROUP BY 1) b
          ON b.HC_subCST = d.cls""",
    "guess": """
        SELECT sampleID, cls AS subCST, score FROM theta
        QUALIFY ROW_NUMBER() OVER (PARTITION BY sampleID ORDER BY score DESC, cls) = 1""",
    "median_guess": """
        SELECT sampleID, cls AS subCST FROM median_theta
        QUALIFY ROW_NUMBER() OVER (PARTITION BY sampleID ORDER BY score DESC, cls) = 1""",
    "pairs": "SELECT s.sampleID, s.HC_subCST, g.subCST FROM samples s JOIN guess g ON g.sampleID = s.sampleID",
    "median_pairs": """
        SELECT s.sampleID, s.HC_subCST, g.subCST FROM samples s JOIN median_guess g ON g.sampleID = s.sampleID""",
    "cells": "SELECT HC_subCST, subCST, COUNT(*) AS n FROM pairs GROUP BY 1, 2",
    "universe": "SELECT HC_subCST AS c FROM cells UNION SELECT subCST FROM cells",
    "per_class": """
        SELECT c, SUM(support) AS support,
               CASE WHEN SUM(guessed) > 0 THEN SUM(tp) / SUM(guessed)::DOUBLE ELSE 0 END AS p,
               CASE WHEN SUM(support) > 0 THEN SUM(tp) / SUM(support)::DOUBLE ELSE 0 END AS r
        FROM (SELECT HC_subCST AS c, n AS support, 0 AS guessed,
                     CASE WHEN HC_subCST = subCST THEN n ELSE 0 END AS tp FROM cells
              UNION ALL SELECT subCST, 0, n, 0 FROM cells) GROUP BY 1""",
    "cohorts": """
        SELECT c_custkey AS sampleID, n_regionkey AS cohort FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "users": """
        SELECT user_id AS sampleID, event_type AS taxon, COUNT(*)::DOUBLE AS count FROM events GROUP BY 1, 2""",
    "user_shares": """
        SELECT sampleID, taxon, count / SUM(count) OVER (PARTITION BY sampleID) AS value FROM users""",
    "ordered": """
        SELECT sampleID, HC_subCST, COUNT(*) OVER (PARTITION BY HC_subCST) AS n,
               ROW_NUMBER() OVER (PARTITION BY HC_subCST ORDER BY md5('7|' || sampleID), sampleID) AS rn
        FROM samples""",
    "two_way": """
        SELECT sampleID, HC_subCST,
               CASE WHEN rn <= FLOOR(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM ordered""",
    "three_way": """
        SELECT sampleID, HC_subCST,
               CASE WHEN rn <= FLOOR(n * 0.6::DOUBLE) THEN 'train'
                    WHEN rn <= FLOOR(n * 0.6::DOUBLE) + FLOOR(n * 0.2::DOUBLE) THEN 'test'
                    ELSE 'validation' END AS split FROM ordered""",
    "ref_share": "SELECT HC_subCST, n / SUM(n) OVER ()::DOUBLE AS p_ref FROM sizes",
    "split_share": """
        SELECT split, HC_subCST, COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY split)::DOUBLE AS p_split
        FROM three_way GROUP BY 1, 2""",
    "audit": """
        SELECT r.HC_subCST, x.split, r.p_ref, p.p_split, ABS(p.p_split - r.p_ref) AS abs_diff,
               (p.p_split / r.p_ref - 1) * 100 AS rel
        FROM ref_share r CROSS JOIN (SELECT DISTINCT split FROM three_way) x
        LEFT JOIN split_share p ON p.HC_subCST = r.HC_subCST AND p.split = x.split""",
    "train": "SELECT sampleID, HC_subCST FROM two_way WHERE split = 'train'",
    "test": "SELECT sampleID, HC_subCST FROM two_way WHERE split = 'test'",
    "train_shares": "SELECT v.* FROM full_shares v JOIN train t ON t.sampleID = v.sampleID",
    "train_moments": """
        SELECT taxon, AVG(value) AS m, STDDEV_POP(value) AS sp, MIN(value) AS lo, MAX(value) AS hi,
               AVG((value > 0)::INTEGER) AS prevalence FROM train_shares GROUP BY 1""",
    "plain_features": "SELECT sampleID, taxon, value AS x FROM full_shares",
    "scaled_features": """
        SELECT v.sampleID, v.taxon, (v.value - t.m) / t.sp AS x FROM full_shares v JOIN train_moments t ON t.taxon = v.taxon""",
    "t_pairs": "SELECT s.sampleID, s.HC_subCST, g.subCST FROM test s JOIN t_guess g ON g.sampleID = s.sampleID",
    "t_cells": "SELECT HC_subCST, subCST, COUNT(*) AS n FROM t_pairs GROUP BY 1, 2",
    "vectors": "SELECT vec_id AS sampleID, label::VARCHAR AS HC_subCST, embedding::DOUBLE[] AS f FROM embeddings",
}



def _nearest(name: str, features: str) -> dict[str, str]:
    """Sub-queries of nearest class means, fitted on the training samples, for the held-out ones."""
    return {
        f"{name}_means": f"""
            SELECT t.HC_subCST AS cls, x.taxon, AVG(x.x) AS c FROM {features} x JOIN train t ON t.sampleID = x.sampleID
            GROUP BY 1, 2""",
        f"{name}_theta": f"""
            SELECT sampleID, cls, ab / (aa + bb - ab) AS score
            FROM (SELECT x.sampleID, m.cls, SUM(x.x * m.c) AS ab, SUM(x.x * x.x) AS aa, SUM(m.c * m.c) AS bb
                  FROM {features} x JOIN test s ON s.sampleID = x.sampleID JOIN {name}_means m ON m.taxon = x.taxon
                  GROUP BY 1, 2)""",
        f"{name}_guess": f"""
            SELECT sampleID, cls AS subCST, score FROM {name}_theta
            QUALIFY ROW_NUMBER() OVER (PARTITION BY sampleID ORDER BY score DESC, cls) = 1""",
    }


PARTS |= _nearest("t", "plain_features") | _nearest("z", "scaled_features") | _nearest("f", "focus_features")
PARTS["focus_shares"] = """
    SELECT sampleID, taxon, count / SUM(count) OVER (PARTITION BY sampleID) AS value FROM counts
    WHERE lower(taxon) IN ('brand#1', 'brand#2', 'brand#3', 'brand#4')"""
PARTS["focus_features"] = """
    SELECT s.sampleID, t.taxon, COALESCE(v.value, 0.0::DOUBLE) AS x
    FROM samples s CROSS JOIN (SELECT DISTINCT taxon FROM focus_shares) t
    LEFT JOIN focus_shares v ON v.sampleID = s.sampleID AND v.taxon = t.taxon"""
PARTS |= {
    # Every feature moved on its own: the sample at place p has the value of place p - b.
    "t_places": "SELECT sampleID, ROW_NUMBER() OVER (ORDER BY md5('0|' || sampleID), sampleID) - 1 AS p, COUNT(*) OVER () AS n FROM test",
    "t_moves": """
        SELECT taxon, CASE WHEN n > 1 THEN 1 + ('0x' || substr(md5('0|' || f), 1, 13))::BIGINT % (n - 1) ELSE 0 END AS b
        FROM (SELECT taxon, ROW_NUMBER() OVER (ORDER BY lower(taxon)) - 1 AS f FROM taxa), (SELECT COUNT(*) AS n FROM test)""",
    "t_moved": """
        SELECT a.sampleID, m.taxon, o.x AS x2, s.x AS x1 FROM t_places a CROSS JOIN t_moves m
        JOIN t_places q ON q.p = (a.p - m.b + a.n) % a.n
        JOIN plain_features o ON o.sampleID = q.sampleID AND o.taxon = m.taxon
        JOIN plain_features s ON s.sampleID = a.sampleID AND s.taxon = m.taxon""",
    "t_moved_guess": """
        SELECT taxon, sampleID, cls AS subCST FROM (
            SELECT v.taxon, v.sampleID, k.cls, k.ab - v.x1 * m.c + v.x2 * m.c AS ab, k.aa - v.x1 * v.x1 + v.x2 * v.x2 AS aa, k.bb
            FROM t_moved v JOIN t_means m ON m.taxon = v.taxon
            JOIN (SELECT x.sampleID, m.cls, SUM(x.x * m.c) AS ab, SUM(x.x * x.x) AS aa, SUM(m.c * m.c) AS bb
                  FROM plain_features x JOIN test s ON s.sampleID = x.sampleID JOIN t_means m ON m.taxon = x.taxon
                  GROUP BY 1, 2) k ON k.sampleID = v.sampleID AND k.cls = m.cls)
        QUALIFY ROW_NUMBER() OVER (PARTITION BY taxon, sampleID ORDER BY ab / (aa + bb - ab) DESC, cls) = 1""",
    # Pairs of the unmoved table have no taxon.
    "t_all_pairs": """
        SELECT lower(g.taxon) AS taxon, s.HC_subCST AS truth, g.subCST AS guess FROM t_moved_guess g JOIN test s ON s.sampleID = g.sampleID
        UNION ALL SELECT '', HC_subCST, subCST FROM t_pairs""",
    "t_all_classes": """
        SELECT taxon, c, support, CASE WHEN guessed > 0 THEN tp / guessed::DOUBLE ELSE 0 END AS p,
               CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END AS r
        FROM (SELECT taxon, c, SUM(s) AS support, SUM(g) AS guessed, SUM(h) AS tp FROM (
                  SELECT taxon, truth AS c, 1 AS s, 0 AS g, (truth = guess)::INTEGER AS h FROM t_all_pairs
                  UNION ALL SELECT taxon, guess, 0, 1, 0 FROM t_all_pairs) GROUP BY 1, 2)""",
    "t_effects": """
        SELECT a.taxon, a.metric, b.v - a.v AS effect
        FROM (UNPIVOT t_scored ON f1, recall, precision, accuracy INTO NAME metric VALUE v) a
        JOIN (UNPIVOT t_scored ON f1, recall, precision, accuracy INTO NAME metric VALUE v) b
          ON b.taxon = '' AND a.taxon <> '' AND a.metric = b.metric""",
    "t_scored": """
        SELECT taxon, SUM(support * CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) / SUM(support) AS f1,
               SUM(support * r) / SUM(support) AS recall, SUM(support * p) / SUM(support) AS precision,
               SUM(support * r) / SUM(support) AS accuracy FROM t_all_classes GROUP BY 1""",
    "s_taxa": "SELECT taxon FROM t_effects WHERE metric = 'accuracy' AND effect > -1e-9",
    "s_shares": """
        SELECT sampleID, lower(taxon) AS taxon, count / SUM(count) OVER (PARTITION BY sampleID) AS value FROM counts
        WHERE lower(taxon) IN (SELECT taxon FROM s_taxa)""",
    "s_features": """
        SELECT s.sampleID, t.taxon, COALESCE(v.value, 0.0::DOUBLE) AS x FROM samples s CROSS JOIN s_taxa t
        LEFT JOIN s_shares v ON v.sampleID = s.sampleID AND v.taxon = t.taxon""",
} | _nearest("s", "s_features")
PARTS["t_universe"] = PARTS["universe"].replace("cells", "t_cells")
PARTS["t_per_class"] = PARTS["per_class"].replace("cells", "t_cells")

NEEDS = {
    "shares": ["counts"], "sizes": ["samples"], "taxa": ["counts"],
    "full_shares": ["samples", "taxa", "shares"], "depths": ["counts"],
    "centroid": ["shares", "samples", "sizes"], "median_centroid": ["full_shares", "samples"],
    "theta": ["shares", "centroid"], "median_theta": ["shares", "median_centroid"],
    "guess": ["theta"], "median_guess": ["median_theta"], "pairs": ["samples", "guess"],
    "median_pairs": ["samples", "median_guess"], "cells": ["pairs"], "universe": ["cells"],
    "per_class": ["cells"], "user_shares": ["users"], "ordered": ["samples"],
    "two_way": ["ordered"], "three_way": ["ordered"], "ref_share": ["sizes"],
    "split_share": ["three_way"], "audit": ["ref_share", "split_share", "three_way"],
    "train": ["two_way"], "test": ["two_way"], "train_shares": ["full_shares", "train"],
    "train_moments": ["train_shares"], "plain_features": ["full_shares"],
    "scaled_features": ["full_shares", "train_moments"],
    "t_means": ["plain_features", "train"], "t_theta": ["t_means", "test"], "t_guess": ["t_theta"],
    "z_means": ["scaled_features", "train"], "z_theta": ["z_means", "test"], "z_guess": ["z_theta"],
    "t_places": ["test"], "t_moves": ["taxa", "test"], "t_moved": ["t_places", "t_moves", "plain_features"],
    "t_moved_guess": ["t_moved", "t_means", "test"], "t_all_pairs": ["t_moved_guess", "t_pairs"],
    "t_all_classes": ["t_all_pairs"], "t_scored": ["t_all_classes"], "t_effects": ["t_scored"],
    "s_taxa": ["t_effects"], "s_shares": ["counts", "s_taxa"], "s_features": ["samples", "s_shares"],
    "s_means": ["s_features", "train"], "s_theta": ["s_means", "test"], "s_guess": ["s_theta"],
    "focus_shares": ["counts"], "focus_features": ["samples", "focus_shares"],
    "f_means": ["focus_features", "train"], "f_theta": ["f_means", "test"], "f_guess": ["f_theta"],
    "t_pairs": ["test", "t_guess"], "t_cells": ["t_pairs"], "t_universe": ["t_cells"], "t_per_class": ["t_cells"],
}


def sql(body: str, *parts: str) -> str:
    """``body`` with the named sub-queries and everything they need in front."""
    done: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in done:
            done.append(name)

    for p in parts:
        add(p)
    head = ", ".join(f"{n} AS ({PARTS[n]})" for n in done)
    return f"WITH {head}{body}" if body.lstrip().startswith(",") else f"WITH {head} {body}"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its SQL form when it has one."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return add


def r6(c: Column | str) -> Column:
    """Six digits, as in the SQL forms."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6) + F.lit(0.0)

"""One query per operator, each over its whole table, with the SQL form where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biomeframe.llm import jaccard, language, lines, lm, mix, pack, pii, quality, rules, spelling, sql, topk, urls, whiten
from biomeframe.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    """Register a function under its name, with its SQL form when it has one."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLE[fn.__name__] = oracle
        return fn

    return add


@query(sql.MIX)
def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op2_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(~held_out("doc_id")))
    return language.predict(docs, model, held_out=held_out("doc_id"))


@query()
def op3_minimum_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.stored(table(spark, sf_dir, "documents"))


@query()
def op4_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality.stored(table(spark, sf_dir, "documents"), held_out=held_out("doc_id"))
    model = quality.fit(measured.filter(~F.col("held_out")), table(spark, sf_dir, "labels"))
    return quality.score(measured, model)


@query(sql.RULES)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query()
def op6_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


@query(sql.LINES)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_frequent_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query(sql.JACCARD)
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


@query(sql.TOP)
def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query()
def op10_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.find(table(spark, sf_dir, "documents")))


@query(sql.SPELLING)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(spelling.runs(table(spark, sf_dir, "documents"))))


@query()
def op12_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(table(spark, sf_dir, "documents"), ~held_out("doc_id", 1))
    figures = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), *figures)


@query()
def op13_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))

"""URL filter: domain rules first, then association rules mined from what they label.

URLs that a domain rule fits carry its verdict as a label. FP-growth mines
combinations of URL tokens (host labels, path segments, file ending, names of
query parameters) together with the label; combinations that imply a label with
enough support and confidence, and better than each shorter one, become rules. A rule is
indexed by its rarest token, and each distinct token set meets only the rules of
its own tokens. All URLs with the same tokens share one answer.

Tokens that stand in exactly the same labelled URLs are one item to the mining: a rule with two of them
would be no better than with one, and any of them may stand for the item when a URL is judged. So parameters that
always come together do not multiply into all their combinations.

The number of rules does not grow with the table: support is a share of all labelled URLs.

Defined results: very long urls have as many tokens as they have parts; null urls and urls without ``://`` have empty host and path, no tokens
and the default verdict; without labelled urls there are no rules; ties between
rules go to the higher support, then to ``block``; repeated rows get equal answers; only
id and url are read, so other columns cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biomeframe.llm.common import UPPER
from biomeframe.session import materialise

# Verdict, host and path; a rule fits the host and its subdomains where the path starts with the rule's.
DOMAIN_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
DEFAULT = "allow"
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.9
ALLOW, BLOCK = "=allow", "=block"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def domain_rule(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> Column:
    """Struct of the longest rule that fits and its verdict, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        found = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found).otherwise(out)
    return out


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a url, sorted. Segments with digits only differ by their ending."""
    rest, path = _rest(url), path_of(url)
    labels = F.transform(F.split(host_of(url), r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(
        F.split(F.translate(path, UPPER, UPPER.lower()), "/"),
        lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0")),
    )
    query = F.regexp_extract(rest, r"\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "^[^=]*", 0)))
    every = F.filter(F.concat(labels, parts, names), lambda x: F.length(x) > 2)
    return F.array_sort(F.array_distinct(every))


def items_of(labelled: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """token, item: every token of enough labelled rows, with the shortest of those that stand in the same rows.

    Rows are told by two 64-bit hashes of their tokens, added up per token.
    """
    least = F.lit(float(min_support)) * labelled.agg(F.count(F.lit(1))).scalar()
    wide = lambda c: c.cast("decimal(20,0)")
    hashed = labelled.select(F.explode("tokens").alias("token"), wide(F.xxhash64("tokens")).alias("a"), wide(F.xxhash64(F.lit(1), "tokens")).alias("b"))
    rows = hashed.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    often = rows.filter(F.col("n") >= F.ceil(least))
    same = often.groupBy("n", "a", "b").agg(
        F.min(F.struct(F.length("token"), "token")).alias("m"), F.collect_list("token").alias("tokens")
    )
    return same.select(F.explode("tokens").alias("token"), F.col("m.token").alias("item"))


def mined(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (tokens, verdict, confidence, support) from rows of ``tokens`` and ``verdict``.

    A rule whose confidence a rule with one token less already reaches is left out.
    """
    label = F.when(F.col("verdict") == "block", F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    baskets = labelled.select(F.concat("tokens", F.array(label)).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = found.associationRules.select(
        F.array_sort("antecedent").alias("tokens"), F.get("consequent", F.lit(0)).alias("label"), "confidence", "support"
    )
    # Labels may stand on the right only.
    either = F.array(F.lit(ALLOW), F.lit(BLOCK))
    rules = materialise(rules.filter(F.col("label").isin(ALLOW, BLOCK) & ~F.arrays_overlap("tokens", either)))
    shorter = rules.select("tokens", "label", "confidence", F.explode("tokens").alias("_t")).select(
        F.array_remove("tokens", F.col("_t")).alias("_less"), "tokens", "label", "confidence"
    )
    known = rules.select(F.col("tokens").alias("_less"), "label", F.col("confidence").alias("_c"))
    needless = shorter.join(known, ["_less", "label"]).filter(F.col("_c") >= F.col("confidence"))
    kept = rules.join(needless.select("tokens", "label").distinct(), ["tokens", "label"], "left_anti")
    return kept.select("tokens", F.substring("label", 2, 99).alias("verdict"), "confidence", "support")


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Best rule of every distinct ``tokens`` row that has one: tokens, best(confidence, support, verdict)."""
    each = sets.select("tokens", F.explode("tokens").alias("token"))
    held = each.groupBy("token").agg(F.count(F.lit(1)).alias("_n"))
    ruled = rules.select(F.col("tokens").alias("needs"), "verdict", "confidence", "support")
    index = (
        ruled.select("*", F.explode("needs").alias("token"))
        .join(held, "token")
        .groupBy("needs", "verdict", "confidence", "support")
        .agg(F.min_by("token", F.struct("_n", "token")).alias("token"))
    )
    met = each.join(index, "token").filter(F.size(F.array_except("needs", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", "verdict")).alias("best")
    return met.groupBy("tokens").agg(best)


def judge(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Iterable[tuple[str, str, str]] = tuple(DOMAIN_RULES),
    default: str = DEFAULT,
    **mining,
) -> DataFrame:
    """page_id, host, path, rule, verdict, and the confidence of the mined rule where that decides."""
    url = F.col(url_col)
    parsed = pages.select(
        F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), tokens_of(url).alias("tokens")
    )
    parsed = parsed.withColumn("_fit", domain_rule(F.col("host"), F.col("path"), list(rules)))
    rows = materialise(parsed.select("page_id", "host", "path", "tokens", "_fit.rule", "_fit.verdict"))
    labelled = rows.filter("verdict IS NOT NULL")
    if labelled.isEmpty():
        return rows.withColumn("verdict", F.lit(default)).withColumn("confidence", F.lit(None).cast("double")).drop("tokens")
    items = materialise(items_of(labelled, mining.get("min_support", MIN_SUPPORT)))
    each = rows.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token")).join(items, "token")
    sets = materialise(each.groupBy("tokens").agg(F.array_sort(F.collect_set("item")).alias("items")))
    none = F.array().cast("array<string>")
    baskets = labelled.select("tokens", "verdict").join(sets, "tokens", "left")
    baskets = materialise(baskets.select(F.coalesce("items", none).alias("tokens"), "verdict"))
    open_sets = rows.filter("verdict IS NULL").select("tokens").distinct().join(sets, "tokens")
    open_sets = materialise(open_sets)
    best = matched(open_sets.select(F.col("items").alias("tokens")).distinct(), materialise(mined(baskets, **mining)))
    answers = materialise(open_sets.join(best.withColumnRenamed("tokens", "items"), "items").select("tokens", "best"))
    joined = rows.join(answers, "tokens", "left")
    return joined.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("verdict", "best.verdict", F.lit(default)).alias("verdict"),
        F.when(F.col("verdict").isNull(), F.col("best.confidence")).alias("confidence"),
    )

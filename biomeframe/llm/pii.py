"""Personal data: fixed patterns as seeds, and bootstrapped contexts that find more.

Emails, IP addresses, card and phone numbers found by fixed patterns are the
seeds. Every mention, a seed or any other run of words, has contexts: the two
words before it, and the words on both sides. A run is one word with an @, or all
adjacent words with digits that only blanks, dots, hyphens and brackets of one
line part, so that a number written with spaces is one instance. Contexts and
instances form a graph over the whole corpus. Per kind, a context's confidence is
the summed score of its distinct instances over their number plus one, given
enough of it; an unseen instance's score is the chance that at least one of its
confident contexts is right. Rounds of this run as Spark joins over distinct
edges until no score rises any more; instances above the threshold are added as spans of that kind
wherever they are mentioned, also by whole words inside a longer run that is no
instance itself; of parts inside each other the longest counts. Fixed spans always stay.

Texts are read once; what is written and joined are spans and mentions.

Defined results: null text is the empty text without spans; offsets count code
points, ends are exclusive; each row is a document, so repeated rows each get their
spans, while the graph counts distinct instances; ties between kinds go to the
first of ``KINDS``; whole texts are searched, however long; only id and text are read, so other columns cannot clash; an
empty table gives no rows.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biomeframe.session import materialise

LOG = logging.getLogger(__name__)

KINDS = ("email", "ip", "card", "phone")
MIN_SUPPORT, MIN_CONTEXT, MIN_INSTANCE = 3.0, 0.7, 0.8
# Scores only rise from round to round; they stand still once none rises by more than this.
STILL = 1e-9

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behinds only spare attempts that cannot match, so that long runs of digits stay linear.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT, MARK = re.compile("[0-9]"), re.compile("[0-9@]")
BLANK = r"[\x20\x09-\x0D]"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = ".,;:!?()[]{}<>\"'`"
# What stands between the words of one identifier: blanks, dots, hyphens and brackets, on one line.
JOINED = re.compile(r"[\x20\x09.()\[\]-]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain: the local part is the whole run before the @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        done = domain.end() if domain else at + 1
        if domain:
            yield start, done
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(DIGIT.findall(m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def core(text: str, a: int, b: int) -> tuple[int, int]:
    """``text[a:b]`` without the marks around it; a bracket stays if its partner is inside."""
    s, e = b - len(text[a:b].lstrip(EDGES)), a + len(text[a:b].rstrip(EDGES))
    if s >= e:
        return s, s
    for left, right in ("()", "[]"):
        inner = [c for c in text[s:e] if c in (left, right)]
        if s > a and text[s - 1] == left and inner[:1] == [right]:
            s -= 1
        if e < b and text[e] == right and inner[-1:] == [left]:
            e += 1
    return s, e


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[tuple]:
    """(start, end, instance, kind or None, contexts) of the spans, and of other runs of words with a digit or word with an @."""
    if not MARK.search(text):
        return []
    words = [m.span() for m in WORD.finditer(text)]
    plain = lambda i: text[slice(*words[i])].lower().strip(EDGES) if 0 <= i < len(words) else "^"
    found: list[tuple] = []
    run: tuple[int, int] | None = None  # first and last word of a run that may go on

    def close() -> None:
        nonlocal run
        if run:
            found.append((*core(text, words[run[0]][0], words[run[1]][1]), None, *run))
        run = None

    starts = iter(spans + [(len(text) + 1, -1, len(text) + 1)])
    span = next(starts)
    for i, (a, b) in enumerate(words):
        while span[2] <= a:
            span = next(starts)
        if span[0] < b:
            close()
            if span[0] >= a:  # the word in which a span starts stands for it
                last = i
                while last + 1 < len(words) and words[last + 1][0] < span[2]:
                    last += 1
                found.append((span[0], span[2], KINDS[span[1]], i, last))
        elif MARK.search(text, a, b) and MARK.search(text, *core(text, a, b)):
            s, e = core(text, a, b)
            if "@" in text[s:e]:
                close()
                found.append((s, e, None, i, i))
            elif run and JOINED.fullmatch(text, core(text, *words[run[1]])[1], s):
                run = (run[0], i)
            else:
                close()
                run = (i, i)
    close()
    return [
        (s, e, text[s:e].lower(), kind, [f"{plain(i - 2)} {plain(i - 1)} _", f"{plain(i - 1)} _ {plain(j + 1)}"])
        for s, e, kind, i, j in found
    ]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])
MENTION = pa.struct(
    [("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("instance", pa.string()), ("kind", pa.string()),
     ("contexts", pa.list_(pa.string()))]
)
PART = pa.schema(
    [("row", pa.int64()), ("run", pa.int64()), ("instance", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]
)
SPANS_SQL = "array<struct<kind:string,start:bigint,end:bigint,text:string>>"


def read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, base spans and mentions of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            numbers, base, seen = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                spans = base_spans(text)
                base.append([{"kind": KINDS[k], "start": s, "end": e, "text": text[s:e]} for s, k, e in spans])
                seen.append(
                    [
                        {"start": s, "end": e, "text": text[s:e], "instance": x, "kind": k, "contexts": c}
                        for s, e, x, k, c in mentions(text, spans)
                    ]
                )
                numbers.append(row)
                row += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int64()), batch.column(0), pa.array(base, pa.list_(SPAN)), pa.array(seen, pa.list_(MENTION))],
                names=["row", "doc_id", "base", "mentions"],
            )

    mention = "struct<start:bigint,end:bigint,text:string,instance:string,kind:string,contexts:array<string>>"
    return rows.mapInArrow(run, f"row bigint, doc_id {kind}, base {SPANS_SQL}, mentions array<{mention}>")


def bootstrapped(
    edges: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_context: float = MIN_CONTEXT,
    min_instance: float = MIN_INSTANCE,
) -> DataFrame:
    """Accepted unseen instances (instance, kind) from distinct edges (context, instance, kind or null)."""
    spark = edges.sparkSession
    size = edges.groupBy("context").agg(F.countDistinct("instance").alias("_n"))
    # Only contexts that enough seeds share can ever become confident at first; others may follow later.
    pairs = materialise(edges.select("context", "instance").distinct())
    size = materialise(size.filter(F.col("_n") >= min_support))
    seeds = materialise(edges.filter("kind IS NOT NULL").select("instance", "kind").distinct())
    unseen = pairs.join(seeds.select("instance").distinct(), "instance", "left_anti")
    unseen = materialise(unseen.join(size.select("context"), "context"))
    scores = seeds.withColumn("s", F.lit(1.0))
    found = spark.createDataFrame([], "instance string, kind string, s double")
    rounds = 0
    while True:
        rounds += 1
        total = pairs.join(scores, "instance").groupBy("context", "kind").agg(F.sum("s").alias("_sum"))
        confident = (
            total.filter(F.col("_sum") >= min_support)
            .join(size, "context")
            .withColumn("p", F.col("_sum") / (F.col("_n") + 1))
            .filter(F.col("p") >= min_context)
        )
        # 1 - product of (1 - p); p stays below 1.
        miss = F.exp(F.sum(F.log(1 - F.col("p"))))
        known = found.withColumnRenamed("s", "_was")
        found = materialise(
            unseen.join(confident, "context").groupBy("instance", "kind").agg((1 - miss).alias("s"))
        )
        # Scores below the threshold count as well: what rises there may lift another instance rounds later.
        risen = found.join(known, ["instance", "kind"], "left").filter(F.col("s") - F.coalesce("_was", F.lit(0.0)) > STILL)
        if risen.isEmpty():
            break
        scores = seeds.withColumn("s", F.lit(1.0)).unionByName(found)
    LOG.info("scores of personal data stood still after %d rounds", rounds)
    first = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    best = F.max(F.struct("s", (-first).alias("o"), "kind")).alias("b")
    accepted = found.groupBy("instance").agg(best).filter(F.col("b.s") >= min_instance)
    return accepted.select("instance", F.col("b.kind").alias("kind"))


def parts(runs: DataFrame, lengths: list[int]) -> DataFrame:
    """row, run, instance, start, end and text of the parts of runs (row, start, text) with so many words, but fewer than the run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, at, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = [m.span() for m in WORD.finditer(text)]
                for n in lengths:
                    spans = [core(text, words[i][0], words[i + n - 1][1]) for i in range(len(words) - n + 1) if n < len(words)]
                    for lot in range(0, len(spans), 1024):
                        cut = [(s, e, text[s:e]) for s, e in spans[lot : lot + 1024]]
                        out = [{"row": row, "run": at, "instance": t.lower(), "start": at + s, "end": at + e, "text": t} for s, e, t in cut]
                        yield pa.RecordBatch.from_pylist(out, PART)

    return runs.select("row", "start", "text").mapInArrow(run, "row bigint, run bigint, instance string, start bigint, end bigint, text string")


def marked(seen: DataFrame, accepted: DataFrame) -> DataFrame:
    """row, kind, start, end and text of accepted instances: whole runs, and in other runs the longest parts."""
    columns = ("row", "kind", "start", "end", "text")
    open_runs = seen.filter("m.kind IS NULL").select("row", "m.instance", "m.start", "m.end", "m.text")
    whole = open_runs.join(accepted, "instance").select(*columns)
    size = F.size(F.split("instance", f"{BLANK}+")).alias("n")
    lengths = [r["n"] for r in accepted.select(size).distinct().collect()]
    several = open_runs.filter(F.col("text").rlike(BLANK)).join(accepted, "instance", "left_anti")
    if not lengths:
        return whole
    found = parts(several, lengths).join(accepted, "instance")
    # Parts inside a longer one of the same run go: none that starts earlier, or there and is longer, may reach as far.
    before = Window.partitionBy("row", "run").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(before), F.lit(-1))
    return whole.unionByName(found.withColumn("_reach", reach).filter("end > _reach").select(*columns))


def ordered(spans: Column) -> Column:
    """Spans by start, then by kind as listed."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(
        spans, lambda s: F.struct(s["start"].alias("a"), F.array_position(kinds, s["kind"]).alias("b"), s["end"].alias("c"), s.alias("s"))
    )
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, ``base`` (spans of the fixed patterns) and ``spans`` (all), each with kind, start, end and text."""
    rows = materialise(read(docs, id_col, text_col))
    seen = rows.select("row", F.explode("mentions").alias("m"))
    edges = seen.select(F.explode("m.contexts").alias("context"), "m.instance", "m.kind").distinct()
    accepted = materialise(bootstrapped(materialise(edges), **how))
    more = marked(seen, accepted).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end", "text")).alias("more"))
    joined = rows.join(more, "row", "left")
    added = F.coalesce("more", F.array().cast(SPANS_SQL))
    return joined.select("doc_id", ordered(F.col("base")).alias("base"), ordered(F.concat("base", added)).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    each = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(each, ",")


def summary(found: DataFrame) -> DataFrame:
    """Counts per kind and digest of the base spans, and all spans as text."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.sha2(written(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", *map(count, KINDS), base, written(F.col("spans")).alias("spans"))

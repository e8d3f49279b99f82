"""URL filter by the ratio of two character language models, with DataFrame functions only.

Rules (host, path) judge the URLs they fit: a rule fits its host and all subdomains if the URL's
path starts with its path, and the longest rule wins.  What the rules accept and reject trains two
variable-order Markov models of URL characters; they judge the rest.

- Characters of the whole URL, scheme, query and fragment included, are reduced to 37 symbols (a-z, any digit as 0, nine marks, all else).
- P(c | context) backs off from three symbols of context to none, each order smoothed by the one
  below in proportion to how little its context was seen (add ``strength`` times the lower
  order's probability).
- A URL's score is the difference of its log-likelihoods, accepted less rejected, over its length.
- The limit is calibrated on a held-out quarter of the judged URLs: of all limits in steps of 1/64 the one
  with the best balanced accuracy.

What is broadcast is bounded by the alphabet: at most 38**3 rows of order 2 and, as there is a row
only for contexts seen, at most 38**4 of order 3, whatever the number of URLs.  Counting and
scoring aggregate map-side before anything is shuffled.

Defined results: a null URL or one without :// has an empty host and path, and a null or empty one score 0; with no
accepted or no rejected URL to learn from every score is 0 and the limit too, so all the rest is
allowed; equal URLs get equal scores; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored

MARKS = "./-_?=&%:"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
ALPHABET = LETTERS + "0" + MARKS
#: Symbol numbers: 0 start, 1-26 letters, 27 digits, 28-36 marks, 37 all else.
SIZE = 38
ORDER = 3
STRENGTH = 2.0


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, LETTERS.upper(), LETTERS)
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: len(r.name)):  # the longest is tested first
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def symbols(text: Column) -> Column:
    """array<int> of symbol numbers: the place in the alphabet, or the last number for all else."""
    plain = F.translate(F.lower(text), "0123456789", "0" * 10)
    place = lambda c: F.instr(F.lit(ALPHABET), c)
    return F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.when(place(c) > 0, place(c)).otherwise(F.lit(SIZE - 1)))


def with_grams(urls: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep and ``gram``, one row for each symbol of ``chars``: it and the three before it as digits
    of one number, oldest first."""
    # symbol numbers get a column of their own, or each gram would make them anew
    rows = urls.select(*keep, F.concat(F.array_repeat(F.lit(0), ORDER), symbols(F.col("chars"))).alias("codes")).where(F.size("codes") > ORDER)
    number = lambda i: sum(F.get("codes", i + k) * SIZE ** (ORDER - k) for k in range(ORDER + 1))
    return rows.select(*keep, F.explode(F.transform(F.sequence(F.lit(0), F.size("codes") - ORDER - 1), number)).alias("gram"))


def fit(urls: DataFrame, strength: float = STRENGTH) -> tuple[DataFrame, ...]:
    """``urls``: (chars, good boolean), the training rows.  Returns the log ratio by symbols, for orders 3 to 0."""
    counted = (
        with_grams(urls, "good")
        .groupBy("gram")
        .agg(F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(~F.col("good"), 1)).alias("bad"))
    )
    counted = stored(counted, "grams")
    spark = urls.sparkSession
    symbol, context = F.pmod(F.col("gram"), F.lit(SIZE)), F.expr(f"gram div {SIZE}")
    # order 0 for every symbol, then each order for every symbol in each context seen
    below = spark.range(1, SIZE).select(F.lit(0).alias("context"), F.col("id").cast("int").alias("symbol"), F.lit(1.0 / (SIZE - 1)).alias("p_good"), F.lit(1.0 / (SIZE - 1)).alias("p_bad"))
    tables = []
    for order in range(ORDER + 1):
        keep = SIZE**order
        here = counted.groupBy(F.pmod(context, F.lit(keep)).cast("int").alias("context"), symbol.cast("int").alias("symbol")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        seen = here.groupBy("context").agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
        grid = seen.withColumn("symbol", F.explode(F.sequence(F.lit(1), F.lit(SIZE - 1))))
        grid = grid.join(here, ["context", "symbol"], "left")
        lower = below.select(F.col("context").alias("low_context"), "symbol", F.col("p_good").alias("low_good"), F.col("p_bad").alias("low_bad"))
        grid = grid.withColumn("low_context", F.pmod(F.col("context"), F.lit(max(1, keep // SIZE))).cast("int")).join(lower, ["low_context", "symbol"])
        p = lambda side: (F.coalesce(F.col(side), F.lit(0)) + strength * F.col(f"low_{side}")) / (F.col(f"all_{side}") + strength)  # noqa: B023, E731
        below = stored(grid.select("context", "symbol", p("good").alias("p_good"), p("bad").alias("p_bad")), f"order{order}")
        tables.append(below.select((F.col("context") * SIZE + F.col("symbol")).alias(f"gram{order}"), F.log(F.col("p_good") / F.col("p_bad")).alias(f"ratio{order}")))
    return tuple(reversed(tables))


def likelihood(chars: DataFrame, model: tuple[DataFrame, ...]) -> DataFrame:
    """(chars, score) for each distinct value of ``chars``; repeats leave the mean as it is."""
    exploded = with_grams(chars, "chars")
    for order, table in zip(range(ORDER, -1, -1), model, strict=True):
        exploded = exploded.withColumn(f"gram{order}", F.pmod(F.col("gram"), F.lit(SIZE ** (order + 1))).cast("int"))
        exploded = exploded.join(F.broadcast(table), f"gram{order}", "left")  # at most SIZE ** (order + 1) rows
    ratio = F.coalesce(*(F.col(f"ratio{o}") for o in range(ORDER, -1, -1)), F.lit(0.0))
    return exploded.groupBy("chars").agg(F.avg(ratio).alias("score"))


def judged(pages: DataFrame, rules: tuple[UrlRule, ...]) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), score and limit: one row per row."""
    host, path = parts(F.col("url").cast("string"))
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), url.alias("chars"))
    rows = rows.withColumn("by_rule", rule_of(F.col("host"), F.col("path"), rules))
    known = rows.where("by_rule is not null").select("chars", (F.col("by_rule.verdict") == "allow").alias("good"))
    held = F.substr(F.md5(F.col("chars").cast("binary")), F.lit(1), F.lit(1)).isin("0", "4", "8", "c")
    model = fit(known.where(~held))
    scores = stored(likelihood(rows.select("chars"), model), "scores")
    limit = _calibrated(known.where(held), scores)
    out = rows.join(scores, "chars", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    verdict = F.coalesce(F.col("by_rule.verdict"), F.when(F.col("score") >= limit, "allow").otherwise("block"))
    return out.select("page_id", "host", "path", F.col("by_rule.rule").alias("rule"), verdict.alias("verdict"), "score", F.lit(limit).alias("limit"))


def _calibrated(known: DataFrame, scores: DataFrame, steps: int = 64) -> float:
    """The limit with the best balanced accuracy: of accepted URLs at or over it and rejected ones under it."""
    bins = (
        known.join(scores, "chars")
        .groupBy(F.greatest(F.least(F.floor(F.col("score") * steps), F.lit(1024)), F.lit(-1024)).alias("bin"))
        .agg(F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(~F.col("good"), 1)).alias("bad"))
    )
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most 2,049 rows
    total = bins.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    if not total.g or not total.b:
        return 0.0
    lost = F.coalesce(F.sum("good").over(upto), F.lit(0))
    stopped = F.coalesce(F.sum("bad").over(upto), F.lit(0))
    best = bins.select("bin", (stopped / total.b - lost / total.g).alias("gain")).orderBy(F.desc("gain"), F.abs("bin"), "bin").first()
    return best.bin / steps

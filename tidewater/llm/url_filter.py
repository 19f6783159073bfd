"""URL filter: block and allow rules first, a character language-model ratio for the rest, in
DataFrame functions.

Two smoothed variable-order Markov models of characters are counted, one over the URLs that a rule
accepts and one over those that a rule rejects. The probability of a character after the last
``ORDER`` characters is interpolated down to shorter contexts by Witten-Bell weights and ends at a
uniform distribution. A URL's score is the difference of its two log-likelihoods divided by its
number of characters. The threshold is calibrated on labelled URLs that training leaves out (one in
five, by hash): it is the score that separates their two classes best, as found on a histogram of
fixed resolution.

Only distinct URLs and distinct grams are scored. Probabilities are worked out order by order over the
table of grams: a gram meets the counts of its context and the probability of its own end, and of either
there are at most as many partners as there are characters, so no key of these joins is hot, whatever
the corpus. Counts are summed before any shuffle. The joins that bring scores of windows back to URLs,
and of URLs back to rows, have written tables on their small sides, so hot windows and hot URLs can be
split by adaptive execution.

Edge cases: a null URL, or one without ``://``, has an empty host and path and no rule; a URL
without characters scores 0 and is allowed; if either class has no labelled URL, every score is 0 and
every URL without a rule is allowed; equal URLs get equal verdicts; ids may repeat or be null; very long
URLs are scored whole; an empty table gives no rows; further columns pass through whatever their names,
a column that bears the name of a result being replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import storage

ORDER = 5
_STEP = 0.01  # resolution of the calibration histogram
_ALPHABET = 256.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _rule(verdict: str, text: str) -> UrlRule:
    host, _, path = text.partition("/")
    return UrlRule(verdict, host, f"/{path}")


RULES = (_rule("block", "com/en/"), _rule("allow", "example.com/en/7"), _rule("allow", "net/de/"), _rule("block", "example.net/de/8"), _rule("block", "org/es/"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path, never null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (of equally long ones, the longer host)."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host))):
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def _windows(text: Column) -> Column:
    """The ORDER + 1 characters that end at each character, and at the end mark."""
    chars = F.split(F.concat(F.lit("\u0002" * ORDER), text, F.lit("\u0003")), "")
    return F.transform(F.array(chars), lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - ORDER), lambda i: F.array_join(F.slice(c, i, ORDER + 1), "")))[0]


def window_scores(counts: DataFrame) -> DataFrame:
    """window, ratio: log P(last character | the others) of the accepted minus the rejected model.
    ``counts``: window, accepted, rejected (both 0 for windows that are only to be scored)."""
    suffixes = F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("k")
    gram = F.substring(F.col("window"), ORDER + 1 - F.col("k"), F.col("k") + 1)
    grams = counts.select("*", suffixes).groupBy(gram.alias("gram")).agg(F.sum("accepted").alias("na"), F.sum("rejected").alias("nr"))
    grams = grams.withColumn("length", F.length("gram")).withColumn("context", F.substring(F.col("gram"), F.lit(1), F.col("length") - 1))
    grams = storage.materialize(grams, "url-grams")
    contexts = grams.groupBy("context", "length").agg(F.sum("na").alias("ca"), F.sum("nr").alias("cr"), F.count_if(F.col("na") > 0).alias("ta"), F.count_if(F.col("nr") > 0).alias("tr"))
    counted = storage.materialize(grams.join(storage.materialize(contexts, "url-contexts"), ["context", "length"]), "url-counted", "length")

    def step(n: str, c: str, t: str, p: Column) -> Column:
        return F.when(F.col(c) > 0, (F.col(n) + F.col(t) * p) / (F.col(c) + F.col(t))).otherwise(p)

    found = None
    for length in range(1, ORDER + 2):
        level = counted.filter(F.col("length") == length)
        if found is None:
            before = level.withColumn("pa", F.lit(1 / _ALPHABET)).withColumn("pr", F.lit(1 / _ALPHABET))
        else:
            before = level.withColumn("end", F.substring(F.col("gram"), 2, length)).join(found, "end")
        found = before.select(F.col("gram").alias("end"), step("na", "ca", "ta", F.col("pa")).alias("pa"), step("nr", "cr", "tr", F.col("pr")).alias("pr"))
        found = storage.materialize(found, "url-probabilities")
    return found.select(F.col("end").alias("window"), (F.log("pa") - F.log("pr")).alias("ratio"))


def calibrate(scored: DataFrame) -> float:
    """The score with the largest sum of the shares of accepted URLs at or above it and of rejected
    ones below it, over rows (score, accepted). Between two scores that occur it is their middle, and
    of several equally good gaps the middle one."""
    bins = scored.groupBy(F.floor(F.col("score") / _STEP).alias("bin")).agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    rows = sorted((r.bin, r.a, r.r) for r in bins.collect())  # scores are bounded, so are the bins
    n_a, n_r = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not n_a or not n_r:
        return float("-inf")
    below_a = below_r = 0
    best, where, before = -1.0, [], rows[0][0] - 1
    for at, a, r in [*rows, (rows[-1][0] + 1, 0, 0)]:
        value = (n_a - below_a) / n_a + below_r / n_r
        if value > best + 1e-12:
            best, where = value, []
        if value > best - 1e-12:
            where.append((before + 1 + at) / 2)
        below_a, below_r, before = below_a + a, below_r + r, at
    return where[len(where) // 2] * _STEP


RESULTS = ("host", "path", "rule", "verdict", "score")


def filter_urls(pages: DataFrame, *, url_col: str = "url", rules=RULES) -> DataFrame:
    """The columns of ``pages``, host, path, rule, verdict and score (null where a rule decides)."""
    rows = storage.numbered(pages)
    url = F.col(rows.columns[pages.columns.index(url_col)])
    host, path = url_parts(url)
    rule, by_rule = match_rule(F.col("host"), F.col("path"), rules)
    at = F.locate("://", url)
    text = F.translate(F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(url), F.lit("")), _UPPER, _LOWER)
    parsed = rows.withColumn("host", host).withColumn("path", path).withColumn("rule", rule).withColumn("by_rule", by_rule).withColumn("text", text)
    with storage.scratch(pages.sparkSession) as keep:
        # paths keep their case, so one text may have several labels; numbers are fixed once they are written
        urls = storage.materialize(parsed.filter("text != ''").select("text", "by_rule").distinct().withColumn("number", F.monotonically_increasing_id()), "url-texts")
        held_out = F.pmod(F.xxhash64("text"), F.lit(5)) == 0
        windows = urls.select("number", F.col("by_rule").alias("label"), held_out.alias("held_out"), F.explode(_windows(F.col("text"))).alias("window"))
        counts = windows.groupBy("window").agg(F.count_if((F.col("label") == "allow") & ~F.col("held_out")).alias("accepted"), F.count_if((F.col("label") == "block") & ~F.col("held_out")).alias("rejected"))
        counts = storage.materialize(counts, "url-windows")
        either = counts.agg(F.sum("accepted"), F.sum("rejected")).first()
        if all(either):
            ratios = window_scores(counts)
            summed = windows.select("number", "window").join(ratios, "window").groupBy("number").agg(F.round(F.avg("ratio"), 9).alias("score"))
            scored = storage.materialize(urls.withColumn("held_out", held_out).join(summed, "number"), "url-scores")
            threshold = calibrate(scored.filter("held_out AND by_rule IS NOT NULL").select("score", (F.col("by_rule") == "allow").alias("accepted")))
            scores = keep(scored.groupBy("text").agg(F.max("score").alias("found")), "url-text-scores")
            judged = parsed.join(scores, "text", "left")
        else:
            threshold, judged = float("-inf"), parsed.withColumn("found", F.lit(0.0))
    found = F.coalesce("found", F.lit(0.0))
    verdict = F.when((F.col("text") == "") | (found >= F.lit(threshold)), "allow").otherwise("block")
    passed = [c for name, c in zip(pages.columns, storage.renamed(pages), strict=True) if name not in RESULTS]
    return judged.select(*passed, "host", "path", "rule", F.coalesce("by_rule", verdict).alias("verdict"), F.when(F.col("rule").isNull(), found).alias("score"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")

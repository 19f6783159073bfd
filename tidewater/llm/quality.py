"""Quality rules as a short-circuit cascade, in DataFrame functions only.

The base test of a whole text comes first; a document that fails it isn't looked at again. The other
rules form a cascade: on a sample the cost of each rule and the share it rejects are estimated, and the
rules run in order of rejection per cost, inside one CASE expression that stops at the first rejection.
A rule's cost holds what it has to measure: ``judge``, which reports the measures of every document,
lends them to the rules; ``accepted``, which only says who stays, has each rule take its own, and takes
none for documents that an earlier rule has rejected. The order never changes a verdict, so neither does
the sample.

Edge cases: a null text has no words; a text without words has zeros everywhere and fails the base
test; lines without a word are never counted; equal rows are judged alike; further columns pass
through whatever their names, except that ``judge`` replaces those that bear a result's name; an empty
table gives no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import storage

_SPACE = " \t\n\x0b\x0c\r"
_SPACES = r"[\x20\x09-\x0D]+"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rows, about, whose cost and rejection are measured; any other number gives the same verdicts.
SAMPLE_ROWS = 2_000
#: Runs over the sample, of which the fastest counts.
_RUNS = 3

#: The measures by name, and ``text`` (never null), as columns or as expressions over them.
Measures = dict[str, Column]


@dataclass(frozen=True)
class Rule:
    """``rejects`` is given the measures; null counts as false."""

    name: str
    rejects: Callable[[Measures], Column]


def words_of(text: Column) -> Column:
    """The maximal runs of characters other than U+0020 and U+0009 to U+000D."""
    trimmed = F.btrim(text, F.lit(_SPACE))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACES, -1))


def _without(text: Column, pattern: str) -> Column:
    """Characters that the pattern takes away."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(_SPACE)) != "")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with value evaluated once for all uses inside lambdas."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur at two places of the text or more: windows are compared
    by hash in sorted order, then the union of the repeated windows' extents is summed up."""
    n = F.size(words)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))).otherwise(F.array().cast("array<bigint>"))

    def covered(win: Column) -> Column:
        by_hash = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(a: Column) -> Column:
            def same(x: Column, k: Column) -> Column:
                before = F.when(k > 0, F.get(a, k - 1)["h"] == x["h"]).otherwise(False)
                after = F.when(k < F.size(a) - 1, F.get(a, k + 1)["h"] == x["h"]).otherwise(False)
                return before | after

            return F.transform(F.filter(a, same), lambda x: x["i"])

        starts = F.sort_array(_bound(by_hash, repeated))
        zero = F.struct(F.lit(0).alias("c"), F.lit(0).alias("e"))
        return F.aggregate(starts, zero, lambda acc, p: F.struct((acc["c"] + F.least(F.lit(3), p + 3 - acc["e"])).alias("c"), (p + 3).alias("e")), lambda acc: acc["c"])

    return _bound(windows, lambda win: F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(covered(win)))


def _fixed(frame: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns through a generator of one row. The optimizer moves neither projections nor
    filters through it, so what they are computed from is never copied into another expression,
    where a lambda would evaluate it again for every word."""
    return frame.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _expressions() -> Measures:
    """Over ``_text`` and ``_words``."""
    text, words = F.col("_text"), F.col("_words")
    found = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": _without(text, r"[#*$%&|<>]+"),
        "n_dup_lines": _bound(_lines_with_words(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))),
        "n_repeat_words": _repeat_words(words),
    }
    return {k: v.cast("long") for k, v in found.items()}


def _packed(docs: DataFrame, text_col: str) -> DataFrame:
    """The columns of ``docs`` under numbered names, which can't clash, _text and _words."""
    rows = storage.numbered(docs)
    text = F.coalesce(F.col(rows.columns[docs.columns.index(text_col)]), F.lit(""))
    return _fixed(rows.withColumn("_text", text), {"_words": words_of(F.col("_text"))})


def _measured(packed: DataFrame) -> tuple[DataFrame, Measures]:
    """All measures as columns, and how rules see them."""
    return _fixed(packed, _expressions()), {"text": F.col("_text")} | {m: F.col(m) for m in MEASURES}


def _based(packed: DataFrame) -> tuple[DataFrame, Measures]:
    """What the base test needs as columns, and the other measures as rules would take them. Repeats
    aren't looked for in texts that are too short."""
    found = _expressions()
    rows = _fixed(packed, {"n_words": found["n_words"]})
    rows = _fixed(rows, {"n_repeat_words": F.when(F.col("n_words") >= 50, found["n_repeat_words"]).otherwise(F.lit(0))})
    return rows, found | {"text": F.col("_text"), "n_words": F.col("n_words")}


BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def default_rules() -> list[Rule]:
    def many_repeated_lines(m: Measures) -> Column:
        return _bound(_lines_with_words(m["text"]), lambda lines: 2 * (F.size(lines) - F.size(F.array_distinct(lines))) > F.size(lines))

    return [
        Rule("many_symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
        Rule("mean_word_length", lambda m: (m["word_chars"] < 3 * m["n_words"]) | (m["word_chars"] > 10 * m["n_words"])),
        Rule("upper_case", lambda m: 10 * _without(m["text"], r"\p{Lu}+") > 3 * m["word_chars"]),
        Rule("repeated_lines", many_repeated_lines),
    ]


def _rejects(rule: Rule, measures: Measures) -> Column:
    return F.coalesce(rule.rejects(measures), F.lit(False))


def order_rules(sample: DataFrame, measures: Measures, rules: list[Rule]) -> list[Rule]:
    """By rejections per second over ``sample``, most first. A rule's time is that of the fastest of some
    runs, less that of a run without a rule, which has the launch and the scan."""

    def run(column: Column) -> tuple[float, int]:
        times, query = [], sample.select(F.count_if(column))
        for _ in range(_RUNS):
            began = time.perf_counter()
            n = query.first()[0]
            times.append(time.perf_counter() - began)
        return min(times), n

    idle = run(F.length("_text") + F.size("_words") + F.col("n_words") < 0)[0]
    scored = []
    for rule in rules:
        seconds, rejected = run(_rejects(rule, measures))
        scored.append(((rejected + 0.5) / max(seconds - idle, 1e-3), rule))
    return [rule for _, rule in sorted(scored, key=lambda x: -x[0])]


def _ordered(docs: DataFrame, text_col: str, prepare, rules: list[Rule] | None, sample_rows: int) -> list[Rule]:
    rules = default_rules() if rules is None else rules
    if len(rules) < 2:
        return rules
    # as many rows from each part of the input as their share, so that no task gathers more
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = docs.select(F.col(f"`{text_col}`").alias("text")).sample(share, seed=0)
    rows, measures = prepare(_packed(sample, "text"))
    # only what passes the base test reaches a rule
    with storage.scratch(docs.sparkSession):
        return order_rules(storage.materialize(rows.filter(f"NOT ({BASE_FAILED})"), "quality-sample"), measures, rules)


def _cascade(rules: list[Rule], measures: Measures) -> Column:
    """Whether a document stays."""
    verdict = F.when(F.expr(BASE_FAILED), False)
    for rule in rules:
        verdict = verdict.when(_rejects(rule, measures), False)
    return verdict.otherwise(True)


def judge(docs: DataFrame, *, text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The columns of ``docs``, the measures, base_failed and kept."""
    rules = _ordered(docs, text_col, _measured, rules, sample_rows)
    rows, measures = _measured(_packed(docs, text_col))
    results = [*MEASURES, "base_failed", "kept"]
    passed = [c for name, c in zip(docs.columns, storage.renamed(docs), strict=True) if name not in results]
    return rows.select(*passed, *MEASURES, F.expr(BASE_FAILED).alias("base_failed"), _cascade(rules, measures).alias("kept"))


def accepted(docs: DataFrame, *, text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that are kept."""
    rules = _ordered(docs, text_col, _based, rules, sample_rows)
    rows, measures = _based(_packed(docs, text_col))
    return rows.filter(_cascade(rules, measures)).select(*storage.renamed(docs))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", *MEASURES, "base_failed", "kept")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS k FROM documents),
e AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
w AS (SELECT k, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM e),
v AS (SELECT k, i, word AS a, lead(word) OVER p AS b, lead(word, 2) OVER p AS c FROM w WINDOW p AS (PARTITION BY k ORDER BY i)),
g AS (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM v WHERE c IS NOT NULL),
r AS (SELECT k, count(DISTINCT i + o) AS n FROM g, (VALUES (0), (1), (2)) AS x(o) WHERE g.n > 1 GROUP BY k),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
             length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper, len(lines) AS n_lines
      FROM e LEFT JOIN r USING (k)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words
            OR 10 * n_upper > 3 * word_chars OR 2 * n_dup_lines > n_lines) AS kept
FROM b
"""

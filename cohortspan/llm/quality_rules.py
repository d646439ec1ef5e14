"""Quality rules as a short-circuit cascade.

Each rule is an expression that rejects a document. On a bounded sample the cascade measures what
share a rule rejects and how long it takes, then asks the rules in order of rejections per second:
a document meets no rule behind the first that rejects it. DataFrame functions only.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.llm.common import SPACES, WORD, table, text_or_empty
from cohortspan.llm.registry import query

#: Fixed value: what counts as a symbol.
SYMBOLS = r"[#*$%&|<>]"
#: Words in the windows that show repetition.
WINDOW = 5


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Maximal runs of characters outside [\\x20\\x09-\\x0D]."""
    return F.filter(F.split(text, SPACES, -1), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def word_chars(text: Column) -> Column:
    return (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOLS)).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(text: Column) -> Column:
    """Words inside 5-word windows that the text holds twice or more, first ones included.

    Windows are compared by a 64-bit hash of word hashes inside one text. Only texts with a window
    found twice go on to sort their windows; positions of equal neighbours then cover words.
    """
    hashes = F.transform(words_of(text), lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - WINDOW)
        of = F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        return F.when(F.size(h) >= WINDOW, of)

    def covered(found: Column) -> Column:
        def positions(s: Column) -> Column:
            def twin(x: Column, i: Column) -> Column:
                before = F.when(i > 0, F.get(s, i - 1)["w"] == x["w"])
                after = F.get(s, i + 1)["w"] == x["w"]
                return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

            return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["at"]))

        at = _let(F.array_sort(F.transform(found, lambda w, i: F.struct(w.alias("w"), i.alias("at")))), positions)
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            at,
            start,
            lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )

    def count(found: Column) -> Column:
        return F.when(F.size(F.array_distinct(found)) < F.size(found), covered(found)).otherwise(F.lit(0).cast("long"))

    return F.coalesce(_let(_let(hashes, windows), count), F.lit(0).cast("long"))


#: Measures by name, each from a text alone.
MEASURES = {
    "n_words": n_words,
    "word_chars": word_chars,
    "n_symbols": n_symbols,
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words,
}


@dataclass(frozen=True)
class Rule:
    """Rejects a document where ``fails``, given measures by name, is true."""

    name: str
    needs: tuple[str, ...]
    fails: Callable[[Mapping[str, Column]], Column]


#: The production rules: small whole-number ratios, so that every engine decides alike.
RULES = (
    Rule("few_words", ("n_words",), lambda m: m["n_words"] < 10),
    Rule("repeats", ("n_repeat_words", "n_words"), lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    Rule("symbols", ("n_symbols", "n_words"), lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule(
        "word_length",
        ("word_chars", "n_words"),
        lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"]),
    ),
    Rule("repeated_lines", ("n_dup_lines", "n_words"), lambda m: 20 * m["n_dup_lines"] > m["n_words"]),
)
#: Rules that a document must pass whatever else is asked.
BASE = ("few_words", "repeats")


def rejects(rule: Rule, measured: Mapping[str, Column], text: Column | None = None) -> Column:
    """The rule over given measures; those that it needs besides are taken from ``text``."""
    known = {name: measured[name] if name in measured else MEASURES[name](text) for name in rule.needs}
    return F.coalesce(rule.fails(known), F.lit(False))


#: A rule is timed on so many passes over the sample that it takes this many times what an empty job takes, at
#: most ``MOST_PASSES``.
OUTWEIGHS, MOST_PASSES = 1, 256


def text_sample(documents: DataFrame, sample_rows: int) -> DataFrame:
    """About ``sample_rows`` texts from all over the table, in one partition: a seeded draw whose share
    the row count sets."""
    share = min(1.0, sample_rows / max(documents.count(), 1))
    return documents.select(text_or_empty().alias("text")).sample(share, seed=1).repartition(1)


def seconds_a_pass(sample: DataFrame, hit: Column) -> float:
    """What ``hit`` takes on every row of ``sample``, beyond an empty job over the same rows.

    Passes rise until the expression outweighs the job. The better of two times counts.
    """

    def timed(what: Column, passes: int) -> float:
        again = sample.select("text", F.explode(F.sequence(F.lit(1), F.lit(passes))))
        times = []
        for _ in range(2):
            begin = time.perf_counter()
            again.agg(F.count_if(what)).first()
            times.append(time.perf_counter() - begin)
        return min(times)

    passes = 4
    while True:
        empty = timed(F.col("text").isNull(), passes)
        seconds = timed(hit, passes) - empty
        if seconds > OUTWEIGHS * empty or passes >= MOST_PASSES:
            return max(seconds, 1e-6) / passes
        passes *= 4


def sampled_order(
    documents: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 400
) -> list[Rule]:
    """Rules by rejections per second, as measured on about ``sample_rows`` documents.

    Times only set the order, never the verdict. The sample is the one thing here that is bounded;
    it takes no part in any count. Rules that reject nothing in it are not timed and come last, in
    their given order.
    """
    sample = text_sample(documents, sample_rows).cache()
    rejected = [rejects(rule, {}, F.col("text")) for rule in rules]
    hits = sample.agg(*[F.count_if(hit).alias(f"hits{i}") for i, hit in enumerate(rejected)]).first()
    rates = [n and n / seconds_a_pass(sample, hit) for n, hit in zip(hits, rejected)]
    sample.unpersist()
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -rates[i])]


def first_failure(order: Sequence[Rule], measured: Mapping[str, Column], text: Column | None = None) -> Column:
    """Name of the first rule in ``order`` that rejects, null for none; later rules are not run."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(order):
        verdict = F.when(rejects(rule, measured, text), F.lit(rule.name)).otherwise(verdict)
    return verdict


def first_failure_of(order: Sequence[Rule], text: Column) -> Column:
    """The same from a text alone. Every rule asks for the words, so these are counted once."""
    return _let(n_words(text), lambda n: first_failure(order, {"n_words": n}, text))


def quality_filter(documents: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 400) -> DataFrame:
    """Documents that no rule rejects; all columns are kept.

    A null text counts as empty and so has no words. Rows are judged one by one: repeated rows and
    null ids change nothing, an empty table gives an empty table.
    """
    order = sampled_order(documents, rules, sample_rows)
    return documents.where(first_failure_of(order, text_or_empty()).isNull())


def measured_verdicts(documents: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 400) -> DataFrame:
    """All measures, ``base_failed`` and ``kept`` of every document, for reports.

    The measures are wanted for every row here, so the cascade runs over them instead of the text.
    """
    order = sampled_order(documents, rules, sample_rows)
    text = text_or_empty()
    measured = documents.select("doc_id", *[of(text).alias(name) for name, of in MEASURES.items()])
    columns = {name: F.col(name) for name in MEASURES}
    base = [rule for rule in rules if rule.name in BASE]
    return measured.select(
        "*",
        first_failure(base, columns).isNotNull().alias("base_failed"),
        first_failure(order, columns).isNull().alias("kept"),
    )


SQL = """
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(0, 5)) AS k FROM twice) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), measured AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM words d LEFT JOIN lines l ON d.doc_id = l.doc_id LEFT JOIN covered c ON d.doc_id = c.doc_id
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured
)
SELECT *, NOT base_failed AND NOT (10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
  OR 20 * n_dup_lines > n_words) AS kept FROM judged
"""


@query("op5_quality_rules", SQL)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured_verdicts(table(spark, sf_dir, "documents"))

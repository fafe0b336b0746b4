"""Quality rules in a short-circuit cascade, with DataFrame functions only.

A rule is a named condition on measures of a text; a document is kept if no rule rejects it, so the
rules' order cannot change the verdict, only the work. `plan` takes a hashed sample of about `SAMPLE` rows,
counts on the executors the work that each rule's measures need on it (`WORK`) and the share that the rule rejects, and
orders the rules by rejection per work, in one aggregation: the same table gives the same order. The
rules are chained in that order, so that a document meets the next rule only if the one before has passed it, and a
dear measure is not made for documents that a cheap one rejects. `judged` returns some measures of every row;
what only later rules need is made inside the chain.

Words are runs of bytes other than 0x20 and 0x09-0x0D. Defined results: a null text has no words and
fails; an empty table gives an empty result; rows are judged one by one, so repeated rows get equal
results; texts are never cut. Columns of the input that clash with a measure's name do no harm.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import read

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Rows on which the rules' costs and selectivity are estimated, about; all rows of smaller tables.
SAMPLE = 10_000
#: Up to so many different repeated windows are looked up in a list; more are found by sorting.
FEW = 48


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return let(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[ \t-\r]+")))


def _n_words(text: Column, words: Column) -> Column:
    return F.size(words).cast("long")


def _word_chars(text: Column, words: Column) -> Column:
    return F.char_length(F.array_join(words, "")).cast("long")


def _n_symbols(text: Column, words: Column) -> Column:
    rest = F.coalesce(text, F.lit(""))
    for c in SYMBOLS:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return (F.octet_length(F.coalesce(text, F.lit(""))) - F.octet_length(rest)).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def _n_lines(text: Column, words: Column) -> Column:
    return F.size(_lines(text)).cast("long")


def _n_dup_lines(text: Column, words: Column) -> Column:
    return let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _covered(at: Column) -> Column:
    """Words in the 3-word windows that begin at these ascending places."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda s, i: F.struct((s["n"] + i + 3 - F.greatest(s["end"], i)).alias("n"), (i + 3).alias("end"))
    return F.aggregate(at, zero, step, lambda s: s["n"])


def _n_repeat_words(text: Column, words: Column) -> Column:
    size = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), size - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def looked_up(h: Column, twice: Column) -> Column:
        return _covered(F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(twice, F.get(h, i))))

    def by_sorting(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda s: F.filter(s, lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False))))
        return _covered(F.sort_array(F.transform(twice, lambda x: x["i"])))

    def repeated(h: Column) -> Column:
        again = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: F.coalesce(x == F.get(s, k - 1), F.lit(False)))))
        return let(again, lambda d: F.when(F.size(d) == 0, 0).when(F.size(d) <= FEW, looked_up(h, d)).otherwise(by_sorting(h)))

    return F.when(size < 3, F.lit(0)).otherwise(let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(repeated(h)))).cast("long")


MEASURES = {"n_words": _n_words, "word_chars": _word_chars, "n_symbols": _n_symbols, "n_lines": _n_lines, "n_dup_lines": _n_dup_lines, "n_repeat_words": _n_repeat_words}


#: The measures that `judged` returns of every row.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A document is rejected where `rejects` holds; it is given a function from a measure's name to its column."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


BASE = (
    Rule("too_short", lambda m: m("n_words") < 50),
    Rule("repeated_words", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
)
RULES = (
    *BASE,
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("repeated_lines", lambda m: (m("n_dup_lines") > 3) & (100 * m("n_dup_lines") > 30 * m("n_lines"))),
    Rule("short_words", lambda m: m("word_chars") < 2 * m("n_words")),
    Rule("long_words", lambda m: m("word_chars") > 15 * m("n_words")),
)


#: Nanoseconds of a measure for a byte of the text and for a word, measured once on prose.
WORK = {"n_words": (0, 4), "word_chars": (0, 90), "n_symbols": (45, 0), "n_lines": (17, 0), "n_dup_lines": (17, 0), "n_repeat_words": (0, 700)}


def _work(rule: Rule, text: Column, words: Column) -> Column:
    """Nanoseconds that the rule's measures take for a text."""
    used: list[str] = []
    rule.rejects(lambda name: (used.append(name), F.lit(0))[1])
    size, n = F.coalesce(F.octet_length(text), F.lit(0)), F.size(words)
    return sum((size * a + n * b for a, b in (WORK[name] for name in dict.fromkeys(used))), F.lit(1)).cast("double")


def _of_text(text: Column, words: Column) -> Callable[[str], Column]:
    return lambda name: MEASURES[name](text, words)


def verdict(rules: tuple[Rule, ...], measure: Callable[[str], Column]) -> Column:
    """Whether no rule rejects: one CASE, so later rules are not evaluated for a rejected row."""
    out = None
    for r in rules:
        out = F.when(r.rejects(measure), False) if out is None else out.when(r.rejects(measure), False)
    return F.lit(True) if out is None else out.otherwise(True)


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE) -> list[tuple[Rule, float, float]]:
    """(rule, work a document, share rejected) in the order of rejection per work, from a hashed sample of about `rows` rows."""
    text = F.col("text")
    share = min(1.0, rows / max(docs.count(), 1))
    some = docs.where(F.pmod(F.xxhash64(*(c for c in ("doc_id", "text") if c in docs.columns)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    each = let(words_of(text), lambda w: F.array(*(F.struct(_work(r, text, w).alias("work"), r.rejects(_of_text(text, w)).cast("double").alias("out")) for r in rules)))
    some = some.select(each.alias("m"))
    found = some.agg(*(F.avg(F.col("m")[k][c]).alias(f"{c}{k}") for k in range(len(rules)) for c in ("work", "out"))).first()
    measured = [(r, found[f"work{k}"] or 1.0, found[f"out{k}"] or 0.0) for k, r in enumerate(rules)]
    return sorted(measured, key=lambda x: (-x[2] / x[1], x[1]))


def kept(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that no rule rejects, all columns as they are."""
    ordered = tuple(r for r, _, _ in plan(docs, rules))
    return docs.where(let(words_of(F.col("text")), lambda w: verdict(ordered, _of_text(F.col("text"), w))))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, the measures, base_failed, kept) for every row of docs (doc_id, text)."""
    text = F.col("text")
    ordered = tuple(r for r, _, _ in plan(docs, tuple(r for r in rules if r not in BASE)))
    every = let(words_of(text), lambda w: F.struct(*(MEASURES[name](text, w).alias(name) for name in REPORTED)))
    out = docs.select("doc_id", "text", every.alias("m"))
    made = lambda name: F.col(f"m.{name}") if name in REPORTED else let(words_of(text), lambda w: MEASURES[name](text, w))
    failed = ~verdict(BASE, made)
    out = out.select("doc_id", "text", "m", failed.alias("base_failed"))
    keeps = F.when(F.col("base_failed"), False).otherwise(verdict(ordered, made))
    return out.select("doc_id", "m.*", "base_failed", keeps.alias("kept"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH w AS (
  SELECT doc_id, rid, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM (SELECT doc_id, text, row_number() OVER () AS rid FROM documents)
), windows AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + k AS p FROM again, range(3) r(k)) GROUP BY rid
), measured AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) AS n_lines,
         len(list_distinct(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS n_own,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_lines - n_own AS BIGINT) AS n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
            OR (n_lines - n_own > 3 AND 100 * (n_lines - n_own) > 30 * n_lines) OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM measured
"""

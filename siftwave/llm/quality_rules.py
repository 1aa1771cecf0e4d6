"""Quality rules: one threshold table compiled into one projection of built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwave.llm.storage import let

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
# Frequent function words of the four languages that the rules expect.
STOP_WORDS = (
    "the be to of and that have with is in it for was are on at by or an he this from "
    "der die das und ist im mit den ein eine zu von nicht auf für sich "
    "le la les de des et un une est en que pour dans qui avec sur pas "
    "el los las del y que se con para una por lo no es al"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes while low <= numerator / denominator <= high; a zero denominator passes."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("few_words", "n_words", "one", low=50),
    Rule("repeated_windows", "n_repeat_words", "n_words", high=0.5),
    Rule("word_length", "word_chars", "n_words", low=2.0, high=14.0),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=0.5),
)
BASE_RULES = ("few_words", "repeated_windows")


def _spread(starts: Column) -> Column:
    """How many positions the 3-word windows at these ascending starts cover."""
    zero = F.struct(F.lit(-3).cast("int").alias("prev"), F.lit(0).cast("int").alias("n"))
    step = lambda acc, p: F.struct(p.alias("prev"), (acc["n"] + F.least(F.lit(3), p - acc["prev"])).cast("int").alias("n"))
    return F.aggregate(starts, zero, step, lambda acc: acc["n"])


def _covered(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, each word once.

    Sorting the window hashes shows which repeat. Most texts repeat few or none, and then a
    short list is looked up; otherwise windows are sorted together with their positions.
    """

    def many(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        same = lambda w, other: F.coalesce(w["h"] == other["h"], F.lit(False))

        def marked(w: Column) -> Column:
            near = lambda x, i: same(x, F.get(w, i - 1)) | same(x, F.get(w, i + 1))
            return _spread(F.array_sort(F.transform(F.filter(w, near), lambda x: x["p"])))

        return let(pairs, marked)

    def few(hashes: Column, repeated: Column) -> Column:
        at = F.transform(hashes, lambda h, i: F.when(F.array_contains(repeated, h), i))
        return _spread(F.filter(at, F.isnotnull))

    def count(hashes: Column) -> Column:
        repeats = lambda s: F.filter(s, lambda h, i: F.coalesce(h == F.get(s, i - 1), F.lit(False)))
        choose = lambda r: F.when(F.size(r) == 0, 0).when(F.size(r) <= 16, few(hashes, r)).otherwise(many(hashes))
        return let(F.sort_array(hashes), lambda s: let(repeats(s), choose))

    first = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    return let(F.transform(first, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), count)


def _measures(text: Column, covered) -> Column:
    """A struct of every quantity that rules may name; covered: words -> their count in repeated windows."""
    words = F.array_remove(F.split(text, SPACE + "+"), "")
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda items, test: F.size(F.filter(items, test))

    def both(w: Column, s: Column) -> Column:
        long = lambda c, name: c.cast("long").alias(name)
        return F.struct(
            F.lit(1).cast("long").alias("one"),
            long(F.size(w), "n_words"),
            long(F.length(F.array_join(w, "")), "word_chars"),
            long(F.regexp_count(text, F.lit(SYMBOLS)), "n_symbols"),
            long(F.size(s) - F.size(F.array_distinct(s)), "n_dup_lines"),
            long(covered(w), "n_repeat_words"),
            long(count(w, lambda x: x.isin(STOP_WORDS)), "n_stop_words"),
            long(F.size(s), "n_lines"),
            long(count(s, lambda x: x.rlike(r"^\s*[-*•]\s")), "n_bullet_lines"),
            long(count(s, lambda x: x.rlike(r"(\.\.\.|…)\s*$")), "n_ellipsis_lines"),
        )

    return let(words, lambda w: let(lines, lambda s: both(w, s)))


def _holds(rule: Rule, m: Column) -> Column:
    a, b = m[rule.numerator], m[rule.denominator]
    tests = [a >= rule.low * b] * (rule.low is not None) + [a <= rule.high * b] * (rule.high is not None)
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out | (b == 0)


def score_quality(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, out: str = "quality") -> DataFrame:
    """df with a struct column `out`: the measures, `failed` (names of broken rules, in table order) and `kept`.

    A null text counts as empty: no words, so it breaks `few_words`. Very long texts, ties and
    repeated rows need no special case, since a row depends on its own text alone. Other columns
    stay; a column that is already named `out` is replaced.
    """

    def verdict(m: Column) -> Column:
        failed = F.filter(F.array(*[F.when(~_holds(r, m), F.lit(r.name)) for r in rules]), F.isnotnull)
        return let(failed, lambda f: F.struct(m.alias("m"), f.alias("failed"), (F.size(f) == 0).alias("kept")))

    value = F.coalesce(df[text].cast("string"), F.lit(""))
    return df.withColumn(out, let(value, lambda t: let(_measures(t, _covered), verdict)))


def quality_rows(df: DataFrame) -> DataFrame:
    """The digest columns of op9 for a table of documents."""
    q = score_quality(df.select("doc_id", "text"), "text", RULES, "_q")
    base = F.exists(F.col("_q.failed"), lambda name: name.isin(*BASE_RULES))
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return q.select("doc_id", *[F.col(f"_q.m.{c}").alias(c) for c in cols], base.alias("base_failed"), F.col("_q.kept").alias("kept"))

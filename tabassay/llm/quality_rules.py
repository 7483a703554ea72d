"""Quality rules whose thresholds follow each language and source.

Every text gets a few counts. Per language and source, the counts' ratios go into
histograms with buckets of a fixed relative width. Such a histogram is a quantile
sketch that merges by adding counts, so any number of tasks fills it and the
result never depends on their order. The quartiles read from the sketches give
fences, and documents outside the fences of their group are rejected.

No fence is a fixed value. It starts at the group's own quartile, and its distance
is the group's own spread. Where most values are equal the spread says nothing;
what a few events change in a document of the group's median size stands in for it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabassay.llm.shared import same, written

SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = "[ \\t-\\r]"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """A ratio in parts per thousand; a value outside the fences is refused.

    The fences lie `reach` spreads outside the quartiles. The spread is the distance
    of the quartiles or, if larger, what `events` more in the numerator change in a
    document of the median size of its group: events / (median + events).
    """

    name: str
    numerator: str
    denominator: str
    events: int
    lower: bool = False
    reach: int = 4


RULES = (
    Rule("symbols", "n_symbols", "n_words", 10),
    Rule("dup_lines", "n_dup_lines", "n_lines", 1),
    # A sentence of ten words that stands twice.
    Rule("repeats", "n_repeat_words", "n_words", 20),
    # About what chance adds to or takes from the characters of some hundred words.
    Rule("word_length", "word_chars", "n_words", 40, lower=True),
)
#: A group's quartiles are averaged with those of its language, which count as this many rows, and these with
#: those of all rows in the same way.
PRIOR_ROWS = 20
#: Groups up to which their fences are broadcast.
FEW_GROUPS = 100_000


def _minus(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def text_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    Words are runs of characters other than space and \\t to \\r. A NULL text counts
    as empty. `n_lines` counts lines with a word; `n_dup_lines` those equal to an
    earlier line. `n_repeat_words` counts the words in windows of three words that
    the text holds at least twice.
    """
    words, lines, runs, at = "_words", "_lines", "_runs", "_at"
    df = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns(
        {
            words: F.filter(F.split("_text", f"{SPACE_CLASS}+"), lambda x: x != ""),
            lines: F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS[1:-1]}]")),
            "word_chars": F.char_length(_minus(F.col("_text"), SPACES)).cast("long"),
            "n_symbols": (
                F.char_length("_text") - F.char_length(_minus(F.col("_text"), SYMBOLS))
            ).cast("long"),
        }
    )
    df = df.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            # One hash per window; 64 bits tell the windows of one text apart.
            runs: F.when(F.size(words) < 4, F.array().cast("array<bigint>")).otherwise(
                F.transform(
                    F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0))),
                    lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
                )
            ),
        }
    )
    df = df.withColumn("_any", F.size(F.array_distinct(runs)) < F.size(runs))
    # Most texts repeat nothing and end here; in the others equal windows become neighbours.
    ordered = F.sort_array(
        F.transform(F.col(runs), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )
    df = df.withColumn(runs, F.when(F.col("_any"), ordered)).withColumn("_size", F.size(runs))
    run = F.col(runs)
    repeated = F.filter(
        run,
        lambda x, j: (F.get(run, j - 1)["h"] == x["h"]) | (F.get(run, j + 1)["h"] == x["h"]),
    )
    df = df.withColumn(
        at, F.when(F.col("_size") > 0, F.sort_array(F.transform(repeated, lambda x: x["i"])))
    )
    # A window adds its three words, less those that the next window has too.
    covered = F.aggregate(
        F.transform(
            F.col(at), lambda i, j: F.least(F.coalesce(F.get(F.col(at), j + 1) - i, F.lit(3)), F.lit(3))
        ),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    df = df.withColumn("_found", F.size(at)).withColumn(
        "n_repeat_words", F.when(F.col("_found") > 0, covered).otherwise(F.lit(0).cast("long"))
    )
    return df.drop("_text", words, lines, runs, at, "_any", "_size", "_found")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def ratio(rule: Rule) -> Column:
    """Whole parts per thousand; 0 where the denominator is 0."""
    return F.when(
        F.col(rule.denominator) > 0,
        F.floor(1000 * F.col(rule.numerator) / F.col(rule.denominator)),
    ).otherwise(F.lit(0)).cast("long")


def sketch_bucket(value: Column) -> Column:
    """The lowest value of the bucket: exact below 64, then 32 buckets per power of two."""
    width = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, width), width)


def _sizes(rules: Sequence[Rule]) -> list[str]:
    return list(dict.fromkeys(r.denominator for r in rules))


def quantile_sketches(df: DataFrame, keys: Sequence[str], rules: Sequence[Rule] = RULES) -> DataFrame:
    """(keys, rule, bucket, n): a histogram per key and rule, and per key and denominator, filled by partial sums."""
    values = {r.name: ratio(r) for r in rules} | {c: F.col(c) for c in _sizes(rules)}
    each = F.explode(
        F.array(*(F.struct(F.lit(k).alias("rule"), sketch_bucket(v).alias("bucket")) for k, v in values.items()))
    )
    return (
        df.select(*keys, each.alias("x"))
        .groupBy(*keys, F.col("x.rule").alias("rule"), F.col("x.bucket").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, rows, q1, q2, q3); a sketch has at most some thousand buckets, whatever the rows."""
    up = W.partitionBy(*keys, "rule").orderBy("bucket")
    cum = sketch.withColumn("upto", F.sum("n").over(up)).withColumn(
        "rows", F.sum("n").over(W.partitionBy(*keys, "rule"))
    )
    reached = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("rows"), F.col("bucket")))
    return cum.groupBy(*keys, "rule").agg(
        F.max("rows").alias("rows"), *(reached(i).alias(f"q{i}") for i in (1, 2, 3))
    )


def fences(
    df: DataFrame, lang: str = "lang", source: str = "source", rules: Sequence[Rule] = RULES
) -> DataFrame:
    """(lang, source, then low_<rule> and high_<rule>): one row per language and source.

    Sketches of single sources are added up to those of languages and of all rows.
    The fewer rows a group has, the more the quartiles of its language decide, without
    a jump at any size.
    """
    fine = quantile_sketches(df, [lang, source], rules)
    # A few thousand buckets per group: what follows is small whatever the table's size.
    fine = written(fine, "sketches")
    coarse = fine.groupBy(lang, "rule", "bucket").agg(F.sum("n").alias("n"))
    whole = fine.groupBy("rule", "bucket").agg(F.sum("n").alias("n"))
    marks = ("q1", "q2", "q3")
    a = _quartiles(fine, [lang, source])
    b = _quartiles(coarse, [lang]).select(
        F.col(lang).alias("_lang"), F.col("rule").alias("_rule"), *(F.col(c).alias(f"b_{c}") for c in ("rows", *marks))
    )
    c = _quartiles(whole, []).select(F.col("rule").alias("_all"), *(F.col(q).alias(f"c_{q}") for q in marks))
    joined = a.join(b, same(F.col(lang), F.col("_lang")) & (F.col("rule") == F.col("_rule"))).join(
        c, F.col("rule") == F.col("_all")
    )
    mixed = "({1} * {0} + {prior} * {2}) div ({0} + {prior})"
    for q in marks:
        joined = joined.withColumn(f"l_{q}", F.expr(mixed.format("b_rows", f"b_{q}", f"c_{q}", prior=PRIOR_ROWS)))
        joined = joined.withColumn(f"p_{q}", F.expr(mixed.format("rows", q, f"l_{q}", prior=PRIOR_ROWS)))
    of = lambda name, value: F.max(F.when(F.col("rule") == name, F.col(value)))
    found = joined.groupBy(lang, source).agg(
        *(of(r.name, f"p_{q}").alias(f"{q}_{r.name}") for r in rules for q in ("q1", "q3")),
        *(of(c, "p_q2").alias(f"median_{c}") for c in _sizes(rules)),
    )
    limits = []
    for r in rules:
        low, high = F.col(f"q1_{r.name}"), F.col(f"q3_{r.name}")
        event = F.expr(f"(1000 * {r.events}L) div (median_{r.denominator} + {r.events})")
        step = r.reach * F.greatest(high - low, event)
        limits.append((high + step).alias(f"high_{r.name}"))
        if r.lower:
            limits.append((low - step).alias(f"low_{r.name}"))
    return found.select(lang, source, *limits)


def judge(
    df: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    carry: Sequence[str] = (),
    rules: Sequence[Rule] = RULES,
) -> DataFrame:
    """The counts and the verdict of every row, with the columns in `carry`.

    Rows that fail the base rules are rejected and do not enter the sketches. NULL
    languages or sources form groups of their own. An empty table gives no rows.
    """
    keep = list(dict.fromkeys([*carry, lang, source]))
    counts = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    # Own names, so that columns of the table called like a count do not clash.
    own = [F.col(c).alias(f"c_{i}") for i, c in enumerate(keep)]
    key = {c: f"c_{keep.index(c)}" for c in (lang, source)}
    measured = text_counts(df.select(*own, F.col(text).alias("c_text")), "c_text").drop("c_text")
    measured = written(measured.withColumn("base_failed", base_failed()), "counts")
    limits = written(fences(measured.filter(~F.col("base_failed")), key[lang], key[source], rules), "fences")
    # Known to be few, they need not be met by a shuffle of all rows.
    limits = F.broadcast(limits) if limits.count() <= FEW_GROUPS else limits
    limits = limits.withColumnsRenamed({key[lang]: "_l", key[source]: "_s"})
    judged = measured.join(
        limits, same(F.col(key[lang]), F.col("_l")) & same(F.col(key[source]), F.col("_s")), "left"
    )
    inside = F.lit(True)
    for rule in rules:
        inside &= ratio(rule) <= F.col(f"high_{rule.name}")
        if rule.lower:
            inside &= ratio(rule) >= F.col(f"low_{rule.name}")
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    names = [F.col(f"c_{keep.index(c)}").alias(c) for c in carry]
    return judged.select(*names, *(F.col(c) for c in counts), "base_failed", kept.alias("kept"))

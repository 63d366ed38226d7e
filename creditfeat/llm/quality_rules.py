"""Quality rules by distribution divergence, in DataFrame operations only.

Every document's histograms of character classes and of its language's common words are compared
with those of the language as a whole by Jensen-Shannon distance (base 2, 0 to 1). The references
come from all documents of a language. Documents below a minimum length aren't judged by a
histogram that says nothing about them; beyond it the allowance shrinks with the square root of
the number of words.

No document is taken apart into rows except for the count of words per language, which is summed
before it is shuffled. References are one row for each language, written to the shared folder, so
Spark sees their size and broadcasts them or not.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditfeat.llm.common import SPACE, pick, stage

CLASSES = ["lower", "space", "upper", "digit", "symbol", "other"]
# In this order, each is counted in what the ones before have left.
_PATTERNS = {
    "lower": r"\p{Ll}+",
    "space": SPACE + "+",
    "upper": r"\p{Lu}+",
    "digit": r"[0-9]+",
    "symbol": r"[#*$%&|<>]+",
}
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    """``common_words``: bins of the word histogram beside "any other word", at most 64.
    ``class_limit``, ``word_limit``: distances above which a document is dropped, plus
    ``slack / sqrt(n_words)``. ``min_words``, ``min_chars``: below, the verdict on words or on
    classes is left out. ``min_reference_words``: a language with fewer words judges nobody."""

    common_words: int = 32
    class_limit: float = 0.20
    word_limit: float = 0.45
    slack: float = 1.0
    min_words: int = 50
    min_chars: int = 200
    min_reference_words: int = 1000


def _marks(n: int) -> list[str]:
    """One printable ASCII character for each common word of a language."""
    if n > 64:
        raise ValueError("at most 64 common words")
    return [chr(48 + i) for i in range(n)]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def _with_classes(docs: DataFrame) -> DataFrame:
    """Adds ``classes``, the number of code points of each class."""
    left, df = "_text", docs
    for name in CLASSES[:-1]:
        df = df.withColumn(f"_no_{name}", F.regexp_replace(left, _PATTERNS[name], ""))
        left = f"_no_{name}"
    sizes = [F.length("_text"), *[F.length(f"_no_{name}") for name in CLASSES[:-1]]]
    counts = [a - b for a, b in zip(sizes, sizes[1:], strict=False)] + [sizes[-1]]
    return df.withColumn("_classes", F.array(*[c.cast("bigint") for c in counts]))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def _shares(counts: Column) -> Column:
    def of(counts: Column) -> Column:
        total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
        return _let(F.greatest(total, F.lit(1)), lambda t: F.transform(counts, lambda x: x / t))

    return _let(counts, of)


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    both = F.zip_with(p, q, lambda a, b: term(a, b) + term(b, a))
    half = F.aggregate(both, F.lit(0.0), lambda s, x: s + x) / 2
    return F.sqrt(F.greatest(half, F.lit(0.0)))


def fit_references(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per language: ``_lang``, ``ref_classes`` and ``ref_words`` (shares, the latter with
    "other" last) and ``ref_map`` (common word to its mark). All documents with a language count."""
    base = docs.filter("lang is not null").select(
        F.col("lang").alias("_lang"), F.coalesce("text", F.lit("")).alias("_text")
    )
    counted = _with_classes(base).select(
        "_lang", *[F.col("_classes")[i].alias(n) for i, n in enumerate(CLASSES)]
    )
    classes = counted.groupBy("_lang").agg(
        F.array(*[F.sum(n) for n in CLASSES]).alias("ref_classes")
    )
    words = base.select("_lang", F.explode(_words(F.col("_text"))).alias("word"))
    counts = stage(words.groupBy("_lang", "word").agg(F.count("*").alias("n")), "word-counts")
    total = counts.groupBy("_lang").agg(F.sum("n").alias("all"))
    place = F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("n"), "word"))
    top = (
        counts.withColumn("place", place)
        .filter(F.col("place") <= rules.common_words)
        .groupBy("_lang")
        .agg(F.sort_array(F.collect_list(F.struct("place", "word", "n"))).alias("top"))
    )
    marks = F.array(*[F.lit(m) for m in _marks(rules.common_words)])
    with_rest = F.concat(F.col("top.n"), F.array(F.col("all") - F.aggregate("top.n", F.lit(0).cast("bigint"), lambda a, x: a + x)))
    return (
        top.join(total, "_lang")
        .join(classes, "_lang")
        .filter(F.col("all") >= rules.min_reference_words)
        .select(
            "_lang",
            _shares(F.col("ref_classes")).alias("ref_classes"),
            _shares(with_rest).alias("ref_words"),
            F.map_from_arrays("top.word", F.slice(marks, 1, F.size("top"))).alias("ref_map"),
        )
    )


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside windows of 8 that the text holds twice or more. Windows are sorted by hash,
    those beside an equal one are marked, and the positions they cover are counted. A window's hash
    is made of those of its halves, so every word is hashed once."""

    def joined(hashes: Column, width: int) -> Column:
        def halves(h: Column) -> Column:
            left = F.size(h) - width
            return F.zip_with(F.slice(h, 1, left), F.slice(h, 1 + width, left), lambda a, b: F.xxhash64(a, b))

        return _let(hashes, halves)

    hashes = F.when(n > WINDOW, F.transform(words, lambda w: F.xxhash64(w)))
    width = 1
    while width < WINDOW:
        hashes, width = joined(hashes, width), 2 * width

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = _let(
            pairs,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        s,
                        lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"]))
                        | (F.get(s, k + 1)["h"] == x["h"]),
                    ),
                    lambda x: x["i"],
                )
            ),
        )
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

        def step(state: Column, i: Column) -> Column:
            return F.struct(
                (i + WINDOW).alias("end"),
                (state["n"] + i + WINDOW - F.greatest(i, state["end"])).alias("n"),
            )

        return F.aggregate(twice, start, step, lambda s: s["n"])

    return F.coalesce(
        _let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0),
        ),
        F.lit(0),
    )


def judge(docs: DataFrame, references: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Counts, distances and the verdict for every row of ``docs`` (doc_id, text, lang).

    Null and empty texts have no words and fail the base rule. A null language, or one without a
    reference, is judged by the base rule only. Repeated rows each give a row. Further columns of
    ``docs`` are ignored. An empty table gives an empty result.
    """
    base = docs.select(
        "doc_id",
        F.col("lang").alias("_lang"),
        F.coalesce("text", F.lit("")).alias("_text"),
    )
    df = _with_classes(base).join(references, "_lang", "left")
    df = df.withColumn("_words", _words(F.col("_text"))).withColumn("_n", F.size("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\v\f\r"))) > 0)
    code = F.array_join(F.transform("_words", lambda w: F.col("ref_map")[w]), "")
    df = df.select(
        "doc_id",
        F.col("_n").cast("bigint").alias("n_words"),
        (F.length("_text") - F.col("_classes")[1]).cast("bigint").alias("word_chars"),
        F.col("_classes")[4].alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
        .cast("bigint")
        .alias("n_dup_lines"),
        _repeat_words(F.col("_words"), F.col("_n")).cast("bigint").alias("n_repeat_words"),
        "_classes",
        F.when(F.col("ref_map").isNotNull(), code).alias("_code"),
        "ref_map",
        "ref_classes",
        "ref_words",
    )
    found = F.transform(
        F.map_values("ref_map"),
        lambda m: (F.length("_code") - F.length(F.replace("_code", m, F.lit("")))).cast("bigint"),
    )
    bins = F.concat(found, F.array(F.col("n_words") - F.length("_code")))
    chars = F.col("word_chars") + F.col("_classes")[1]
    class_distance = F.when(
        (chars >= rules.min_chars) & F.col("ref_classes").isNotNull(),
        _distance(_shares(F.col("_classes")), F.col("ref_classes"))
    )
    word_distance = F.when(
        (F.col("n_words") >= rules.min_words) & F.col("ref_words").isNotNull(),
        _distance(_shares(bins), F.col("ref_words"))
    )
    allowance = rules.slack / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    df = df.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        class_distance.alias("class_distance"),
        word_distance.alias("word_distance"),
    )
    near = (F.coalesce("class_distance", F.lit(0.0)) <= rules.class_limit + allowance) & (
        F.coalesce("word_distance", F.lit(0.0)) <= rules.word_limit + allowance
    )
    return df.withColumn("kept", ~F.col("base_failed") & near)


def quality_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``judge`` with references fitted on the same documents."""
    docs = pick(docs, doc_id="bigint", text="string", lang="string")
    return judge(docs, stage(fit_references(docs, rules), "references"), rules)

"""Quality rules: base counts, and divergence of a text from its language, in DataFrame operations.

For every document two histograms are taken: of the character classes of its
words, and of its language's most common words. Each is compared with the same
histogram summed over all documents of the language that pass the base rules, by
Jensen-Shannon distance (base 2, square root: 0 for equal, 1 for disjoint). Too
short texts give no useful histogram: below a minimum number of words a distance
is not judged.

All work on a text stays in its row; only one row of sums for each language is
shuffled. The counts are staged once, so texts are read a single time.

Defined cases: a null text counts as empty, has no words and fails the base
rules; a null or unknown language is compared with all rows of the same value and
has no common words, so only the character classes are judged; repeated rows get
the same verdict; an empty table gives an empty result. Input columns other than
``doc_id``, ``text`` and ``lang`` are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.llm.common import words
from trialloom.staging import stage

#: Frequent function words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that it for with as was on are this by be from or an at".split(),
    "de": "der die und in den von zu das mit sich ist im ein nicht auf dem des eine für als auch es".split(),
    "fr": "de la le et les des en un une que du est pour qui dans par au sur pas avec plus ne".split(),
    "es": "de la que el en y los se del las un por con una para su al lo como más es no".split(),
}
BINS = 22
MIN_WORDS = 50
#: Share of words in repeated three-word windows, in percent.
MAX_REPEATED = 50
#: A distance rejects above base + slack / sqrt(number of words), from a number of words on:
#: the fewer words, the further a sound text strays from its language by chance.
CLASS_LIMIT = (0.15, 1.2, 50)
WORD_LIMIT = (0.15, 2.0, 100)
_SYMBOL = r"[#*$%&|<>]"
_PUNCTUATION = r"[.,;:!?'\"()-]"


def repeated_words(w: Column, hashes: Column) -> Column:
    """Words covered by three-word windows that occur at least twice.

    ``hashes`` are the windows' hashes in order. Sorted with their positions, equal
    windows stand side by side; the positions that have an equal neighbour, sorted
    again, each add the words not covered by the one before.
    """
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    bound = F.transform(F.array(placed), _covered)[0]
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(bound).cast("long")


def _covered(s: Column) -> Column:
    same = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
    at = F.sort_array(F.transform(same, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last"))
    return F.aggregate(at, start, step)["n"]


def _window_hashes(w: Column) -> Column:
    at = F.sequence(F.lit(0), F.size(w) - 3)
    return F.when(F.size(w) >= 3, F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))


def measure(docs: DataFrame) -> DataFrame:
    """The base counts and the two histograms of each document."""
    pick = reduce(lambda done, item: F.when(F.col("lang") == item[0], F.lit(item[1])).otherwise(done), COMMON_WORDS.items(), F.array().cast("array<string>"))
    d = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("_text")).withColumn("_w", words(F.col("_text")))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "doc_id", "lang", "_w",
        pick.alias("_list"),
        _window_hashes(F.col("_w")).alias("_hashes"),
        lines.alias("_lines"),
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(_SYMBOL)).cast("long").alias("n_symbols"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).alias("_upper"),
        F.regexp_count("_text", F.lit("[0-9]")).alias("_digit"),
        F.regexp_count("_text", F.lit(_PUNCTUATION)).alias("_punct"),
    )
    common = F.filter(F.transform("_w", lambda w: F.lower(w)), lambda w: F.array_contains(F.col("_list"), w))
    d = d.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "_upper", "_digit", "_punct", "_list",
        common.alias("_common"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_w"), F.col("_hashes")).alias("n_repeat_words"),
    )
    known = [F.col("_upper"), F.col("_digit"), F.col("n_symbols"), F.col("_punct")]
    rest = F.greatest(F.col("word_chars") - sum(known[1:], known[0]), F.lit(0))
    classes = F.array(*[c.cast("long") for c in (*known, rest)])
    hits = F.transform("_list", lambda c: F.size(F.filter("_common", lambda w: w == c)).cast("long"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return d.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
        classes.alias("classes"), F.concat(hits, F.array(F.col("n_words") - F.size("_common"))).alias("common"),
    )


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of one length; null if one is empty."""
    add = lambda a, x: a + x
    total = lambda h: F.aggregate(h, F.lit(0.0), add)
    shares = lambda h: F.transform(h, lambda x: x / total(h))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    one = lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2
    sums = F.aggregate(F.zip_with(shares(p), shares(q), one), F.lit(0.0), add)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(sums, F.lit(0.0))))


def references(measured: DataFrame) -> DataFrame:
    """One row for each language: both histograms summed over all documents that pass the base rules."""
    n = {"classes": 5, "common": BINS + 1}
    # The element sums of an array, one aggregate for each place.
    sums = [F.sum(F.get(k, F.lit(i))).alias(f"_{k}{i}") for k, size in n.items() for i in range(size)]
    ref = measured.filter(~F.col("base_failed")).groupBy("lang").agg(*sums)
    arrays = [F.filter(F.array(*[f"_{k}{i}" for i in range(size)]), lambda x: x.isNotNull()).alias(f"ref_{k}") for k, size in n.items()]
    return ref.select(F.col("lang").alias("_lang"), *arrays)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, class_distance, word_distance, kept."""
    measured = stage(measure(docs), "quality-counts")
    j = measured.join(references(measured), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    as_double = lambda c: F.col(c).cast("array<double>")
    j = j.withColumn("class_distance", distance(as_double("classes"), as_double("ref_classes")))
    j = j.withColumn("word_distance", distance(as_double("common"), as_double("ref_common")))

    def far(column: str, base: float, slack: float, least: int) -> Column:
        limit = base + slack / F.sqrt(F.col("n_words").cast("double"))
        return (F.col("n_words") >= least) & (F.coalesce(F.col(column), F.lit(0.0)) > limit)

    kept = ~F.col("base_failed") & ~far("class_distance", *CLASS_LIMIT) & ~far("word_distance", *WORD_LIMIT)
    return j.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", kept.alias("kept")
    )

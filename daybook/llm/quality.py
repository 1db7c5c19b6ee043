"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for each document. The ledger keeps what was measured and one
bit for each rule that failed. Policies are chosen later: a policy is a version and
a set of bits, so trying another one, or leaving out a rule, reads a number for each
document and no text.

Null texts have no words and no lines. Empty tables give empty ledgers. Rows repeated in the
input are repeated in the ledger. Columns of the input other than ``text`` are kept;
those named like a measure, ``failures`` or an underscored helper are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.words import SPACE, WORD, words

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``bit`` is the rule's place in every ledger ever written; never give it to another rule."""
    bit: int
    name: str
    fails: Callable[[], Column]


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    def mask(self) -> int:
        return reduce(lambda m, name: m | 1 << BITS[name], self.rules, 0)


# The first two are the base rules. Limits are whole numbers, compared without division.
RULES = (
    Rule(0, "few_words", lambda: F.col("n_words") < 20),
    Rule(1, "repeated_words", lambda: 100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    Rule(2, "symbols", lambda: 100 * F.col("n_symbols") > 20 * F.col("n_words")),
    Rule(3, "repeated_lines", lambda: 100 * F.col("n_dup_lines") > 50 * F.col("n_lines")),
    Rule(4, "stutters", lambda: 100 * F.col("n_stutters") > 30 * F.col("n_words")),
    Rule(5, "shouts", lambda: 100 * F.col("n_shouts") > 30 * F.col("n_words")),
    Rule(6, "long_words", lambda: F.col("word_chars") > 40 * F.col("n_words")),
)
BITS = {rule.name: rule.bit for rule in RULES}
BASE = Policy("base-1", ("few_words", "repeated_words"))
POLICY = Policy("2", tuple(BITS))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutters", "n_shouts")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts of ``MEASURES``, all long: of words, their characters, symbols, lines
    with a word and those equal to an earlier one, words in repeated windows, words equal to the one
    before, and double exclamation marks.

    Windows of eight words are compared by 64-bit hashes, built from those of two and
    four words; only texts in which a hash comes twice sort their windows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    enough = F.col("n_words") >= WINDOW
    return (
        docs.withColumns({"_words": words(F.col("text")), "_lines": lines})
        .withColumns({
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_shouts": F.regexp_count(text, F.lit("!!")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
        })
        .drop("_words", "_lines")
        .withColumn("n_stutters", F.size(F.filter(
            "_hashes", lambda h, i: h.eqNullSafe(F.get("_hashes", i - 1)))).cast("long"))
        .withColumn("_hashes", F.when(enough, _paired("_hashes", 1)))
        .withColumn("_hashes", F.when(enough, _paired("_hashes", 2)))
        .withColumn("_hashes", F.when(enough, _paired("_hashes", 4)))
        .withColumn("_sorted", F.when(
            F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
            F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("hash"), i.alias("start"))))))
        .drop("_hashes")
        .withColumn("_starts", F.sort_array(F.transform(F.filter("_sorted", _has_equal), lambda x: x["start"])))
        .drop("_sorted")
        .withColumn("n_repeat_words", F.coalesce(F.aggregate(
            F.transform("_starts", _covered), F.lit(0).cast("long"), lambda total, n: total + n), F.lit(0).cast("long")))
        .drop("_starts")
    )


def _paired(hashes: str, gap: int) -> Column:
    """Hashes of twice as many words: each with the one ``gap`` places on."""
    n = F.size(hashes) - gap
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(gap + 1), n), lambda a, b: F.xxhash64(a, b))


def _has_equal(window: Column, i: Column) -> Column:
    """Whether a neighbour in ``_sorted`` has the same hash."""
    hash_at = lambda j: F.get("_sorted", j)["hash"]
    return window["hash"].eqNullSafe(hash_at(i - 1)) | window["hash"].eqNullSafe(hash_at(i + 1))


def _covered(start: Column, i: Column) -> Column:
    """Words that the window at ``start`` covers and later windows don't."""
    to_next = F.get("_starts", i + 1) - start
    return F.least(F.lit(WINDOW), F.coalesce(to_next, F.lit(WINDOW))).cast("long")


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the measures and ``failures``, a long with the bit of each rule that fails."""
    bits = [F.when(rule.fails(), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long") for rule in rules]
    # A filter on a value that names its task stays above it; else Spark would put all rules
    # into the filter, each with its measures, and evaluate them there once more.
    nothing = F.shiftright(F.spark_partition_id(), 31).cast("long")
    return measured(docs).withColumn("failures", reduce(lambda a, b: a.bitwiseOR(b), [*bits, nothing]))


def passes(policy: Policy) -> Column:
    """Whether a row of a ledger passes ``policy``."""
    return F.col("failures").bitwiseAND(F.lit(policy.mask()).cast("long")) == 0


def ablation(ledgers: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of ``policy`` the documents it fails, those it alone rejects, and
    those kept by the policy with and without it.

    Rows fold to one for each combination of bits, at most two to the number of rules.
    """
    patterns = ledgers.groupBy(F.col("failures").bitwiseAND(F.lit(policy.mask()).cast("long")).alias("bits")).agg(
        F.count(F.lit(1)).alias("docs"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << BITS[name]).cast("long").alias("bit"))
                                for name in policy.rules])).alias("r")
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("docs"))), F.lit(0)).cast("long")
    return (
        patterns.select("bits", "docs", rules).select("bits", "docs", "r.*")
        .groupBy("rule")
        .agg(total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("failed"),
             total(F.col("bits") == F.col("bit")).alias("failed_alone"),
             total(F.col("bits") == 0).alias("kept"),
             total((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("kept_without"))
        .withColumn("policy", F.lit(policy.version))
    )

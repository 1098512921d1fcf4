"""Quality rules as a bitmask ledger.

Every rule is evaluated once a document.  The ledger holds the measurements and one
long whose bits name the failed rules; policies are masks with a version, so another
policy, or the effect of leaving a rule out, is bit arithmetic on the ledger and never
reads a text again.  All expressions run row by row inside the scan: no shuffle.

Defined cases: a null or empty text has no words and fails ``few_words``; a null
doc_id passes through; repeated rows each keep their own row; texts of any length are
read whole; an empty table gives an empty ledger; ``keep`` returns the columns it gets,
whatever their names.

The rule on word length counts what white space parts, so it rejects clean text of scripts
that part words otherwise.  ``strict-3`` left it out, and let texts of single letters pass;
``strict-4`` applies it with the characters of such scripts left out of the upper bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.llm.common import fresh, let, words

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"
#: Scripts that don't part words by spaces: Thai to Tibetan, Burmese, Khmer, Chinese, Japanese.
#: The one wide range comes first, so most characters meet no other.
UNSPACED = (
    r"[\x{0E00}-\x{3FFFF}&&[\x{0E00}-\x{0FFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{312F}\x{3190}-\x{9FFF}"
    r"\x{F900}-\x{FAFF}\x{FF01}-\x{FF9F}\x{20000}-\x{3FFFF}]]"
)
#: Bits that hold a window's place while windows are sorted; longer texts sort pairs instead.
PLACE = (1 << 21) - 1

#: Rule names by bit.  Bits never change their meaning; new rules take new bits.
RULES = (
    "few_words",  # bit 0: under 10 words
    "repeated_windows",  # bit 1: over 20 % of the words in 5-word windows that occur twice
    "symbols",  # bit 2: over 5 % of the characters of words are symbols
    "capitals",  # bit 3: over 45 % of the characters of words are capitals
    "exclamations",  # bit 4: over 6 % of the characters of words are exclamation marks
    "stuttering",  # bit 5: over 25 % of the words equal the word before
    "word_length",  # bit 6: mean word length outside 1.5 to 25 characters
    "duplicate_lines",  # bit 7: over 60 % of at least 10 lines equal an earlier one
    "spaced_word_length",  # bit 8: as bit 6, but only characters of spaced scripts count above 25
)
BASE = ("few_words", "repeated_windows")

#: Which rules each version of the policy applies.
POLICIES = {
    "base-1": BASE,
    "strict-1": RULES[:6],
    "strict-2": RULES[:8],
    "strict-3": tuple(r for r in RULES[:8] if r != "word_length"),
    "strict-4": tuple(r for r in RULES if r != "word_length"),
}
CURRENT = "strict-4"


def mask(rules) -> int:
    return sum(1 << RULES.index(r) for r in rules)


def _repeated_words(tokens: Column) -> Column:
    """Words inside windows that occur twice or more; windows meet by 64-bit hashes."""

    def spread(places: Column) -> Column:
        """Words under windows that start at these places."""
        return F.aggregate(
            F.sort_array(places),
            F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
            lambda a, p: F.struct(
                (p + WINDOW).alias("end"),
                (a["n"] + F.lit(WINDOW) - F.greatest(a["end"] - p, F.lit(0))).alias("n"),
            ),
        )["n"]

    def twice(ordered: Column, hash_of, place_of) -> Column:
        return let(
            ordered,
            lambda s: spread(
                F.transform(
                    F.filter(
                        s,
                        lambda x, i: (hash_of(F.get(s, i - 1)) == hash_of(x))
                        | (hash_of(F.get(s, i + 1)) == hash_of(x)),
                    ),
                    place_of,
                )
            ),
        )

    def covered(hashes: Column) -> Column:
        # The upper 43 bits of a hash over the place, sorted as plain longs: equal windows
        # stand side by side.  Neighbours count as equal only if all 64 bits agree.
        place = lambda x: x.bitwiseAND(F.lit(PLACE)).cast("int")
        packed = F.sort_array(
            F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long")))
        )
        paired = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        # Most texts repeat no window: a set tells so without sorting.
        return (
            F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long"))
            .when(F.size(hashes) <= PLACE, twice(packed, lambda x: F.get(hashes, place(x)), place))
            .otherwise(twice(paired, lambda x: x["h"], lambda x: x["p"]))
        )

    def windows(codes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(codes) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*(F.get(codes, i + k) for k in range(WINDOW))))

    return F.when(F.size(tokens) < WINDOW, F.lit(0).cast("long")).otherwise(
        let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda codes: let(windows(codes), covered))
    )


def measurements(text: Column) -> Column:
    """All figures that the rules look at, as one struct, from one splitting of the text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(tokens: Column) -> Column:
        repeats = F.filter(tokens, lambda w, i: (i > 0) & (F.get(tokens, i - 1) == w))
        return F.struct(
            F.size(tokens).cast("long").alias("n_words"),
            F.length(F.array_join(tokens, "")).cast("long").alias("word_chars"),
            F.regexp_count(whole, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeated_words(tokens).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.regexp_count(whole, F.lit("[\\p{Lu}]")).cast("long").alias("n_capitals"),
            (F.length(whole) - F.length(F.replace(whole, F.lit("!"), F.lit("")))).cast("long").alias("n_exclamations"),
            F.size(repeats).cast("long").alias("n_stutters"),
            F.regexp_count(whole, F.lit(UNSPACED)).cast("long").alias("n_unspaced"),
        )

    return let(words(text), of)


def failures(m: Column) -> Column:
    """The failed rules of a measurement struct, as bits of a long."""
    fails = {
        "few_words": m["n_words"] < 10,
        "repeated_windows": 100 * m["n_repeat_words"] > 20 * m["n_words"],
        "symbols": 100 * m["n_symbols"] > 5 * m["word_chars"],
        "capitals": 100 * m["n_capitals"] > 45 * m["word_chars"],
        "exclamations": 100 * m["n_exclamations"] > 6 * m["word_chars"],
        "stuttering": 100 * m["n_stutters"] > 25 * m["n_words"],
        "word_length": (2 * m["word_chars"] < 3 * m["n_words"]) | (m["word_chars"] > 25 * m["n_words"]),
        "duplicate_lines": (m["n_lines"] >= 10) & (100 * m["n_dup_lines"] > 60 * m["n_lines"]),
        "spaced_word_length": (2 * m["word_chars"] < 3 * m["n_words"])
        | (m["word_chars"] - m["n_unspaced"] > 25 * m["n_words"]),
    }
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(fails[rule], F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def passes(bits: Column, policy: str = CURRENT) -> Column:
    return bits.bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, every measurement and the failure bits of each document."""
    row = let(measurements(F.col("text")), lambda m: F.struct(m.alias("m"), failures(m).alias("bits")))
    return docs.select("doc_id", row.alias("row")).select(
        "doc_id", "row.m.*", F.col("row.bits").alias("failed_bits")
    )


def apply_policy(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with the verdict of a policy; the texts are not needed."""
    base = F.lit(mask(BASE)).cast("long")
    return book.withColumns(
        {
            "policy": F.lit(policy),
            "base_failed": F.col("failed_bits").bitwiseAND(base) != 0,
            "kept": passes(F.col("failed_bits"), policy),
        }
    )


def keep(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    bits = fresh(docs, "_bits")
    judged = let(measurements(F.col("text")), failures)
    return docs.withColumn(bits, judged).where(passes(F.col(bits), policy)).drop(bits)


def ablations(book: DataFrame) -> DataFrame:
    """For each policy and rule: documents that fail it, and that it alone rejects.

    The documents are first counted by their bits (at most 2^rules groups, summed before
    the shuffle); everything else is arithmetic on those few masks.
    """
    by_bits = book.groupBy("failed_bits").agg(F.count("*").alias("n"))
    arms = F.array(
        *(
            F.struct(
                F.lit(version).alias("policy"),
                F.lit(rule).alias("rule"),
                F.lit(mask(rules)).cast("long").alias("all"),
                F.lit(mask([rule])).cast("long").alias("one"),
            )
            for version, rules in POLICIES.items()
            for rule in rules
        )
    )
    hit = F.col("failed_bits").bitwiseAND(F.col("arm.one")) != 0
    alone = F.col("failed_bits").bitwiseAND(F.col("arm.all")) == F.col("arm.one")
    rejected = F.col("failed_bits").bitwiseAND(F.col("arm.all")) != 0
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0).cast("long"))
    return (
        by_bits.select("failed_bits", "n", F.explode(arms).alias("arm"))
        .groupBy("arm.policy", "arm.rule")
        .agg(total(hit).alias("failing"), total(alone).alias("rejected_alone"), total(rejected).alias("rejected_by_policy"))
    )

"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements
and one failure bit per rule; policies are versioned masks over those bits, so
a new policy, or the effect of leaving a rule out, needs no second look at the
texts.

Words are runs of characters other than U+0020 and U+0009 to U+000D. Null and
empty texts have no word and fail `too_short`. Repeated rows get one ledger row
each; columns of the input named like a ledger column are replaced by it.
Repeated windows are found by a 64-bit hash of their three words within one
document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loadweave.llm.common import SPACE, text_or_empty

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_digits"]

#: name -> condition over the measurements under which the rule fails; the bit is the position.
RULES: dict[str, str] = {
    "too_short": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 4 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "few_letters": "2 * n_letters < word_chars",
    "many_digits": "2 * n_digits > word_chars",
}
BASE = ("too_short", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: documents failing any named rule are rejected."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return mask_of(*self.rules)


def mask_of(*rules: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in set(rules))


POLICIES = {
    "base": Policy("base", BASE),
    "v1": Policy("v1", tuple(RULES)),
}


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements; all steps are array functions within the row."""
    own = {"_text": text_or_empty(text)}
    df = docs.withColumns(own).withColumn("_words", F.array_remove(F.split("_text", SPACE), ""))
    df = df.withColumn("_windows", F.expr(
        "if(size(_words) < 3, array(), transform(sequence(0, greatest(size(_words) - 3, 0)), "
        "i -> xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2))))"
    )).withColumn("_lines", F.expr(rf"filter(split(_text, '\n'), l -> l rlike '[^ \\t-\\r]')"))
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.regexp_replace("_text", SPACE, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_letters": F.length(F.regexp_replace("_text", r"\P{L}+", "")).cast("long"),
        "n_digits": F.length(F.regexp_replace("_text", r"[^0-9]+", "")).cast("long"),
        # only documents with a repeated window are sorted
        "_sorted": F.expr(
            "if(size(array_distinct(_windows)) = size(_windows), cast(null as array<struct<h: bigint, i: int>>), "
            "sort_array(transform(_windows, (h, i) -> struct(h as h, i as i))))"
        ),
    }).drop("_text", "_words", "_lines", "_windows")
    # equal windows are neighbours now; keep the places of those that have an equal neighbour
    df = df.withColumn("_places", F.expr(
        "array_sort(transform(filter(_sorted, (x, k) -> coalesce(get(_sorted, k - 1).h = x.h, false) "
        "or coalesce(get(_sorted, k + 1).h = x.h, false)), x -> x.i))"
    )).drop("_sorted")
    # a window covers three words; count each word once
    covered = F.coalesce(F.expr(
        "aggregate(transform(_places, (x, k) -> least(3, coalesce(get(_places, k + 1) - x, 3))), 0L, (a, x) -> a + x)"
    ), F.lit(0))
    # The condition always holds. It marks the column as not repeatable, so that a filter on the ledger is
    # evaluated above these steps; pushed below them, it would repeat every step for each array element.
    return df.withColumn("n_repeat_words", F.when(F.monotonically_increasing_id() >= 0, covered)).drop("_places")


def failure_bits() -> Column:
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out.cast("long")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of `docs`, the measurements and `failed_bits`."""
    return measured(docs.drop(*MEASURES, "failed_bits"), text).withColumn("failed_bits", failure_bits())


def passes(policy: Policy, bits: str = "failed_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask)) == 0


def ablation(rows: DataFrame, policy: Policy, bits: str = "failed_bits") -> DataFrame:
    """Per rule of the policy: documents failing it, failing nothing else, and kept without it.

    Works on the counts of each bit pattern, at most 2 ** rules rows.
    """
    patterns = rows.groupBy(F.col(bits).bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    names = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask_of(r)).cast("long").alias("bit")) for r in policy.rules])
    has = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0)).cast("long")
    return (
        patterns.select("bits", "n", F.explode(names).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            total(has).alias("failed"),
            total(F.col("bits") == F.col("r.bit")).alias("failed_only"),
            total((F.col("bits") == 0) | (F.col("bits") == F.col("r.bit"))).alias("kept_without"),
        )
    )


def kept_documents(docs: DataFrame, policy: Policy = POLICIES["v1"], text: str = "text") -> DataFrame:
    """The documents that the policy keeps, with their own columns only."""
    names = docs.columns
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), F.col(text).alias("text"))
    return ledger(own).where(passes(policy)).select("_doc.*")

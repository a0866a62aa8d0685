from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from loadweave.llm import quality
from tests.llm.helpers import empty_documents, odd_documents, words


def measured_plainly(text: str | None) -> tuple:
    t, w = text or "", words(text)
    lines = [x for x in t.split("\n") if words(x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + o for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for o in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines), len(lines) - len(set(lines)), len(covered))


def test_measures_equal_brute_force(spark):
    rows = quality.ledger(odd_documents(spark)).collect()
    assert len(rows) == 18
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == measured_plainly(r.text)
        assert bool(r.failed_bits & 1) == (r.n_words < 50)
        assert bool(r.failed_bits & 2) == (100 * r.n_repeat_words > 50 * r.n_words)


def test_clashing_and_extra_columns(spark):
    docs = odd_documents(spark).withColumn("n_words", F.lit("x")).withColumn("_text", F.lit(1)).withColumn("odd name.x", F.lit(2))
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 8, 9, 10, 15, 16, None}
    assert {r.n_words for r in kept.collect()} == {"x"}


def test_empty_table(spark):
    assert quality.kept_documents(empty_documents(spark)).count() == 0
    assert quality.ablation(quality.ledger(empty_documents(spark)), quality.POLICIES["v1"]).count() == 0


def test_ablation_counts_bit_patterns(spark):
    rows = quality.ledger(odd_documents(spark))
    bits = [r.failed_bits for r in rows.collect()]
    for r in quality.ablation(rows, quality.POLICIES["v1"]).collect():
        bit = quality.mask_of(r["rule"])
        assert (r.failed, r.failed_only, r.kept_without) == (
            sum(b & bit > 0 for b in bits), sum(b == bit for b in bits), sum(b & ~bit == 0 for b in bits))


def test_policy_is_a_mask(spark):
    only_symbols = quality.Policy("symbols", ("symbols",))
    assert only_symbols.mask == quality.mask_of("symbols") == 4
    rows = quality.ledger(odd_documents(spark)).where(~quality.passes(only_symbols)).select("doc_id").collect()
    assert [r.doc_id for r in rows] == [14]

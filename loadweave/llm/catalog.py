"""The registered queries of the subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from loadweave.llm import (
    alignment, chunking, extraction, neighbours, packing, pieces, quality, resampling, search, sharding, simhash, suffixes, toxicity,
)
from loadweave.llm.common import prepared, table, text_or_empty

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepared(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("op1_histogram_sort")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 16 shards of near-equal bytes, ordered by text hash so that equal texts are neighbours."""
    text = text_or_empty()
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("_text_hash"), F.xxhash64("doc_id").alias("_id_hash"),
    )
    rows = sharding.histogram_sort(docs, F.col("_text_hash"), F.col("_id_hash"), F.col("size"), shards=16)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


_LEDGER_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
win AS (SELECT k, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
grams AS (SELECT win.k, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM win JOIN d USING (k)),
twice AS (SELECT k, i FROM grams QUALIFY count(*) OVER (PARTITION BY k, a, b, c) > 1),
covered AS (SELECT k, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY k),
lines AS (SELECT k, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
         length(t) - length(regexp_replace(t, '\p{L}', '', 'g')) AS n_letters,
         length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS n_digits
  FROM d JOIN lines USING (k) LEFT JOIN covered USING (k)),
f AS (
  SELECT *, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
         + 8 * (10 * n_dup_lines > 4 * n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT
         + 32 * (word_chars > 15 * n_words)::INT + 64 * (2 * n_letters < word_chars)::INT
         + 128 * (2 * n_digits > word_chars)::INT AS failed_bits
  FROM m)
"""


@query("op5_rule_ledger", _LEDGER_SQL + """
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept,
       failed_bits::BIGINT AS failed_bits
FROM f
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every document with the verdicts of the base policy and of policy v1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes(quality.POLICIES["base"])).alias("base_failed"),
        quality.passes(quality.POLICIES["v1"]).alias("kept"), "failed_bits",
    )


@query("op3_simhash_trie")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    rows = simhash.clustered(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op8_vector_best_fit")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4,096 tokens."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.packed(packing.pieces(table(spark, sf_dir, "documents"), path))


@query("op10_factorization_machine")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; the model learns from at most 16,384 documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    rows = toxicity.scored(docs, machine)
    return rows.select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query("op6_sparse_suffixes")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that occurs in an earlier place, by word position."""
    return suffixes.repeated_spans(table(spark, sf_dir, "documents"))


@query("op9_content_chunks")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of 100 bytes or more made of chunks that occur in an earlier place."""
    return chunking.duplicate_spans(table(spark, sf_dir, "documents"))


@query("op2_tree_extraction")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    rows = extraction.extracted(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op4_unigram_viterbi")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, as count and checksum, and whether they decode to its text."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    rows = pieces.decoded(pieces.encoded(docs, path), path)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), "ids_crc32", F.crc32("decoded").alias("decoded_crc32"),
        (F.col("decoded") == F.translate("text", pieces.MARK, " ")).alias("round_trip"),
    )


_TOP_K_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


@query("op7_impact_search", _TOP_K_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best matches of every vector whose id is divisible by 50."""
    return search.top_k(search.whole_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, k=5)


_RESAMPLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS k, TRUE AS is_doc FROM documents
  UNION ALL
  SELECT NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), row_number() OVER (), FALSE FROM benchmark),
runs AS (
  SELECT k, is_doc, array_to_string(w[i:i + n], ' ') AS f
  FROM (SELECT k, is_doc, w, n, unnest(range(1, len(w) - n + 1)) AS i FROM w, (SELECT unnest([0, 1, 2]) AS n) WHERE len(w) > n)),
uses AS (SELECT k, is_doc, f, count(*) AS c FROM runs GROUP BY ALL),
texts AS (SELECT f, hex(encode(f)) AS h, octet_length(encode(f)) AS len FROM (SELECT DISTINCT f FROM uses)),
byte AS (
  SELECT b, list_reduce([b] || range(8), lambda x, y: xor(x // 2, (x % 2) * 3988292384)) AS v
  FROM (SELECT unnest(range(256)) AS b)),
step AS (SELECT list(v ORDER BY b) AS t FROM byte),
place AS (
  SELECT 0 AS d, b, v FROM byte
  UNION ALL
  SELECT d + 1, b, xor(v // 256, t[v % 256 + 1]) FROM place, step WHERE d + 1 < (SELECT max(len) FROM texts)),
zero AS (
  SELECT 0 AS n, 4294967295::BIGINT AS v
  UNION ALL
  SELECT n + 1, xor(v // 256, t[v % 256 + 1]) FROM zero, step WHERE n < (SELECT max(len) FROM texts)),
bytes AS (
  SELECT f, len - i AS d, 16 * (strpos('0123456789ABCDEF', substr(h, 2 * i - 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, 2 * i, 1)) - 1 AS b
  FROM (SELECT f, h, len, unnest(range(1, len + 1)) AS i FROM texts)),
sums AS (SELECT f, bit_xor(v) AS x FROM bytes JOIN place USING (d, b) GROUP BY f),
bucket AS (
  SELECT f, xor(xor(x, zero.v), 4294967295) % 10000 AS bucket
  FROM sums JOIN texts USING (f) JOIN zero ON zero.n = texts.len),
counts AS (
  SELECT bucket, coalesce(sum(c) FILTER (is_doc), 0) AS s, coalesce(sum(c) FILTER (NOT is_doc), 0) AS t
  FROM uses JOIN bucket USING (f) GROUP BY bucket),
total AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM counts),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain
  FROM counts, total),
weight AS (
  SELECT k, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight
  FROM uses JOIN bucket USING (f) JOIN gain USING (bucket) WHERE is_doc GROUP BY k),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN weight USING (k) WHERE is_doc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_words >= 20 AND r <= (SELECT 5 * count(*) // 100 FROM scored WHERE n_words >= 20) THEN r END AS rank
FROM ranked
"""


@query("op12_crc_resampling", _RESAMPLE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document in a draw of 5 in 100 towards the benchmark's distribution."""
    rows = resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


@query("op13_pair_bitmaps")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two vocabularies line up in every document, and in how many documents its links occur."""
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.aligned(table(spark, sf_dir, "documents"), *paths)


@query("op11_balanced_postings")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found of every vector whose id is divisible by 100."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)

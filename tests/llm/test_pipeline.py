from __future__ import annotations

import random

import corpus_pipeline
import __spark_entry__ as entry
from loadweave.llm import quality, toxicity
from loadweave.llm.common import table
from tests.llm.helpers import documents, empty_documents, odd_texts, prose, words
from tests.llm.test_passages import repeated_words
from tests.llm.test_quality import measured_plainly
from tests.llm.test_simhash import plain_classes, plain_fingerprint
from tests.llm.test_tokens import packed_right


def write_tables(spark, folder, rows, labels) -> str:
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def sample(seed: int = 12):
    rng = random.Random(seed)
    rows = odd_texts(seed)
    passage = prose(rng, 90)
    for k in range(100, 340):
        body = [prose(rng, rng.randrange(20, 200))]
        body += ["idiot fool"] * (k % 4 == 0) + [passage] * (k % 9 == 0) + [prose(rng, 20)]
        rows.append((k, " ".join(body)))
    rows += [(k + 1000, t + " more") for k, t in rows if k is not None and k % 10 == 1 and t]
    return rows, [(k, 1, int(k % 4 == 0)) for k in range(100, 340)]


def test_stages_equal_brute_force(spark, tmp_path):
    rows, labels = sample()
    folder = write_tables(spark, tmp_path, rows, labels)
    docs, seen = table(spark, folder, "documents"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        seen[name] = docs
        assert docs.columns == columns or name == "best_fit_packing"
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda p: (p[0] is None, p[0], p[1]))
    order = lambda items: sorted(items, key=lambda p: (p[0] is None, p[0], p[1]))

    def good(t):
        n, chars, symbols, lines, dups, repeats = measured_plainly(t)
        letters, digits = sum(c.isalpha() for c in t or ""), sum(c in "0123456789" for c in t or "")
        return not (n < 50 or 100 * repeats > 50 * n or 10 * symbols > n or 10 * dups > 4 * lines or chars < 2 * n or chars > 15 * n
                    or 2 * letters < chars or 2 * digits > chars)

    left = [p for p in rows if good(p[1])]
    assert pairs(seen["quality_rules"]) == order(left)
    machine = toxicity.train(seen["quality_rules"], table(spark, folder, "labels"))
    terms = toxicity.Terms(machine.feature_of)
    left = [p for p in left if machine.score([terms(p[1])])[0] < 0.7]
    assert pairs(seen["toxicity"]) == order(left)
    assert not [p for p in left if "idiot" in p[1]] and len(left) > 150
    classes = plain_classes({i: plain_fingerprint(t) for i, t in left if i is not None})
    first: dict = {}
    for i, t in left:
        if i is None or (classes[i] == i and i not in first):
            first[i] = t
    assert pairs(seen["simhash_near_dedup"]) == order(first.items())
    gone = repeated_words({i: t for i, t in first.items() if i is not None}, 50)
    after = {r.doc_id: r.text for r in seen["suffix_array_dedup"].collect()}
    for i, t in first.items():
        kept = [w for x, w in enumerate(words(t)) if (i, x) not in gone]
        assert words(after.get(i)) == kept
    assert gone and all(words(t) for t in after.values())
    packed_right(seen["best_fit_packing"].collect(), list(after.items()))


def test_run_is_registered_and_takes_empty_tables(spark, tmp_path):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    empty_documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_policy_of_the_first_stage_covers_all_rules():
    assert quality.POLICIES["v1"].mask == (1 << len(quality.RULES)) - 1

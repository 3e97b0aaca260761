"""The corpus pipeline, stage by stage, against plain versions; and the registered queries."""

from collections import Counter

import brute
import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from millrace.llm import queries
from millrace.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"


def test_stages(spark, documents):
    scratch = Scratch(spark, "test-pipeline")
    benchmark = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, docs = documents.collect(), documents
    seen = {}
    for name, stage in pipeline.STAGES:
        docs = scratch.save(stage(spark, docs, SF))
        after = docs.collect()
        seen[name] = (before, after)
        assert docs.columns[:5] == documents.columns
        before = after
    a, b = seen["language_id"]
    assert Counter(a) - Counter(b) == Counter(r for r in a if not any(c.isalpha() for c in r["text"] or ""))
    a, b = seen["near_duplicates"]
    rows = [(r["doc_id"], r["text"]) for r in a]
    assert Counter(r["doc_id"] for r in b) == Counter({c for _, c in brute.components(rows)})
    a, b = seen["decontamination"]
    found = brute.contamination([(r["doc_id"], r["text"]) for r in a], benchmark)
    assert Counter(b) == Counter(r for r, (n, h, _) in zip(a, found, strict=True) if not (h > 0 and 20 * h >= n))
    a, b = seen["mixture"]
    assert set(b) <= set(a) and max(Counter(b).values()) <= 2
    words = lambda rs: sum(len(brute.WORD.findall(r["text"])) for r in rs)
    assert abs(words(b) - 1.5 * words(a)) < 0.05 * words(a)
    a, b = seen["shards"]
    assert Counter(tuple(r)[:5] for r in b) == Counter(map(tuple, a))
    places = Counter((r["shard"], r["slot"]) for r in b)
    assert max(places.values()) == 1 and len({r["shard"] for r in b}) == 40


def test_language_stage_without_labels(spark, odd):
    rows = odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), "source", "n_chars")
    kept = pipeline.language_id(spark, rows, SF).collect()
    assert Counter(kept) == Counter(r for r in rows.collect() if any(c.isalpha() for c in r["text"] or ""))


def test_near_duplicates_of_odd_rows(spark, odd):
    rows = odd.select("doc_id", "text", "lang", "source", "n_chars")
    kept = pipeline.near_duplicates(spark, rows, SF).collect()
    ids = Counter(r["doc_id"] for r in kept)
    assert ids[6] == 1 and ids[7] == 0 and ids[3] == 1 and ids[4] == 0 and ids[9] == 1


def test_stages_of_odd_and_empty_rows(spark, odd, none):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing and other columns, no rows."""
    names = odd.columns
    clash = odd.withColumn("lang_pred", F.lit("x")).withColumn("target", F.lit(1)).withColumn("source_size", F.lit(2)).withColumn("hit_items", F.lit("i")).withColumn("n_words", F.lit(3)).withColumn("slot", F.lit("t")).withColumn("repeats", F.lit("r")).withColumn("part", F.lit("p")).withColumn("text_crc32", F.lit(0)).withColumn("n", F.lit(0))
    before = Counter(odd.collect())
    for name, stage in pipeline.STAGES:
        got = stage(spark, clash, SF)
        added = ["shard", "slot"] if name == "shards" else []
        assert got.columns == [c for c in clash.columns if c not in added] + added
        rows = got.collect()
        if name != "shards":
            assert set(Counter(r[: len(names)] for r in rows)) <= set(map(tuple, before))
        assert stage(spark, none, SF).count() == 0 and stage(spark, none, SF).columns[:5] == names[:5]
        kept = Counter(r["doc_id"] for r in rows)
        if name == "language_id":
            assert not {0, 1, 2, 11} & set(kept) and kept[6] == 3
        elif name == "near_duplicates":
            assert kept[0] == kept[1] == kept[6] == 1 and kept[7] == kept[4] == 0 and kept[None] == 1  # the null text stays, the copy goes
        elif name == "decontamination":
            assert sum(kept.values()) == odd.count()
        elif name == "mixture":
            assert max(kept.values()) <= 6 and kept[0] >= 1
        else:
            assert len({(r["shard"], r["slot"]) for r in rows}) == odd.count()


def test_repeated_ids_hide_no_copy(spark):
    a, b = "one two three four five six seven", "other words stand here in a row"
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (2, b, "y"), (3, b, "x"), (None, a, "x"), (None, b + " and more words are here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.lit(1))
    kept = pipeline.near_duplicates(spark, docs, SF).select("doc_id", "text").collect()
    assert Counter(map(tuple, kept)) == Counter([(1, a), (2, b), (None, b + " and more words are here")])


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11)) and set(queries.SQL) <= set(queries.QUERIES)

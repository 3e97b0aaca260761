import hashlib
import random
import zlib
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from millrace.llm import contamination, katz, langid, mixing, ngram_join, pii, secret_scan, sharding, substring
from millrace.llm.scratch import Scratch


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def bag(rows):
    return Counter(map(tuple, rows))


def same(a, b):
    assert bag(a) == bag(b)


# 1


def check_components(df):
    rows = pairs(df)
    same(ngram_join.op1(df).collect(), [(d, n, c) for (d, _), (n, c) in zip(rows, brute.components(rows), strict=True)])


def test_ngram_join_documents(documents):
    check_components(documents)


def test_ngram_join_odd_and_empty(odd, none):
    check_components(odd)
    assert ngram_join.op1(none).count() == 0


def test_ngram_join_chains_and_frequent_shingles(spark):
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(30))
    rows, doc = [], [f"c{i}" for i in range(60)]
    for i in range(150):  # near copies that drift: neighbours link, ends do not
        rows.append((1000 + i, " ".join(doc)))
        doc[rng.randrange(60)] = f"n{i}"
    rows += [(i, f"{passage} " + " ".join(f"u{i}_{j}" for j in range(rng.randrange(5, 40)))) for i in range(300)]  # a passage that all share
    rows += [(2000 + i, rows[0][1] + " end") for i in range(40)]
    check_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def test_ngram_join_boilerplate(spark):
    """A shingle that all share, and lengths and positions that rule all pairs out."""
    rows = [(i, f"all rights reserved by the owner of page {i}") for i in range(1500)] + [(5000 + i, f"all rights reserved by the owner of page {i} {i} and of many others too") for i in range(300)]
    check_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


# 2


def test_sharding(spark, documents, odd, none):
    for df in (documents, odd):
        rows = sharding.op2(df).collect()
        shards = Counter(r["shard"] for r in rows)
        assert len(rows) == df.count() and max(shards.values()) - min(shards.get(i, 0) for i in range(40)) <= 1
        slots = {}
        for r in rows:
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        want = bag((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in pairs(df))
        assert bag((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
        same(rows, sharding.op2(df.repartition(5)).collect())
    assert sharding.op2(none).count() == 0


def test_places_are_those_of_a_plain_version(spark, documents, odd):
    for df in (documents, odd):
        rows = sharding.op2(df).collect()
        want = brute.shards([(r["doc_id"], r["text_crc32"], r["size"]) for r in rows], 40, sharding.round_keys(sharding.SEED), sharding.PRIME, sharding.buckets_for(len(rows)), sharding.SEED)
        same([(r["doc_id"], r["shard"], r["slot"]) for r in rows], want)
    one, two = ([r[0] for r in spark.range(500).select(sharding.permuted(F.col("id"), 500, s)).collect()] for s in (1, 2))
    assert one != two and sorted(one) == sorted(two)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4099])
def test_permutation_is_one(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n)).collect()]
    assert sorted(got) == list(range(n)) and (n < 100 or got != sorted(got))


# 3


def check_substrings(df, k=50):
    rows = pairs(df)
    got = substring.deduplicate(df, k).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    same(got, [(d, *x) for (d, _), x in zip(rows, brute.dedupe(rows, k), strict=True)])


def test_substrings(spark, documents, odd, none):
    check_substrings(documents)
    check_substrings(odd)
    check_substrings(spark.createDataFrame([(i, " ".join(f"w{(i * j) % 7}" for j in range(40))) for i in range(30)], "doc_id long, text string").repartition(3), 6)
    assert substring.op3(none).count() == 0


def test_kept_text_and_spans(spark):
    a, b = " ".join(f"a{i}" for i in range(10)), " ".join(f"b{i}" for i in range(10))
    rows = spark.createDataFrame([(1, a), (2, b), (3, f"x {a} {b}  y")], "doc_id long, text string")
    r = substring.deduplicate(rows, 5).where("doc_id = 3").first()
    assert r["kept"] == "x y" and r["n_removed"] == 20 and [(s["start"], s["end"]) for s in r["spans"]] == [(1, 21)]


def plain_factors(rows, k):
    """Greedy factors of each text against the windows of smaller ids, each where it occurs first."""
    words = [brute.WORD.findall(t or "") for _, t in rows]
    first = {}
    for (doc, _), w in sorted(zip(rows, words, strict=True), key=lambda x: x[0][0]):
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i : i + k]), (doc, i))
    out = {}
    for (doc, _), w in zip(rows, words, strict=True):
        source = [s if (s := first[tuple(w[i : i + k])])[0] < doc else None for i in range(len(w) - k + 1)]
        i, out[doc] = 0, []
        while i < len(source):
            if source[i] is None:
                i += 1
                continue
            n = 1
            while i + n < len(source) and source[i + n] == (source[i][0], source[i][1] + n):
                n += 1
            out[doc].append((i, i + n - 1 + k, *source[i]))
            i += n - 1 + k
    return out


def test_factors(spark):
    rng = random.Random(5)
    passages = [[f"p{i}x{j}" for j in range(12)] for i in range(6)]
    rows = []
    for d in range(40):
        text = [f"u{d}y{i}" for i in range(rng.randrange(4))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(5)
            text += p[a : a + rng.randrange(4, 12)] + [f"z{rng.randrange(30)}"] * rng.randrange(2)
        rows.append((d * 3 - 20, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    told = {r["doc_id"]: [tuple(f) for f in r["factors"]] for r in substring.deduplicate(df.coalesce(1), 4).collect()}
    assert told == plain_factors(rows, 4) and sum(map(len, told.values())) > 30
    # in several chunks a chunk's own earlier documents are a block too: other sources, but true ones
    words = {d: t.split() for d, t in rows}
    for r in substring.deduplicate(df.repartition(5), 4).collect():
        end = 0
        for start, stop, source, at in map(tuple, r["factors"]):
            assert end <= start and stop - start >= 4 and source < r["doc_id"] and words[r["doc_id"]][start:stop] == words[source][at : at + stop - start]
            end = stop
    check_substrings(df.repartition(5), 4)


# 4


def test_secrets(spark, documents, odd, none):
    key = hashlib.sha1(b"x").hexdigest()
    texts = [f'the token = "{key}" here', f"commit {key} of master", "see http://host.example.com/usr/local/share/dictionary/words.html now", "internationalization-misunderstanding", f"password: {key[:32]}", "a" * 400_000]
    rows = odd.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in secret_scan.op4(rows).where("doc_id >= 100").collect()}
    assert got[100]["secret_spans"] == f"13:{13 + len(key)}" and got[104]["n_secrets"] == 1
    assert [got[i]["n_secrets"] for i in (101, 102, 103, 105)] == [0] * 4
    assert secret_scan.op4(odd).count() == odd.count() and secret_scan.op4(none).count() == 0


def test_dictionary_counts_all_texts(spark):
    word = F.translate((F.col("id") % 6000).cast("string"), "0123456789", "abcdefghij")
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Common xy"), word, F.when(F.col("id") % 6000 < 3000, F.concat(F.lit(" xy"), word)).otherwise(F.lit(""))).alias("text"))
    counts = Counter(w for r in docs.collect() for w in r["text"].lower().split())
    want = sorted(counts, key=lambda w: (-counts[w], w))[: secret_scan.DICTIONARY]
    assert sorted(r["word"] for r in secret_scan.learned_words(docs).collect()) == sorted(want)


def test_character_features(spark):
    matches = ["internationalization", "AbC-123/xyz+09_=", "ffff0000aaaa1111", "Zz9", "x" * 40, "deadBEEF00"]
    scratch = Scratch(spark, "test-secrets")
    found = spark.createDataFrame([(m, "see token = ", " and") for m in matches], "match string, before string, after string")
    dictionary = spark.createDataFrame([("international",), ("ffff",), ("xyz",)], "word string")
    for r in secret_scan.with_features(found, dictionary, scratch).collect():
        for name, want in brute.transitions(r["match"]).items():
            assert r[name] == pytest.approx(want), (r["match"], name)
        assert (r["assigned"], r["quoted"], r["secret_word"], r["other_word"]) == (1.0, 0.0, 1.0, 0.0)
        assert r["covered"] == pytest.approx({"AbC-123/xyz+09_=": 3 / 16, "ffff0000aaaa1111": 4 / 16}.get(r["match"], 0.0))


def test_forest_on_held_out_findings(spark, documents):
    """Trained on four fifths of the labelled findings, the forest tells the others apart."""
    scratch = Scratch(spark, "test-secrets")
    dictionary = scratch.save(secret_scan.learned_words(documents))
    rows = scratch.save(secret_scan.generated_findings(spark, dictionary))
    model = secret_scan.fit(rows.where("id % 5 <> 1"), dictionary, scratch)
    found = secret_scan.judge(model, secret_scan.with_features(rows.where("id % 5 = 1"), dictionary, scratch)).select("label", "p").collect()
    told, true = [r for r in found if r["p"] > 0.5], [r for r in found if r["label"] == 1]
    hit = sum(r["label"] for r in told)
    print("precision", hit / len(told), "recall", hit / len(true))
    assert hit / len(told) >= 0.9 and hit / len(true) >= 0.9


# 5


def check_contamination(docs, benchmark, **options):
    rows = pairs(docs)
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    found = contamination.judged(contamination.find(docs.select("doc_id", "text"), benchmark, ["doc_id"], **options))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["hit_items"])) for r in found.collect()]
    same(got, [(d, n, h, ",".join(i)) for (d, _), (n, h, i) in zip(rows, brute.contamination(rows, items), strict=True)])


def test_contamination(spark, documents, odd, none):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    check_contamination(documents, benchmark)
    check_contamination(documents, benchmark, block_bytes=2000)  # in several passes
    items = spark.createDataFrame([(1, "one, two"), (2, None), (None, "a b c"), (3, "a"), (4, " ".join(f"alpha{i} beta{i % 5}" for i in range(5, 25))), (4, "текст"), (5, "!!")], "item_id long, text string")
    check_contamination(odd, items)
    assert contamination.op5(odd, items.limit(0)).where("contaminated").count() == 0 and contamination.op5(none, items).count() == 0
    assert contamination.find(odd, items).drop("n_words", "hit_spans", "hit_items").columns == [c for c in odd.columns if c != "hit_spans"]


# 6


def check_personal(df):
    got = bag((r["doc_id"], r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in pii.op6(df).collect())
    want = Counter()
    for d, t in pairs(df):
        s = brute.personal(t)
        want[(d, hashlib.sha256(",".join(s).encode()).hexdigest(), *[sum(x.startswith(k) for x in s) for k in ("email", "ip", "card", "phone")])] += 1
    assert got == want


def test_personal_data(spark, documents, odd, none):
    check_personal(documents)
    tricky = ["a@b.co", "x@y@z.com.", "é a@b.com_c@d.org", "1.2.3.4.5.6.7.8", "999.1.1.1 0000255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824, +1", "+49 30 1234567 8 ñ 10.0.0.1", "7" * 30_000, "a." * 20_000 + "@", "+" + "1 " * 9_000]
    check_personal(odd.select("doc_id", "text").union(spark.createDataFrame([(200 + i, t) for i, t in enumerate(tricky)], "doc_id long, text string")))
    assert pii.op6(none).count() == 0


def test_bootstrapping_discovers(spark):
    rows = [(i, f"reach us at mail box{i}@host{i % 3}.example.com for more") for i in range(20)]
    rows += [(50, "reach us at mail jane9.at.host1 for more"), (51, "the year 1984 was fine")]
    got = {r["doc_id"]: r for r in pii.op6(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id >= 50").collect()}
    assert got[50]["spans"] == "email:17:31" and got[50]["n_email"] == 0 and got[51]["spans"] == ""


def test_seeds_without_digits_and_long_neighbours(spark):
    name = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    far = "x" * 200
    rows = [(i, f"please write {far} {name(i)}@mail.example.com today") for i in range(20)]
    rows += [(50, f"please write {far} jane(at)host9 today"), (51, "please write soon jane(at)host8 then")]
    got = {r["doc_id"]: r["spans"] for r in pii.op6(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id >= 50").collect()}
    start = len(f"please write {far} ")
    assert got == {50: f"email:{start}:{start + 13}", 51: ""}


# 8


def test_mixing(spark, documents, odd, none):
    for df in (documents, odd):
        rows = mixing.op8(df.select("doc_id", "text", "source")).collect()
        source = {}
        for d, s in df.select("doc_id", "source").distinct().collect():
            source.setdefault(d, set()).add(s)
        assert all(r["taken"] <= 2 * r["size"] for r in rows) and len(rows) == df.count()
        taken, target = Counter(), {}
        for r in rows:
            (s, *_) = source[r["doc_id"]]
            if len(source[r["doc_id"]]) == 1 and r["doc_id"] is not None:
                taken[s] += r["taken"]
                target[s] = r["target"]
        if df is documents:
            assert all(abs(taken[s] - target[s]) <= 1 for s in target)
        assert bag(rows) == bag(mixing.op8(df.select("doc_id", "text", "source").repartition(3)).collect())
    assert mixing.op8(none).count() == 0


def filled(sizes, weights, share=1.5, cap=2.0):
    """Water-filling by redistribution, round after round."""
    total, target, free = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        w = sum(weights[i] for i in free)
        over = {i for i in free if total * weights[i] / w > cap * sizes[i]}
        if not over:
            for i in free:
                target[i] = total * weights[i] / w
            break
        for i in over:
            target[i] = cap * sizes[i]
            total -= target[i]
        free -= over
    return target


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1000, 1, 5, 70, 3, 900], [5], [7, 0, 9], [1, 10_000]])
def test_water_filling(spark, sizes):
    rows = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "__key string, source_size long")
    got = [r["target"] for r in mixing.targets(rows, F.lit(1.5 * sum(sizes)), (3, 1, 2), 2.0).orderBy("__key").collect()]
    assert got == pytest.approx(filled(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))]))


# 9


def check_scores(df):
    rows = pairs(df)
    train = [d is None or zlib.crc32(str(d).encode()) % 5 != 1 for d, _ in rows]
    model = brute.Katz([t for (_, t), k in zip(rows, train, strict=True) if k])
    is_train = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1, F.lit(True))
    got = sorted(([-1 if r[0] is None else r[0], *r[1:]] for r in katz.score(df, is_train).collect()), key=lambda r: (r[0], r[2], r[6]))
    want = sorted(([-1 if d is None else d, not k, *model.score(t)] for (d, t), k in zip(rows, train, strict=True)), key=lambda r: (r[0], r[2], r[5]))
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4] and g[4] == model.N and g[5:] == pytest.approx(w[4:], rel=1e-9)
    return model


def test_katz(documents, odd, none):
    model = check_scores(documents)
    for h in ("<s>", "the", "</s>"):  # every history's probabilities sum to 1
        assert sum(model.prob(h, w) for w in model.p) == pytest.approx(1)
    check_scores(odd)
    assert katz.op9(none).count() == 0


def test_katz_caches_change_no_score(documents, monkeypatch):
    """Whatever words and pairs are dealt by pair or broadcast, the scores are those of the plain version."""
    some = documents.where("doc_id < 80")
    for least, share in ((1, 1 / 4096), (1 << 40, 1.0), (3, 1 / 50)):
        monkeypatch.setattr(katz, "COMMON_LEAST", least)
        monkeypatch.setattr(katz, "HOT_SHARE", share)
        check_scores(some.repartition(3))


# 10


def test_language_id(documents, odd, none):
    rows = langid.op10(documents).collect()
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    got = langid.op10(odd).collect()
    assert len(got) == odd.count() and sum(r["lang_pred"] == "und" for r in got) == 5
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {0, 1, 2, 11, None} and all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert langid.op10(none).count() == 0


def test_language_scores_are_cosines(documents):
    """Prototypes and scores against a plain version."""
    import numpy as np

    some = documents.orderBy("doc_id").limit(40)
    rows = [(t, lang) for t, lang in some.select("text", "lang").collect()]
    known: dict[str, list[int]] = {}
    vector = lambda c: known.setdefault(c, langid.letter_vectors(np.array([0 if c == " " else ord(c)], np.uint64))[0].astype(int).tolist())
    bundles = [np.array(brute.bundle(t[:300], vector, langid.DIM), float) for t, _ in rows]
    langs = sorted({lang for _, lang in rows})
    proto = [sum(b for b, (_, x) in zip(bundles, rows, strict=True) if x == lang) for lang in langs]
    want = sorted(max(float(b @ p / np.linalg.norm(b) / np.linalg.norm(p)) for p in proto) for b in bundles)
    short = some.withColumn("text", F.substring("text", 1, 300))
    assert sorted(r["score"] for r in langid.predict(short, langid.fit(short)).collect()) == pytest.approx(want, abs=1e-5)


def test_language_model_is_bounded_and_deterministic(documents):
    a, b = langid.fit(documents, 20), langid.fit(documents.repartition(7), 20)
    assert a[0] == b[0] and (a[1] == b[1]).all()

"""Secret scans: candidates by shape, false positives removed by a random forest.

A candidate is a run of 12 or more letters, digits and ``+/=_-`` that holds a digit, or of 16 or more without one. Features
are its length, the shares of digits, capitals and distinct characters, how often each kind of character follows each
(lower case, capital, digit, other) and a vowel a consonant, the share of its
letters that dictionary words cover, whether it looks like a path, and the neighbouring words: the two before it and the one behind it, however
long (an assignment, a quote, a secret's usual names, a checksum's or address's usual names).

The forest is trained from labelled findings (``findings``: match, before, after, label), by default a
generated set of FINDINGS rows (a documented bound) whose labels come from how a string was made (at random, or from
words, digests, numbers, paths, fillers), not from what stands beside it; both kinds stand in all kinds of contexts. The dictionary holds the DICTIONARY most frequent
words of all texts, equal counts in the words' order. Scanning covers all texts.

Everything is DataFrame expressions and Spark's own forest; candidates are few, so only they are
shuffled. Results for odd input: null texts are empty; a null ``doc_id`` is a key like others;
repeated rows get equal results; very long texts count whole; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.scratch import Scratch

CANDIDATE = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/=_-]*+[0-9]|[A-Za-z+/=_-]{16})[A-Za-z0-9+/=_-]{12,}+"
FINDINGS, DICTIONARY, TREES, DEPTH, SEED = 4000, 5000, 40, 10, 11
SPACE = r"\x20\x09-\x0D"
#: Character classes whose transitions count: each is a feature for each that may follow.
CLASSES = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "other": "+/=_-"}
TRANSITIONS = [f"{a}_{b}" for a in CLASSES for b in CLASSES]
FEATURES = ["length", "digits", "capitals", "distinct", "hex", *TRANSITIONS, "spoken", "path", "assigned", "quoted", "secret_word", "other_word", "covered"]
#: Words that usually stand beside a secret, and beside harmless long strings.
SECRET_WORDS = ["token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "auth", "bearer", "credential", "private"]
OTHER_WORDS = ["commit", "sha1", "sha256", "md5", "checksum", "digest", "uuid", "http", "https", "www", "href", "src", "path", "file", "version", "id"]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, h, start, end, match, before, after) of every candidate; before and after: the neighbouring words."""
    t = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(t).alias("h"), t.alias("text")).withColumn("m", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).where(F.size("m") > 0)
    two, one = rf"(?<![^{SPACE}])([^{SPACE}]++[{SPACE}]++[^{SPACE}]*+)$", rf"(?<![^{SPACE}])([^{SPACE}]*+)$"
    last = lambda p: F.coalesce(F.nullif(F.regexp_extract(p, two, 1), F.lit("")), F.regexp_extract(p, one, 1))
    pieces = F.transform(F.split("text", CANDIDATE, -1), lambda p: F.struct(F.length(p).alias("n"), last(p).alias("last"), F.regexp_extract(p, rf"^([{SPACE}]*+[^{SPACE}]*+)", 1).alias("first")))
    rows = rows.select("doc_id", "h", F.arrays_zip("m", pieces.alias("p")).alias("x")).dropDuplicates(["doc_id", "h"])
    flat = rows.select("doc_id", "h", F.posexplode("x").alias("i", "x")).select("doc_id", "h", "i", F.col("x.m").alias("match"), F.col("x.p").alias("p"))
    order = Window.partitionBy("doc_id", "h").orderBy("i")
    end = F.sum(F.col("p.n") + F.coalesce(F.length("match"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    flat = flat.withColumn("end", end.cast("long")).withColumn("after", F.lead("p.first").over(order)).where("match is not null")
    return flat.select("doc_id", "h", (F.col("end") - F.length("match")).cast("long").alias("start"), "end", "match", F.col("p.last").alias("before"), "after")


def times(pattern: str) -> Column:
    return F.regexp_count("match", F.lit(pattern))


def word_of(words: list[str], text: Column) -> Column:
    return text.rlike("(?i)(?<![a-z])(" + "|".join(words) + ")(?![a-z])").cast("double")


def with_features(found: DataFrame, dictionary: DataFrame, scratch: Scratch) -> DataFrame:
    """``found`` (match, before, after and keys) with the features; a row may come more than once."""
    before, after, n = F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")), F.length("match")
    steps = F.greatest(n - 1, F.lit(1))
    follows = {f"{a}_{b}": times(f"[{x}](?=[{y}])") / steps for a, x in CLASSES.items() for b, y in CLASSES.items()}
    path = F.col("match").rlike("/[A-Za-z_-]+/") | before.rlike(rf"[/\\][^{SPACE}]*$") | after.rlike(r"^\.[a-z]{1,4}\b")
    rows = found.select(
        "*", n.cast("double").alias("length"), (times("[0-9]") / n).alias("digits"), (times("[A-Z]") / n).alias("capitals"),
        (F.size(F.array_distinct(F.split("match", ""))) / F.least(n, F.lit(64))).alias("distinct"), F.col("match").rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double").alias("hex"),
        *[c.alias(name) for name, c in follows.items()], (times("(?i)[bcdfghj-np-tv-z](?=[aeiou])") / steps).alias("spoken"), path.cast("double").alias("path"),
        before.rlike(rf"[=:][{SPACE}]*[\"'`]?$").cast("double").alias("assigned"), before.rlike("[\"'`]$").cast("double").alias("quoted"),
        word_of(SECRET_WORDS, before).alias("secret_word"), word_of(OTHER_WORDS, F.concat(before, F.lit(" "), after)).alias("other_word"),
    )
    runs = rows.select("match").distinct().withColumn("word", F.explode(F.regexp_extract_all(F.lower(F.regexp_replace("match", "(?<=[a-z])(?=[A-Z])", "-")), F.lit("[a-z]{3,}+"), F.lit(0))))
    covered = runs.join(dictionary, "word").groupBy("match").agg(F.sum(F.length("word")).alias("__c"))
    covered = scratch.save(covered)  # so that the join deals both sides anew and adaptive execution can split a frequent match
    return rows.join(covered, "match", "left").withColumn("covered", F.coalesce(F.col("__c") / F.col("length"), F.lit(0.0))).drop("__c")


def learned_words(docs: DataFrame) -> DataFrame:
    """The dictionary: the most frequent letters-only words of all texts."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("(?<![a-z])[a-z]{3,}+(?![a-z])"), F.lit(0))).alias("word"))
    return words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(DICTIONARY).select("word")


def generated_findings(spark: SparkSession, dictionary: DataFrame, rows: int = FINDINGS) -> DataFrame:
    """Labelled findings (match, before, after, label): random strings, and harmless ones of several kinds."""
    digest = lambda name: F.sha2(F.concat(F.lit(name), F.col("id").cast("string")), 256)
    number = lambda at, below: F.conv(F.substring("h", at, 6), 16, 10).cast("int") % below
    known = dictionary.where(F.length("word") < 12).withColumn("i", F.row_number().over(Window.orderBy("word")) - 1)  # at most DICTIONARY rows
    size = max(known.count(), 1)
    raw = spark.range(rows).withColumn("h", digest("finding")).withColumn("r", digest("string"))
    for k in range(3):
        raw = raw.withColumn("i", number(1 + 6 * k, size)).join(known.select("i", F.col("word").alias(f"w{k}")), "i", "left").withColumn(f"w{k}", F.coalesce(f"w{k}", F.lit("sample"))).drop("i")
    b64 = F.regexp_replace(F.base64(F.unhex("r")), "=+$", "")
    one_of = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), number(at, len(values)) + 1)
    alnum = F.translate(b64, "+/", "xQ")
    kinds = [  # match, label
        (F.substring("r", 1, 32), 1), (F.substring("r", 3, 40), 1), (F.col("r"), 1), (F.substring(b64, 1, 40), 1), (F.substring(alnum, 2, 20), 1), (F.concat(one_of(["sk_", "ghp_", "AKIA", "key-"], 30), F.substring(alnum, 5, 24)), 1), (F.concat("w0", F.substring(alnum, 1, 8)), 1),
        (F.concat_ws("_", "w0", "w1", "w2"), 0), (F.concat("w0", F.initcap("w1"), F.initcap("w2"), F.initcap("w0")), 0), (F.concat_ws("-", "w0", "w1", "w2", "w0"), 0), (F.concat(F.lit("usr/"), "w0", F.lit("/"), "w1", F.lit("/"), "w2"), 0),
        (F.substring("r", 3, 40), 0), (F.substring("r", 3, 32), 0), (F.repeat(F.substring("r", 1, 1), 24), 0), (F.substring(F.translate("r", "abcdef", "123456"), 1, 18), 0), (F.concat("w0", F.lit("_"), "w1", F.lit("_20"), F.substring(F.translate("r", "abcdef", "123456"), 1, 6)), 0), (F.upper(F.concat("w0", "w1", "w2")), 0),
    ]
    kind = F.pmod("id", F.lit(len(kinds)))
    pick = lambda values: F.element_at(F.array(*values), (kind + 1).cast("int"))
    name, other = one_of(SECRET_WORDS, 36), one_of(OTHER_WORDS, 42)
    joint = one_of([" = \"", "='", ": ", "=", " "], 48)
    named, neutral, described = F.concat("w1", F.lit(" "), F.when(number(54, 3) == 0, F.upper(name)).otherwise(name), joint), F.concat("w1", F.lit(" "), "w2", joint), F.concat(F.lit("see "), other, F.lit(" "))
    # digests are told from keys by what stands beside them; all others stand anywhere
    digests, secrets, turn = F.pmod("id", F.lit(len(kinds))).isin(11, 12), F.pmod("id", F.lit(len(kinds))) < 7, number(58, 100)
    before = F.when(digests, F.when(turn < 75, described).otherwise(F.concat("w1", F.lit(" "), "w2", F.lit(" "))))
    before = before.when(secrets, F.when(turn < 70, named).when(turn < 92, neutral).otherwise(F.concat("w1", F.lit(" "), "w2", F.lit(" \"")))).otherwise(F.when(turn < 25, named).when(turn < 60, neutral).when(turn < 75, described).otherwise(F.concat("w1", F.lit(" "), "w2", F.lit(" "))))
    return raw.select(pick([m for m, _ in kinds]).alias("match"), before.alias("before"), one_of(['" and', "'", " and", ".", ""], 52).alias("after"), pick([F.lit(float(y)) for _, y in kinds]).alias("label"), "id")


def fit(findings: DataFrame, dictionary: DataFrame, scratch: Scratch) -> RandomForestClassificationModel:
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(findings, dictionary, scratch)).select("features", "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(rows)


def judge(model: RandomForestClassificationModel, rows: DataFrame) -> DataFrame:
    """``rows`` with the forest's share ``p`` of votes for a secret."""
    judged = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
    return judged.withColumn("p", vector_to_array("probability")[1])


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, h, start, end, match, p, secret) of every candidate in ``docs`` (doc_id, text)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "secrets")
    dictionary = scratch.save(learned_words(docs.select("doc_id", "text")))
    model = fit(findings if findings is not None else generated_findings(spark, dictionary), dictionary, scratch)
    found = scratch.save(candidates(docs))
    return judge(model, with_features(found, dictionary, scratch)).select("doc_id", "h", "start", "end", "match", "p").withColumn("secret", F.col("p") > threshold)


def op4(docs: DataFrame) -> DataFrame:
    """Candidates and secrets of each of ``documents``, with the secrets' spans (code points)."""
    found = scan(docs.select("doc_id", "text"))
    span = F.when(F.col("secret"), F.struct("start", "end"))
    by = found.groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(span)).alias("spans"))
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    rows = keyed.join(by, keyed["doc_id"].eqNullSafe(by["__id"]) & (keyed["h"] == by["__h"]), "left")
    told = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    zero = F.lit(0).cast("long")
    return rows.select("doc_id", F.coalesce("n", zero).alias("n_candidates"), F.coalesce(F.size("spans").cast("long"), zero).alias("n_secrets"), F.coalesce(told, F.lit("")).alias("secret_spans"))

r"""Personal data: base patterns, and unseen identifiers by bootstrapped contextual extraction.

Base entities (e-mail, IP, card, phone) come from regular expressions; positions follow from the
lengths of the pieces between the matches. Then tokens with a digit or an @ are candidates: those that
overlap a base entity are seeds. Seeds induce lexical patterns (the two words before, the word
before, the word after, however long), patterns are scored on the graph of distinct (instance, pattern) pairs by
the share of their instances that are seeds of one kind, instances by the noisy-or of their
patterns, and instances above the threshold become seeds of the next round, until no round finds another. Their
occurrences are added under the kind they were found for; base spans always stay.

Everything is DataFrame expressions. Regular expressions are written so that they never go back
over a run of characters twice, which keeps very long texts linear; the \G and lookbehind parts
only skip starts that cannot match.

Results for odd input: null texts are empty; a null ``doc_id`` is a key like others; repeated rows
get equal results; a doc_id with several texts gets a row for each; an empty table gives an empty
result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.scratch import Scratch

KINDS = ("email", "ip", "card", "phone")
SPACE = r"\x20\x09-\x0D"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "token": rf"(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+",
}
#: A pattern needs so many distinct seeds and this share of seeds; an instance this noisy-or.
SEEDS, CONFIDENCE, ACCEPT = 3, 0.8, 0.9
#: The last one or two words of a piece of text with what follows them, and its first.
LAST_TWO, LAST_ONE, FIRST = rf"(?<![^{SPACE}])([^{SPACE}]++[{SPACE}]++[^{SPACE}]++[{SPACE}]*+)$", rf"(?<![^{SPACE}])([^{SPACE}]++[{SPACE}]*+)$", rf"^([{SPACE}]*+[^{SPACE}]++)"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of at most 19 digits passes Luhn's test."""
    padded = F.lpad(number, 19, "0")

    def add(total: Column, i: Column) -> Column:
        d = F.substring(padded, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.lit(19)), F.lit(0), add) % 10 == 0


def holds(kind: Column, match: Column) -> Column:
    """What a match of each kind must satisfy beyond its pattern."""
    d = digits(match)
    byte = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
    card = F.length(d).between(13, 19) & luhn(F.when(F.length(d).between(13, 19), d).otherwise("1"))
    return F.when(kind == 1, match.rlike(rf"^{byte}\.{byte}\.{byte}\.{byte}$")).when(kind == 2, card).when(kind == 3, F.length(d).between(9, 15)).otherwise(True)


def segment(kind: int) -> Callable[[Column], Column]:
    """Makes a match, and the piece of text before it, a row of ``kind``."""
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["m"].alias("match"), x["p"]["n"].alias("gap"), x["p"]["last"].alias("last"), x["p"]["first"].alias("first"))


def of_kind(spans: Column, kind: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def matches(docs: DataFrame) -> DataFrame:
    """(doc_id, h, kind, start, end, match, before, after) of every match; kind 4: tokens with a digit or an @."""
    t = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(t).alias("h"), t.alias("text"))
    rows = rows.withColumn("digit", F.col("text").rlike("[0-9]")).withColumn("at", F.col("text").contains("@")).where("digit or at")
    names = [*KINDS, "token"]
    for name in names:
        rows = rows.withColumn("m_" + name, F.when(F.expr({"email": "at", "token": "digit or at"}.get(name, "digit")), F.regexp_extract_all("text", F.lit(PATTERNS[name]), F.lit(0))))
    rows = rows.where(" or ".join(f"size(m_{name}) > 0" for name in names))
    found = []
    for i, name in enumerate(names):
        m, piece = F.col("m_" + name), F.split("text", PATTERNS[name], -1)
        if name == "token":
            last = lambda p: F.coalesce(F.nullif(F.regexp_extract(p, LAST_TWO, 1), F.lit("")), F.regexp_extract(p, LAST_ONE, 1))
            ends = F.transform(piece, lambda p: F.struct(F.length(p).alias("n"), last(p).alias("last"), F.regexp_extract(p, FIRST, 1).alias("first")))  # noqa: B023
        else:
            ends = F.transform(piece, lambda p: F.struct(F.length(p).alias("n"), F.lit(None).cast("string").alias("last"), F.lit(None).cast("string").alias("first")))
        found.append(F.when(F.size(m) > 0, F.transform(F.arrays_zip(m.alias("m"), ends.alias("p")), segment(i))).otherwise(F.array()))
    rows = rows.select("doc_id", "h", *[f.alias(f"f{i}") for i, f in enumerate(found)]).dropDuplicates(["doc_id", "h"])
    flat = rows.select("doc_id", "h", F.explode(F.array(*[F.col(f"f{i}") for i in range(len(names))])).alias("f")).select("doc_id", "h", F.posexplode("f").alias("i", "f")).select("doc_id", "h", "i", "f.*")
    order = Window.partitionBy("doc_id", "h", "kind").orderBy("i")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.length("match")
    flat = flat.withColumn("end", F.sum(F.col("gap") + F.coalesce(n, F.lit(0))).over(upto)).withColumn("after", F.lead("first").over(order))
    return flat.where("match is not null").select("doc_id", "h", "kind", (F.col("end") - n).cast("long").alias("start"), F.col("end").cast("long").alias("end"), "match", F.col("last").alias("before"), "after")


def candidates(found: DataFrame) -> DataFrame:
    """Tokens with a digit or an @: instance, its span, its patterns, and the kind of the base entity they overlap."""
    base, token = found.where("kind < 4"), found.where("kind = 4")
    lead = F.length(F.regexp_extract("match", r"^([^A-Za-z0-9+]*+)", 1))
    instance = F.regexp_replace("match", r"^[^A-Za-z0-9+]++|(?<=[A-Za-z0-9])[^A-Za-z0-9]++$", "")
    token = token.withColumn("instance", instance).withColumn("start", F.col("start") + lead).withColumn("end", F.col("start") + F.length("instance"))
    one, two = rf"([^{SPACE}]+)[{SPACE}]*$", rf"([^{SPACE}]+[{SPACE}]+[^{SPACE}]+)[{SPACE}]*$"
    word = lambda c: F.lower(c)
    patterns = F.array(
        F.concat(F.lit("2:"), word(F.regexp_replace(F.regexp_extract("before", two, 1), rf"[{SPACE}]+", " "))),
        F.concat(F.lit("1:"), word(F.regexp_extract("before", one, 1))),
        F.concat(F.lit("3:"), word(F.regexp_extract("after", rf"^[{SPACE}]*([^{SPACE}]+)", 1))),
    )
    token = token.withColumn("patterns", F.filter(patterns, lambda p: F.length(p) > 2))
    marks = base.select("doc_id", "h", F.col("start").alias("at"), F.lit(0).alias("what"), F.struct("end", "kind").alias("mark"), F.lit(None).cast("string").alias("instance"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit(None).cast("array<string>").alias("patterns"))
    rows = marks.union(token.select("doc_id", "h", (F.col("end") - 1).alias("at"), F.lit(1).alias("what"), F.lit(None).cast("struct<end: bigint, kind: int>").alias("mark"), "instance", "start", "end", "patterns"))
    upto = Window.partitionBy("doc_id", "h").orderBy("at", "what").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("mark", F.max("mark").over(upto)).where("what = 1")
    return rows.select("doc_id", "h", "instance", "start", "end", "patterns", F.when(F.col("mark.end") > F.col("start"), F.col("mark.kind")).alias("kind"))


def bootstrap(tokens: DataFrame, scratch: Scratch) -> DataFrame:
    """(instance, kind) of the instances that patterns discover."""
    edges = scratch.save(tokens.where("instance <> ''").select("instance", F.explode("patterns").alias("pattern")).distinct())
    seeds = scratch.save(tokens.where("kind is not null and instance <> ''").groupBy("instance").agg(F.min("kind").alias("kind")))
    first = seeds
    while True:
        known = edges.join(seeds, "instance", "left")
        counts = known.groupBy("pattern").agg(F.count("*").alias("all"), *[F.count(F.when(F.col("kind") == k, 1)).alias(f"k{k}") for k in range(len(KINDS))])
        best = F.greatest(*[F.struct(F.col(f"k{k}").alias("n"), F.lit(-k).alias("kind")) for k in range(len(KINDS))])
        good = counts.select("pattern", "all", best.alias("best")).where((F.col("best.n") >= SEEDS) & (F.col("best.n") >= F.col("all") * CONFIDENCE))
        good = good.select("pattern", (-F.col("best.kind")).alias("to"), (F.col("best.n") / (F.col("all") + 1)).alias("p"))
        fresh = known.where("kind is null").join(good, "pattern").groupBy("instance", "to").agg((1 - F.exp(F.sum(F.log(1 - F.col("p"))))).alias("p"))
        fresh = fresh.where(F.col("p") >= ACCEPT).groupBy("instance").agg(F.max_by("to", F.struct("p", -F.col("to"))).alias("kind"))
        fresh = scratch.save(fresh)
        if fresh.isEmpty():
            break
        seeds = scratch.save(seeds.union(fresh))
    return seeds.join(first.select("instance"), "instance", "left_anti")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, h, base, added) of the texts in which something is found; spans are (kind, start, end)."""
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.save(matches(docs).where(holds(F.col("kind"), F.col("match"))))
    tokens = scratch.save(candidates(found))
    new = bootstrap(tokens, scratch)
    added = tokens.where("kind is null").drop("kind").join(new, "instance").select("doc_id", "h", "kind", "start", "end", F.lit(1).alias("added"))
    rows = found.where("kind < 4").select("doc_id", "h", "kind", "start", "end", F.lit(0).alias("added")).union(added)
    span = F.struct("kind", "start", "end")
    return rows.groupBy("doc_id", "h").agg(*[F.array_sort(F.collect_list(F.when(F.col("added") == k, span))).alias(name) for k, name in enumerate(("base", "added"))])


def op6(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans of ``documents``."""
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    found = spans(docs).withColumnRenamed("doc_id", "__id").withColumnRenamed("h", "__h")
    rows = keyed.join(found, keyed["doc_id"].eqNullSafe(found["__id"]) & (keyed["h"] == found["__h"]), "left")
    base = F.coalesce("base", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>"))
    every = F.array_sort(F.concat(base, F.coalesce("added", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    told = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(of_kind(base, k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(every).alias("spans"))

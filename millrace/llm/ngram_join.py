"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair.

Two documents link when the Jaccard similarity of their sets of distinct 5-word shingles is 0.8 or
more. Texts with equal sets form a class and are joined once. For each class:

* Document frequencies of all shingles are counted in packed postings. Shingles of one class only
  cannot match; they come first in the rare-first order and are never sent back.
* Only classes whose prefix (n - ceil(0.8 n) + 1 rarest shingles) holds a shared shingle go on,
  with their shared shingles. Very frequent shingles (in a chunk of documents already) are taken
  last in the order and are known to the mappers, so their postings never meet in one task.
* Classes that share a prefix shingle are candidates if the length, positional and suffix filters
  allow it. The suffix filter cuts the sets at 16 points of the hash order; the sizes of the parts bound the
  overlap before any set is fetched.
* First each prefix shingle's classes are compared with its hub, the class with the fewest unshared
  shingles. Then, exactly, all candidates that are not yet connected and were not compared: in each prefix
  shingle's group the members outside the largest component meet the members of other components.
  Length and position are tested between the distinct (size, position) kinds of a group before its members
  meet, so a shingle that very many documents share costs nothing where the filters rule them out.
  Pairs that are already connected need no verification, so a group of copies costs its size, not its square.

A set's identity is a 64-bit fingerprint, a shingle inside a pair 48 bits of its hash.

Results for odd input: a null or wordless text has no shingles, links with nothing and is its own
component; fewer than five words form one shingle; repeated rows link as equal texts do; a null
``doc_id`` never is a component's smallest id (its row gets the component's, or null); an empty
table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import postings as P
from millrace.llm import words as W
from millrace.llm.components import components
from millrace.llm.scratch import Scratch

SIZE, PERCENT, PARTS = 5, 80, 16
#: A task remembers so many classes it has sent; others may be sent again.
REMEMBERED = 1 << 16
#: A shingle counts as frequent from so many documents of a chunk on, and over all from so many or this share; at most so many are kept.
FREQUENT_HERE, FREQUENT_LEAST, FREQUENT_SHARE, FREQUENT_MOST = 8, 64, 0.001, 500_000


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """n - ceil(percent n / 100) + 1."""
    return n - (percent * n + 99) // 100 + 1


def shingle_sets(text: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle, sorted by row; set size and fingerprint per row."""
    buf, off = W.text_bytes(text)
    starts, ends, first = W.split(buf, off, W.space_class())
    h = W.word_hashes(buf, starts, ends, True)
    count, n = np.diff(first), len(h)
    row_of = np.repeat(np.arange(len(count)), count)
    row, value = [], []
    for k in range(1, size + 1):
        w = W.window_hashes(h, k)
        if k < size:
            at = first[:-1][count == k]
        else:
            at = np.flatnonzero(W.window_starts(first, k)) if n else np.zeros(0, np.int64)
        row.append(row_of[at])
        value.append(w[at] if len(at) else np.zeros(0, np.uint64))
    row, value = np.concatenate(row), np.concatenate(value)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    sizes = np.bincount(row, minlength=len(count))
    sums = np.zeros(len(count), np.uint64)
    np.add.at(sums, row, W.mix(value ^ np.uint64(W.STEP)))
    return row, value, sizes, W.mix(sums + sizes.astype(np.uint64)).view(np.int64)


def signatures(batches, size: int):
    """kind 0: (doc_id, fingerprint, set size); kind 1: (-, frequent shingle, its documents here)."""
    for batch in W.chunks(batches):
        row, value, sizes, cid = shingle_sets(batch.column("text"), size)
        out = [(batch.column("doc_id").cast(pa.int64()), cid, sizes)]
        _, at = np.unique(cid, return_index=True)  # equal sets count once
        once = np.zeros(len(cid), bool)
        once[at] = True
        token, seen = np.unique(value[once[row]] & P.LOW48, return_counts=True)
        token, seen = token[seen >= FREQUENT_HERE], seen[seen >= FREQUENT_HERE]
        out.append((pa.nulls(len(token), pa.int64()), token.view(np.int64), seen))
        for kind, (doc, a, n) in enumerate(out):
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(a), pa.int32()), doc, pa.array(a, pa.int64()), pa.array(n.astype(np.int64))], ["kind", "doc_id", "cid", "n"])


def post(batches, size: int, parts: int, hot: np.ndarray):
    """kind 0: shingles by their hash; kind 1: each class's frequent shingles, kind 2: its set size (both by class)."""
    last = np.arange(1, REMEMBERED + 1)  # no key that belongs there
    for batch in W.chunks(batches):
        row, value, sizes, cid = shingle_sets(batch.column("text"), size)
        _, at = np.unique(cid, return_index=True)
        at = at[(sizes[at] > 0) & (last[cid[at] % REMEMBERED] != cid[at])]
        last[cid[at] % REMEMBERED] = cid[at]
        take = np.zeros(len(cid), bool)
        take[at] = True
        mine = take[row]
        ids, value = cid[row[mine]], value[mine]
        token = value & P.LOW48
        at = np.searchsorted(hot, token)
        frequent = (at < len(hot)) & (hot[np.minimum(at, max(len(hot) - 1, 0))] == token) if len(hot) else np.zeros(len(token), bool)
        part = P.parts_of(value[~frequent], parts)
        yield from P.rows(0, P.pack(part, ids[~frequent], token[~frequent]))
        yield from P.rows(1, P.pack(P.parts_of(ids[frequent].view(np.uint64), parts), ids[frequent], token[frequent]))
        yield from P.rows(2, P.pack(P.parts_of(cid[take].view(np.uint64), parts), cid[take], sizes[take].astype(np.uint64)))


def count(batches, parts: int):
    """Sends the shingles of two classes or more back to their classes, with their document frequency."""
    blobs = P.gather(batches)
    for kind in (1, 2):
        for blob in blobs.get(kind, []):
            ids = np.frombuffer(blob, "<i8", 1, 4)
            yield P.batch_of(kind, P.parts_of(ids.view(np.uint64), parts).tolist(), [blob])
    ids, token = P.unpack(blobs.pop(0, []))
    order = np.lexsort((ids, token))
    ids, token = ids[order], token[order]
    if len(ids):
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (token[1:] != token[:-1])
        ids, token = ids[new], token[new]
        _, at, df = np.unique(token, return_inverse=True, return_counts=True)
        df = df[at]
        ids, token, df = ids[df > 1], token[df > 1], df[df > 1]
        yield from P.rows(0, P.pack(P.parts_of(ids.view(np.uint64), parts), ids, token, df))


SETS = "cid long, n int, own int, shared binary, prefix array<long>, parts array<int>"


def prefixes(batches, percent: int, hot: np.ndarray, hot_df: np.ndarray):
    """Classes with a shared shingle in their prefix: all shared shingles, those of the prefix in order, the sizes of the parts."""
    blobs = P.gather(batches)
    cid, n = P.unpack(blobs.pop(2, []))
    cid, at = np.unique(cid, return_index=True)
    n = n[at].astype(np.int64)
    ids, token, df = P.unpack(blobs.pop(0, []), True)
    hot_ids, hot_token = P.unpack(blobs.pop(1, []))
    df = np.concatenate([df.astype(np.int64), hot_df[np.searchsorted(hot, hot_token)] + (1 << 40) if len(hot_token) else np.zeros(0, np.int64)])
    ids, token = np.concatenate([ids, hot_ids]), np.concatenate([token, hot_token])
    at = np.searchsorted(cid, ids)
    order = np.lexsort((token, df, at))
    at, token = at[order], token[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (token[1:] != token[:-1])  # a class that several tasks have sent
    at, token = at[new], token[new]
    shared = np.bincount(at, minlength=len(cid))
    own = n - shared
    room = prefix_length(n, percent) - own
    begin = np.concatenate([[0], np.cumsum(shared)])
    out: list[list] = [[] for _ in range(6)]
    size = 0
    for i in np.flatnonzero((room > 0) & (shared > 0)).tolist():
        mine = token[begin[i] : begin[i + 1]]
        for column, x in zip(out, (int(cid[i]), int(n[i]), int(own[i]), W.pack6(np.sort(mine)), mine[: room[i]].view(np.int64), np.bincount((mine >> np.uint64(44)).astype(np.int64), minlength=PARTS)), strict=True):
            column.append(x)
        size += 6 * len(mine)
        if size > 4 << 20:
            yield sets_batch(out)
            out, size = [[] for _ in range(6)], 0
    if out[0]:
        yield sets_batch(out)


def sets_batch(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["cid", "n", "own", "shared", "prefix", "parts"])


def similar(batches, percent: int):
    """The pairs (a, b) whose sets are similar enough."""
    for batch in batches:
        keep = []
        for na, nb, ra, rb in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")), strict=True):
            x, y = W.unpack6(ra), W.unpack6(rb)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            keep.append((100 + percent) * int((y[at] == x).sum()) >= percent * (na + nb))
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], ["a", "b"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) that link."""
    one = sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    two = sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(lambda it: similar(it, percent), "a long, b long")


def links(docs: DataFrame, scratch: Scratch, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """All documents with fingerprint and set size; and (node, root) of the linked fingerprints."""
    spark = docs.sparkSession
    docs, parts = docs.select("doc_id", "text"), P.shuffle_parts(docs)
    signed = scratch.save(docs.mapInArrow(lambda it: signatures(it, size), "kind int, doc_id long, cid long, n long"))
    documents = signed.where("kind = 0").select("doc_id", "cid", "n")
    rows, shingles = documents.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = max(FREQUENT_LEAST, rows * FREQUENT_SHARE, shingles / FREQUENT_MOST)  # so no more than FREQUENT_MOST can be
    found = sorted((r[0], r[1]) for r in signed.where("kind = 1").groupBy("cid").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect())
    hot = spark.sparkContext.broadcast((np.array([x[0] for x in found], np.uint64), np.array([x[1] for x in found], np.int64)))
    posted = docs.mapInArrow(lambda it: post(it, size, parts, hot.value[0]), P.SCHEMA)
    counted = P.dealt(posted, parts).mapInArrow(lambda it: count(it, parts), P.SCHEMA)
    sets = scratch.save(P.dealt(counted, parts).mapInArrow(lambda it: prefixes(it, percent, *hot.value), SETS))
    scratch.sweep()
    entries = sets.select("cid", "n", "own", "parts", F.posexplode("prefix").alias("pos", "tok")).select("tok", "cid", "n", "own", (F.col("own") + F.col("pos")).alias("pos"), "parts")

    def needed(na, nb) -> F.Column:
        return F.ceil(F.lit(percent) * (na + nb) / F.lit(100 + percent))

    def allowed(na, nb, pa_, pb) -> F.Column:
        """Length and positional filters."""
        return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (F.least(na - pa_, nb - pb) >= needed(na, nb))

    def overlaps(na, nb, xs, ys) -> F.Column:
        """Suffix filter: the parts of the hash order bound the overlap."""
        return F.aggregate(F.zip_with(xs, ys, lambda x, y: F.least(x, y)), F.lit(0), lambda t, k: t + k) >= needed(na, nb)

    # saved, so that the join deals both sides anew and adaptive execution can split a frequent shingle's entries
    hub = scratch.save(entries.groupBy("tok").agg(F.min(F.struct("own", "n", "cid", "pos", "parts")).alias("hub"), F.count("*").alias("k")).where("k > 1").select("tok", "hub"))
    near = entries.join(hub, "tok").where((F.col("cid") != F.col("hub.cid")) & allowed(F.col("n"), F.col("hub.n"), F.col("pos"), F.col("hub.pos")))
    near = near.where(overlaps(F.col("n"), F.col("hub.n"), F.col("parts"), F.col("hub.parts")))
    pairs = scratch.save(near.select(F.least("cid", "hub.cid").alias("a"), F.greatest("cid", "hub.cid").alias("b")).distinct())
    first = scratch.save(verified(pairs, sets, percent))
    roots = components(first, scratch)
    named = entries.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    largest = scratch.save(named.groupBy("tok", "root").count().groupBy("tok").agg(F.max(F.struct("count", "root")).alias("top"), F.count("*").alias("k")).where("k > 1").select("tok", F.col("top.root").alias("top")))
    mixed = scratch.save(named.join(largest, "tok"))
    # sizes that differ by the length filter's factor at most are in the same or in neighbouring classes
    step = F.floor(F.log(F.col("n")) / F.lit(math.log(100 / percent + 1e-9))).cast("int")
    kinds = scratch.save(mixed.groupBy("tok", "n", "pos").agg(F.max(F.col("root") != F.col("top")).alias("outside")).withColumn("step", step))
    x = kinds.where("outside").select("tok", F.col("n").alias("x_n"), F.col("pos").alias("x_pos"), F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step"))
    y = kinds.select("tok", F.col("n").alias("y_n"), F.col("pos").alias("y_pos"), "step")
    meeting = scratch.save(x.join(y, ["tok", "step"]).where(allowed(F.col("x_n"), F.col("y_n"), F.col("x_pos"), F.col("y_pos"))).select("tok", "x_n", "x_pos", "y_n", "y_pos"))
    x = mixed.where("root <> top").select("tok", *[F.col(c).alias("x_" + c) for c in ("cid", "n", "pos", "root", "parts")])
    y = mixed.select("tok", "top", *[F.col(c).alias("y_" + c) for c in ("cid", "n", "pos", "root", "parts")])
    once = (F.col("y_root") == F.col("top")) | (F.col("x_cid") < F.col("y_cid"))
    rest = x.join(meeting, ["tok", "x_n", "x_pos"]).join(y, ["tok", "y_n", "y_pos"]).where((F.col("x_root") != F.col("y_root")) & once)
    rest = rest.where(overlaps(F.col("x_n"), F.col("y_n"), F.col("x_parts"), F.col("y_parts")))
    rest = rest.select(F.least("x_cid", "y_cid").alias("a"), F.greatest("x_cid", "y_cid").alias("b")).distinct()
    second = scratch.save(verified(rest.join(pairs, ["a", "b"], "left_anti"), sets, percent))  # each pair is verified once
    out = components(first.union(second), scratch)
    scratch.drop(roots, hub, pairs, largest, mixed, kinds, meeting, first, second, sets)
    return documents, out


def classes(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "ngram-join")
    documents, roots = links(docs, scratch, size, percent)
    some = documents.where("n > 0")
    least = some.groupBy("cid").agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("cid", "component_id")
    linked = some.join(named, "cid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.union(documents.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op1(docs: DataFrame) -> DataFrame:
    """The links' components of ``documents``."""
    return classes(docs)


OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS s FROM d, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS t(i)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g AS a JOIN g AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) AS m USING (doc_id)
"""

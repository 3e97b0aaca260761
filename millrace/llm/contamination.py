"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are all windows of 13 words of each benchmark item; an item with fewer words is one
pattern of its own length. For each pattern length a shift table says how far a window may move
on, given the hash of its last two words; many windows of different documents move at once. Where
the shift is 0, the hash of the window's last four words picks a bucket of test strings, a hash of the words before
them those of the bucket that can match, and the words themselves are
compared before an occurrence counts. Documents are searched where they are read: no shuffle.

Tables are numpy arrays: sorted suffix and prefix hashes, and offsets into one array of bytes. They take
about 50 bytes a word, so they are broadcast only up to ``block_bytes`` of item text; a larger benchmark is
searched in blocks, one pass over the documents for each, which keeps the hits of the texts that have any, keyed by two
hashes of the text; the hits are joined to the documents at the end.

Results for odd input: a null or empty text has no words and no hits; items without words, or
with a null id, match nothing; repeated item ids count as one item; an empty benchmark leaves every
document clean; repeated rows get equal results; an empty table gives an empty result. Other columns of the documents pass through; ``hit_spans``, ``hit_items`` and
``n_words`` replace columns of these names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import words as W
from millrace.llm.scratch import Scratch

WINDOW, BLOCK_BYTES, LANE, SUFFIX = 13, 8 << 20, 256, 4
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def pattern_sets(items: list[tuple[str, str]]) -> list[dict]:
    """Wu-Manber tables, one set for each pattern length."""
    names = np.array(sorted({i for i, _ in items}), dtype=object)
    owner = np.searchsorted(names, np.array([i for i, _ in items], dtype=object)).astype(np.int32) if items else np.zeros(0, np.int32)
    buf, off = W.text_bytes(pa.array([t for _, t in items], pa.string()))
    buf = W.lower_table()[buf] if len(buf) else buf
    starts, ends, first = W.split(buf, off, W.alnum_class())
    h = W.word_hashes(buf, starts, ends, False)
    # all words, each with a blank: the words of a window are one slice
    begin = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    flat = np.full(int(begin[-1]), 0x20, np.uint8)
    shift_by = np.repeat(starts - begin[:-1], ends - starts)
    inner = np.flatnonzero(~np.isin(np.arange(len(flat)), begin[1:] - 1)) if len(starts) else np.zeros(0, np.int64)
    flat[inner] = buf[inner + shift_by] if len(inner) else 0
    flat_bytes = flat.tobytes()
    size = np.diff(first)
    out = []
    for k in sorted({min(WINDOW, n) for n in size.tolist()} - {0}):
        at = np.flatnonzero(W.window_starts(first, k) & np.repeat(size >= WINDOW, size)) if k == WINDOW else first[:-1][size == k]
        width, tail = min(2, k), min(SUFFIX, k)
        bits = max(12, min(22, int(np.ceil(np.log2(8 * k * len(at) + 1)))))
        shift = np.full(1 << bits, k - width + 1, np.int64)
        for end in range(width - 1, k):
            block = h[at + end] if width == 1 else h[at + end - 1] * np.uint64(W.STEP) + h[at + end]
            np.minimum.at(shift, (W.mix(block) >> np.uint64(64 - bits)).astype(np.int64), k - 1 - end)
        suffix, prefix = window_of(h, at + k - tail, tail), window_of(h, at, k - tail)
        item = owner[np.searchsorted(first, at, "right") - 1]
        order = np.lexsort((item, prefix, suffix))
        at, suffix, prefix, item = at[order], suffix[order], prefix[order], item[order]
        a, b = begin[at], begin[at + k] - 1
        new = np.ones(len(at), bool)  # equal windows of several items are one test string
        for x in np.flatnonzero((suffix[1:] == suffix[:-1]) & (prefix[1:] == prefix[:-1])).tolist():
            new[x + 1] = flat_bytes[a[x] : b[x]] != flat_bytes[a[x + 1] : b[x + 1]]
        edge = np.flatnonzero(new)
        out.append({"k": k, "width": width, "tail": tail, "bits": bits, "shift": shift, "suffix": suffix[edge], "prefix": prefix[edge], "a": a[edge], "b": b[edge], "flat": flat_bytes, "owner": item, "owners": np.append(edge, len(at)), "names": names})
    return out


def window_of(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """One hash for the ``k`` word hashes from each place on."""
    acc = np.zeros(len(at), np.uint64)
    for j in range(k):
        acc = acc * np.uint64(W.MIX_A) + h[at + j]
    return W.mix(acc)


def inside(values: np.ndarray, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
    """``searchsorted`` of each x in its own sorted part [lo, hi) of ``values``."""
    lo, hi = lo.copy(), hi.copy()
    while len(live := np.flatnonzero(lo < hi)):
        mid = (lo[live] + hi[live]) // 2
        on = values[mid] <= x[live] if right else values[mid] < x[live]
        lo[live[on]], hi[live[~on]] = mid[on] + 1, mid[~on]
    return lo


def occurrences(table: dict, h: np.ndarray, first: np.ndarray, word_at) -> list[tuple[int, int]]:
    """(word position, pattern number) of every pattern of one length; ``word_at(i, k)`` gives k words' text."""
    k, width, bits, shift = table["k"], table["width"], table["bits"], table["shift"]
    rows = np.flatnonzero(np.diff(first) >= k)
    if not len(rows):
        return []
    low, high = first[rows] + k - 1, first[rows + 1]  # the last word of a window is in [low, high)
    lanes = -(-(high - low) // LANE)
    begin = np.repeat(low, lanes) + LANE * (np.arange(int(lanes.sum())) - np.repeat(np.concatenate([[0], np.cumsum(lanes)[:-1]]), lanes))
    stop = np.minimum(begin + LANE, np.repeat(high, lanes))
    block = h if width == 1 else np.concatenate([h[:1], h[:-1] * np.uint64(W.STEP) + h[1:]])
    slot = (W.mix(block) >> np.uint64(64 - bits)).astype(np.int64)
    found, at = [], begin
    while len(at):
        by = shift[slot[at]]
        found.append(at[by == 0])
        at = at + np.maximum(by, 1)
        live = at < stop
        at, stop = at[live], stop[live]
    ends = np.concatenate(found)
    if not len(ends):
        return []
    tail = table["tail"]
    key = window_of(h, ends - tail + 1, tail)
    lo, hi = np.searchsorted(table["suffix"], key, "left"), np.searchsorted(table["suffix"], key, "right")
    ends, lo, hi = ends[lo < hi], lo[lo < hi], hi[lo < hi]
    key = window_of(h, ends - k + 1, k - tail)
    lo, hi = inside(table["prefix"], key, lo, hi, False), inside(table["prefix"], key, lo, hi, True)
    out = []
    for e, a, b in zip(ends[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
        text = word_at(e - k + 1, k)
        out += [(e - k + 1, n) for n in range(a, b) if table["flat"][table["a"][n] : table["b"][n]] == text]
    return out


def search(batches, tables: list[dict], others: list[str]):
    """Adds n_words, hit_spans (word positions, end exclusive) and hit_items to the rows of ``batches``."""
    sep, lower = W.alnum_class(), W.lower_table()
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in W.chunks(batches):
        raw, off = W.text_bytes(batch.column("text"))
        buf = lower[raw] if len(raw) else raw
        starts, ends, first = W.split(buf, off, sep)
        h = W.word_hashes(buf, starts, ends, False)
        n = len(h)
        edge, items = np.zeros(n + 1, np.int64), [set() for _ in range(batch.num_rows)]
        word_at = lambda i, k: b" ".join(buf[starts[j] : ends[j]].tobytes() for j in range(i, i + k))  # noqa: B023, E731
        for table in tables:
            hits = occurrences(table, h, first, word_at)
            if hits:
                at = np.array([x[0] for x in hits])
                np.add.at(edge, at, 1)
                np.add.at(edge, at + table["k"], -1)
                for row, (_, p) in zip((np.searchsorted(first, at, "right") - 1).tolist(), hits, strict=True):
                    items[row].update(table["names"][table["owner"][table["owners"][p] : table["owners"][p + 1]]].tolist())
        covered = np.cumsum(edge)[:n] > 0
        spans: list[list[dict]] = [[] for _ in items]
        for row in np.unique(np.searchsorted(first, np.flatnonzero(covered), "right") - 1).tolist():
            c = np.concatenate([[0], covered[first[row] : first[row + 1]].astype(np.int8), [0]])
            turn = np.flatnonzero(np.diff(c))
            spans[row] = [{"start": int(a), "end": int(b)} for a, b in turn.reshape(-1, 2)]
        columns = [batch.column(c) for c in others] + [pa.array(np.diff(first), pa.int64()), pa.array(spans, spans_type), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, [*others, "n_words", "hit_spans", "hit_items"])


FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("hit_items", T.ArrayType(T.StringType()))])


def find(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (all columns, or those of ``keep``) with n_words, hit_spans and hit_items."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total * 2 // block_bytes) if total > block_bytes else 1
    docs = docs.drop("n_words", "hit_spans", "hit_items")
    others = [c for c in (keep or docs.columns) if c not in FOUND.names]

    def searched(rows: DataFrame, some: DataFrame, names: list[str]) -> DataFrame:
        found = some.distinct().collect()  # a block's bytes, or one item
        tables = docs.sparkSession.sparkContext.broadcast(pattern_sets(sorted((r[0], r[1]) for r in found)))
        schema = T.StructType([rows.schema[c] for c in names] + FOUND.fields)
        return rows.select(*dict.fromkeys([*names, "text"])).mapInArrow(lambda it: search(it, tables.value, names), schema)

    if blocks == 1:
        return searched(docs, items, others)
    scratch, narrow, hits = Scratch(docs.sparkSession, "contamination"), docs.select("text", *text_key("text")), None
    for b in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        found = scratch.save(searched(narrow, some, ["__a", "__b"]).where("size(hit_items) > 0").dropDuplicates(["__a", "__b"]))
        hits = found if hits is None else hits.union(found)
    every, kind = F.array_sort(F.flatten(F.collect_list("hit_spans"))), FOUND["hit_spans"].dataType.simpleString()
    merged = hits.groupBy("__a", "__b").agg(every.alias("__every"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_items")))).alias("hit_items"))

    def joined(done: Column, s: Column) -> Column:
        """Spans in order; one that meets the last makes it longer."""
        last = F.try_element_at(done, F.lit(-1))
        longer = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (last["end"] >= s["start"]), longer).otherwise(F.concat(done, F.array(s)))

    merged = scratch.save(merged.select("__a", "__b", F.aggregate("__every", F.array().cast(kind), joined).alias("hit_spans"), "hit_items"))
    n_words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words")
    rows = docs.select(*others, n_words, *text_key("text")).join(merged, ["__a", "__b"], "left")
    kinds = {f.name: f.dataType.simpleString() for f in FOUND.fields}
    return rows.select(*others, "n_words", *[F.coalesce(c, F.array().cast(kinds[c])).alias(c) for c in ("hit_spans", "hit_items")])


def text_key(text: str) -> list[Column]:
    return [F.xxhash64(text).alias("__a"), F.xxhash64(F.lit("text"), text).alias("__b")]


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit and ``contaminated``: a hit, and a twentieth of the words or more are hit."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def op5(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document of ``documents``: words hit by benchmark windows, and the items."""
    found = judged(find(docs.select("doc_id", "text"), benchmark, ["doc_id"]))
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), "contaminated")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item, least(13, len(w)) AS k, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS s FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
v AS (SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM d, (SELECT DISTINCT k FROM p) AS q, unnest(range(1, greatest(len(w) - k + 1, 0) + 1)) AS t(i)),
h AS (SELECT doc_id, i, v.k, item FROM v JOIN p ON p.k = v.k AND p.s = v.s),
n AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, x FROM h, unnest(range(i, i + k)) AS t(x)) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

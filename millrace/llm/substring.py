"""Substring de-duplication by relative Lempel-Ziv parsing against an index of all documents.

The reference of a document is every document of a smaller id. It is indexed in blocks: each chunk of
documents that a mapper reads is a block of its own, and what is new in a chunk goes, dealt by hash, to
the blocks of the whole table's index, which keep for each window of ``window`` words (the
shortest factor that counts) where it occurs first: the smallest id that has it, and the place. So the indexed
reference holds each window once, and the longest match of a place is unique.

A block answers with a window's source for all documents but the first. Answers whose distance
from their source stays the same are one match. A document is then parsed greedily: at each word the
longest match that begins there is taken as a factor (source document, position, length), else the word stays a
literal. A factor's end may hide windows that begin inside it and end beyond it, so the matches at each
factor's boundary are checked as well; factors and these together are the duplicate spans.

A window is known by a 64-bit hash; among n windows n^2 / 2^65 false matches are to be expected.
Texts are shuffled once, with the blocks' answers; a window is sent once per chunk, by the smallest id
that has it, so that hot passages don't pile up. Results for odd input: null and empty
texts have no words and lose none; a null ``doc_id`` neither removes nor loses words; rows that
repeat a ``doc_id`` lose what a smaller id's text holds, not what each other's holds; an empty
table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import postings as P
from millrace.llm import words as W
from millrace.llm.scratch import Scratch

WINDOW, CHUNK = 50, 8 << 20
#: Fixed values of the hash that deals document ids: a Mersenne prime and a primitive root of it.
PRIME, SPREAD = 2147483647, 48271


def doc_part(ids: np.ndarray, parts: int) -> np.ndarray:
    """An even partition of document ids; ``doc_part_column`` is the same in Spark."""
    return (ids % PRIME * SPREAD % PRIME % parts).astype(np.int32)


def doc_part_column(key: F.Column, parts: int) -> F.Column:
    return F.pmod(F.pmod(F.pmod(key, F.lit(PRIME)) * SPREAD, F.lit(PRIME)), F.lit(parts)).cast("int")


def windows(text: pa.Array, k: int) -> tuple[np.ndarray, ...]:
    """Bytes, word starts and ends, rows' bounds; position and hash of each window inside a row."""
    buf, off = W.text_bytes(text)
    starts, ends, first = W.split(buf, off, W.space_class())
    value = W.window_hashes(W.word_hashes(buf, starts, ends, False), k)
    at = np.flatnonzero(W.window_starts(first, k))
    return buf, starts, ends, first, at, value[at] if len(at) else np.zeros(0, np.uint64)


def sources(ids: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by (token, id, place as given), and for each entry in that order where its token's first one stands."""
    order = np.lexsort((ids, token))
    token = token[order]
    new = np.ones(len(order), bool)
    new[1:] = token[1:] != token[:-1]
    return order, np.flatnonzero(new)[np.cumsum(new) - 1]


def matches(ids: np.ndarray, row: np.ndarray, pos: np.ndarray, ref: np.ndarray, ref_pos: np.ndarray) -> np.ndarray:
    """Rows (id, row, ref, distance, first window, windows) of matches that run on, from single windows' sources."""
    order = np.lexsort((pos, row, ids))
    ids, row, pos, ref, off = ids[order], row[order], pos[order].astype(np.int64), ref[order], (ref_pos.astype(np.int64) - pos)[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (row[1:] != row[:-1]) | (ref[1:] != ref[:-1]) | (off[1:] != off[:-1]) | (pos[1:] != pos[:-1] + 1)
    at = np.flatnonzero(new)
    return np.column_stack([ids[at], row[at], ref[at], off[at], pos[at], np.diff(np.append(at, len(ids)))])


def post(batches, k: int, parts: int):
    """kind 0: windows of the smallest id of a chunk, by hash; kind 1: the others' matches with it, by document."""
    for batch in W.chunks(batches, CHUNK):
        batch = batch.filter(batch.column("doc_id").is_valid())
        if not batch.num_rows:
            continue
        doc, key = np.asarray(batch.column("doc_id").cast(pa.int64())), np.asarray(batch.column("row"))
        *_, first, at, token = windows(batch.column("text"), k)
        if not len(at):
            continue
        place = np.searchsorted(first, at, "right") - 1
        order, source = sources(doc[place], token)
        ids, row, pos, token = doc[place][order], key[place][order], (at - first[place])[order], token[order]
        mine = ids == ids[source]
        yield from P.rows(0, P.pack_runs(P.parts_of(token[mine], parts), [ids[mine], row[mine]], [token[mine], pos[mine]], ("<u8", "<u4")))
        found = matches(ids[~mine], row[~mine], pos[~mine], ids[source][~mine], pos[source][~mine])
        yield from P.records(1, doc_part(found[:, 0], parts), found)


def look_up(batches, parts: int):
    """One block of the index: where each window occurs first, told to all other documents (kind 2); kind 1 passes."""
    blobs = P.gather(batches)
    for blob in blobs.get(1, []):
        yield P.batch_of(1, doc_part(np.frombuffer(blob, "<i8", 1), parts).tolist(), [blob])
    ids, row, token, pos = P.unpack_runs(blobs.pop(0, []), 2, ("<u8", "<u4"))
    if len(ids):
        order, source = sources(ids, token)
        ids, row, pos = ids[order], row[order], pos[order]
        ref, ref_pos = ids[source], pos[source].astype(np.int64)
        later = ids > ref
        ids, row, pos, ref, ref_pos = ids[later], row[later], pos[later], ref[later], ref_pos[later]
        yield from P.rows(2, P.pack_runs(doc_part(ids, parts), [ids, row, ref, ref_pos - pos], [pos], ("<u4",)))


def factors(found: np.ndarray, k: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, end, source document, start there), in words, from a document's matches by place."""
    out: list[tuple[int, int, int, int]] = []
    at = 0
    for ref, off, first, n in found[:, 2:].tolist():
        start = max(first, at)
        if start < first + n:  # a window that begins here is in the index
            at = first + n - 1 + k
            out.append((start, at, ref, start + off))
    return out


def spans_of(parse: list[tuple[int, int, int, int]], found: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The factors' spans, and those of the windows that straddle a factor's end; overlapping ones as one."""
    straddling = [(first, first + n - 1 + k) for first, n in found[:, 4:].tolist()]
    out: list[tuple[int, int]] = []
    for a, b in sorted([(f[0], f[1]) for f in parse] + straddling):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def parse(batches, k: int):
    """Rows of kinds 1 and 2 bring matches, then rows of kind 3 the texts to parse."""
    known, single = [np.zeros((0, 6), np.int64)], []
    index = None
    for batch in batches:
        kinds = np.asarray(batch.column("kind"))
        for kind in (1, 2):
            blobs = batch.filter(pa.array(kinds == kind)).column("blob").to_pylist()
            if kind == 1:
                known.append(P.unrecord(blobs, 6))
            else:
                single += blobs
        late = batch.filter(pa.array(kinds == 3))
        if not late.num_rows:
            continue
        if index is None:
            ids, row, ref, off, pos = P.unpack_runs(single, 4, ("<u4",))
            index = np.concatenate([*known, matches(ids, row, pos, ref, off + pos)])
            index = index[np.lexsort((index[:, 4], index[:, 0]))]
        for part in W.chunks([late], CHUNK):
            yield parsed(part, index, k)


def merged(found: np.ndarray) -> np.ndarray:
    """Matches by place, those that run on as one."""
    if len(found) < 2:
        return found
    new = np.ones(len(found), bool)
    new[1:] = np.any(found[1:, 2:4] != found[:-1, 2:4], 1) | (found[1:, 4] != found[:-1, 4] + found[:-1, 5])
    at = np.flatnonzero(new)
    out = found[at].copy()
    out[:, 5] = np.add.reduceat(found[:, 5], at)
    return out


def parsed(batch: pa.RecordBatch, index: np.ndarray, k: int) -> pa.RecordBatch:
    buf, off = W.text_bytes(batch.column("text"))
    starts, ends, first = W.split(buf, off, W.space_class())
    docs, rows = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
    keep, spans, parses = np.ones(len(starts), bool), [], []
    for i, (doc, row) in enumerate(zip(docs, rows, strict=True)):
        spans.append([])
        parses.append([])
        if doc is None:
            continue
        lo, hi = np.searchsorted(index[:, 0], doc, "left"), np.searchsorted(index[:, 0], doc, "right")
        if lo < hi:
            found = index[lo:hi]
            # a row that several tasks have read answers more than once
            found = merged(np.unique(found[found[:, 1] == row][:, [4, 2, 3, 5, 0, 1]], axis=0)[:, [4, 5, 1, 2, 0, 3]])
            way = factors(found, k)
            parses[i] = [{"start": a, "end": b, "source": s, "at": p} for a, b, s, p in way]
            for a, b in spans_of(way, found, k):
                keep[first[i] + a : first[i] + b] = False
                spans[i].append({"start": a, "end": b})
    lens = (ends - starts)[keep] + 1  # each word with a blank
    begin = np.concatenate([[0], np.cumsum(lens)])
    out = np.full(int(begin[-1]), 0x20, np.uint8)
    size = lens - 1
    inner = np.arange(int(size.sum())) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(size) else np.zeros(0, np.int64)
    out[inner + np.repeat(begin[:-1], size)] = buf[inner + np.repeat(starts[keep], size)] if len(size) else 0
    kept = np.concatenate([[0], np.cumsum(keep)])[first]
    raw = out.tobytes()
    texts = [raw[begin[a] : max(begin[a], begin[b] - 1)].decode() for a, b in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)]
    n = np.diff(first)
    factor_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("source", pa.int64()), ("at", pa.int64())]))
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    digest = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    columns = [pa.array(docs, pa.int64()), pa.array(n, pa.int64()), pa.array(n - np.diff(kept), pa.int64()), pa.array(parses, factor_type), pa.array(spans, span_type), pa.array(texts, pa.string()), pa.array(digest)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "factors", "spans", "kept", "kept_sha256"])


PARSED = "doc_id long, n_words long, n_removed long, factors array<struct<start: long, end: long, source: long, at: long>>, spans array<struct<start: long, end: long>>, kept string, kept_sha256 string"


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its factors and duplicate spans (in words), the kept text and its digest."""
    docs, parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row")), P.shuffle_parts(docs)
    scratch = Scratch(docs.sparkSession, "substring")
    posted = docs.mapInArrow(lambda it: post(it, window, parts), P.SCHEMA)
    known = scratch.save(P.dealt(posted, parts).mapInArrow(lambda it: look_up(it, parts), P.SCHEMA))
    scratch.sweep()
    return parse_with(docs, known, window, parts)


def parse_with(docs: DataFrame, known: DataFrame, window: int, parts: int) -> DataFrame:
    key = F.coalesce("doc_id", F.xxhash64("text"))
    texts = docs.select(doc_part_column(key, parts).alias("part"), F.lit(3).alias("kind"), F.lit(None).cast("binary").alias("blob"), "doc_id", "text", "row")
    rows = known.select("part", "kind", "blob", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("row")).union(texts)
    return P.dealt(rows, parts).sortWithinPartitions("kind").mapInArrow(lambda it: parse(it, window), PARSED)


def op3(docs: DataFrame) -> DataFrame:
    """What is left of each of ``documents``."""
    return deduplicate(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS s FROM d, unnest(range(1, greatest(len(w) - 49, 0) + 1)) AS t(i)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first_id FROM v),
gone AS (SELECT DISTINCT doc_id, p FROM f, unnest(range(i, i + 50)) AS t(p) WHERE first_id < doc_id),
k AS (SELECT d.doc_id, p, w[p] AS word, gone.p IS NULL AS kept FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) AS d LEFT JOIN gone USING (doc_id, p)),
o AS (SELECT doc_id, count(*) FILTER (NOT kept) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (kept), '') AS text FROM k GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(o.text, '')) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)
"""

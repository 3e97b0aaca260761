"""Language-model scores: Katz backoff over words.

P(w | h) is the discounted count share d(c) c(h, w) / c(h) where the pair was seen in training,
else a(h) P(w); P(w) is the discounted share of w, and what the words leave over is the unknown
type's. Discounts are Good-Turing's for counts up to 5, and a(h) is what the seen pairs
leave over, divided by the unigram probability of the words not seen after h, so that each
history's probabilities sum to exactly 1. The order is 2; every word of the training part is a type
and a history of its own, whatever their number.

The model is a table of packed blocks. Pairs are counted in blocks by their second word, which adds
up the word's own count as well, then dealt to blocks by their history, which add up its
discounted counts and seen unigram mass and so know a(h). Pairs of very frequent words (found in a sample, which
decides only where a pair is counted) are dealt by pair, their sums added up over the blocks.

Per token the recursion P(w | h) -> a(h) P(w) is followed in logarithms:

    log P(w) + log a(h), and for a pair that was seen log P(w | h) - log a(h) - log P(w) on top.

Each text asks the blocks for its words and pairs; the blocks answer with sums. Words and pairs that make up a
2^20th of all tokens each are broadcast with the same counts (at most 2^20 of either, whatever the corpus),
so that none of them meets in one task; this changes no score. Counts cover the whole training part; equal texts of a task are
scored once. A word is known by 48 bits of its hash, a pair by 47 bits and its block.

Results for odd input: a null or wordless text is one end token; a null key is training text; an
empty training part gives every token probability 1; repeated rows count each in
training; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import postings as P
from millrace.llm import words as W
from millrace.llm.scratch import Scratch

CUTOFF, CHUNK = 5, 4 << 20
#: Words with this share of a sample of so many texts are dealt by pair; words and pairs with this share of all tokens are broadcast.
HOT_SHARE, SAMPLE, COMMON_SHARE, COMMON_LEAST = 1 / 4096, 4000, 1 / (1 << 20), 64
#: Stand for a text's end, its start (a history only), and its presence among its pairs.
END, START, PRESENT = (1 << 48) - 1, (1 << 48) - 2, (1 << 47) - 1
#: What texts ask for are 47 bits of a hash; the 48th tells words from pairs.
LOW47, WORD = np.uint64((1 << 47) - 1), np.uint64(1 << 47)
#: A task remembers so many texts it has sent; others may be sent again.
REMEMBERED = 1 << 16


def discounts(n: list[float], cutoff: int = CUTOFF) -> np.ndarray:
    """Katz's d(r) for r = 0..cutoff from n[r] types of count r (up to cutoff + 1); half a count off where Good-Turing fails."""
    out = np.ones(cutoff + 1)
    tail = (cutoff + 1) * n[cutoff + 1] / n[1] if n[1] else 1.0
    for r in range(1, cutoff + 1):
        d = ((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(c < len(d), d[np.minimum(c, len(d) - 1)], 1.0) * c


def hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, off = W.text_bytes(text)
    starts, ends, first = W.split(buf, off, W.space_class())
    return W.word_hashes(buf, starts, ends, True) & P.LOW48, first


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, rows' bounds over words, and histories and targets of all rows with each row's end (n + 1 a row)."""
    h, first = hashes(text)
    rows, n = len(first) - 1, len(h)
    target = np.empty(n + rows, np.uint64)
    target[np.arange(n) + np.repeat(np.arange(rows), np.diff(first))] = h
    target[first[1:] + np.arange(rows)] = END
    history = np.empty(n + rows, np.uint64)
    history[1:] = target[:-1]
    history[first[:-1] + np.arange(rows)] = START
    return h, first, history, target


def pair_hash(history: np.ndarray, target: np.ndarray) -> np.ndarray:
    return W.mix(W.mix(history + np.uint64(W.STEP)) ^ target)


def places(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``x`` are in a sorted table, and where."""
    if not len(table):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return table[at] == x, at


def blocks(word: np.ndarray, pair: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """The block of a word, or of the pair where the word is hot."""
    return P.parts_of(np.where(places(hot, word)[0], pair, W.mix(word)), parts)


def sampled_words(batches):
    for batch in W.chunks(batches, CHUNK):
        w, c = np.unique(hashes(batch.column("text"))[0], return_counts=True)
        mine = c >= max(2, c.sum() * HOT_SHARE / 4)
        w, c, n = np.append(w[mine].astype(np.int64), -1), np.append(c[mine], 0), c.sum()
        yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(c), pa.array(np.where(w < 0, n, 0))], ["w", "c", "n"])


def hot_words(train: DataFrame, rows: int) -> np.ndarray:
    """Words with HOT_SHARE of a sample, the end and the start, sorted."""
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE / max(rows, 1)) * (1 << 30)))
    found = train.where(draw).select("text").mapInArrow(sampled_words, "w long, c long, n long").groupBy("w").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    some = found.where(F.col("c") >= max(2.0, total * HOT_SHARE)).collect()  # at most 1 / HOT_SHARE rows
    return np.unique(np.array([r["w"] for r in some] + [END, START], np.uint64))


def count_pairs(batches, parts: int, hot: np.ndarray):
    """Pairs of training texts, counted by chunk, to the blocks of their second words."""
    for batch in W.chunks(batches, CHUNK):
        _, _, v, w = tokens(batch.column("text"))
        pair, at, c = np.unique(pair_hash(v, w), return_index=True, return_counts=True)
        yield from P.rows(0, P.pack_runs(blocks(w[at], pair, hot, parts), [w[at]], [v[at], c], ("6", "<u4")))


COUNTED = "kind int, blob binary, key long, n long"


def counted(kind: int, blob: list[bytes] | None, key: np.ndarray | None = None, n: np.ndarray | None = None) -> pa.RecordBatch:
    size = len(blob) if blob is not None else len(key)
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * size, pa.int32()), pa.array(blob or [None] * size, pa.binary()), pa.array(np.zeros(size, np.int64) if key is None else key.astype(np.int64)), pa.array(np.zeros(size, np.int64) if n is None else n.astype(np.int64))], ["kind", "blob", "key", "n"]
    )


def add_pairs(batches, hot: np.ndarray):
    """A block's pairs with their and their second word's count (kind 0), hot words' partial counts (1), and how many pairs (2)
    and words (3) of each small count there are, and of all words (key 0)."""
    w, v, c = P.unpack_runs(P.gather(batches).pop(0, []), 1, ("6", "<u4"))
    if not len(w):
        return
    w = w.view(np.uint64)
    order = np.lexsort((v, w))
    w, v, c = w[order], v[order], c[order].astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (v[1:] != v[:-1])]))
    c, w, v = np.add.reduceat(c, at), w[at], v[at]
    at = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
    sums = np.add.reduceat(c, at)
    is_hot = places(hot, w[at])[0]
    each = np.repeat(sums, np.diff(np.append(at, len(w))))
    for lo in range(0, len(w), 1 << 18):
        s = slice(lo, lo + (1 << 18))
        yield counted(0, [b for _, b in P.pack_runs(np.zeros(len(w[s]), np.int32), [w[s], each[s]], [v[s], c[s]], ("6", "<i8"))])
    yield counted(1, None, w[at][is_hot].view(np.int64), sums[is_hot])
    small = np.arange(1, CUTOFF + 2)
    yield counted(2, None, small, np.bincount(c[c <= CUTOFF + 1], minlength=CUTOFF + 2)[1:])
    own = sums[~is_hot]
    yield counted(3, None, np.append(small, 0), np.append(np.bincount(own[own <= CUTOFF + 1], minlength=CUTOFF + 2)[1:], len(own)))
    yield counted(4, None, np.zeros(1), np.array([sums.sum()]))


def by_history(batches, parts: int, hot: np.ndarray, hot_count: np.ndarray):
    """Pairs with both counts, to the blocks of their histories."""
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            w, cw, v, c = P.unpack_runs([blob], 2, ("6", "<i8"))
            w = w.view(np.uint64)
            known, at = places(hot, w)
            cw = np.where(known, hot_count[at], cw)
            yield from P.rows(0, P.pack_runs(blocks(v, pair_hash(v, w), hot, parts), [v], [w, c, cw], ("6", "<i8", "<i8")))


def weight(c: np.ndarray, dc: np.ndarray, p: np.ndarray, unknown: float) -> tuple[np.ndarray, np.ndarray]:
    """log a(h) and the count that its pairs are shares of, from c(h), the discounted counts and the seen unigram mass."""
    full = np.where(c - dc > 1e-9 * c, c, c + 1)  # nothing was discounted: leave one count's worth over
    return np.log10(1 - dc / full) - np.log10(np.maximum(1 - p, unknown)), full  # the unknown type is never seen: 1 - p is no less but for rounding


MODEL = "part int, kind int, blob binary, key long, c long, x double, y double, z double"


def model_rows(kind: int, key: np.ndarray, c: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    size = len(key)
    values = [*values, *[np.zeros(size)] * (3 - len(values))]
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(size, np.int32)), pa.array(np.full(size, kind, np.int32)), pa.nulls(size, pa.binary()), pa.array(key.astype(np.int64)), pa.array(c.astype(np.int64)), *[pa.array(np.asarray(x, float)) for x in values]], ["part", "kind", "blob", "key", "c", "x", "y", "z"])


def model_blobs(batches):
    for b in batches:
        size = b.num_rows
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.zeros(size, np.int64)), pa.array(np.zeros(size, np.int64)), *[pa.array(np.zeros(size))] * 3], ["part", "kind", "blob", "key", "c", "x", "y", "z"])


def weigh(batches, parts: int, model: dict):
    """A block's words (kind 12) and pairs (10; 11: of hot histories, whose a(h) comes later; 2 more where counts need 64 bits)
    for look-ups; of hot histories the partial sums (kind 1); the common words (2) and pairs (3: of hot histories, 4) as rows."""
    v, w, c, cw = P.unpack_runs(P.gather(batches).pop(0, []), 1, ("6", "<i8", "<i8"))
    if not len(v):
        return
    v = v.view(np.uint64)
    order = np.argsort(v, kind="stable")
    v, w, c, cw = v[order], w[order], c[order], cw[order]
    at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    share = unigram(cw, model)
    dc = discounted(c, model["d2"])
    sums = [np.add.reduceat(x, at) for x in (c, dc, share)]
    word, n = v[at], np.diff(np.append(at, len(v)))
    is_hot, place = places(model["hot"], word)
    yield model_rows(1, word[is_hot], sums[0][is_hot], sums[1][is_hot], sums[2][is_hot])
    log_a, full = weight(*sums, model["unknown"])
    part = P.parts_of(W.mix(word), parts)
    yield from model_blobs(P.rows(12, P.pack_runs(part[~is_hot], [], [word[~is_hot] & LOW47, sums[0][~is_hot], log_a[~is_hot]], ("6", "<i8", "<f8"))))
    often = ~is_hot & (sums[0] >= model["common_from"])
    yield model_rows(2, word[often], sums[0][often], log_a[often])
    pair, hot, off = pair_hash(v, w), np.repeat(is_hot, n), np.repeat(log_a + np.log10(full), n)
    place, often, part = np.repeat(place, n), c >= model["common_from"], blocks(v, pair, model["hot"], parts)
    wide = int(cw.max()) >= 1 << 32
    size, more = "<i8" if wide else "<u4", 20 if wide else 0
    yield from model_blobs(P.rows(10 + more, P.pack_runs(part[~hot], [off[~hot].view(np.int64)], [pair[~hot] & LOW47, c[~hot], cw[~hot]], ("6", size, size))))
    yield from model_blobs(P.rows(11 + more, P.pack_runs(part[hot], [place[hot]], [pair[hot] & LOW47, c[hot], cw[hot]], ("6", size, size))))
    gain = gains(c, cw, model) - np.where(hot, 0, off)
    yield model_rows(3, (pair & LOW47)[often & hot], place[often & hot], gain[often & hot])
    yield model_rows(4, (pair & LOW47)[often & ~hot], c[often & ~hot], gain[often & ~hot])


def gains(c: np.ndarray, cw: np.ndarray, model: dict) -> np.ndarray:
    """log of a pair's discounted count and of 1 / P(w): what it adds but for its history's part."""
    return np.log10(discounted(c, model["d2"])) - np.log10(unigram(cw, model))


def unigram(c: np.ndarray, model: dict) -> np.ndarray:
    """P(w) of words with these counts; the unknown type's for 0."""
    if model["undiscounted"]:
        return np.where(c > 0, c / (model["N"] + 1.0), model["unknown"])
    return np.where(c > 0, discounted(c, model["d1"]) / max(model["N"], 1), model["unknown"])


def base_of(c: np.ndarray, model: dict) -> np.ndarray:
    return np.log10((c + 0.5) / (model["N"] + 0.5 * (model["V"] + 1)))


def fit(train: DataFrame, scratch: Scratch) -> tuple[dict, DataFrame]:
    """The model's broadcast part (bounded), and the table of its blocks."""
    parts, spark = P.shuffle_parts(train), train.sparkSession
    hot, train = hot_words(train, train.count()), train.select("text")
    pairs = scratch.save(P.dealt(train.mapInArrow(lambda it: count_pairs(it, parts, hot), P.SCHEMA), parts).mapInArrow(lambda it: add_pairs(it, hot), COUNTED))
    scratch.sweep()
    told = {(r["kind"], r["key"]): r["n"] for r in pairs.where("kind > 0").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()}  # hot words and a few sums
    hot_count = np.array([told.get((1, int(x)), 0) for x in hot], np.int64)
    N, V = told.get((4, 0), 0), told.get((3, 0), 0) + int((hot_count > 0).sum())
    n1 = [float(told.get((3, r), 0) + (hot_count == r).sum()) if r else 0.0 for r in range(CUTOFF + 2)]
    d1, d2 = discounts(n1), discounts([float(told.get((2, r), 0)) if r else 0.0 for r in range(CUTOFF + 2)])
    model = {"hot": hot, "N": N, "V": V, "d1": d1, "d2": d2, "undiscounted": sum(n1[1 : CUTOFF + 1]) == 0, "common_from": max(COMMON_LEAST, N * COMMON_SHARE)}
    left = 1.0 / (N + 1) if model["undiscounted"] else sum(n1[r] * r * (1 - d1[r]) for r in range(1, CUTOFF + 1)) / max(N, 1)
    model["unknown"] = left if N else 1.0
    shared = spark.sparkContext.broadcast(model)
    posted = pairs.where("kind = 0").select("blob").mapInArrow(lambda it: by_history(it, parts, hot, hot_count), P.SCHEMA)
    table = scratch.save(P.dealt(posted, parts).mapInArrow(lambda it: weigh(it, parts, shared.value), MODEL))
    scratch.drop(pairs)
    sums = {r["key"]: r for r in table.where("kind = 1").groupBy("key").agg(F.sum("c").alias("c"), F.sum("x").alias("x"), F.sum("y").alias("y")).collect()}  # hot words
    c, dc, p = (np.array([sums[int(x)][name] if int(x) in sums else 0 for x in hot], float) for name in "cxy")
    log_a, full = np.zeros(len(hot)), np.ones(len(hot))
    seen = c > 0
    log_a[seen], full[seen] = weight(c[seen], dc[seen], p[seen], model["unknown"])
    model["hot_off"] = log_a + np.log10(full)
    common = {k: table.where(F.col("kind") == k).select("key", "c", "x").toArrow() for k in (2, 3, 4)}  # at most 1 / COMMON_SHARE rows each
    column = lambda k, i: np.asarray(common[k].column(i).combine_chunks())
    word, count, log_as = np.concatenate([hot, column(2, 0).view(np.uint64)]), np.concatenate([hot_count, column(2, 1)]), np.concatenate([log_a, column(2, 2)])
    order = np.argsort(word)
    word, count, log_as = word[order], count[order], log_as[order]
    model |= {"word": word, "count": count, "log_a": log_as, "log_p": np.log10(unigram(count, model)), "log_base": base_of(count, model)}
    pair, value = np.concatenate([column(3, 0), column(4, 0)]).view(np.uint64), np.concatenate([column(3, 2) - model["hot_off"][column(3, 1)], column(4, 2)])
    order = np.argsort(pair)
    model |= {"pair": pair[order], "gain": value[order]}
    return model, table.where("kind >= 10").select("part", "kind", "blob")


def keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's word sequence."""
    n = np.diff(first)
    place = np.arange(len(h)) - np.repeat(first[:-1], n)
    x = W.mix(W.mix(place.astype(np.uint64) + np.uint64(W.STEP)) ^ h)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    return W.mix(sums[first[1:]] - sums[first[:-1]] + n.astype(np.uint64)).view(np.int64)


def read(batches, model: dict):
    """One row a text: key (a hash of its words), tokens, the sums over common words and pairs, and how many others there are."""
    for batch in W.chunks(batches, CHUNK):
        h, first, v, w = tokens(batch.column("text"))
        rows = np.arange(batch.num_rows)
        row = np.repeat(rows, np.diff(first) + 1)
        pair = pair_hash(v, w) & LOW47
        known, at = places(model["word"], w)  # the end is known, as all hot words are
        common, place = places(model["pair"], pair)
        start = int(np.searchsorted(model["word"], np.uint64(START)))
        total = lambda r, x: np.bincount(r, x, len(rows))  # noqa: B023, E731
        own = total(row[known], (model["log_p"] + np.where(model["word"] == END, 0, model["log_a"]))[at[known]]) + total(row[common], model["gain"][place[common]]) + model["log_a"][start]
        seen = total(row[known], (model["count"][at[known]] > 0).astype(float))
        posted = np.bincount(row[~known], minlength=len(rows)) + np.bincount(row[~common], minlength=len(rows)) + 1
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(keys(h, first)), pa.array(np.diff(first) + 1), pa.array(seen.astype(np.int64)), pa.array(total(row[known], model["log_base"][at[known]])), pa.array(own), pa.array(posted.astype(np.int64))],
            ["doc_id", "held_out", "key", "n_tokens", "known", "base", "own", "posted"],
        )


def post(batches, parts: int, model: dict):
    """A text's pairs and words but the common ones, to their blocks; equal texts once as far as remembered."""
    last = np.arange(1, REMEMBERED + 1)  # no key that belongs there
    for batch in W.chunks(batches, CHUNK):
        h, first, v, w = tokens(batch.column("text"))
        key = keys(h, first)
        _, at = np.unique(key, return_index=True)
        at = at[last[key[at] % REMEMBERED] != key[at]]
        last[key[at] % REMEMBERED] = key[at]
        take = np.zeros(len(key), bool)
        take[at] = True
        row = np.repeat(np.arange(len(key)), np.diff(first) + 1)
        pair, mine = pair_hash(v, w), take[row]
        rare = mine & ~places(model["pair"], pair & LOW47)[0]
        word = mine & ~places(model["word"], w)[0]
        part = [blocks(v[rare], pair[rare], model["hot"], parts), P.parts_of(W.mix(w[word]), parts), P.parts_of(key[take].view(np.uint64), parts)]
        asked = [pair[rare] & LOW47, w[word] | WORD, np.full(len(at), PRESENT, np.uint64)]
        yield from P.rows(0, P.pack(np.concatenate(part), key[np.concatenate([row[rare], row[word], np.flatnonzero(take)])], np.concatenate(asked)))


def look_up(batches, model: dict, parts: int):
    """One block: for each text how much it asked for, how many words are known, and the sums of values and base scores."""
    blobs = P.gather(batches)
    token, value = [np.zeros(0, np.uint64)], [np.zeros(0)]
    for more, size in ((0, "<u4"), (20, "<i8")):
        for kind in (10, 11):
            key, pair, c, cw = P.unpack_runs(blobs.pop(kind + more, []), 1, ("6", size, size))
            token.append(pair)
            value.append(gains(c.astype(np.int64), cw.astype(np.int64), model) - (key.view(np.float64) if kind == 10 else model["hot_off"][key]))
    token, value = np.concatenate(token), np.concatenate(value)
    order = np.argsort(token)
    token, value = token[order], value[order]
    word, count, log_a = P.unpack_runs(blobs.pop(12, []), 0, ("6", "<i8", "<f8"))
    order = np.argsort(word)
    word, count, log_a = word[order], count[order], log_a[order]
    key, asked = P.unpack(blobs.pop(0, []))
    if not len(key):
        return
    is_word = (asked & WORD) > 0
    seen, at = places(token, asked)  # a word's bit is in no pair
    told, base, known = np.zeros(len(key)), np.zeros(len(key)), np.zeros(len(key))
    told[seen] = value[at[seen]]
    seen, at = places(word, asked[is_word] & LOW47)
    c = np.where(seen, count[at], 0) if len(count) else np.zeros(len(seen), np.int64)
    told[is_word] = np.log10(unigram(c, model)) + (np.where(seen, log_a[at], 0) if len(count) else 0)
    base[is_word], known[is_word] = base_of(c, model), seen
    text, at = np.unique(key, return_inverse=True)
    sums = [np.bincount(at), *[np.bincount(at, x) for x in (known, told, base)]]
    yield from P.rows(5, P.pack_runs(P.parts_of(text.view(np.uint64), parts), [], [text, *sums], ("<i8", "<u4", "<u4", "<f8", "<f8")))


def added(columns: list[list[np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sums of the other columns for each value of the first."""
    key, at = np.unique(np.concatenate(columns[0]), return_inverse=True)
    return key, [np.bincount(at, np.concatenate(x), len(key)) for x in columns[1:]]


def total(batches):
    """All blocks' sums of each text."""
    got = P.unpack_runs(P.gather(batches).pop(5, []), 0, ("<i8", "<u4", "<u4", "<f8", "<f8"))
    if len(got[0]):
        key, sums = added([[x] for x in got])
        yield pa.RecordBatch.from_arrays([pa.array(key), *[pa.array(x) for x in sums]], ["key", "n", "s_known", "s_value", "s_base"])


def score(df: DataFrame, train: Column, key: str = "doc_id") -> DataFrame:
    """Per row of ``df`` (key, text): held_out, n_tokens, n_known, train_tokens, base_score, score."""
    scratch, parts, spark = Scratch(df.sparkSession, "katz"), P.shuffle_parts(df), df.sparkSession
    df = df.select(F.col(key).alias("doc_id"), (~train).alias("held_out"), "text")
    model, table = fit(df.where(~F.col("held_out")), scratch)
    shared = spark.sparkContext.broadcast(model)
    schema = f"doc_id {df.schema['doc_id'].dataType.simpleString()}, held_out boolean, key long, n_tokens long, known long, base double, own double, posted long"
    rows = df.mapInArrow(lambda it: read(it, shared.value), schema)
    posted = df.select("text").mapInArrow(lambda it: post(it, parts, shared.value), P.SCHEMA).union(table)
    found = P.dealt(posted, parts).mapInArrow(lambda it: look_up(it, shared.value, parts), P.SCHEMA)
    sums = scratch.save(P.dealt(found, parts).mapInArrow(total, "key long, n double, s_known double, s_value double, s_base double"))
    scratch.sweep()
    # a text sent k times has k times its entries here: k is told by their number, and divides all sums
    k = F.col("n") / F.col("posted")
    return rows.join(sums, "key").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.round(F.col("s_known") / k)).cast("long").alias("n_known"), F.lit(model["N"]).cast("long").alias("train_tokens"), (F.col("base") + F.col("s_base") / k).alias("base_score"), (F.col("own") + F.col("s_value") / k).alias("score")
    )


def op9(docs: DataFrame) -> DataFrame:
    """Scores of all ``documents``, learned from four fifths of them."""
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1, F.lit(True))
    return score(docs, train)

"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1; an n-gram vector binds (multiplies) its letters'
vectors, each permuted (rolled) by its place; a text bundles (adds) its n-grams' vectors, a language
the vectors of its labelled texts. The language whose prototype has the largest cosine with the
text's vector wins. Runs of other characters count as one blank, texts begin and end with one.

Prototypes are fitted on labelled texts: all of them, or for a language with more than
``train_rows`` a seeded sample of about that many (the documented bound). Sums are integers, so the
order of tasks does not matter. The number of languages is taken to be small (they are labels).

Results for odd input: null texts and texts without a letter get ``und`` and score 0,
texts with a letter a null and score 0 when no labelled text has one; rows with null ``lang`` are not learned from; ties
go to the first language by code point; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import words as W

DIM, GRAM, TRAIN_ROWS, DOCS, BASE = 512, 3, 10_000, 256, 1 << 21


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """A vector of +-1 for each code point, the same in every process."""
    lanes = np.arange(DIM, dtype=np.uint64) * np.uint64(W.STEP)
    return np.where(W.mix(W.mix(points.astype(np.uint64)[:, None] + np.uint64(1)) + lanes) >> np.uint64(63), 1, -1).astype(np.float32)


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """The bound vectors of packed n-grams."""
    out = None
    for place in range(GRAM):
        points = (grams >> np.uint64(21 * place)) & np.uint64(BASE - 1)
        known, at = np.unique(points, return_inverse=True)
        v = np.roll(letter_vectors(known), GRAM - 1 - place, axis=1)[at]
        out = v if out is None else out * v
    return out


def grams_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct packed n-grams per text: text number, n-gram, count; sorted by text."""
    lowered = [(t or "").lower() for t in texts]
    size = np.array([len(t) + 2 for t in lowered])
    raw = np.frombuffer("".join(" " + t + " " for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), size)
    known, at = np.unique(raw, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in known.tolist()], bool)
    points = np.where(letter, known, 0)[at].astype(np.uint64)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0) | (row[1:] != row[:-1])
    points, row = points[keep], row[keep]
    if len(points) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gram = np.zeros(len(points) - GRAM + 1, np.uint64)
    for place in range(GRAM):
        gram |= points[GRAM - 1 - place : len(points) - place] << np.uint64(21 * place)
    same = row[: len(gram)] == row[GRAM - 1 :]
    gram, row = gram[same], row[: len(same)][same]
    order = np.lexsort((gram, row))
    gram, row = gram[order], row[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], gram[at], np.diff(np.append(at, len(gram)))


def text_vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bundled vector of each text, and which texts have a letter."""
    row, gram, count = grams_of(texts)
    out, has = np.zeros((len(texts), DIM), np.float32), np.zeros(len(texts), bool)
    has[row] = True
    known, at = np.unique(gram, return_inverse=True)
    for lo in range(0, len(known), 4096):  # a bounded part of the dense matrix at a time
        mine = (at >= lo) & (at < lo + 4096)
        dense = np.zeros((len(texts), min(4096, len(known) - lo)), np.float32)
        dense[row[mine], at[mine] - lo] = count[mine]
        out += dense @ gram_vectors(known[lo : lo + 4096])
    return out, has


def slices(batches):
    for batch in W.chunks(batches, 2 << 20):
        for lo in range(0, batch.num_rows, DOCS):
            yield batch.slice(lo, DOCS)


def bundled(batches):
    """(lang, place, value) sums of one task."""
    total: dict[str, np.ndarray] = {}
    for batch in slices(batches):
        v, _ = text_vectors(batch.column("text").to_pylist())
        langs = batch.column("lang").to_pylist()
        for lang in sorted(set(langs)):
            mine = np.array([x == lang for x in langs])
            total[lang] = total.get(lang, 0) + np.rint(v[mine].sum(0, dtype=np.float64)).astype(np.int64)
    for lang, v in sorted(total.items()):
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(v)], ["lang", "place", "value"])


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS, key: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes (unit vectors) from columns text and lang; ``key`` draws the sample."""
    rows = labelled.where("text is not null and lang is not null").select("text", "lang", key)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each label
    if not counts:
        return [], np.zeros((0, DIM))
    rate = F.lit(1.0)
    for lang, n in counts.items():
        if n > train_rows:
            rate = F.when(F.col("lang") == lang, F.lit(train_rows / n)).otherwise(rate)
    draw = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    sums = rows.where(draw < rate).select("text", "lang").mapInArrow(bundled, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    langs = sorted(counts)
    out = np.zeros((len(langs), DIM))
    for r in sums.collect():  # languages x DIM numbers
        out[langs.index(r["lang"]), r["place"]] = r["value"]
    norm = np.linalg.norm(out, axis=1)
    known = [i for i in range(len(langs)) if norm[i] > 0]
    return [langs[i] for i in known], out[known] / norm[known, None]


def predict(df: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``df`` (with ``text``) plus lang_pred and score, the cosine clipped to 0..1; of an empty model, texts with a letter get a null and 0."""
    langs, proto = model
    df = df.drop("lang_pred", "score")
    names = df.columns

    def scored(batches):
        for batch in slices(batches):
            v, has = text_vectors(batch.column("text").to_pylist())
            if langs:
                cos = (v.astype(np.float64) @ proto.T) / np.maximum(np.linalg.norm(v.astype(np.float64), axis=1), 1e-9)[:, None]
                best = cos.argmax(1)
                pred = [langs[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)]
                score = np.where(has, np.clip(cos.max(1), 0, 1), 0.0)
            else:
                pred, score = [None if h else "und" for h in has.tolist()], np.zeros(len(v))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return df.mapInArrow(scored, T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(key: Column, parts: int = 3) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == 1, F.lit(False))


def op10(docs: DataFrame) -> DataFrame:
    """The predicted language of each of ``documents``, learned from two thirds of them."""
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")

"""Packed postings: many small (id, hash) pairs carried as a few binary rows.

A row holds, for one target partition, runs of hashes per id. Targets come from the hashes
themselves, so they are even; the number of partitions is the session's number of shuffle
partitions, so a partition's share stays the same as tables and clusters grow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm import words as W

SCHEMA = "part int, kind int, blob binary"
LOW48 = np.uint64((1 << 48) - 1)


def parts_of(h: np.ndarray, parts: int) -> np.ndarray:
    """An even target partition for each 64-bit hash."""
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int32)


def raw6(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6])


def pack(part: np.ndarray, ids: np.ndarray, tokens: np.ndarray, counts: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
    """(partition, blob) for (part, id, 48-bit token[, 32-bit count]) triples, ids in runs inside a part."""
    if not len(part):
        return
    order = np.lexsort((ids, part)) if len(ids) and np.any((part[1:] < part[:-1]) | ((part[1:] == part[:-1]) & (ids[1:] < ids[:-1]))) else np.arange(len(part))
    part, ids, six = part[order], ids[order], raw6(tokens[order])
    counts = None if counts is None else counts[order].astype("<u4")
    new = np.ones(len(part), bool)
    new[1:] = (part[1:] != part[:-1]) | (ids[1:] != ids[:-1])
    run = np.flatnonzero(new)
    length = np.diff(np.append(run, len(part))).astype("<u4")
    run_ids, run_part = ids[run].astype("<i8"), part[run]
    edge = np.flatnonzero(np.concatenate([[True], run_part[1:] != run_part[:-1], [True]]))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        lo, hi = int(run[a]), int(run[b - 1] + length[b - 1])
        blob = [np.array([b - a], "<u4").tobytes(), run_ids[a:b].tobytes(), length[a:b].tobytes(), six[lo:hi].tobytes()]
        if counts is not None:
            blob.append(counts[lo:hi].tobytes())
        yield int(run_part[a]), b"".join(blob)


def unpack(blobs: list[bytes], counted: bool = False) -> tuple[np.ndarray, ...]:
    """ids, tokens[, counts] of all blobs, one entry for each token."""
    ids, tokens, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
    for blob in blobs:
        k = int(np.frombuffer(blob, "<u4", 1)[0])
        run_ids = np.frombuffer(blob, "<i8", k, 4)
        length = np.frombuffer(blob, "<u4", k, 4 + 8 * k)
        n, at = int(length.sum()), 4 + 12 * k
        ids.append(np.repeat(run_ids, length))
        tokens.append(W.unpack6(memoryview(blob)[at : at + 6 * n]))
        if counted:
            counts.append(np.frombuffer(blob, "<u4", n, at + 6 * n))
    out = (np.concatenate(ids), np.concatenate(tokens))
    return (*out, np.concatenate(counts)) if counted else out


def rows(kind: int, packed) -> Iterator[pa.RecordBatch]:
    """Record batches of packed rows, a few MB each."""
    part, blob, size = [], [], 0
    for p, b in packed:
        part.append(p)
        blob.append(b)
        size += len(b)
        if size > 4 << 20:
            yield batch_of(kind, part, blob)
            part, blob, size = [], [], 0
    if part:
        yield batch_of(kind, part, blob)


def batch_of(kind: int, part: list[int], blob: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([kind] * len(part), pa.int32()), pa.array(blob, pa.binary())], ["part", "kind", "blob"])


def pack_runs(part: np.ndarray, keys: list[np.ndarray], values: list[np.ndarray], kinds: tuple[str, ...]) -> Iterator[tuple[int, bytes]]:
    """(partition, blob): runs of equal 64-bit ``keys`` inside a partition, and for each entry its ``values``, of a numpy kind or "6" for 48 bits."""
    if not len(part):
        return
    order = np.lexsort((*reversed(keys), part))
    part, keys = part[order], [k[order].astype("<i8") for k in keys]
    values = [raw6(v[order]) if kind == "6" else v[order].astype(kind) for v, kind in zip(values, kinds, strict=True)]
    new = np.ones(len(part), bool)
    new[1:] = part[1:] != part[:-1]
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    run = np.flatnonzero(new)
    length = np.diff(np.append(run, len(part))).astype("<u4")
    run_part, run_keys = part[run], [k[run] for k in keys]
    edge = np.flatnonzero(np.concatenate([[True], run_part[1:] != run_part[:-1], [True]]))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        lo, hi = int(run[a]), int(run[b - 1] + length[b - 1])
        yield int(run_part[a]), b"".join([np.array([b - a], "<u4").tobytes(), *[k[a:b].tobytes() for k in run_keys], length[a:b].tobytes(), *[v[lo:hi].tobytes() for v in values]])


def unpack_runs(blobs: list[bytes], keys: int, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """All blobs' keys and values, one entry for each value."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(keys)] + [[np.zeros(0, np.uint64 if kind == "6" else kind)] for kind in kinds]
    for blob in blobs:
        k = int(np.frombuffer(blob, "<u4", 1)[0])
        length = np.frombuffer(blob, "<u4", k, 4 + 8 * k * keys)
        for i in range(keys):
            out[i].append(np.repeat(np.frombuffer(blob, "<i8", k, 4 + 8 * k * i), length))
        n, at = int(length.sum()), 4 + 8 * k * keys + 4 * k
        for i, kind in enumerate(kinds):
            size = n * (6 if kind == "6" else np.dtype(kind).itemsize)
            out[keys + i].append(W.unpack6(memoryview(blob)[at : at + size]) if kind == "6" else np.frombuffer(blob, kind, n, at))
            at += size
    return [np.concatenate(x) for x in out]


def records(kind: int, part: np.ndarray, table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of a table of 64-bit numbers, as one blob for each partition."""
    order = np.argsort(part, kind="stable")
    part, table = part[order], np.ascontiguousarray(table[order].astype("<i8"))
    edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, np.int64)
    return rows(kind, ((int(part[a]), table[a:b].tobytes()) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)))


def unrecord(blobs: list[bytes], width: int) -> np.ndarray:
    return np.concatenate([np.zeros((0, width), np.int64), *[np.frombuffer(b, "<i8").reshape(-1, width) for b in blobs]])


def gather(batches) -> dict[int, list[bytes]]:
    """All blobs of a task by kind."""
    out: dict[int, list[bytes]] = {}
    for batch in batches:
        for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            out.setdefault(kind, []).append(blob)
    return out


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, parts: int) -> DataFrame:
    """Packed rows, each in the partition it names."""
    return df.repartitionById(parts, df["part"])

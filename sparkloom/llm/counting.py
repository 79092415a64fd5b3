"""How many documents hold each hash: counted over all documents, answered to the chunks that sent it.

A chunk sends each of its distinct hashes once, with the number of its documents that hold it, in packed blocks by
range of the hash space.  So a hash that a third of all documents share costs one entry for each chunk, and what one
task gathers is bounded by its range.  The answers name, by place in the chunk's own sorted list, the hashes that
occur in two documents or more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bucket_edges, pack, unpack

SENT = "bucket int, chunk int, hashes binary, counts binary"
ANSWER = "chunk int, bucket int, places binary, counts binary"
ANSWER_ARROW = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("places", pa.binary()), ("counts", pa.binary())])


def send(chunk: int, h48: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Blocks of one chunk's distinct sorted hashes with their numbers of documents."""
    edges = bucket_edges(h48, buckets)
    full = np.flatnonzero(edges[1:] > edges[:-1])
    # A count that does not fit is kept at the largest that does, alike everywhere.
    counts = np.minimum(counts, 65535).astype(np.uint16)
    return pa.table({
        "bucket": pa.array(full, pa.int32()),
        "chunk": pa.array(np.full(len(full), chunk), pa.int32()),
        "hashes": pa.array([pack(h48[edges[b] : edges[b + 1]]) for b in full], pa.binary()),
        "counts": pa.array([counts[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary()),
    })


def _answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Of one range: sort the hashes of all chunks, compare neighbours, sum the counts of equal ones."""
    chunks = table["chunk"].to_numpy()
    parts = [unpack(x.as_py()) for x in table["hashes"]]
    sizes = np.array([len(x) for x in parts])
    h = np.concatenate(parts)
    del parts
    c = np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in table["counts"]]).astype(np.uint32)
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    del h, s
    run = np.cumsum(first) - 1
    total = np.bincount(run, weights=c[order]).astype(np.uint32)
    back = np.empty(len(order), np.uint32)
    back[order] = total[run]
    out = {"chunk": [], "bucket": [], "places": [], "counts": []}
    at = 0
    for chunk, size in zip(chunks, sizes):
        own = back[at : at + size]
        at += size
        if len(many := np.flatnonzero(own > 1)):
            out["chunk"].append(chunk)
            out["bucket"].append(key[0].as_py())
            out["places"].append(many.astype(np.uint32).tobytes())
            out["counts"].append(own[many].astype(np.uint32).tobytes())
    return pa.table(out, schema=ANSWER_ARROW)


def shared_hashes(sent: DataFrame) -> DataFrame:
    return sent.groupBy("bucket").applyInArrow(_answer, ANSWER)


def counts_of(h48: np.ndarray, answers: pa.Table, buckets: int) -> np.ndarray:
    """The number of documents for each hash of a chunk's sorted list; 1 where no answer says more."""
    counts, edges = np.ones(len(h48), np.uint32), bucket_edges(h48, buckets)
    for b, places, c in zip(answers["bucket"].to_pylist(), answers["places"].to_pylist(), answers["counts"].to_pylist()):
        if places:
            counts[edges[b] + np.frombuffer(places, np.uint32)] = np.frombuffer(c, np.uint32)
    return counts

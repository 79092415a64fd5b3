"""Removal of word runs that an earlier document already holds: the exchange under the two exact substring operators.

Documents are dealt to chunks by id.  (1) Each chunk picks anchors and sends their hashes.  (2) Ranges of the hash space,
sorted, tell each chunk which anchors two documents share.  (3) Around shared anchors, and nowhere else, each chunk states
matches to be judged: entries, each distinct one once with its smallest document id.  (4) Entries that can be equal meet
in one range, and those windows of an entry that an earlier document holds are late.  (5) Each chunk removes the words
of its late windows.  What no shared anchor leads to stays, inside a chunk as well as across chunks.

Which anchors are picked, what an entry says and how entries are compared is the operator's: see ``Method``.  Windows
that very many chunks hold are judged in rounds of ``fan`` chunks: who is late in a round is answered and leaves, and
only the earliest go on, so no task gathers a hot passage from all chunks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import counting
from .common import Words, chunk_size, give_back, in_chunks, n_chunks, settle, total_bytes

RESULT = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string"
BODY = RESULT + ", kept binary"
SENT = "bucket int, chunk int, places binary, body binary, bits binary, ids binary, whose binary, late binary"
SENT_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), *[(n, pa.binary()) for n in ("places", "body", "bits", "ids", "whose", "late")]])


@dataclass
class Entries:
    """What a chunk states: distinct entries, and where in the chunk each occurs.

    The order of entries follows from what they say, never from the order of rows: a chunk is read twice, and Spark
    promises no order.  Bit o of an entry stands for the window that starts o words before the base of an occurrence.
    """

    ranges: np.ndarray  # uint64 by which entries go to ranges; equal windows have equal ones
    ids: np.ndarray  # the smallest document id of each
    bits: np.ndarray  # booleans, a row for each entry
    bodies: object  # what the method compares, by entry
    entry: np.ndarray  # for each occurrence its entry,
    base: np.ndarray  # and its base


class Method(Protocol):
    window_words: int
    width: int  # bits of an entry

    def anchors(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ascending order and their hashes."""

    def entries(self, words: Words, at: np.ndarray) -> Entries:
        """The entries around shared anchors."""

    def pack(self, bodies, part: np.ndarray) -> bytes: ...

    def unpack(self, packed: list[bytes], sizes: list[int]): ...

    def late(self, bodies, bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which windows of the entries of one range a smaller id holds."""


def _distinct(h48: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and the number of documents that hold each."""
    if not len(h48):
        return h48, np.empty(0, np.int64)
    order = np.argsort(h48, kind="stable")  # owners ascend within equal hashes
    s, o = h48[order], owner[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    new_doc = new | np.concatenate([[True], o[1:] != o[:-1]])
    run = np.cumsum(new) - 1
    return s[new], np.bincount(run[new_doc])


def _bits(raw: list[bytes], width: int, sizes: list[int]) -> np.ndarray:
    """Rows of bits; where none are sent, all are meant."""
    parts = [np.unpackbits(np.frombuffer(x, np.uint8).reshape(n, -1), axis=1, count=width).astype(bool) if x else np.ones((n, width), bool) for x, n in zip(raw, sizes)]
    return np.concatenate(parts) if parts else np.empty((0, width), bool)


def _block(method: Method, bucket: int, chunk: int, places: np.ndarray, body: bytes, bits: np.ndarray, ids: np.ndarray) -> dict:
    used, whose = np.unique(ids, return_inverse=True)
    whose = whose.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)
    return {"bucket": bucket, "chunk": chunk, "places": places.astype(np.uint32).tobytes(), "body": body, "bits": b"" if bits.all() else np.packbits(bits, axis=1).tobytes(), "ids": used.tobytes(), "whose": whose.tobytes(), "late": None}


def _states(method: Method, words: Words, known: pa.Table, buckets: int) -> Entries | None:
    """The entries of a chunk, given which of its anchors are shared."""
    at, h = method.anchors(words)
    h48 = h >> np.uint64(16)
    own = np.unique(h48)
    shared = counting.counts_of(own, known, buckets)[np.searchsorted(own, h48)] > 1
    return method.entries(words, at[shared]) if shared.any() else None


def _order(entries: Entries, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries by bucket, and where each bucket begins."""
    bucket = ((entries.ranges >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _judge(method: Method, last: bool):
    def judge(key, table):
        places = [np.frombuffer(x, np.uint32) for x in table["places"].to_pylist()]
        sizes = [len(x) for x in places]
        used, whose = table["ids"].to_pylist(), table["whose"].to_pylist()
        ids = np.concatenate([(u := np.frombuffer(a, np.int64))[np.frombuffer(b, np.uint16 if len(u) <= 1 << 16 else np.uint32)] for a, b in zip(used, whose)])
        bits = _bits(table["bits"].to_pylist(), method.width, sizes)
        bodies = method.unpack(table["body"].to_pylist(), sizes)
        late = method.late(bodies, bits, ids)
        out, at = [], 0
        for bucket, chunk, place, size in zip(table["bucket"].to_pylist(), table["chunk"].to_pylist(), places, sizes):
            part = slice(at, at + size)
            if len(said := np.flatnonzero(late[part].any(axis=1))):
                out.append({"bucket": bucket, "chunk": chunk, "places": place[said].tobytes(), "late": b"" if late[part][said].all() else np.packbits(late[part][said], axis=1).tobytes()})
            stay = bits[part] & ~late[part]
            if not last and len(on := np.flatnonzero(stay.any(axis=1))):
                out.append(_block(method, bucket, chunk, place[on], method.pack(bodies, on + at), stay[on], ids[part][on]))
            at += size
        del bodies, bits, late, stay
        give_back()
        return pa.Table.from_pylist(out, schema=SENT_ARROW)

    return judge


def remove_repeats(docs: DataFrame, method: Method, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, carry: tuple[str, ...] = (), chunk_bytes: int = 4 << 20, fan: int = 1024) -> DataFrame:
    """One row per row of docs; see the operators for the columns and the defined results.

    Carried columns come back as c0, c1, ..., so no name of docs can clash.
    """
    size = total_bytes(docs, text_col)
    chunk_bytes = chunk_size(size, chunk_bytes)
    chunks = max(8, n_chunks(size, chunk_bytes))
    # Ranges of anchors, and, as entries are larger, more ranges of entries.
    buckets, ranges = max(8, n_chunks(size, 4 * chunk_bytes)), max(8, n_chunks(size, chunk_bytes))
    dealt = in_chunks(docs, id_col, text_col, chunks, carry)

    def send_anchors(key, table):
        words = Words(table)
        at, h = method.anchors(words)
        sent = counting.send(key[0].as_py(), *_distinct(h >> np.uint64(16), words.owner[at]), buckets)
        del words, at, h
        give_back()
        return sent

    def send_entries(key, table, known):
        found = _states(method, Words(table), known, buckets) if len(table) and len(known) else None
        if found is None:
            return SENT_ARROW.empty_table()
        order, cuts = _order(found, ranges)
        rows = []
        for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            part = order[cuts[b] : cuts[b + 1]]
            rows.append(_block(method, b, key[0].as_py(), np.arange(len(part)), method.pack(found.bodies, part), found.bits[part], found.ids[part]))
        del found, order
        give_back()
        return pa.Table.from_pylist(rows, schema=SENT_ARROW)

    def cut(key, table, answers):
        words = Words(table)
        known = answers.filter(answers["late"].is_null())
        said = answers.filter(answers["late"].is_valid())
        found = _states(method, words, known, buckets) if len(known) else None
        starts = np.empty(0, np.int64)
        if found is not None:
            order, cuts = _order(found, ranges)
            late = np.zeros(found.bits.shape, bool)
            for b, places, raw in zip(*(said[c].to_pylist() for c in ("bucket", "places", "late"))):
                own = order[cuts[b] + np.frombuffer(places, np.uint32).astype(np.int64)]
                late[own] |= _bits([raw], method.width, [len(own)])
            # A later document of the chunk that states the same entry is late in all its windows.
            again = words.ids[words.owner[found.base]] > found.ids[found.entry]
            k, o = np.nonzero(found.bits[found.entry] & (late[found.entry] | again[:, None]))
            starts = found.base[k] - o
        done = _cut(words, starts, method.window_words, with_text)
        for i in range(len(carry)):
            done = done.append_column(f"c{i}", table[f"c{i}"])
        del words, found
        give_back()
        return done

    sent = dealt.groupBy("chunk").applyInArrow(send_anchors, counting.SENT)
    known = counting.shared_hashes(sent)
    late, blocks, groups = None, dealt.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(send_entries, SENT), chunks
    while groups > fan:
        groups = -(-groups // fan)
        judged = settle(blocks.groupBy("bucket", F.pmod("chunk", F.lit(groups))).applyInArrow(_judge(method, False), SENT), "judged")
        answered = judged.where("late is not null")
        late, blocks = answered if late is None else late.unionByName(answered), judged.where("late is null")
    answered = blocks.groupBy("bucket").applyInArrow(_judge(method, True), SENT)
    late = answered if late is None else late.unionByName(answered)
    both = known.select("chunk", "bucket", "places", "counts", F.lit(None).cast("binary").alias("late")).unionByName(late.select("chunk", "bucket", "places", F.lit(None).cast("binary").alias("counts"), "late"))
    schema = ", ".join([BODY if with_text else RESULT, *[f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry)]])
    return dealt.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(cut, schema)


def _cut(words: Words, starts: np.ndarray, window_words: int, with_text: bool) -> pa.Table:
    gone = np.zeros(len(words.hashes) + 1, np.int32)
    starts = np.unique(starts)
    gone[starts] += 1
    np.subtract.at(gone, starts + window_words, 1)
    covered = np.cumsum(gone[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(covered)])
    removed = total[words.starts[1:]] - total[words.starts[:-1]]
    opens = covered & np.concatenate([[True], ~covered[:-1] | (words.owner[1:] != words.owner[:-1])]) if len(covered) else covered
    spans = np.bincount(words.owner[opens], minlength=len(words.sizes)) if len(words.sizes) else np.empty(0, np.int64)
    digests, kept = [], []
    for i, body in enumerate(words.bodies):
        left = body.split()
        text = body
        if removed[i]:
            stay = ~covered[words.starts[i] : words.starts[i + 1]]
            text = _without(body, left, stay) if with_text else None
            left = [w for w, s in zip(left, stay) if s]
        digests.append(hashlib.sha256(b" ".join(left)).hexdigest())
        if with_text:
            kept.append(text)
    out = {
        "doc_id": pa.array(words.ids, pa.int64(), mask=words.null),
        "n_words": pa.array(words.sizes, pa.int64()),
        "n_removed": pa.array(removed, pa.int64()),
        "n_spans": pa.array(spans, pa.int64()),
        "kept_sha256": pa.array(digests, pa.string()),
    }
    return pa.table(out | {"kept": pa.array(kept, pa.binary())} if with_text else out)


def _without(body: bytes, words: list[bytes], stay: np.ndarray) -> bytes:
    """The text less the words that go and the white space behind each; what stays keeps its own white space."""
    parts, at = [], 0
    for i, word in enumerate(words):
        start = body.index(word, at)
        end = start + len(word)
        if i == 0 or stay[i - 1]:
            parts.append(body[at:start])
        if stay[i]:
            parts.append(word)
        at = end
    return b"".join(parts) + (body[at:] if not words or stay[-1] else b"")

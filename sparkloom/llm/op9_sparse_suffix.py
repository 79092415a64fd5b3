"""Long-passage dedup by sparse suffix arrays.

Of all suffixes (word positions) only those at minimisers stay: in each run of ``window_words`` words, the position
whose k-word prefix hashes lowest.  Two equal runs select the same offset.  About 2 of every ``window_words - k + 2``
suffixes are kept, so the array is a twentieth of a full one.

Suffixes whose k-word prefix occurs in one document alone match nothing and leave.  The others go, with as many words to
the left and right as the runs they stand for reach, to ranges of their prefix.  There they are sorted by their words to
the right and by their words to the left; neighbours are compared word by word, and how many words each has in common
with the next tells which suffixes agree over a run, o words to the left and window_words - o to the right, for every
extension o.  The words themselves are compared, so no hash decides what goes.

Defined results.  Null text: no words.  Null id: kept as null, counts as the largest id.  Rows with one id repeated are
the same document: neither removes words of the other.  Fewer words than a window: nothing goes.  The earliest document
keeps the passage.  Empty table: no rows.  Other columns are not read by ``sparse_suffix_dedup`` and pass unchanged,
whatever their names, through ``drop_passages``, which keeps null texts null.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, count

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, gram_hashes, grams_at
from .repeats import Entries, remove_repeats

PREFIX_WORDS, WINDOW_WORDS = 8, 50


def _common(sorted_rows: np.ndarray) -> np.ndarray:
    """How many leading words each row has in common with the one before; 0 for the first."""
    differ = np.ones((len(sorted_rows), sorted_rows.shape[1] + 1), bool)
    differ[1:, :-1] = sorted_rows[1:] != sorted_rows[:-1]
    found = differ.argmax(axis=1)
    found[:1] = 0
    return found


def _sorted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their words, and what neighbours have in common."""
    if not rows.shape[1]:
        return np.arange(len(rows)), np.zeros(len(rows), np.int64)
    order = np.argsort(rows.astype(">u4").view(f"S{4 * rows.shape[1]}")[:, 0], kind="stable")
    return order, _common(rows[order])


class SparseSuffixes:
    def __init__(self, window_words: int, prefix_words: int):
        if not 1 <= prefix_words <= window_words:
            raise ValueError("prefix_words must lie between 1 and window_words")
        self.window_words, self.prefix_words = window_words, prefix_words
        self.width = window_words - prefix_words + 1

    def _minimisers(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """For each run its start and the suffix that stands for it; ties go to the leftmost."""
        place = np.arange(len(words.hashes)) - words.starts[words.owner]
        starts = np.flatnonzero(place + self.window_words <= words.sizes[words.owner])
        if not len(starts):
            return starts, starts
        view = np.lib.stride_tricks.sliding_window_view(gram_hashes(words.hashes, self.prefix_words), self.width)
        return starts, np.concatenate([part + view[part].argmin(axis=1) for part in np.array_split(starts, len(starts) // 65536 + 1)])

    def anchors(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        at = np.unique(self._minimisers(words)[1])
        return at, grams_at(words.hashes, at, self.prefix_words)

    def entries(self, words: Words, at: np.ndarray) -> Entries:
        """Distinct suffixes with the words around them that their runs reach."""
        starts, chosen = self._minimisers(words)
        # The runs of one suffix are neighbours.
        first, last = starts[np.searchsorted(chosen, at)], starts[np.searchsorted(chosen, at, "right") - 1]
        ids, known, entry, doc, text = words.ids[words.owner[at]], {}, [], -1, []
        for i, a, b, left in zip(words.owner[at].tolist(), (first - words.starts[words.owner[at]]).tolist(), (last - words.starts[words.owner[at]]).tolist(), (at - first).tolist()):
            if i != doc:
                doc, text = i, words.bodies[i].split()
            entry.append(known.setdefault((b" ".join(text[a : b + self.window_words]), left), len(known)))
        # Sorted: answers name entries by place, and the rows of a chunk come in another order each time it is read.
        bodies = sorted(known)
        rank = np.empty(len(known), np.int64)
        rank[[known[body] for body in bodies]] = np.arange(len(known))
        entry = rank[np.array(entry, np.int64)]
        least = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(least, entry, ids)
        one = np.empty(len(known), np.int64)
        one[entry] = np.arange(len(at))
        offsets = np.arange(self.width)
        bits = (offsets >= (at - last)[one][:, None]) & (offsets <= (at - first)[one][:, None])
        return Entries(grams_at(words.hashes, at[one], self.prefix_words), least, bits, bodies, entry, at)

    def pack(self, bodies, part: np.ndarray) -> bytes:
        chosen = [bodies[i] for i in part.tolist()]
        return np.array([left for _, left in chosen], np.uint32).tobytes() + b"\n".join(text for text, _ in chosen)

    def unpack(self, packed: list[bytes], sizes: list[int]):
        return [pair for x, n in zip(packed, sizes) for pair in zip(x[4 * n :].split(b"\n"), np.frombuffer(x, np.uint32, n).tolist())]

    def late(self, bodies, bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
        code = defaultdict(count(1).__next__)
        sizes = np.array([text.count(b" ") + 1 for text, _ in bodies], np.int32)
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int32)
        flat = np.zeros(sizes.sum() + 1, np.uint32)  # the last is 0: no word there
        flat[:-1] = np.fromiter(map(code.__getitem__, chain.from_iterable(text.split(b" ") for text, _ in bodies)), np.uint32, len(flat) - 1)
        del code
        middle = at + np.array([n for _, n in bodies], np.int32)

        def around(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            place = middle[:, None] + steps.astype(np.int32)
            place[(place < at[:, None]) | (place >= (at + sizes)[:, None])] = len(flat) - 1
            return _sorted(flat[place])

        right_order, right = around(np.arange(self.window_words))
        left_order, left = around(-np.arange(1, self.width))
        late = np.zeros(bits.shape, bool)
        by_id = np.argsort(ids, kind="stable")
        right_class, left_class = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
        for o in range(self.width):
            own = by_id[bits[by_id, o]]
            if len(own) < 2:
                continue
            right_class[right_order] = np.cumsum(right < self.window_words - o)
            left_class[left_order] = np.cumsum(left < o)
            _, earliest, run = np.unique(right_class[own] * (len(ids) + 1) + left_class[own], return_index=True, return_inverse=True)
            late[own, o] = ids[own][earliest][run] < ids[own]
        return late


def sparse_suffix_dedup(docs: DataFrame, window_words: int = WINDOW_WORDS, prefix_words: int = PREFIX_WORDS, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, n_spans, kept_sha256[, kept]): passages of window_words or more that an earlier document holds go."""
    return remove_repeats(docs, SparseSuffixes(window_words, prefix_words), **options)


def drop_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with such passages gone from its texts."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    ids, text = docs.schema[id_col].dataType, docs.schema[text_col].dataType
    names = {c: f"p{i}" for i, c in enumerate(others)}
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("body_text"), F.col(text_col).isNull().alias("none"), *[F.col(c).alias(n) for c, n in names.items()])
    carry = ("none", *names.values())
    found = sparse_suffix_dedup(rows, id_col="doc", text_col="body_text", with_text=True, carry=carry, **options)
    back = {c: F.col(f"c{i + 1}") for i, c in enumerate(others)}
    back |= {id_col: F.col("doc_id").cast(ids), text_col: F.when(~F.col("c0"), F.col("kept").cast(text))}
    return found.select(*[back[c].alias(c) for c in docs.columns])


def op9_sparse_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))

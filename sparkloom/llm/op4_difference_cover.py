"""Substring dedup by difference-cover anchors.

Positions whose place in their document, modulo a period of 7, lies in {0, 1, 3} form a difference cover: for any two
starts i and j some shift below 7 takes both to cover positions.  Anchors are the 7 words at each cover position, so two
equal windows of 13 words or more share an aligned anchor (6 + 7 <= 13).  Only 3 of 7 positions are hashed.

Each anchor that two documents share is extended: by d words to the left and 6 - d to the right, for each shift d that
the document has room for.  These extended windows are compared by 128-bit digests, and those that an earlier document
holds go.  A window that holds no shared anchor is never looked at.

Defined results.  Null text: no words.  Null id: kept as null, counts as the largest id.  Rows with one id repeated are
the same document: neither removes words of the other.  Fewer words than a window: nothing goes.  Empty table: no rows.
Other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import Words, grams_at
from .repeats import Entries, remove_repeats

PERIOD, COVER = 7, (0, 1, 3)


class CoverAnchors:
    width = 1

    def __init__(self, window_words: int):
        self.window_words, self.anchor_words = window_words, window_words - PERIOD + 1
        if self.anchor_words < 1:
            raise ValueError(f"window_words must be at least {PERIOD}")

    def anchors(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        place = np.arange(len(words.hashes)) - words.starts[words.owner]
        at = np.flatnonzero(np.isin(place % PERIOD, COVER) & (place + self.anchor_words <= words.sizes[words.owner]))
        return at, grams_at(words.hashes, at, self.anchor_words)

    def entries(self, words: Words, at: np.ndarray) -> Entries:
        """Distinct extended windows: 128-bit digests with the smallest id."""
        first, end = words.starts[words.owner[at]], words.starts[words.owner[at] + 1]
        reached = np.zeros(len(words.hashes), bool)
        for shift in range(PERIOD):
            start = at - shift
            reached[start[(start >= first) & (start + self.window_words <= end)]] = True
        base = np.flatnonzero(reached)
        high, low = grams_at(words.hashes, base, self.window_words), grams_at(words.second, base, self.window_words, 1)
        ids = words.ids[words.owner[base]]
        order = np.lexsort((low, high))
        h, l = high[order], low[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (l[1:] != l[:-1])]) if len(h) else np.empty(0, bool)
        entry = np.empty(len(base), np.int64)
        entry[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(ids[order], np.flatnonzero(new)) if len(h) else ids
        return Entries(h[new], least, np.ones((len(least), 1), bool), (h[new], l[new]), entry, base)

    def pack(self, bodies, part: np.ndarray) -> bytes:
        return bodies[0][part].tobytes() + bodies[1][part].tobytes()

    def unpack(self, packed: list[bytes], sizes: list[int]):
        return tuple(np.concatenate([np.frombuffer(x, np.uint64, n, 8 * n * lane) for x, n in zip(packed, sizes)]) for lane in (0, 1))

    def late(self, bodies, bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
        high, low = bodies
        order = np.lexsort((low, high))
        h, l, i = high[order], low[order], ids[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (l[1:] != l[:-1])])
        least = np.minimum.reduceat(i, np.flatnonzero(new))[np.cumsum(new) - 1]
        found = np.zeros((len(ids), 1), bool)
        found[order, 0] = least < i
        return found


def difference_cover_dedup(docs: DataFrame, window_words: int = 13, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, n_spans, kept_sha256[, kept]): words in windows that an earlier document holds go."""
    return remove_repeats(docs, CoverAnchors(window_words), **options)


def op4_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return difference_cover_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))

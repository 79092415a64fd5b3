"""The two exact substring operators against plain Python, and through their anchors alone."""

import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from test_operators import corpus, frame, words

from sparkloom.llm import repeats
from sparkloom.llm.common import Words, give_back
from sparkloom.llm.op4_difference_cover import CoverAnchors, difference_cover_dedup
from sparkloom.llm.op9_sparse_suffix import SparseSuffixes, drop_passages, sparse_suffix_dedup


def removed_words(rows, window):
    """For each id, which words go."""
    first = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, i), i)
    found = {}
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        found[i] = gone
    return found


def removed(rows, window):
    found = removed_words(rows, window)
    for i, t in rows:
        kept = b" ".join(x for x, g in zip(words(t), found[i]) if not g)
        yield i, len(words(t)), sum(found[i]), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("operator, window, fan", [(difference_cover_dedup, 13, 1024), (difference_cover_dedup, 9, 2), (difference_cover_dedup, 13, 3), (sparse_suffix_dedup, 50, 1024), (sparse_suffix_dedup, 20, 2), (sparse_suffix_dedup, 50, 3)])
def test_repeats(spark, operator, window, fan):
    """Many chunks; with a small fan, windows are judged in several rounds."""
    rows = corpus()
    got = operator(frame(spark, rows), window_words=window, chunk_bytes=6000, fan=fan)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == sorted(removed(rows, window))


def test_repeats_text(spark):
    rows = corpus()
    for operator in (difference_cover_dedup, sparse_suffix_dedup):
        kept = operator(frame(spark, rows), with_text=True, carry=("chunk", "id")).collect()
        assert all(hashlib.sha256(b" ".join(bytes(r.kept).split())).hexdigest() == r.kept_sha256 and (r.c0, r.c1) == ("c", "i") for r in kept)


def fewer(method, step):
    """The method with a share of its anchors; a class of the function, so that it travels whole."""

    class Fewer(type(method)):
        def anchors(self, words):
            at, h = super().anchors(words)
            keep = h % np.uint64(step) == 0 if step else np.zeros(len(at), bool)
            return at[keep], h[keep]

    found = Fewer.__new__(Fewer)
    found.__dict__.update(method.__dict__)
    return found


@pytest.mark.parametrize("method", [CoverAnchors(13), SparseSuffixes(50, 8)])
def test_repeats_go_by_anchors_alone(spark, method):
    """Without anchors nothing goes, inside a chunk or across; with some, less goes, and nothing that should stay."""
    rows = corpus()
    most = {i: n for i, _, n, _ in removed(rows, method.window_words)}
    for step in (0, 5):
        for chunk_bytes in (9000, 1 << 20):
            got = {r.doc_id: r.n_removed for r in repeats.remove_repeats(frame(spark, rows), fewer(method, step), chunk_bytes=chunk_bytes).collect()}
            assert all(got[i] <= most[i] for i in most) and sum(got.values()) <= (sum(most.values()) - 1 if step else 0)


@pytest.mark.parametrize("method", [CoverAnchors(13), SparseSuffixes(50, 8)])
def test_entries_do_not_follow_the_order_of_rows(method):
    """A chunk is read twice, to send entries and to cut; answers name entries by place."""
    rows = [(i, t.encode() if isinstance(t, str) else t or b"") for i, t in corpus() if i is not None]

    def stated(rows):
        table = pa.table({"id": pa.array([i for i, _ in rows], pa.int64()), "body": pa.array([t for _, t in rows], pa.binary())})
        words = Words(table)
        found = method.entries(words, method.anchors(words)[0])
        order, cuts = repeats._order(found, 8)
        return cuts.tolist(), [(found.ids[k], found.bits[k].tolist(), method.pack(found.bodies, np.array([k]))) for k in order.tolist()]

    want = stated(rows)
    assert len(want[1]) > 100
    for seed in range(3):
        assert stated(random.Random(seed).sample(rows, len(rows))) == want


def test_workers_give_memory_back():
    """What a chunk has freed leaves the process, although smaller things allocated later stay."""
    private = lambda: int(re.search(r"Private_Dirty:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024
    before, held = private(), []
    for _ in range(2000):
        freed = [bytes(1000) for _ in range(50)]
        held.append(bytes(1000))
        del freed[::2]
        held.append(freed)
    for x in held[1::2]:
        x.clear()
    left = private()
    give_back()
    assert left - before > 30 and private() - before < (left - before) / 2


def test_suffixes_compare_words():
    """Neighbours in both orders against every pair of suffixes."""
    rng = random.Random(3)
    method = SparseSuffixes(6, 2)
    for _ in range(60):
        bodies, bits = [], []
        for _ in range(rng.randint(2, 30)):
            left, right = rng.randint(0, 4), rng.randint(2, 6)
            bodies.append((b" ".join(rng.choice([b"a", b"b"]) for _ in range(left + right)), left))
            bits.append([o <= left and 6 - o <= right and rng.random() < 0.9 for o in range(5)])
        ids, bits = np.array([rng.randint(0, 9) for _ in bodies]), np.array(bits)
        run = lambda k, o: bodies[k][0].split()[bodies[k][1] - o : bodies[k][1] - o + 6]
        want = [[bool(bits[k, o]) and any(bits[j, o] and ids[j] < ids[k] and run(j, o) == run(k, o) for j in range(len(bodies))) for o in range(5)] for k in range(len(bodies))]
        assert method.late(bodies, bits, ids).tolist() == want


@pytest.mark.parametrize("operator", [difference_cover_dedup, sparse_suffix_dedup])
def test_repeats_of_null_and_repeated_ids(spark, operator):
    text = " ".join(f"w{i}" for i in range(60))
    got = operator(frame(spark, [(5, text), (5, text), (None, text), (7, text), (8, None), (None, None)])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in got) == [(False, 5, 0), (False, 5, 0), (False, 7, 60), (False, 8, 0), (True, 0, 0), (True, 0, 60)]
    assert operator(frame(spark, [])).count() == 0


def test_drop_passages_keeps_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, -1, "z", 5), (2, "x " + text, -2, "y", 6), (3, None, None, None, 7), (4, "", 1, "", 8)], "doc_id int, text string, n_words int, n_spans string, c0 int")
    got = drop_passages(docs)
    assert got.schema == docs.schema
    assert sorted(tuple(r) for r in got.collect()) == [(1, text, -1, "z", 5), (2, "x ", -2, "y", 6), (3, None, None, None, 7), (4, "", 1, "", 8)]

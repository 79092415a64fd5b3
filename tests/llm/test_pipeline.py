"""The pipeline against one plain Python program, on a small corpus with copies, passages, junk, personal data and nulls."""

import collections
import hashlib
import random
import re
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_operators import classes, plain_trusted
from test_repeats import removed_words

from sparkloom.llm import op3_pii, sql

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(9)
    syllables = "ka lo mi ren tu sa vel dor ni pra".split()
    prose = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)) + "."
    passage = prose(70)
    texts = [prose(rng.randint(60, 200)) for _ in range(40)]
    texts += [texts[0], texts[1].replace(".", " end."), texts[2] + " " + prose(3)]
    texts += [prose(30) + "\n" + passage + "\n" + prose(rng.randint(20, 60)) for _ in range(4)]
    texts += [prose(40) + f" write to jo{i}@mail{i}.org " + prose(40) for i in range(6)]
    texts += [prose(40) + ' token = "' + hashlib.sha1(b"%d" % i).hexdigest() + '" ' + prose(40) for i in range(6)] + [prose(40) + ' token = "SK_77x_live" ' + prose(40)]
    texts += [" ".join(f"{prose(1)}$$$ |" for _ in range(60)) for _ in range(5)]
    texts += [None, "", "too short", "again and again " * 50]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def plain(rows):
    """Documents after each of the four filtering stages."""
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    kept = {i for i, k in con.sql(f"SELECT doc_id, kept FROM ({sql.ORACLES['op5_quality']})").fetchall() if k}
    rows = [r for r in rows if r[0] in kept]
    yield rows
    label = classes(rows, 5, 80)
    rows = [r for r in rows if label[r[0]][1] == r[0]]
    yield rows
    gone = removed_words(rows, 50)
    rows = [(i, "".join(p for p, g in zip(re.findall(r"^[ \t-\r]*|[^ \t-\r]+[ \t-\r]*", t), [False, *gone[i]]) if not g)) for i, t in rows]
    yield rows
    found = {i: op3_pii.examine(t) for i, t in rows}
    patterns, instances = plain_trusted([(p, m["instance"], m["kind"]) for f in found.values() for m in f["marks"] for p in m["patterns"]])
    of_pattern, of_instance = {p: (s, -k) for (p, k), s in patterns.items()}, {i: k for (i, k), s in instances.items() if s >= 0.8}
    out = []
    for i, t in rows:
        spans = [(a, k, b) for a, k, b in op3_pii.base_spans(t)]
        for m in found[i]["marks"]:
            if m["kind"] in (-1, 4):
                best = max((of_pattern[p] for p in m["patterns"] if p in of_pattern), default=None)
                kind = -best[1] if best else of_instance.get(m["instance"])
                spans += [(m["start"], kind, m["end"])] * (kind is not None)
        for a, k, b in sorted(spans, reverse=True):
            t = f"{t[:a]}<{op3_pii.KINDS[k].upper()}>{t[b:]}"
        out.append((i, t))
    yield out


def test_pipeline(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = plain([(i, t) for i, t, *_ in rows])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.settle(stage(spark, docs, str(tmp_path)), "test")
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        got = docs.collect()
        last = sorted(next(stages))
        assert sorted((r.doc_id, r.text) for r in got) == last and all(r.n_chars == len(r.text) for r in got)
    texts = dict(last)
    assert any("<EMAIL>" in t for t in texts.values()) and sum("<SECRET>" in t for t in texts.values()) == 7
    from tokenizers import Tokenizer

    tokenizer, by_doc, by_sequence = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), collections.defaultdict(list), collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids, at = np.array(tokenizer.encode(texts[i], add_special_tokens=False).ids + [2], "<u4"), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert ends[-1] <= 4096 and [o for o, _ in sorted(pieces)] == [0, *ends[:-1]]


def test_stages_keep_any_columns(spark):
    """Names that the operators use themselves, odd values, repeated and null ids, and no rows at all."""
    names = ["q_words", "v_short", "pii_row", "row", "spans", "n_words", "n_spans", "kept", "c0", "p0", "doc", "chunk", "id", "body", "digest", "kept_digest", "component_id", "none"]
    rows = [r for r in corpus() if r[0] < 12] + [(3, "x " * 80, "en", "s", 1), (None, None, None, None, None), (None, "word " * 3, "en", "s", 2)]
    docs = spark.createDataFrame(rows, COLUMNS).withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, frame, "")
            assert got.columns == docs.columns
            assert all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for r in got.collect() for n in names)
        assert corpus_pipeline.STAGES[-1][1](spark, frame, "").columns[0] == "doc_id"

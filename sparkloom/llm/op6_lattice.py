"""Language-model scores by subword lattices.

The pieces of an existing vocabulary are weighted by how often they occur in the training documents.  A word's
probability is the sum over all its segmentations into pieces, by a forward recursion in log space; a text's is the
product over its words and one end.  No piece runs across white space, so a word is scored once wherever it occurs.

Words are counted over all training documents: chunks of documents send each distinct word with its count, ranges of
words (dealt by hash) sum them, learn piece counts from them and, in a second reading of the same blocks, answer each
chunk with count and score.  Only piece counts, a table as large as the vocabulary, reach the driver.

Defined results.  Null text: empty, so the end alone.  A null id counts as the empty string for the fold.  Rows repeated:
each is scored for itself.  Empty table: no rows.  Characters without a piece go by their bytes.  Without training
documents all pieces weigh alike.  Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_chunks, n_chunks, settle, total_bytes

RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
SENT = "bucket int, chunk int, words binary, counts binary"
_LOADED: dict = {}


def _pieces(path: str):
    if path not in _LOADED:
        import sentencepiece

        _LOADED[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _LOADED[path]


class Lattice:
    """Log probability of a word, summed over its segmentations."""

    def __init__(self, path: str, counts: dict[int, int], smooth: float = 0.1):
        sp = _pieces(path)
        total = sum(counts.values()) + smooth * (sp.vocab_size() + 1)
        log = lambda i: math.log((counts.get(i, 0) + smooth) / total)
        self.end = log(-1)
        usable = [i for i in range(sp.vocab_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i))]
        self.bytes = [0.0] * 256
        self.log = {}
        for i in usable:
            if sp.is_byte(i):
                self.bytes[int(sp.id_to_piece(i)[3:5], 16)] = log(i)
            else:
                self.log[sp.id_to_piece(i)] = log(i)
        self.longest = max(map(len, self.log), default=1)

    def word(self, word: str) -> float:
        text, found, longest, exp = "▁" + word, self.log.get, self.longest, math.exp
        forward = [0.0]
        for end in range(1, len(text) + 1):
            terms = [forward[start] + p for start in range(end - longest if end > longest else 0, end) if (p := found(text[start:end])) is not None]
            if found(text[end - 1]) is None:
                terms.append(forward[end - 1] + sum(self.bytes[b] for b in text[end - 1].encode("utf-8", "surrogatepass")))
            top = max(terms)
            forward.append(top + math.log(sum([exp(t - top) for t in terms])) if len(terms) > 1 else top)
        return forward[-1]


def _held_out(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i in ids], bool)


def _join(words: list[bytes]) -> bytes:
    return b" ".join(words)


def _summed(table: pa.Table) -> tuple[list[list[bytes]], dict[bytes, int]]:
    lists, total = [], {}
    for raw, counts in zip(table["words"].to_pylist(), table["counts"].to_pylist()):
        words = raw.split(b" ")
        lists.append(words)
        for w, c in zip(words, np.frombuffer(counts, np.uint32).tolist()):
            total[w] = total.get(w, 0) + c
    return lists, total


def score_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row; scores are log10."""
    size = total_bytes(docs, text_col)
    chunks, buckets = n_chunks(size, chunk_bytes), max(12, n_chunks(size, 4 * chunk_bytes))
    dealt = in_chunks(docs, id_col, text_col, chunks)

    def send(key, table):
        counts: Counter = Counter()
        seen: set = set()
        for body, held in zip(table["body"].to_pylist(), _held_out(table["id"].to_pylist())):
            words = body.lower().split()
            seen.update(words) if held else counts.update(words)
        by_bucket = [[] for _ in range(buckets)]
        for w in sorted(counts.keys() | seen):
            by_bucket[xxhash.xxh3_64_intdigest(w) % buckets].append(w)
        full = [b for b in range(buckets) if by_bucket[b]]
        return pa.table({
            "bucket": pa.array(full, pa.int32()),
            "chunk": pa.array([key[0].as_py()] * len(full), pa.int32()),
            "words": pa.array([_join(by_bucket[b]) for b in full], pa.binary()),
            "counts": pa.array([np.array([counts[w] for w in by_bucket[b]], np.uint32).tobytes() for b in full], pa.binary()),
        })

    sent = settle(dealt.groupBy("chunk").applyInArrow(send, SENT), "words")

    def learn(key, table):
        total = {w: c for w, c in _summed(table)[1].items() if c}
        sp, pieces = _pieces(vocabulary_path), Counter()
        words = list(total)
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            for w, ids in zip(part, sp.encode([x.decode("utf-8", "replace") for x in part], num_threads=1)):
                for i in ids:
                    pieces[i] += total[w]
        pieces[-2], pieces[-3] = sum(total.values()), len(total)
        return pa.table({"piece": pa.array(list(pieces), pa.int32()), "n": pa.array(list(pieces.values()), pa.int64())})

    # As many rows as the vocabulary has pieces, at most, and the sums of words and of distinct words.
    learned = {r["piece"]: r["n"] for r in sent.groupBy("bucket").applyInArrow(learn, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    text_id = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))
    ends = docs.agg(F.count(F.when(F.crc32(text_id.cast("binary")) % 10 != 0, 1))).first()[0]
    tokens, kinds = learned.pop(-2, 0) + ends, learned.pop(-3, 0) + (ends > 0)
    learned[-1] = ends
    whole = math.log10(tokens + 0.1 * (kinds + 1))
    score_end = Lattice(vocabulary_path, learned).end / math.log(10)

    def answer(key, table):
        lists, total = _summed(table)
        lattice = Lattice(vocabulary_path, learned)
        scores = {w: lattice.word(w.decode("utf-8", "replace")) / math.log(10) for w in total}
        return pa.table({
            "chunk": table["chunk"],
            "words": table["words"],
            "counts": pa.array([np.array([total[w] for w in words], np.int64).tobytes() for words in lists], pa.binary()),
            "scores": pa.array([np.array([scores[w] for w in words]).tobytes() for words in lists], pa.binary()),
        })

    def score(key, table, answers):
        place, counts, scores = {}, [], []
        for words, c, s in zip(answers["words"].to_pylist(), answers["counts"].to_pylist(), answers["scores"].to_pylist()):
            for w in words.split(b" "):
                place[w] = len(place)
            counts.append(np.frombuffer(c, np.int64))
            scores.append(np.frombuffer(s))
        counts = np.concatenate([*counts, [0]])
        base = np.log10(counts + 0.1) - whole
        scores = np.concatenate([*scores, [0.0]])
        ids = table["id"].to_pylist()
        rows = {n: [] for n in ("n_tokens", "n_known", "base_score", "score")}
        base_end = math.log10(ends + 0.1) - whole
        for body in table["body"].to_pylist():
            words = body.lower().split()
            at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
            rows["n_tokens"].append(len(words) + 1)
            rows["n_known"].append(int((counts[at] > 0).sum()) + (ends > 0))
            rows["base_score"].append(float(base[at].sum()) + base_end)
            rows["score"].append(float(scores[at].sum()) + score_end)
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()),
            "held_out": pa.array(_held_out(ids)),
            "n_tokens": pa.array(rows["n_tokens"], pa.int64()),
            "n_known": pa.array(rows["n_known"], pa.int64()),
            "train_tokens": pa.array([tokens] * len(ids), pa.int64()),
            "base_score": pa.array(rows["base_score"], pa.float64()),
            "score": pa.array(rows["score"], pa.float64()),
        })

    answers = sent.groupBy("bucket").applyInArrow(answer, "chunk int, words binary, counts binary, scores binary")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, RESULT)


def op6_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))

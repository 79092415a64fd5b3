"""Encoding with a SentencePiece vocabulary, and decoding, by a max-plus parallel scan.

The encoding of a text is the segmentation into pieces with the largest sum of log probabilities, as SentencePiece's
unigram model encodes.  A unigram file holds these.  A BPE file holds merge ranks, which are no log probabilities; there a
piece's probability follows Zipf's law, 1 / (rank + 1) over their sum, so encodings depend on the file alone.  Scores are
rounded to 2 ** -16, so sums are exact and do not depend on where a text is cut.  In a vocabulary whose pieces hold the
space mark at their start only, a piece boundary lies before each run of spaces, so ordinary texts fall into units that are
solved once and remembered.

A giant text is cut into chunks anywhere.  A chunk's boundary state says by how many characters the piece that crosses its
start reaches into it; the chunk yields the matrix of best scores from each state at its start to each at its end.  These
matrices are combined associatively (max, plus) in a tree of groups of ``fan`` neighbours, up to one matrix for the text and
down again to the true scores at every chunk's start.  From these each chunk tells, for each state at its end, the state at
its start on the best path; the states chosen follow from the end of the text; then each chunk is traced back on its own,
between its two states, and only that trace is sent.

Equal sums: at each position the longest piece wins, so chunked and whole encodings are the same.

Defined results.  Null or empty text: no ids, score 0, decoded to the empty text.  Characters without a piece, the space
mark itself among them, go by their bytes, at the lowest score less 10 for each such character.  Null ids and repeated
rows: each row for itself.  Empty table: no rows.  Other columns are not read.  A text is one row and so shorter than 2 ** 31
bytes: the states of its chunks, 16 bytes for each 8192 characters, are gathered in one task, and its ids are one row again.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle

SPACE, LITERAL = "▁", "\udfff"  # a space mark in the text itself stands apart: a lone surrogate occurs in no valid text
NONE = -np.inf
MOST_UNITS = 600_000
_LOADED: dict = {}


class _Units(dict):
    """Unit -> its ids as bytes, solved when first asked for; forgets everything when full."""

    def __init__(self, owner):
        self.owner = owner

    def __missing__(self, text: str) -> bytes:
        owner = self.owner
        ids = owner.solve_unit(text)
        if len(text) <= 64:
            if len(self) >= MOST_UNITS:
                self.clear()
            self[text] = ids
        return ids


NEVER = -1e8


def log_probabilities(scores: dict[int, float]) -> dict[int, float]:
    """Scores as log probabilities, in steps of 2 ** -16; merge ranks (0, -1, -2, ...) go by Zipf's law.

    A score so low that it only marks a piece becomes the lowest other less 10; -1 has that score as well.
    """
    used = [s for s in scores.values() if s > NEVER]
    if used and all(s <= 0 and s == int(s) for s in used) and len(set(used)) == len(used):
        whole = math.log(sum(1 / (1 - s) for s in used))
        scores = {i: -math.log(1 - s) - whole if s > NEVER else s for i, s in scores.items()}
    lowest = min((s for s in scores.values() if s > NEVER), default=0.0) - 10
    return {i: round(max(s, lowest) * 65536) / 65536 for i, s in (scores | {-1: lowest}).items()}


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = range(sp.vocab_size())
        plain = [i for i in size if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.text = {i: sp.id_to_piece(i) for i in plain}
        self.byte_of = {i: int(sp.id_to_piece(i)[3:5], 16) for i in size if sp.is_byte(i)}
        self.stands_for = {i: p.replace(SPACE, " ").encode() for i, p in self.text.items()} | {i: bytes([b]) for i, b in self.byte_of.items()}
        self.byte = {b: i for i, b in self.byte_of.items()}
        if len(self.byte) != 256:
            raise ValueError("the vocabulary needs a piece for every byte")
        found = log_probabilities({i: sp.get_score(i) for i in plain})
        self.piece = {p: (found[i], i) for i, p in self.text.items()}
        # Below other pieces: for each character that has none, and for pieces marked as hardly to be used.
        self.floor = min(found.values(), default=0.0)
        self.longest = max(map(len, self.piece), default=1)
        # Whether runs of the space mark begin a unit: the mark stands inside no piece that begins otherwise.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.piece)
        # The pieces as a tree: a character leads to (score or none, id, what follows).
        self.tree: dict = {}
        for p, (score, i) in sorted(self.piece.items()):  # shorter beginnings come first
            at = self.tree
            for c in p[:-1]:
                at = at.setdefault(c, (NONE, -1, {}))[2]
            at[p[-1]] = (score, i, {})
        # A character without a piece is scored at its first byte.
        self.scores = np.zeros(sp.vocab_size())
        self.scores[[i for b, i in self.byte.items() if b < 0x80 or b >= 0xC0]] = self.floor
        self.scores[plain] = [self.piece[self.text[i]][0] for i in plain]
        self.units = _Units(self)

    def prepare(self, text: str) -> str:
        return SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE) if text else ""

    def ids_of(self, piece: str) -> list[int]:
        found = self.piece.get(piece)
        return [found[1]] if found else [self.byte[b] for b in (SPACE if piece == LITERAL else piece).encode()]

    def forward(self, text: str, start: dict[int, float], until: int) -> tuple[list[float], list[int]]:
        """Best scores at the positions of text, and where the piece that ends there starts; entries are fixed scores.

        Pieces start before ``until`` and may end behind it.
        """
        n, tree = len(text), self.tree
        best, back = [NONE] * (n + 1), [-1] * (n + 1)
        for p, s in start.items():
            if p <= n:
                best[p] = s
        for a in range(min(until, n)):
            if (at := best[a]) == NONE:
                continue
            if text[a] not in self.piece and (score := at + self.floor) > best[a + 1]:
                best[a + 1], back[a + 1] = score, a
            node = tree
            for b in range(a, n):
                if (found := node.get(text[b])) is None:
                    break
                # Starts come in ascending order, so the first of equals is the longest piece.
                if (score := at + found[0]) > best[b + 1]:
                    best[b + 1], back[b + 1] = score, a
                node = found[2]
        return best, back

    def trace(self, text: str, back: list[int], end: int) -> tuple[list[int], int]:
        """Ids up to end, and the entry that they begin at."""
        pieces = []
        while (a := back[end]) >= 0:
            pieces.append(text[a:end])
            end = a
        return [i for p in reversed(pieces) for i in self.ids_of(p)], end

    def solve(self, text: str) -> tuple[list[int], float]:
        best, back = self.forward(text, {0: 0.0}, len(text))
        return self.trace(text, back, len(text))[0], best[len(text)]

    def solve_unit(self, text: str) -> bytes:
        """``solve`` for a whole unit, with the ids kept on the way."""
        n, tree, none = len(text), self.tree, NONE
        best, back, ids = [none] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for a in range(n):
            at, node = best[a], tree
            if text[a] not in self.piece and (score := at + self.floor) > best[a + 1]:
                best[a + 1], back[a + 1], ids[a + 1] = score, a, -1
            for b in range(a, n):
                found = node.get(text[b])
                if found is None:
                    break
                score, i, node = found
                score += at
                if score > best[b + 1]:
                    best[b + 1], back[b + 1], ids[b + 1] = score, a, i
        out = []
        while n:
            if ids[n] >= 0:
                out.append(ids[n])
            else:
                out += reversed(self.ids_of(text[back[n] : n]))
            n = back[n]
        out.reverse()
        return array("i", out).tobytes()

    def score(self, ids: bytes) -> float:
        return float(self.scores[np.frombuffer(ids, np.int32)].sum())

    def split(self, text: str) -> list[str]:
        """Units of a prepared text."""
        if not self.cuts:
            return [text] if text else []
        words = text.split(SPACE)
        if "" not in words[1:]:
            return ([words[0]] if words[0] else []) + [SPACE + w for w in words[1:]]
        out, run = [words[0]] if words[0] else [], ""
        for w in words[1:]:
            run += SPACE
            if w:
                out.append(run + w)
                run = ""
        return out + [run] * bool(run)

    def encode(self, text: str) -> tuple[bytes, float]:
        ids = b"".join(map(self.units.__getitem__, self.split(self.prepare(text))))
        return ids, self.score(ids)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.stands_for.__getitem__, ids))[1:]

    # ------------------------------------------------------------ chunks of giant texts
    def first_cut(self, text: str, least: int, most: int) -> int:
        """The first place from least on, before most, at which every segmentation has a boundary; -1 if there is none."""
        if not self.cuts:
            return -1
        at = text.find(SPACE, least, most)
        while at > 0 and text[at - 1] == SPACE:
            end = at
            while end < most and text[end] == SPACE:
                end += 1
            at = text.find(SPACE, end, most)
        return at

    def last_cut(self, text: str, least: int, most: int) -> int:
        at = text.rfind(SPACE, least, most) if self.cuts else -1
        while at > 0 and text[at - 1] == SPACE:
            at -= 1
        return at if at >= least else -1

    def matrix(self, text: str, size: int, states: int) -> np.ndarray:
        """Best score from state e (a boundary at e) to state x (the first boundary from size on is at size + x)."""
        out = np.full((states, states), NONE)
        first = self.first_cut(text, states, size)
        last = self.last_cut(text, first, size) if first >= 0 else -1
        if first < 0 or last < 0:
            for e in range(states):
                self._row(out[e], self.forward(text, {e: 0.0}, size)[0], size)
            return out
        middle = self.score(b"".join(map(self.units.__getitem__, self.split(text[first:last]))))
        tail = np.full(states, NONE)
        self._row(tail, self.forward(text[last:], {0: 0.0}, size - last)[0], size - last)
        head = np.array([self.forward(text[:first], {e: 0.0}, first)[0][first] for e in range(states)])
        return head[:, None] + (middle + tail)[None, :]

    @staticmethod
    def _row(row: np.ndarray, best: list[float], size: int) -> None:
        part = best[size : size + len(row)]
        row[: len(part)] = part

    def entered(self, text: str, size: int, entry: np.ndarray) -> np.ndarray:
        """For each state at the end the state at the start on the best path, given true scores at the start; -1 for none."""
        start = {e: s for e, s in enumerate(entry.tolist()) if s != NONE}
        states = len(entry)
        first = self.first_cut(text, states, size)
        if first >= 0:  # all paths meet there
            return np.full(states, self._entry(self.forward(text[:first], start, first)[1], first), np.int16)
        best, back = self.forward(text, start, size)
        return np.array([self._entry(back, size + x) if size + x < len(best) and best[size + x] != NONE else -1 for x in range(states)], np.int16)

    @staticmethod
    def _entry(back: list[int], end: int) -> int:
        while (a := back[end]) >= 0:
            end = a
        return end

    def leaves(self, text: str, size: int, entry: np.ndarray) -> float:
        """The best score at the end of the last chunk."""
        return float((entry + self.matrix(text, size, len(entry))[:, 0]).max())

    def between(self, text: str, size: int, enter: int, leave: int) -> bytes:
        """The ids of the best path from the state enter to the state leave."""
        pack = lambda ids: np.array(ids, np.int32).tobytes()
        first = self.first_cut(text, max(enter, 1), size)
        last = self.last_cut(text, first, size) if first >= 0 else -1
        if first < 0 or last < 0:
            return pack(self.trace(text, self.forward(text, {enter: 0.0}, size)[1], size + leave)[0])
        head = self.trace(text[:first], self.forward(text[:first], {enter: 0.0}, first)[1], first)[0]
        tail = self.trace(text[last:], self.forward(text[last:], {0: 0.0}, size - last)[1], size - last + leave)[0]
        return pack(head) + b"".join(map(self.units.__getitem__, self.split(text[first:last]))) + pack(tail)


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """Of neighbours in order, combined in a tree."""
    while len(matrices) > 1:
        matrices = [times(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]


def _square(raw: bytes) -> np.ndarray:
    m = np.frombuffer(raw)
    return m.reshape(math.isqrt(len(m)), -1)


def entries(matrices: DataFrame, chunks: int, fan: int) -> DataFrame:
    """(row, k, entry) for matrices (row, k, m): the true scores at the start of each chunk, of at most ``chunks`` a row.

    Up a tree of groups of ``fan`` neighbours, then down; a task holds one group, and a level a fan-th of the one below.
    """
    levels = [matrices]
    while chunks > fan:
        chunks = -(-chunks // fan)

        def up(key, table):
            order = table.sort_by("k")
            return pa.table({"row": order["row"].slice(0, 1), "k": [key[1].as_py()], "m": [product([_square(x) for x in order["m"].to_pylist()]).tobytes()]}, schema=pa.schema([("row", pa.int64()), ("k", pa.int32()), ("m", pa.binary())]))

        levels.append(settle(levels[-1].groupBy("row", F.floor(F.col("k") / fan).cast("int")).applyInArrow(up, "row long, k int, m binary"), "matrices"))

    def along(table: pa.Table, at: np.ndarray) -> pa.Table:
        order, found = table.sort_by("k"), []
        for x in order["m"].to_pylist():
            found.append(at.tobytes())
            at = (at[:, None] + _square(x)).max(axis=0)
        return pa.table({"row": order["row"], "k": order["k"], "entry": pa.array(found, pa.binary())})

    def top(key, table):
        at = np.full(len(_square(table["m"][0].as_py())), NONE)
        at[0] = 0.0
        return along(table, at)

    def down(key, table, above):
        return along(table, np.frombuffer(above["entry"][0].as_py()))

    schema = "row long, k int, entry binary"
    found = levels.pop().groupBy("row").applyInArrow(top, schema)
    while levels:
        above = found.withColumnRenamed("k", "group").groupBy("row", "group")
        found = levels.pop().groupBy("row", F.floor(F.col("k") / fan).cast("int")).cogroup(above).applyInArrow(down, schema)
    return found


def _lists(raw: list[bytes]) -> pa.ListArray:
    sizes = np.array([len(x) // 4 for x in raw], np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.frombuffer(b"".join(raw), np.int32)))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", giant: int = 32768, chunk: int = 8192, fan: int = 64) -> DataFrame:
    """(doc_id, ids array<int>, score) for each row; texts of more than ``giant`` characters go through the scan in chunks."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    schema = "doc_id long, ids array<int>, score double"

    def whole(batches):
        v = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [v.encode(x) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "ids", "score"])

    ordinary = rows.where(F.length("text") <= giant).mapInArrow(whole, schema)

    def cut(batches):
        v = vocabulary(path)
        for batch in batches:
            for row, doc, body in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                prepared = v.prepare(body)
                count = -(-len(prepared) // chunk)
                for k in range(count):
                    piece = prepared[k * chunk : (k + 1) * chunk + v.longest]
                    size = min(chunk, len(prepared) - k * chunk)
                    yield pa.RecordBatch.from_pylist([{"row": row, "doc_id": doc, "k": k, "size": size, "last": k == count - 1, "piece": piece.encode("utf-8", "surrogatepass")}], schema=pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int32()), ("size", pa.int32()), ("last", pa.bool_()), ("piece", pa.binary())]))

    def matrices(batches):
        v = vocabulary(path)
        for batch in batches:
            out = [v.matrix(p.decode("utf-8", "surrogatepass"), s, v.longest).tobytes() for p, s in zip(batch.column("piece").to_pylist(), batch.column("size").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array(out, pa.binary())], ["row", "k", "m"])

    def enter(batches):
        v = vocabulary(path)
        for batch in batches:
            for r in batch.to_pylist():
                entry = np.frombuffer(r["entry"])
                found = v.entered(r["piece"].decode("utf-8", "surrogatepass"), r["size"], entry).tobytes()
                score = None
                if r["last"]:  # the last matrix row that leaves at the very end
                    score = v.leaves(r["piece"].decode("utf-8", "surrogatepass"), r["size"], entry)
                yield pa.RecordBatch.from_pylist([{"row": r["row"], "k": r["k"], "enter": found, "score": score}], schema=pa.schema([("row", pa.int64()), ("k", pa.int32()), ("enter", pa.binary()), ("score", pa.float64())]))

    def choose(key, table):
        order, state, rows = table.sort_by([("k", "descending")]), 0, []
        for raw in order["enter"].to_pylist():
            leave, state = state, int(np.frombuffer(raw, np.int16)[state])
            rows.append((state, leave))
        score = order["score"][0].as_py()
        return pa.table({"row": order["row"], "k": order["k"], "enter": pa.array([e for e, _ in rows], pa.int32()), "leave": pa.array([x for _, x in rows], pa.int32()), "score": pa.array([score] * len(rows), pa.float64())})

    def traced(batches):
        v = vocabulary(path)
        for batch in batches:
            for r in batch.to_pylist():
                raw = v.between(r["piece"].decode("utf-8", "surrogatepass"), r["size"], r["enter"], r["leave"])
                yield pa.RecordBatch.from_pylist([{"row": r["row"], "doc_id": r["doc_id"], "k": r["k"], "score": r["score"], "raw": raw}], schema=pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int32()), ("score", pa.float64()), ("raw", pa.binary())]))

    def joined(key, table):
        order = table.sort_by("k")
        return pa.table({"doc_id": order["doc_id"].slice(0, 1), "ids": _lists([b"".join(order["raw"].to_pylist())]), "score": order["score"].slice(0, 1)})

    giants = rows.where(F.length("text") > giant).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    pieces = settle(giants.mapInArrow(cut, "row long, doc_id long, k int, size int, last boolean, piece binary"), "giants")
    most = pieces.agg(F.coalesce(F.max("k"), F.lit(0))).first()[0] + 1
    pieces = pieces.repartition("row", "k")
    starts = entries(settle(pieces.mapInArrow(matrices, "row long, k int, m binary"), "matrices"), most, fan)
    maps = pieces.join(starts, ["row", "k"]).mapInArrow(enter, "row long, k int, enter binary, score double")
    states = settle(maps.groupBy("row").applyInArrow(choose, "row long, k int, enter int, leave int, score double"), "states")
    paths = pieces.join(states, ["row", "k"]).mapInArrow(traced, "row long, doc_id long, k int, score double, raw binary")
    return ordinary.unionByName(paths.groupBy("row").applyInArrow(joined, schema))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with the column text: what its ids stand for."""

    def back(batches):
        v = vocabulary(path)
        for batch in batches:
            ids = batch.column("ids")
            texts = [v.decode(x).decode() for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return encoded.mapInArrow(back, "doc_id long, ids array<int>, score double, text string")


def op10_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the text decoded from them."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")

    def digest(batches):
        v = vocabulary(path)
        for batch in batches:
            ids = batch.column("ids")
            for at in range(0, batch.num_rows, 500):
                part = [np.asarray(x.values, np.int32) for x in ids.slice(at, 500)]
                texts = [v.decode(x.tolist()) for x in part]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(at, 500),
                    pa.array([len(x) for x in part], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4")) for x in part], pa.int64()),
                    batch.column("score").slice(at, 500),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                ], ["doc_id", "n_pieces", "ids_crc32", "score", "decoded_sha256"])

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, path).mapInArrow(digest, "doc_id long, n_pieces long, ids_crc32 long, score double, decoded_sha256 string")

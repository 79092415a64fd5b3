"""Packing of token sequences, balanced by attention cost.

Documents are dealt to shards by id.  In a shard, whole sequences are cut from long documents first; what remains of
each document goes, dearest first, to the sequence whose cost is lowest among those with room, where a piece of n tokens
costs ``linear * n + quadratic * n * n``.  Only when no sequence has room for a piece is it cut to fill the widest gap, so
a shard pads fewer tokens than one sequence holds.

Defined results.  Null or empty text: the end id alone.  Null ids and repeated rows: each row is packed for itself.
Empty table: no rows.  A very long text becomes many whole sequences.  Other columns of the input are not read.  Ids equal
the tokenizer library's: one text in 64 is encoded by the library as well, and the job fails if any differs.  A vocabulary
with other splitting rules than ``TextIds.RULE`` goes word by word.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_chunks, total_bytes

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ENCODERS: dict = {}
#: Words remembered by a worker; punctuation that may end a word.
MOST_WORDS, TAIL = 700_000, b"!#$%&*+,-./:;=?@^_|~"
#: One text in so many is encoded by the library as well.
CHECKED = 64


class WordIds(dict):
    """Word between ASCII white space -> its ids as bytes.  The vocabulary drops white space and no id spans it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 65536 else np.uint32
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and t.content.startswith("<|") and not (t.single_word or t.lstrip or t.rstrip)]
        self.between, self.mark = special[-1] if special else ("", None)

    def learn(self, words: set[bytes]) -> None:
        """Take up words that are not known yet; when there are too many, the others are forgotten.  Case and a tail of punctuation behind a letter need no encoding of their own."""
        if len(self) + 2 * len(words) > MOST_WORDS:
            self.clear()
        split, new = [], set()
        for word in words:
            low = word if b"<|" in word else word.lower()  # special tokens are told by their case
            stem = low.rstrip(TAIL)
            if len(stem) == len(low) or not stem or not 97 <= stem[-1] <= 122:
                new.add(low)
                if low != word:
                    split.append((word, low, b""))
            else:
                tail = low[len(stem) :]
                split.append((word, stem, tail))
                new.add(stem)
                new.add(tail)
        new = list(new - self.keys())
        for at in range(0, len(new), 2000):
            self._encode(new[at : at + 2000])
        self[b""] = b""
        for word, stem, tail in split:
            self[word] = self[stem] + self[tail]

    def _encode(self, words: list[bytes]) -> None:
        # One text for many words: a special token stands between them, and cuts the text before anything else is done.
        plain = [w for w in words if b"<|" not in w]
        if self.mark is not None and plain:
            ids = np.array(self.tokenizer.encode_batch_fast([self.between.join([w.decode() for w in plain])], add_special_tokens=False)[0].ids, self.kind)
            cuts = np.flatnonzero(ids == self.mark).tolist()
            raw, width = ids.tobytes(), ids.itemsize
            for word, a, b in zip(plain, [0, *[c + 1 for c in cuts]], [*cuts, len(ids)]):
                self[word] = raw[a * width : b * width]
            words = [w for w in words if b"<|" in w]
        for word in words:
            self[word] = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, self.kind).tobytes()

    def encode_all(self, bodies: list[bytes], end: bytes) -> list[bytes]:
        texts = [b.split() for b in bodies]
        found = [list(map(self.get, words)) for words in texts]
        unknown = {w for words, ids in zip(texts, found) if None in ids for w, i in zip(words, ids) if i is None}
        if unknown:
            self.learn(unknown)
            for words, ids in zip(texts, found):
                if None in ids:
                    ids[:] = [self[w] if i is None else i for w, i in zip(words, ids)]
        return [b"".join(ids) + end for ids in found]


class TextIds:
    """Whole texts -> their ids, several texts in one pass.

    Lower-casing and splitting into runs are array operations here; only the merges are left to a library.  A run's last
    byte becomes a symbol of its own, which stands for the byte with the end-of-word mark, so one string holds all runs of
    many texts and the library cuts it behind each such symbol.  Ids are merge ranks and each id's own bytes merge to it,
    so merging neighbours by the rank of their union equals merging listed pairs.  Texts with characters beyond Latin
    Extended-B, controls or special tokens, and runs of more than ``LONGEST`` symbols, go word by word instead.
    """

    CHARS, ROOM, LONGEST = 0x250, 1 << 19, 1000
    LETTER, NUMBER, SPACE, OTHER, MARK = range(5)
    #: Fixed values of the vocabulary file: its splitting rule and its normalizers.
    RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    NORMALIZERS = ["NFC", "Replace", "Lowercase"]

    def __init__(self, path: str):
        self.words = WordIds(path)
        self.kind = self.words.kind
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocab, merges = told["model"].get("vocab", {}), told["model"].get("merges", [])
        self.encoding = None
        try:
            known = told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == self.RULE
            known &= [n["type"] for n in told["normalizer"]["normalizers"]] == self.NORMALIZERS
        except (KeyError, TypeError, IndexError):
            known = False
        places = [vocab.get("".join(m)) for m in merges] if known and told["model"].get("end_of_word_suffix") == "</w>" else [None]
        self.mark = self.words.tokenizer.get_vocab_size() + 1
        if None not in places and places == sorted(places) and self.mark + 200 < np.iinfo(self.kind).max:
            self._prepare(vocab)

    def _prepare(self, vocab: dict) -> None:
        import regex
        import tiktoken

        letters, signs = range(97, 123), [b for b in range(33, 127) if not chr(b).isalnum()]
        inner = {b: bytes([b]) for b in letters} | {b: bytes([i]) for i, b in enumerate(signs)}
        last = {b: bytes([b - 32]) for b in letters} | {b: bytes([b]) for b in (*signs, *range(48, 58))}
        for b in range(128, 256):
            inner[b], last[b] = chr(0x80 + b).encode(), chr(0x180 + b).encode()
        # The file writes bytes as characters: printable Latin-1 stands for itself, the others follow from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        ranks = {}
        for token, i in vocab.items():
            ends = token.endswith("</w>") and len(token) > 4
            raw = [byte_of[c] for c in (token[:-4] if ends else token)]
            parts = [inner.get(b) for b in (raw[:-1] if ends else raw)] + ([last.get(raw[-1])] if ends else [])
            if None not in parts:  # others hold symbols that no text can give
                ranks[b"".join(parts)] = i
        ranks[b" "] = self.mark
        for i, b in enumerate([0xC4, 0xC5, 0xC8, 0xC9, *range(0x80, 0xC0)]):  # halves of symbols, joined before any merge
            ranks[bytes([b])] = self.mark + 1 + i
        self.encoding = tiktoken.Encoding("runs", pat_str="[a-z\\x00-\\x1f\u0100-\u017f]*[^a-z\\x00-\\x1f\u0100-\u017f]", mergeable_ranks=ranks, special_tokens={})

        self.lower = np.arange(self.CHARS, dtype=np.uint16)
        self.classes = np.full(self.CHARS, self.OTHER, np.uint8)
        self.one, self.four = np.zeros((2, 128), np.uint8), np.zeros((2, self.CHARS, 4), np.uint8)
        odd = []
        for c in range(self.CHARS):
            low = chr(c).lower()
            if len(low) != 1 or ord(low) >= self.CHARS or (c < 32 and not 9 <= c <= 13) or c == 127:
                odd.append(c)
                continue
            self.lower[c] = ord(low)
            for kind, rule in enumerate((r"\p{L}", r"\p{N}", r"\s")):
                if regex.match(rule, low):
                    self.classes[c] = kind
            raw = low.encode()
            for end, table in enumerate((inner, last)):
                if len(raw) == 1:
                    self.one[end, ord(low)] = (table.get(raw[0]) or b"?")[0]
                else:
                    self.four[end, ord(low)] = list(inner[raw[0]] + table[raw[1]])
        self.classes[127], self.one[1, 127] = self.MARK, 32
        self.odd = re.compile("[" + "".join(f"\\u{c:04x}" for c in odd) + f"\\u{self.CHARS:04x}-\U0010ffff]|<\\|")

    def _symbols(self, text: str) -> list[str] | None:
        """Strings for the library, cut behind whole runs; None where a run is too long.  \\x7f ends a text."""
        if text.isascii():
            found = np.frombuffer(text.encode(), np.uint8)
        else:
            found = np.frombuffer(text.encode("utf-16-le"), np.uint16)
        classes, low = self.classes[found], self.lower[found]
        after = np.append(classes[1:], np.uint8(self.SPACE))
        final = (classes != after) | (classes == self.NUMBER) | (classes == self.MARK)
        quote = np.flatnonzero(low == 39)
        quote = quote[(quote == 0) | (classes[quote - 1] != self.OTHER)]
        if len(quote):
            padded = np.append(low, [0, 0])
            a, b = padded[quote + 1], padded[quote + 2]
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = np.isin(a.astype(np.int64) << 16 | b, [ord(x[0]) << 16 | ord(x[1]) for x in ("re", "ve", "ll")])
            final[quote[one | two]] = False
            final[quote[one] + 1] = True
            final[quote[two] + 1] = False
            final[quote[two] + 2] = True
        kept = classes != self.SPACE
        low, final = low[kept], final[kept]
        if found.itemsize == 1:
            out = self.one[final.view(np.uint8), low]
            ends = np.flatnonzero(final) + 1
        else:
            wide = low >= 128
            at = np.cumsum(np.where(wide, 4, 1))
            out = np.empty(at[-1] if len(at) else 0, np.uint8)
            thin = ~wide
            out[at[thin] - 1] = self.one[final[thin].view(np.uint8), low[thin]]
            first = at[wide] - 4
            four = self.four[final[wide].view(np.uint8), low[wide]]
            for j in range(4):
                out[first + j] = four[:, j]
            ends = at[final]
        if len(ends) == 0:
            return []
        if np.diff(ends, prepend=0).max() > self.LONGEST:
            return None
        raw = out.tobytes()
        cuts = ends[np.minimum(np.searchsorted(ends, np.arange(self.ROOM, len(raw), self.ROOM)), len(ends) - 1)]
        cuts = [0, *dict.fromkeys(cuts.tolist()), len(raw)]
        return [raw[a:b].decode() for a, b in zip(cuts, cuts[1:]) if a < b]

    def _ids(self, text: str) -> np.ndarray | None:
        parts = self._symbols(text)
        return None if parts is None else np.concatenate([np.empty(0, self.kind), *[np.array(self.encoding.encode_ordinary(x), self.kind) for x in parts]])

    def _long(self, text: str) -> bytes | None:
        """A long text, cut at spaces."""
        parts, at = [], 0
        while at < len(text):
            cut = len(text) if len(text) - at <= self.ROOM else text.rfind(" ", at, at + self.ROOM) + 1
            if cut <= at:
                return None
            ids = self._ids(text[at:cut])
            if ids is None:
                return None
            parts.append(ids.tobytes())
            at = cut
        return b"".join(parts)

    def encode_all(self, bodies: list[bytes], end: bytes) -> list[bytes]:
        found: list[bytes | None] = [None] * len(bodies)
        group, size = [], 0
        for i, body in enumerate(bodies if self.encoding else ()):
            text = body.decode()
            if self.odd.search(text):
                continue
            if len(text) > self.ROOM:
                ids = self._long(text)
                found[i] = None if ids is None else ids + end
                continue
            if size + len(text) > self.ROOM:
                self._group(group, end, found)
                group, size = [], 0
            group.append((i, text))
            size += len(text) + 1
        self._group(group, end, found)
        rest = [i for i, x in enumerate(found) if x is None]
        for i, ids in zip(rest, self.words.encode_all([bodies[i] for i in rest], end)):
            found[i] = ids
        for body, ids in zip(bodies, found):
            if zlib.crc32(body) % CHECKED == 0:
                self._check(body, ids[: len(ids) - len(end)])
        return found

    def _check(self, body: bytes, ids: bytes) -> None:
        """The library itself encodes a fixed share of texts, chosen by their bytes."""
        if self.words.tokenizer.encode(body.decode(), add_special_tokens=False).ids != np.frombuffer(ids, self.kind).tolist():
            raise ValueError(f"ids differ from the tokenizer library's, text of crc32 {zlib.crc32(body)}")

    def _group(self, group: list[tuple[int, str]], end: bytes, found: list) -> None:
        if not group:
            return
        ids = self._ids("\x7f".join(t for _, t in group) + "\x7f")
        if ids is None:  # a run is too long: find its text
            for i, text in group:
                ids = self._ids(text)
                found[i] = None if ids is None else ids.tobytes() + end
            return
        cuts = np.flatnonzero(ids == self.mark).tolist()
        raw, width, at = ids.tobytes(), ids.itemsize, 0
        for (i, _), cut in zip(group, cuts):
            found[i] = raw[at * width : cut * width] + end
            at = cut + 1


def text_ids(path: str) -> TextIds:
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = TextIds(path)
    return _ENCODERS[path]


def pack(lengths: list[int], room: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(document, start, length, sequence, offset) of each piece, and the number of sequences."""
    pieces, rest, n = [], [], 0
    for doc, length in enumerate(lengths):
        whole = length // room
        for i in range(whole):
            pieces.append((doc, i * room, room, n, 0))
            n += 1
        if length % room:
            rest.append((length % room, doc, whole * room))
    rest.sort(key=lambda x: (-x[0], x[1]))
    open_ = -(-sum(x[0] for x in rest) // room)
    used = [0] * open_
    costs = [0.0] * open_
    by_cost = [(0.0, s) for s in range(open_)]
    narrow: list[tuple[int, int]] = []  # sequences passed over for want of room, widest first

    def put(doc, start, length, s):
        pieces.append((doc, start, length, n + s, used[s]))
        used[s] += length
        costs[s] += linear * length + quadratic * length * length
        if used[s] < room:
            heapq.heappush(by_cost, (costs[s], s))

    for length, doc, start in rest:
        while length:
            while narrow and -narrow[0][0] >= length:
                s = heapq.heappop(narrow)[1]
                heapq.heappush(by_cost, (costs[s], s))
            while by_cost and room - used[by_cost[0][1]] < length:
                s = heapq.heappop(by_cost)[1]
                heapq.heappush(narrow, (used[s] - room, s))
            if by_cost:
                put(doc, start, length, heapq.heappop(by_cost)[1])
                break
            gap, s = heapq.heappop(narrow)
            put(doc, start, -gap, s)
            start, length = start - gap, length + gap
    return pieces, n + open_


def pack_documents(docs: DataFrame, tokenizer_path: str, room: int = 4096, end_id: int = 2, linear: float = 1.0, quadratic: float = 1 / 4096, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 6 << 20) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    shards = n_chunks(total_bytes(docs, text_col), shard_bytes)

    def encode(batches):
        ids = text_ids(tokenizer_path)
        end = np.array([end_id], ids.kind).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                bodies = ids.encode_all(part.column("body").to_pylist(), end)
                yield pa.RecordBatch.from_arrays([part.column("shard"), part.column("id"), pa.array(bodies, pa.binary())], ["shard", "id", "ids"])

    def fill(key, table):
        kind = text_ids(tokenizer_path).kind
        order = table.sort_by([("id", "ascending"), ("ids", "ascending")])  # the same packing whatever order rows arrive in
        ids, doc_ids = order["ids"].to_pylist(), order["id"].to_pylist()
        width = np.dtype(kind).itemsize
        lengths = [len(x) // width for x in ids]
        rows = []
        for doc, start, length, s, offset in pack(lengths, room, linear, quadratic)[0]:
            part = np.frombuffer(ids[doc], kind, length, start * width).astype("<u4")
            rows.append((doc_ids[doc], start, length, zlib.crc32(part), lengths[doc], (key[0].as_py() << 32) + s, offset))
        columns = list(zip(*rows)) if rows else [()] * 7
        names = [x.split()[0] for x in PIECES.split(", ")]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})

    dealt = docs.select(
        F.pmod(F.xxhash64(F.col(id_col), F.octet_length(text_col)), F.lit(shards)).cast("int").alias("shard"),
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"),
    )
    return dealt.mapInArrow(encode, "shard int, id long, ids binary").groupBy("shard").applyInArrow(fill, PIECES)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))

"""N-gram Jaccard join with token-combination prefixes.

Texts that are equal share one representative.  Over the representatives' shingle sets the number of documents of each
shingle is counted, and each set is ordered from rare to frequent.  Two sets that link share at least k shingles among
the first ``n - ceil(t * n) + k`` of each, so from these extended prefixes rare shingles are indexed one by one and
frequent ones in combinations of k = 2; a shingle of one document alone is not indexed at all.  (Sets of more than
``combined`` shingles index frequent shingles singly, and sets near that size both ways, so that combinations stay few.)

In each index list, members are first compared with a few neighbours in a random order; links found contract to
components.  The lists are dealt by ranges of (key, order), so a list of any length spreads over many tasks.  Then members
of lists that still hold several components are compared across components, in a join whose condition bounds the overlap by
sizes and by parity bitmaps, so only plausible pairs leave it; a long list is dealt in blocks, each compared with the whole.
Every pair that leaves is verified exactly.  No pair of a component is needed twice, no pair is left out that could join two
components.

Defined results.  Null or empty text, or no words: an empty set, linked with nothing, its own component.  Every row
goes by its own text, be its id null or repeated with other texts; component_id is the smallest id among the rows of the
component, null where none has one.  Empty table: no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import counting
from .common import fold_set, give_back, gram_hashes, in_chunks, n_chunks, settle, total_bytes, unused, word_hashes
from .components import components

#: Longs of the bitmap that neighbours are compared by, and of that used across components.
NARROW, WIDE = 4, 16
PROFILE = ", ".join(["doc long, n long, tokens binary", *[f"b{i} long" for i in range(NARROW)], *[f"w{i} long" for i in range(WIDE)], "keys array<long>"])
#: Neighbours compared in each order, orders, documents of a rare shingle, shingles of a set that combines frequent ones,
#: members of a block of a long list.
NEIGHBOURS, ORDERS, RARE, COMBINED, BLOCK = 3, 6, 64, 400, 4096


def shingles(body: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = word_hashes(body.lower().split())
    return np.unique(gram_hashes(words, min(size, max(len(words), 1))))


def _keys(tag: int, *parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), tag, np.uint64)
    for p in parts:
        h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def index_keys(tokens: np.ndarray, counts: np.ndarray, percent: int, rare: int = RARE, combined: int = COMBINED) -> np.ndarray:
    """The keys under which a set is indexed; tokens sorted, counts their numbers of documents."""
    n = len(tokens)
    if not n:
        return np.empty(0, np.int64)
    order = np.lexsort((tokens, counts))[: n + 2 - -(-percent * n // 100)]
    t, c = tokens[order], counts[order]
    found = [np.frombuffer(fold_set(tokens), np.int64)[:1], _keys(1, t[(c > 1) & (c <= rare)])]
    often = t[c > rare]
    if n >= combined * percent // 100:
        found.append(_keys(1, often))
    if n <= combined and len(often) > 1:
        often = np.sort(often)
        i, j = np.triu_indices(len(often), 1)
        found.append(_keys(2, often[i], often[j]))
    return np.concatenate(found)


def bitmap(tokens: np.ndarray, longs: int) -> np.ndarray:
    """Parity of the tokens at each of 64 * longs places: two bitmaps differ in no more places than the sets in tokens."""
    bits = np.bincount((tokens >> np.uint64(17)).astype(np.int64) & (64 * longs - 1), minlength=64 * longs).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64)


def profiles(dealt: DataFrame, firsts: DataFrame, size: int, percent: int, buckets: int) -> DataFrame:
    """One row per representative: the size of its set, tokens that others hold too, bitmap and index keys."""

    def chosen(table, marks):
        keep = {}
        for i, digest, key in zip(marks["first"].to_pylist(), marks["digest"].to_pylist(), marks["key"].to_pylist()):
            keep.setdefault(i, {})[digest] = key
        ids, bodies = table["id"].to_pylist(), table["body"].to_pylist()
        rows, done = Counter(ids), set()
        for i, body in zip(ids, bodies):
            if i not in keep or not body.split():
                continue
            # All rows of an id are here, so digests are needed only where it has several; null ids may meet by chance.
            key = next(iter(keep[i].values())) if i is not None and rows[i] == 1 else keep[i].get(hashlib.sha256(body).hexdigest())
            if key is not None and key not in done:
                done.add(key)
                yield key, shingles(body, size)

    def send(key, table, marks):
        sets = [t for _, t in chosen(table, marks)]
        h48, counts = np.unique(np.concatenate(sets) >> np.uint64(16), return_counts=True) if sets else (np.empty(0, np.uint64), np.empty(0, np.int64))
        del sets
        give_back()
        return counting.send(key[0].as_py(), h48, counts, buckets)

    def profile(key, table, answers):
        marks = answers.filter(answers["key"].is_valid())
        known = answers.filter(answers["places"].is_valid())
        sets = list(chosen(table, marks))
        h48 = np.unique(np.concatenate([t for _, t in sets]) >> np.uint64(16)) if sets else np.empty(0, np.uint64)
        counts = counting.counts_of(h48, known, buckets)
        rows = {x.split()[0]: [] for x in PROFILE.split(", ")}
        for doc, tokens in sets:
            c = counts[np.searchsorted(h48, tokens >> np.uint64(16))]
            b = [*bitmap(tokens, NARROW).tolist(), *bitmap(tokens, WIDE).tolist()]
            for name, value in zip(rows, (doc, len(tokens), tokens[c > 1].tobytes(), *b, index_keys(tokens, c, percent))):
                rows[name].append(value)
        found = pa.table({k: pa.array(v, pa.binary() if k == "tokens" else pa.list_(pa.int64()) if k == "keys" else pa.int64()) for k, v in rows.items()})
        del sets, rows
        give_back()
        return found

    sent = dealt.groupBy("chunk").cogroup(firsts.groupBy("chunk")).applyInArrow(send, counting.SENT)
    answers = counting.shared_hashes(sent)
    both = firsts.select("chunk", "first", "digest", "key", *[F.lit(None).cast(t).alias(c) for c, t in (("bucket", "int"), ("places", "binary"), ("counts", "binary"))]).unionByName(answers, allowMissingColumns=True)
    return settle(dealt.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(profile, PROFILE), "profiles")


def _plausible(a: str, b: str, percent: int, bits: str = "b", longs: int = NARROW) -> str:
    """SQL: sizes and bitmaps leave room for the similarity asked for."""
    differ = " + ".join(f"bit_count({a}.{bits}{i} ^ {b}.{bits}{i})" for i in range(longs))
    most = f"floor(({a}.n + {b}.n - ({differ})) / 2)"
    return f"(100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) AND 100 * {most} >= {percent} * ({a}.n + {b}.n - {most}))"


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those that link: overlaps counted on whole sets."""

    def check(batches):
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            over = np.array([len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True)) for p, q in zip(x, y)], np.int64)
            union = batch.column("n").to_numpy() + batch.column("m").to_numpy() - over
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(100 * over >= percent * union))
        give_back()

    one = sets.select(F.col("doc").alias("a"), "n", F.col("tokens").alias("x"))
    two = sets.select(F.col("doc").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("y"))
    return settle(pairs.join(one, "a").join(two, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(check, "a long, b long"), "links")


def _beside(percent: int, neighbours: int):
    """Plausible pairs of rows (key, doc, n, bitmap), sorted by key, at most ``neighbours`` places apart in one list.

    A task's first and last key come with b null: their lists may go on in another task.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches):
        left = key = None
        for batch in batches:
            if not len(batch):
                continue
            if key is None:
                yield pa.RecordBatch.from_pydict({"a": batch.column("key")[:1], "b": [None]}, schema=schema)
            rows = [batch.column(c).to_numpy() for c in ("key", "doc", "n", *[f"b{i}" for i in range(NARROW)])]
            rows = rows if left is None else [np.concatenate([x, y]) for x, y in zip(left, rows)]
            key, doc, n, *bits = rows
            found = []
            for r in range(1, neighbours + 1):
                i = np.flatnonzero((key[r:] == key[:-r]) & (doc[r:] != doc[:-r]))
                j = i + r
                differ = sum(np.bitwise_count(b[i] ^ b[j]).astype(np.int64) for b in bits)
                most = (n[i] + n[j] - differ) // 2
                fit = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (100 * most >= percent * (n[i] + n[j] - most))
                found.append(np.stack([np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])])[:, fit])
            pairs = np.unique(np.concatenate(found, axis=1), axis=1)
            left = [x[-neighbours:] for x in rows]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_pydict({"a": key[-1:], "b": [None]}, schema=schema)

    return compare


def link(sets: DataFrame, percent: int, neighbours: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """(id, component) of the representatives that link with any other."""
    members = ["doc", "n", *[f"b{i}" for i in range(NARROW)]]
    wide = sets.select("doc", "n", *[f"w{i}" for i in range(WIDE)])
    index = sets.select(F.explode("keys").alias("key"), *members)
    few = sets.select(F.explode(F.slice(F.sort_array("keys"), 1, ORDERS)).alias("key"), *members)

    # Every list in one order; of each set a few lists, which near copies tend to share, in further orders.
    lists = index.withColumn("order", F.lit(0)).unionByName(few.withColumn("order", F.explode(F.sequence(F.lit(1), F.lit(ORDERS)))))
    lists = lists.withColumns({"key": F.xxhash64("key", "order"), "order": F.xxhash64("doc", "order")}).repartitionByRange("key", "order").sortWithinPartitions("key", "order")
    pairs = settle(lists.select("key", *members).mapInArrow(_beside(percent, neighbours), "a long, b long").distinct(), "pairs")
    # Two keys a task at most.
    cut = F.broadcast(pairs.where("b is null").select(F.col("a").alias("cut")))
    pairs = pairs.where("b is not null")
    links = _verify(pairs, sets, percent)

    def crossing(lists: DataFrame, label: DataFrame, least: int) -> DataFrame:
        """Links between components as they stand, of members of one list; uncut lists of fewer than least members have been compared whole."""
        owned = lists.select("key", "doc").join(label.withColumnRenamed("id", "doc"), "doc", "left").select("key", "doc", F.coalesce("component", "doc").alias("root"))
        groups = owned.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max(F.struct("c", "root")).getField("root").alias("main"), F.count(F.lit(1)).alias("roots"), F.sum("c").alias("size"))
        groups = groups.where("roots > 1").join(cut, F.xxhash64("key", F.lit(0)) == F.col("cut"), "left")
        open_ = settle(groups.where(f"size >= {least} OR cut IS NOT NULL").select("key", "main", F.ceil(F.col("size") / block).cast("int").alias("blocks")), "open")
        owned = settle(owned.join(open_, "key").join(wide, "doc"), "owned")
        one = owned.where("root <> main").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
        other = owned.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        across = one.alias("l").join(other.alias("r"), F.expr(f"l.key = r.key AND l.block = r.block AND l.root <> r.root AND (r.root = r.main OR l.doc < r.doc) AND {_plausible('l', 'r', percent, 'w', WIDE)}"))
        return _verify(across.select(F.least("l.doc", "r.doc").alias("a"), F.greatest("l.doc", "r.doc").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"), sets, percent)

    label = settle(components(links), "components")
    # First where a pair meets in few lists, so that hardly any component is left to cross in all of them.
    label = settle(merged(label, crossing(few, label, 2)), "components")
    return merged(label, crossing(index, label, neighbours + 2))


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (id, component) after further links; only their components' smallest members are linked anew."""
    of = lambda c, r: label.select(F.col("id").alias(c), F.col("component").alias(r))
    roots = links.join(of("a", "ra"), "a", "left").join(of("b", "rb"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    joined = settle(components(roots), "joined")
    new = joined.select("id", F.col("id").alias("component")).join(label, "id", "left_anti")
    up = joined.select(F.col("id").alias("component"), F.col("component").alias("up"))
    return label.unionByName(new).join(up, "component", "left").select("id", F.coalesce("up", "component").alias("component"))


def _digest(text_col: str):
    return F.sha2(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")), 256).alias("digest")


def _labelled(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, digest, n_shingles, component_id, root) for each row; root tells components apart, null for texts without words."""
    size = total_bytes(docs, text_col)
    chunks, buckets = n_chunks(size, chunk_bytes), max(8, n_chunks(size, 4 * chunk_bytes))
    dealt = in_chunks(docs, id_col, text_col, chunks)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _digest(text_col), F.xxhash64(text_col, F.lit(1)).alias("by_text"))
    # One row of each text represents it: that of the smallest id, or one without id, which its text has dealt.
    by_text = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.min("by_text").alias("by_text"))
    by_text = settle(by_text.select(F.monotonically_increasing_id().alias("key"), "digest", "first", "by_text"), "texts")
    dealt_by = F.when(F.col("first").isNotNull(), F.xxhash64("first")).otherwise(F.col("by_text"))
    firsts = by_text.select(F.coalesce(F.pmod(dealt_by, F.lit(chunks)).cast("int"), F.lit(0)).alias("chunk"), "first", "digest", "key")
    sets = profiles(dealt, firsts, shingle_words, percent, buckets)
    linked = settle(link(sets.where(F.size("keys") > 0), percent), "linked").withColumnRenamed("id", "key")
    least = linked.join(by_text.select("key", "first"), "key").groupBy("component").agg(F.min("first").alias("least"))
    linked = linked.join(least, "component")
    known = by_text.drop("by_text").join(sets.select(F.col("doc").alias("key"), "n"), "key").join(linked, "key", "left")
    known = known.select("digest", "n", F.coalesce("component", "key").alias("root"), F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("least")).alias("least"))
    empty = F.col("n").isNull()
    return rows.join(known, "digest", "left").select(
        "doc_id",
        "digest",
        F.coalesce("n", F.lit(0).cast("long")).alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
        "root",
    )


def jaccard_join(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: documents whose shingle sets have a Jaccard similarity of percent / 100 or more link."""
    return _labelled(docs, shingle_words, percent, id_col, text_col, chunk_bytes).select("doc_id", "n_shingles", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, less those whose component holds a smaller id; of rows with one id and component one stays, rows without id stay.

    Of rows equal in id and text, but not in other columns, any one stays.
    """
    digest = unused(docs, "kept_digest")
    found = _labelled(docs, id_col=id_col, text_col=text_col, **options).where("doc_id = component_id")
    first = found.groupBy("doc_id", F.coalesce(F.col("root").cast("string"), F.col("digest"))).agg(F.min("digest").alias("digest"))
    first = first.select(F.col("doc_id").alias(id_col), F.col("digest").alias(digest))
    rows = docs.withColumn(digest, _digest(text_col)).join(first, [id_col, digest], "left_semi").dropDuplicates([id_col, digest])
    return rows.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=4, percent=85)

"""Personal data by bootstrapped contextual extraction.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; these are seeds and are spans as they stand.  A
fifth kind, secrets, has no base pattern: tokens of 40 hex digits are presumed seeds, which count for less and become
spans only where the graph confirms them.

Seeds induce lexical patterns: the last one, two or three pieces of text before them, the two pieces behind, and one before
with one behind; lower-cased, digits made alike.  Patterns and instances form a bipartite graph that Spark scores in rounds.  A
pattern's score for a kind is the share of that kind among the instances it introduces whose kind is known; it is trusted if
that is high, if it has enough of them, more the shorter it is, and if known ones are no small share of all it introduces
(share times the logarithm of their number).  An instance that no seed names is worth its best trusted pattern, and counts
as known in the next round.  Identifier-like tokens in trusted patterns, and known instances elsewhere, become new spans of
the kind their pattern stands for.

Identifier-like is a token of 4 to 128 characters between white space, quotes and brackets that holds a digit or one of
``@ _ ( ) # + : / \\ ~`` inside; which of them are personal is left to the graph.  Identifiers of several tokens are found by
base patterns only.

Only distinct (pattern, instance) edges are shuffled, and patterns of too few instances leave before any join; documents
stay where they are and get their new spans by row.

Defined results.  Null text: empty.  Null ids and repeated rows: each row for itself.  Empty table: no rows.  All scans
are linear in a text's length.  Ties between kinds go to the lower kind.  Other columns are not read by ``find_pii`` and
pass unchanged, whatever their names, through ``redact_pii``, which keeps null texts null.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, settle, unused

#: Kinds in the order of equal starts.
KINDS = ["email", "ip", "card", "phone", "secret"]
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SECRET = re.compile(r"(?<![0-9A-Za-z])[0-9a-f]{40}(?![0-9A-Za-z])")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
BREAK, SIGNS = r"\s\"'<>,;|\[\]{}=", r"0-9@_()#+:/\\~"
SIGN = re.compile(f"[{SIGNS}]")
#: A whole token that holds a sign; possessive, so linear.
IDENTIFIER = re.compile(f"(?<![^{BREAK}])[^{BREAK}{SIGNS}]*+[{SIGNS}][^{BREAK}]*+")
#: An identifier-like token has this many characters at least and at most; characters of context on either side.
LEAST, MOST, CONTEXT = 4, 128, 40
#: Known instances that a pattern needs, by its number of pieces; what a presumed seed counts for; the score that trust
#: needs, against half an instance of another kind; the least share of known instances times log2(1 + known).
SUPPORT, PRESUMED, TRUST, DOUBT, WORTH = {1: 8.0, 2: 4.0, 3: 2.5}, 0.9, 0.8, 0.5, 1.0
LUHN_DOUBLE = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)

SPAN = "array<struct<start:int,kind:int,end:int>>"
FOUND = f"n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, seeds {SPAN}, marks array<struct<start:int,kind:int,end:int,patterns:array<string>,instance:long>>"


def _luhn(digits: str) -> bool:
    return (sum(map(int, digits[-1::-2])) + sum(LUHN_DOUBLE[int(x)] for x in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted; kinds by place in KINDS."""
    found = []
    if "@" in text:
        last = 0
        for m in AT.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                found.append((start, 0, m.end()))
                last = m.end()
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = NOT_DIGIT.sub("", m[0])
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    found.sort()
    return found


def _pieces(text: str) -> list[str]:
    return re.sub("[0-9]", "0", text.lower()).split()


def contexts(text: str, start: int, end: int) -> list[str]:
    """The patterns that a span stands in: a digit for the number of pieces, then the pieces; each holds a letter."""
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    left, right = _pieces(before), _pieces(after)
    if left and start > CONTEXT and not text[start - CONTEXT - 1].isspace() and not before[0].isspace():
        left = left[1:]  # a cut word
    if right and end + CONTEXT < len(text) and not text[end + CONTEXT].isspace() and not after[-1].isspace():
        right = right[:-1]
    gap, next_ = " " * before[-1:].isspace(), " " * after[:1].isspace()
    found = [f"{n}{' '.join(left[-n:])}{gap}_" for n in (1, 2, 3) if len(left) >= n]
    if len(right) >= 2:
        found.append(f"2_{next_}{right[0]} {right[1]}")
    if left and right:
        found.append(f"2{left[-1]}{gap}_{next_}{right[0]}")
    return [x for x in found if any(map(str.isalpha, x))]


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like tokens that no taken span touches."""
    found, spans, k = [], sorted(taken), 0
    for m in IDENTIFIER.finditer(text):
        start, end = m.span()
        while end > start and not text[end - 1].isalnum():
            end -= 1
        while end > start and not text[start].isalnum():
            start += 1
        while k < len(spans) and spans[k][2] <= start:
            k += 1
        touched = any(a < end and start < b for a, _, b in spans[k : k + 4])
        if LEAST <= end - start <= MOST and not touched and SIGN.search(text, start, end):
            found.append((start, end))
    return found


def examine(text: str) -> dict:
    base = base_spans(text)
    counts = [0, 0, 0, 0]
    for _, kind, _ in base:
        counts[kind] += 1
    presumed = [(m.start(), 4, m.end()) for m in SECRET.finditer(text)] if DIGIT.search(text) else []
    marks = []
    for start, kind, end in base + presumed + [(a, -1, b) for a, b in candidates(text, base + presumed)]:
        instance = xxhash.xxh3_64_intdigest(text[start:end].lower().encode()) - (1 << 63)
        marks.append({"start": start, "kind": kind, "end": end, "patterns": contexts(text, start, end), "instance": instance})
    digest = hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
    return dict(zip(("n_email", "n_ip", "n_card", "n_phone"), counts)) | {"base_sha256": digest, "seeds": [{"start": a, "kind": k, "end": b} for a, k, b in base], "marks": marks}


def _examined(docs: DataFrame, id_type: str, keep: str) -> DataFrame:
    """keep: the SQL type and name of one column that goes along with what is found."""
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    mark = pa.struct([*span, ("patterns", pa.list_(pa.string())), ("instance", pa.int64())])
    fields = [(f"n_{k}", pa.int64()) for k in KINDS[:4]] + [("base_sha256", pa.string()), ("seeds", pa.list_(span)), ("marks", pa.list_(mark))]

    def look(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [examine(x) for x in part.column("body").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), *[pa.array([r[n] for r in rows], t) for n, t in fields]], ["row", "id", *[n for n, _ in fields]])
        give_back()

    return docs.mapInArrow(look, f"row long, id {id_type}, {FOUND}")


def _best(df: DataFrame, key: str) -> DataFrame:
    """(key, kind, score) with the best score of each key; of equal ones the lower kind."""
    top = df.groupBy(key).agg(F.max(F.struct("score", (-F.col("kind")).alias("kind"))).alias("b"))
    return top.select(key, (-F.col("b.kind")).alias("kind"), F.col("b.score").alias("score"))


def trusted(edges: DataFrame, rounds: int = 3, trust: float = TRUST) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, score) and (instance, kind, score) that the graph of (pattern, instance, kind) edges supports.

    kind is -1 for an instance that no seed names, 4 for presumed seeds.  Instances that only presumed or discovered come
    with a score only through a trusted pattern.
    """
    edges = edges.distinct()
    # An instance is one thing, whatever its kinds in several places.
    sizes = edges.groupBy("pattern").agg(F.countDistinct("instance").alias("n")).where(F.col("n") >= min(SUPPORT.values()))
    edges = settle(edges.join(sizes, "pattern"), "pii-edges")
    needed = F.substring("pattern", 1, 1)
    needed = F.when(needed == "1", SUPPORT[1]).when(needed == "2", SUPPORT[2]).otherwise(SUPPORT[3])
    seeds = edges.where("kind between 0 and 3").select("instance", "kind", F.lit(1.0).alias("score")).distinct()
    presumed = edges.where("kind = 4").select("instance", "kind", F.lit(PRESUMED).alias("score")).distinct()
    links = edges.select("pattern", "instance", "n").distinct()
    known, patterns, found = seeds.unionByName(presumed), None, None
    for _ in range(rounds):
        sums = links.join(known, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("support"), F.max("n").alias("n"))
        sums = sums.join(sums.groupBy("pattern").agg(F.sum("support").alias("all")), "pattern")
        score, share = F.col("support") / (F.col("all") + DOUBT), F.col("support") / F.col("n")
        worth = sums.where((score >= trust) & (F.col("support") >= needed) & (share * F.log2(1 + F.col("support")) >= WORTH)).select("pattern", "kind", score.alias("score"))
        patterns = settle(_best(worth, "pattern"), "pii-patterns")
        fresh = links.select("pattern", "instance").join(patterns, "pattern").select("instance", "kind", "score")
        found = _best(fresh.join(seeds.select("instance").distinct(), "instance", "left_anti"), "instance")
        found = settle(seeds.unionByName(found), "pii-instances")
        known = found.unionByName(presumed.join(found.select("instance").distinct(), "instance", "left_anti"))
    return patterns, found


def _with_spans(found: DataFrame) -> DataFrame:
    """found with the column spans: seeds and what trusted patterns and instances add, sorted."""
    marks = found.select("row", F.explode("marks").alias("m")).select("row", "m.*")
    patterns, known = trusted(marks.select(F.explode("patterns").alias("pattern"), "instance", "kind"))
    unknown = marks.where("kind < 0 or kind = 4").drop("kind")
    by_pattern = unknown.withColumn("pattern", F.explode("patterns")).join(patterns, "pattern")
    by_instance = unknown.join(known.where(F.col("score") >= TRUST).groupBy("instance").agg(F.min("kind").alias("kind")), "instance")
    # The best of a token's patterns decides, and only where it has none its instance.
    rank = F.struct(F.col("o"), F.col("score"), (-F.col("kind")).alias("kind"))
    added = by_pattern.select("row", "start", "end", F.lit(1).alias("o"), "score", "kind").unionByName(by_instance.select("row", "start", "end", F.lit(0).alias("o"), F.lit(0.0).alias("score"), "kind"))
    added = added.groupBy("row", "start", "end").agg((-F.max(rank).getField("kind")).alias("kind")).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    return found.join(added, "row", "left").withColumn("spans", F.array_sort(F.when(F.col("added").isNull(), F.col("seeds")).otherwise(F.concat("seeds", "added")))).drop("added", "seeds", "marks")


def _body(column):
    return F.coalesce(column.cast("string"), F.lit("")).alias("body")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans as kind:start:end joined by commas) for each row."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), _body(F.col(text_col)))
    found = settle(_examined(rows, "long", "id"), "pii")
    names = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.get(names, s.getField("kind")), s.getField("start"), s.getField("end"))), ",")
    return _with_spans(found).select(F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"))


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span of its texts replaced by its kind in angle brackets; overlapping spans are replaced as one."""
    row, body, there = unused(docs, "row"), F.col(text_col), unused(docs, "spans")
    rows = settle(docs.select(F.monotonically_increasing_id().alias(row), *docs.columns), "pii-docs")
    found = settle(_examined(rows.select(F.col(row).alias("row"), F.lit(0).cast("long").alias("id"), _body(body)), "long", "id").where((F.size("marks") > 0) | (F.size("seeds") > 0)), "pii")
    spans = _with_spans(found).where(F.size("spans") > 0).select(F.col("row").alias(row), F.col("spans").alias(there))

    @F.pandas_udf("string")
    def redact(text, spans):
        import pandas as pd

        return pd.Series([t if s is None else _redacted(t, s) for t, s in zip(text, spans)], dtype=object)

    # One join, so texts are shuffled once; only texts with spans go through Python.
    found = F.col(there).isNotNull()
    clean = redact(F.when(found, body.cast("string")), F.col(there))
    return rows.join(spans, row, "left").withColumn(text_col, F.when(found, clean).otherwise(body)).select(*docs.columns)


def _redacted(text: str, spans) -> str:
    parts, at, end = [], 0, 0
    for s in spans:
        if s["start"] >= end:
            parts += [text[at : s["start"]] if s["start"] > at else "", f"<{KINDS[s['kind']].upper()}>"]
        end = at = max(end, s["end"])
    return "".join(parts) + text[at:]


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))

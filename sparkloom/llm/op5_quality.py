"""Quality rules by weak supervision, in DataFrame functions alone.

Each rule votes clean, votes junk or abstains on a document.  Votes are counted by pattern over all documents (at most
3 ** rules patterns, whatever the size of the corpus), and expectation-maximisation over these counts estimates, for each
rule, how often it votes junk on junk and on clean documents, and the share of junk.  A document is kept when its
posterior probability of being clean is at least one half, so no single rule decides.

Only the counts of patterns, at most 6561 rows, and the estimates from them live outside Spark.  Features are computed once
and settled in the shared folder; there is no shuffle but that of the pattern counts, and one of the rows where a table has
fewer splits than the cluster has cores.

Defined results.  Null or empty text: zero counts, base_failed, not kept, posterior of the votes cast.  Null ids and
repeated rows: each row is judged for itself.  Empty table: no rows.  Very long texts: sorting, never pairs of positions.
Other columns are not read by ``score_quality`` and pass unchanged, whatever their names, through ``keep_quality``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle

#: White space that separates words, the symbols counted, ASCII punctuation, ASCII capitals.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPLIT = "[ \\t\\n\\x0B\\f\\r]+"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Strength of the prior that anchors the estimates, in documents, and its values on junk and on clean documents.
PRIOR, ON_JUNK, ON_CLEAN, JUNK = 20.0, 0.25, 0.005, 0.2
#: Rounds of expectation-maximisation.
ROUNDS = 20


def _without(column: Column, characters: str) -> Column:
    return F.translate(column, characters, "")


def _count_of(column: Column, characters: str) -> Column:
    return (F.length(column) - F.length(_without(column, characters))).cast("long")


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns q_*: the counts that the rules read."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    inner = F.btrim(text, F.lit(SPACE))
    out = docs.withColumns({
        "q_words": F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPLIT)),
        "q_lines": F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""),
        "q_word_chars": F.length(_without(text, SPACE)).cast("long"),
        "q_n_symbols": _count_of(text, SYMBOLS),
        "q_marks": _count_of(text, PUNCTUATION),
        "q_capitals": _count_of(text, CAPITALS),
    })
    out = out.withColumns({
        "q_n_words": F.size("q_words").cast("long"),
        "q_distinct": F.size(F.array_distinct("q_words")).cast("long"),
        "q_n_lines": F.size("q_lines").cast("long"),
        "q_n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
        # Each three-word window as one number; the last two positions start none.
        "q_grams": F.when(F.size("q_words") < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.slice("q_words", 1, F.greatest(F.size("q_words") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("q_words", i + 1), F.get("q_words", i + 2)))
        ),
    })
    # Windows sorted with their places: equal ones are neighbours.
    out = out.withColumn(
        "q_sorted",
        F.when(F.size(F.array_distinct("q_grams")) == F.size("q_grams"), F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
            F.sort_array(F.transform("q_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        ),
    )
    same = lambda x, j: F.coalesce(F.get("q_sorted", j).getField("h") == x.getField("h"), F.lit(False))
    out = out.withColumn(
        "q_found",
        F.sort_array(F.transform(F.filter("q_sorted", lambda x, j: same(x, j + 1) | same(x, F.greatest(j - 1, F.lit(0))) & (j > 0)), lambda x: x.getField("i"))),
    )
    # A window covers three words, fewer where the next found window begins sooner.
    gaps = F.transform("q_found", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("q_found", j + 1) - x, F.lit(3))).cast("long"))
    out = out.withColumn("q_n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, b: a + b))
    return out.drop("q_words", "q_lines", "q_grams", "q_sorted", "q_found")


def _share(a: str, b: str) -> Column:
    return F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))


def _vote(value: Column, junk: Column, clean: Column) -> Column:
    """1 junk, 0 clean, null abstains."""
    return F.when(value.isNull(), None).when(junk, 1).when(clean, 0).cast("tinyint")


def rules() -> dict[str, Column]:
    """Votes over the columns of ``features``."""
    length, symbols, marks = _share("q_word_chars", "q_n_words"), _share("q_n_symbols", "q_n_words"), _share("q_marks", "q_n_words")
    lines, repeats, capitals, distinct = _share("q_n_dup_lines", "q_n_lines"), _share("q_n_repeat_words", "q_n_words"), _share("q_capitals", "q_word_chars"), _share("q_distinct", "q_n_words")
    return {
        "v_word_length": _vote(length, (length < 2) | (length > 14), length.between(3, 10)),
        "v_symbols": _vote(symbols, symbols > 0.1, symbols < 0.02),
        "v_marks": _vote(marks, marks > 0.45, marks < 0.35),
        "v_dup_lines": _vote(lines, lines > 0.5, (F.col("q_n_lines") > 1) & (lines <= 0.2)),
        "v_repeats": _vote(repeats, repeats > 0.3, repeats < 0.1),
        "v_capitals": _vote(capitals, capitals > 0.4, capitals < 0.1),
        "v_distinct": _vote(distinct, distinct < 0.1, distinct > 0.25),
        "v_short": _vote(F.col("q_n_words"), F.col("q_n_words") < 25, F.col("q_n_words") >= 100),
    }


def posterior(model: dict) -> Column:
    """Probability that a document is clean, given its votes."""
    junk, clean = F.lit(math.log(model["junk"])), F.lit(math.log(1 - model["junk"]))
    for name, (a, b) in model["rules"].items():
        vote = F.col(name)
        junk = junk + F.when(vote == 1, math.log(a)).when(vote == 0, math.log(1 - a)).otherwise(0.0)
        clean = clean + F.when(vote == 1, math.log(b)).when(vote == 0, math.log(1 - b)).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.least(junk - clean, F.lit(700.0))))


def estimate(patterns: list[tuple[tuple, int]], names: list[str], rounds: int = ROUNDS) -> dict:
    """Expectation-maximisation over (votes, n); a Beta prior keeps the classes from changing places."""
    model = {"junk": JUNK, "rules": {n: (ON_JUNK, ON_CLEAN) for n in names}}
    rate = lambda hit, all_, at: (hit + PRIOR * at) / (all_ + PRIOR)
    for _ in range(rounds):
        # For junk, then clean: documents, and for each rule votes for junk and votes at all.
        documents, hits, said = [0.0, 0.0], [[0.0] * len(names) for _ in "jc"], [[0.0] * len(names) for _ in "jc"]
        for votes, n in patterns:
            sums = [math.log(model["junk"]), math.log(1 - model["junk"])]
            for vote, rates in zip(votes, model["rules"].values()):
                if vote is not None:
                    sums = [s + math.log(r if vote else 1 - r) for s, r in zip(sums, rates)]
            good = 1 / (1 + math.exp(min(sums[0] - sums[1], 700.0)))
            for side, share in enumerate((n * (1 - good), n * good)):
                documents[side] += share
                for i, vote in enumerate(votes):
                    if vote is not None:
                        said[side][i] += share
                        hits[side][i] += share * vote
        model = {"junk": rate(documents[0], sum(documents), JUNK), "rules": {n: (rate(hits[0][i], said[0][i], ON_JUNK), rate(hits[1][i], said[1][i], ON_CLEAN)) for i, n in enumerate(names)}}
    return model


def _spread(docs: DataFrame) -> DataFrame:
    """docs dealt anew where they come in fewer parts than there are cores; reads no column to tell."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    parts = docs.select(F.spark_partition_id().alias("part")).distinct().count()
    return docs.repartition(cores) if parts < cores else docs


def _judged(docs: DataFrame, text_col: str, columns: list[str]) -> tuple[DataFrame, dict]:
    votes = rules()
    scored = features(_spread(docs), text_col).withColumns(votes)
    scored = settle(scored.select(*columns, *[f"q_{c}" for c in COUNTS], *votes), "quality")
    # At most 3 ** rules rows.
    patterns = [(tuple(r)[:-1], r["n"]) for r in scored.groupBy(*votes).agg(F.count(F.lit(1)).alias("n")).collect()]
    return scored, estimate(sorted(patterns, key=str), list(votes))


def _kept(model: dict) -> tuple[Column, Column]:
    failed = (F.col("q_n_words") < 50) | (100 * F.col("q_n_repeat_words") > 50 * F.col("q_n_words"))
    return failed, ~failed & (posterior(model) >= 0.5)


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the base counts, base_failed, kept, quality) for each row."""
    scored, model = _judged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("q_text")), "q_text", ["doc_id"])
    failed, kept = _kept(model)
    return scored.select("doc_id", *[F.col(f"q_{c}").alias(c) for c in COUNTS], failed.alias("base_failed"), kept.alias("kept"), F.round(posterior(model), 6).alias("quality"))


def keep_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with the columns of docs."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names)])
    scored, model = _judged(plain, names[docs.columns.index(text_col)], names)
    return scored.where(_kept(model)[1]).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))

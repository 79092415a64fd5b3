"""DuckDB statements that state, independently of the operators, what some queries return."""

#: Words as the operators take them, as a list; the table must be called documents.
WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1 = """
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to, url
FROM m
"""


def _repeats(window: int) -> str:
    return f"""
WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(words[s : s + {window - 1}], ' ')) AS h
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - {window - 2})) AS s FROM w)),
least AS (SELECT h, min(doc_id) AS d FROM win GROUP BY h),
late AS (SELECT win.doc_id, s FROM win JOIN least USING (h) WHERE least.d < win.doc_id),
gone AS (SELECT DISTINCT doc_id, s + o AS p FROM late, range({window}) r(o)),
words AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w),
marked AS (SELECT words.doc_id, words.p, word, gone.p IS NOT NULL AS g FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p),
runs AS (SELECT *, g AND NOT coalesce(lag(g) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM marked),
sums AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (g) AS n_removed, count(*) FILTER (opens) AS n_spans,
                coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT g), '') AS kept FROM runs GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN sums USING (doc_id)
"""


#: Components of the pairs in ``links`` (a, b): the smallest vertex that each reaches.
COMPONENTS = """
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
least AS (SELECT a, min(least(a, b)) AS c FROM reach GROUP BY a)
"""

OP2 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(words[s : s + 3], ' ') AS h
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS s FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
{COMPONENTS}
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least.c, w.doc_id)::BIGINT AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = w.doc_id
"""

OP7 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e)
          WHERE x.norm > 0 AND y.norm > 0 AND list_inner_product(x.e, y.e) / (x.norm * y.norm) >= 0.95),
{COMPONENTS},
counts AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id)::BIGINT AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counts ON counts.a = vec_id LEFT JOIN least ON least.a = vec_id
"""


#: The votes of the quality rules: value, junk, clean.
VOTES = [
    ("word_chars / nullif(n_words, 0)", "{v} < 2 OR {v} > 14", "{v} BETWEEN 3 AND 10"),
    ("n_symbols / nullif(n_words, 0)", "{v} > 0.1", "{v} < 0.02"),
    ("marks / nullif(n_words, 0)", "{v} > 0.45", "{v} < 0.35"),
    ("n_dup_lines / nullif(n_lines, 0)", "{v} > 0.5", "n_lines > 1 AND {v} <= 0.2"),
    ("n_repeat_words / nullif(n_words, 0)", "{v} > 0.3", "{v} < 0.1"),
    ("capitals / nullif(word_chars, 0)", "{v} > 0.4", "{v} < 0.1"),
    ("n_distinct / nullif(n_words, 0)", "{v} < 0.1", "{v} > 0.25"),
    ("n_words", "{v} < 25", "{v} >= 100"),
]


def _quality(rounds: int) -> str:
    """Counts, votes, and expectation-maximisation written out round by round."""
    count = lambda characters: f"length(t) - length(translate(t, '{characters}', ''))"
    votes = ", ".join(f"CASE WHEN {v} IS NULL THEN NULL WHEN {junk.format(v=f'({v})')} THEN 1 WHEN {clean.format(v=f'({v})')} THEN 0 END AS v{i}" for i, (v, junk, clean) in enumerate(VOTES))
    names = range(len(VOTES))
    side = lambda c, share: f"ln({share}) + " + " + ".join(f"CASE v{i} WHEN 1 THEN ln({c}{i}) WHEN 0 THEN ln(1 - {c}{i}) ELSE 0 END" for i in names)
    good = f"1 / (1 + exp(least(({side('a', 'junk')}) - ({side('b', '1 - junk')}), 700)))"
    steps = ["m0 AS MATERIALIZED (SELECT 0.2::DOUBLE AS junk, " + ", ".join(f"0.25::DOUBLE AS a{i}, 0.005::DOUBLE AS b{i}" for i in names) + ")"]
    rate = lambda hit, all_, at: f"(coalesce(sum({hit}), 0) + 20 * {at}) / (coalesce(sum({all_}), 0) + 20)"
    for r in range(rounds):
        columns = ", ".join(f"{rate(f'CASE WHEN v{i} = 1 THEN n * (1 - g) END', f'CASE WHEN v{i} IS NOT NULL THEN n * (1 - g) END', 0.25)} AS a{i}, {rate(f'CASE WHEN v{i} = 1 THEN n * g END', f'CASE WHEN v{i} IS NOT NULL THEN n * g END', 0.005)} AS b{i}" for i in names)
        steps.append(f"m{r + 1} AS MATERIALIZED (SELECT {rate('n * (1 - g)', 'n', 0.2)} AS junk, {columns} FROM (SELECT p.*, {good} AS g FROM p, m{r}))")
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {WORDS.replace("coalesce(text, '')", "t")} AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT doc_id, s, words[s : s + 2] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS s FROM w)),
twice AS (SELECT doc_id, s FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
again AS (SELECT doc_id, count(DISTINCT s + o) AS n FROM twice, range(3) r(o) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, ({count('#*$%&|<>')})::BIGINT AS n_symbols,
             {count("!" + '"' + "#$%&''()*+,-./:;<=>?@[\\]^_`{|}~")} AS marks, {count("ABCDEFGHIJKLMNOPQRSTUVWXYZ")} AS capitals,
             len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(list_distinct(words)) AS n_distinct,
             coalesce(again.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN again USING (doc_id)),
v AS (SELECT *, {votes} FROM f),
p AS MATERIALIZED (SELECT {", ".join(f"v{i}" for i in names)}, count(*) AS n FROM v GROUP BY ALL),
{", ".join(steps)},
said AS (SELECT v.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {good} AS quality FROM v, m{rounds})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND quality >= 0.5 AS kept, round(quality, 6) AS quality FROM said
"""


ORACLES = {"op1_warc": OP1, "op2_jaccard": OP2, "op4_difference_cover": _repeats(13), "op5_quality": _quality(20), "op7_forest": OP7, "op9_sparse_suffix": _repeats(50)}

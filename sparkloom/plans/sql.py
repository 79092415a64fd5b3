"""DuckDB statements, written apart from the operators, for what the registered queries return."""

ROWS = """
x AS (SELECT vec_id AS id, label AS class_index, vec_id % 5 = 0 AS is_query, embedding::DOUBLE[] AS v FROM embeddings),
e AS (SELECT id, class_index, is_query, generate_subscripts(v, 1) AS pos, unnest(v) AS val FROM x),
st AS (SELECT pos, avg(val) AS mean, stddev_pop(val) AS deviation FROM e WHERE NOT is_query GROUP BY pos)
"""
NEAR = (
    ROWS
    + """,
z AS (SELECT id, class_index, is_query, list((val - mean) / CASE WHEN deviation = 0 THEN 1 ELSE deviation END ORDER BY pos) AS v
      FROM e JOIN st USING (pos) GROUP BY id, class_index, is_query),
pairs AS (SELECT q.id AS qid, q.class_index AS true_index, t.id AS tid, t.class_index,
                 greatest(round(1 - coalesce(list_dot_product(q.v, t.v) / nullif(sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(t.v, t.v)), 0), 0), 9), 0) AS d
          FROM z q JOIN z t ON q.is_query AND NOT t.is_query),
near AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, tid) AS r FROM pairs QUALIFY r <= 7),
classes AS (SELECT DISTINCT class_index, 'c' || class_index AS class_name FROM x WHERE NOT is_query),
truth AS (SELECT id AS qid, class_index AS true_index FROM x WHERE is_query)
"""
)


def scores(k: int, tag: str = "") -> str:
    return f"""
w{tag} AS (SELECT qid, class_index, CASE WHEN min(d) OVER (PARTITION BY qid) = 0 THEN (d = 0)::INT::DOUBLE ELSE 1 / nullif(d, 0) END AS w FROM near WHERE r <= {k}),
s{tag} AS (SELECT qid, class_index, sum(w) AS w FROM w{tag} GROUP BY ALL HAVING sum(w) > 0),
v{tag} AS (SELECT qid, class_index, round(w / sum(w) OVER (PARTITION BY qid), 9) AS p FROM s{tag}),
scores{tag} AS (SELECT t.qid, true_index, c.class_index, class_name, coalesce(p, 0) AS p FROM truth t CROSS JOIN classes c LEFT JOIN v{tag} v ON v.qid = t.qid AND v.class_index = c.class_index),
low{tag} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY p DESC, class_index) AS rk FROM scores{tag}),
high{tag} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY p DESC, class_index DESC) AS rk FROM scores{tag}),
predicted{tag} AS (SELECT qid, true_index, class_index AS predicted_index FROM low{tag} WHERE rk = 1)
"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts)


SCORED = with_(NEAR, scores(5))
CELLS = (
    SCORED
    + """, cells AS (SELECT a.class_index AS true_index, b.class_index AS predicted_index, count(qid) AS n
    FROM classes a CROSS JOIN classes b LEFT JOIN predicted p ON p.true_index = a.class_index AND p.predicted_index = b.class_index GROUP BY ALL),
report AS (SELECT c.class_index, coalesce(hit / nullif(said, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall, support
    FROM classes c JOIN (SELECT true_index AS class_index, sum(n)::DOUBLE AS support, (sum(n) FILTER (true_index = predicted_index))::DOUBLE AS hit FROM cells GROUP BY 1) USING (class_index)
    JOIN (SELECT predicted_index AS class_index, sum(n)::DOUBLE AS said FROM cells GROUP BY 1) USING (class_index)),
full_ AS (SELECT class_index, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, support FROM report)
"""
)


def wide(order: str) -> str:
    tops = ", ".join(f"max(CASE WHEN o.rk = {i} THEN o.class_name END) AS top_{i}_class" for i in (1, 2, 3))
    tops += ", " + ", ".join(f"round(max(CASE WHEN o.rk = {i} THEN o.p END), 6) AS top_{i}_probability" for i in (1, 2, 3))
    return (
        SCORED
        + f"""SELECT o.qid, max(o.true_index) AS true_index, max(p.predicted_index) AS predicted_index, 'c' || max(p.predicted_index) AS predicted_class,
        round(max(o.p), 6) AS confidence, {tops}, max(o.true_index) = max(p.predicted_index) AS is_correct
        FROM {order} o JOIN predicted p USING (qid) GROUP BY o.qid"""
    )


SELECTION = with_(NEAR, scores(3, "3"), scores(5, "5"), scores(7, "7")) + ", selection AS (" + " UNION ALL ".join(
    f"SELECT 'knn_cosine_k{k}' AS model_name, 'all' AS feature_name, round(avg((true_index = predicted_index)::INT), 9) AS validation_accuracy, (SELECT count(*) FROM x WHERE NOT is_query) AS train_examples, count(*) AS validation_examples FROM predicted{k}" for k in (3, 5, 7)
) + ")"

RECORDS = "records AS (SELECT CASE WHEN vec_id % 5 = 0 THEN 'dataset_test' ELSE 'dataset_dev' END AS split, 'c' || label AS class_name FROM embeddings)"

ORACLES = {
    "dataset_summary": f"WITH {RECORDS} SELECT split, class_name, count(*) AS image_count FROM records GROUP BY ALL",
    "discover_classes": f"WITH {RECORDS} SELECT (row_number() OVER (ORDER BY class_name) - 1)::INT AS class_index, class_name FROM (SELECT DISTINCT class_name FROM records WHERE split = 'dataset_dev')",
    "class_count_stats": f"WITH {RECORDS} SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_classes, min(n) AS least FROM (SELECT class_name, count(*) AS n FROM records GROUP BY 1)",
    "class_value_counts": f"WITH {RECORDS} SELECT class_name, count(*) AS image_count FROM records GROUP BY 1",
    "unknown_classes": "SELECT DISTINCT source AS class_name FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 3 = 0) ORDER BY 1",
    "missing_classes": "SELECT DISTINCT lang || '/' || source AS class_name FROM documents WHERE lang || '/' || source NOT IN (SELECT lang || '/' || source FROM documents WHERE doc_id % 5 = 0) ORDER BY 1",
    "suffix_filter": r"SELECT page_id, lower(regexp_extract(url, '\.([^./]+)$', 1)) AS suffix, lower(regexp_extract(url, '\.([^./]+)$', 1)) IN ('jpg', 'jpeg', 'png', 'bmp', 'webp', 'tif', 'tiff') AS is_image FROM pages",
    "stratified_split": """
        WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
        g AS (SELECT *, ceil(0.2 * sum(n) OVER ()) AS goal, ceil(0.2 * sum(n) OVER ()) * n / sum(n) OVER () AS share FROM c),
        f AS (SELECT *, floor(share) AS fl, goal - sum(floor(share)) OVER () AS lft FROM g),
        q AS (SELECT label, fl + CASE WHEN row_number() OVER (ORDER BY round(share - fl, 9) DESC, label) <= lft THEN 1 ELSE 0 END AS quota FROM f)
        SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) <= quota AS is_val FROM embeddings JOIN q USING (label)""",
    "feature_stats": f"WITH {ROWS} SELECT pos::INT AS pos, round(mean, 6) AS mean, round(deviation, 6) AS deviation FROM st",
    "knn_neighbors": f"WITH {NEAR} SELECT qid, tid, d, r::INT AS r FROM near WHERE r <= 5",
    "knn_vote": SCORED + "SELECT qid, true_index, class_index, round(p, 6) AS p, rk::INT AS rank FROM low",
    "top3_wide_low_tie": wide("low"),
    "top3_wide_high_tie": wide("high"),
    "accuracy_topk": SCORED + "SELECT round((SELECT avg((true_index = predicted_index)::INT) FROM predicted), 9) AS accuracy, round((SELECT avg((rk <= 3)::INT) FROM high WHERE class_index = true_index), 9) AS top_3_accuracy",
    "confusion_matrix": CELLS + "SELECT true_index, predicted_index, n FROM cells",
    "confusion_wide": CELLS + "SELECT true_index, " + ", ".join(f"(sum(n) FILTER (predicted_index = {i}))::BIGINT AS c{i}" for i in range(10)) + " FROM cells GROUP BY 1",
    "classification_report": CELLS + "SELECT class_index, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM full_",
    "report_averages": CELLS
    + """SELECT 'macro avg' AS average, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1, sum(support) AS support FROM full_
    UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9), sum(support) FROM full_""",
    "model_selection": SELECTION + "SELECT * FROM selection",
    "best_model": SELECTION + "SELECT * FROM selection ORDER BY validation_accuracy DESC, model_name LIMIT 1",
    "confidence_unpivot": SCORED + "SELECT qid, class_name, round(p, 6) AS confidence FROM scores",
    "first_predictions": SCORED + "SELECT qid, 'c' || predicted_index AS predicted_class, round((SELECT max(p) FROM scores s WHERE s.qid = predicted.qid), 6) AS confidence, true_index = predicted_index AS is_correct FROM predicted ORDER BY qid LIMIT 5",
    "one_prediction": SCORED + "SELECT class_name, round(p, 6) AS confidence, printf('%.2f', round(p, 6)) AS label FROM scores WHERE qid = (SELECT DISTINCT qid FROM scores ORDER BY qid LIMIT 1 OFFSET 3)",
    "confusion_named": CELLS + "SELECT 'c' || true_index AS true_class, " + ", ".join(f"(sum(n) FILTER (predicted_index = {i}))::BIGINT AS c{i}" for i in range(10)) + " FROM cells GROUP BY true_index",
    "largest_cell": CELLS + "SELECT max(n) AS largest FROM cells",
    "preview_records": "SELECT page_id, url FROM pages ORDER BY page_id LIMIT 10",
    "class_weights": "SELECT quality, n, round((sum(n) OVER ())::DOUBLE / (count(*) OVER () * n), 9) AS weight FROM (SELECT quality, count(*) AS n FROM labels GROUP BY 1)",
    "hist_1d": """
        WITH b AS (SELECT least(floor((value - 0) / 100 * 10), 9)::INT AS bin FROM events WHERE value BETWEEN 0 AND 100)
        SELECT r.i::INT AS bin, count(bin) AS n, round(count(bin) / ((SELECT count(*) FROM b) + 1e-8), 9) AS mass FROM range(10) r(i) LEFT JOIN b ON b.bin = r.i GROUP BY r.i""",
    "hist_3d": """
        WITH b AS (SELECT (least(floor((l_quantity - 1) / 49 * 10), 9) * 16 + least(floor(l_discount / 0.1 * 4), 3) * 4 + least(floor(l_tax / 0.08 * 4), 3))::INT AS bin
                   FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 AND l_discount BETWEEN 0 AND 0.1 AND l_tax BETWEEN 0 AND 0.08)
        SELECT r.i::INT AS bin, count(bin) AS n, round(count(bin) / ((SELECT count(*) FROM b) + 1e-8), 9) AS mass FROM range(160) r(i) LEFT JOIN b ON b.bin = r.i GROUP BY r.i""",
    "softmax_scores": """
        WITH e AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
        s AS (SELECT vec_id, i, exp(x - max(x) OVER (PARTITION BY vec_id)) AS y FROM e)
        SELECT vec_id, (i - 1)::INT AS class_index, round(y / sum(y) OVER (PARTITION BY vec_id), 9) AS p FROM s""",
    "l1_normalised": """
        WITH e AS (SELECT vec_id, abs(unnest(embedding::DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
        SELECT vec_id, (i - 1)::INT AS pos, round(x / (sum(x) OVER (PARTITION BY vec_id) + 1e-8), 9) AS mass FROM e""",
}

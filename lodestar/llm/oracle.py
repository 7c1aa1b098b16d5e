"""SQL for the llm queries that SQL can express over whole tables."""

ORACLE = {
    "p6_agreement": """
WITH ranked AS (
  SELECT job_id, field, labeller_id, nullif(lower(trim(value)), '') AS v,
         row_number() OVER (PARTITION BY job_id, field, labeller_id ORDER BY round_no DESC, labelled_at DESC, id DESC) AS rn
  FROM eval_labels WHERE job_id IS NOT NULL AND field IS NOT NULL AND labeller_id IS NOT NULL),
votes AS (SELECT * FROM ranked WHERE rn = 1 AND v IS NOT NULL),
cells AS (SELECT job_id, field, v, count(*) AS n FROM votes GROUP BY ALL),
items AS (SELECT job_id, field, sum(n) AS m, sum(n * (n - 1)) AS same FROM cells GROUP BY ALL HAVING sum(n) > 1),
seen AS (SELECT field, count(*) AS items, sum(m) AS answers, sum((m * (m - 1) - same) / (m - 1)) AS d FROM items GROUP BY field),
tot AS (SELECT c.field, c.v, sum(n) AS nc FROM cells c JOIN items USING (job_id, field) GROUP BY ALL),
sq AS (SELECT field, sum(nc * nc) AS sq FROM tot GROUP BY field)
SELECT field, CAST(items AS BIGINT) AS items, CAST(answers AS BIGINT) AS answers, round(1 - d / answers, 6) AS observed,
       round(1 - (d / answers) / nullif((answers * answers - sq) / (answers * (answers - 1)), 0), 6) AS alpha
FROM seen JOIN sq USING (field)"""
}

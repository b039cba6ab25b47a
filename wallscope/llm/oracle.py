"""DuckDB SQL for those queries that SQL can express."""

#: The terms of the Poisson distribution by recursion, as many as the largest rate may need.
MIXTURE = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM {docs} GROUP BY source),
rates AS (
    SELECT source, ((SELECT sum(n) FROM counts)::DOUBLE / (SELECT sum(pow(n::DOUBLE, 0.7)) FROM counts))
        * pow(n::DOUBLE, 0.7) / n AS rate
    FROM counts
),
terms AS (
    SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS total FROM rates
    UNION ALL
    SELECT source, rate, k + 1, p * rate / (k + 1), total + p * rate / (k + 1)
    FROM terms WHERE k < rate + 9 * sqrt(rate) + 20
),
drawn AS (
    SELECT d.*, (('0x' || substr(md5('0|0|' || coalesce(d.doc_id::VARCHAR, '~' || md5(coalesce(d.text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
    FROM {docs} d
),
counted AS (
    SELECT d.doc_id, d.source, d.text, (SELECT count(*) FROM terms t WHERE t.source IS NOT DISTINCT FROM d.source AND t.total < d.u) AS n
    FROM drawn d
)
"""

ORACLES: dict[str, str] = {
    "op2_mixture": MIXTURE.format(docs="documents")
    + """
SELECT doc_id, source, c.copy::INTEGER AS copy, md5('mix|0|' || coalesce(doc_id::VARCHAR, '~' || md5(coalesce(text, ''))) || '|' || c.copy) AS mix_key, text
FROM counted, LATERAL (SELECT unnest(generate_series(1, n)) AS copy) c
""",
}

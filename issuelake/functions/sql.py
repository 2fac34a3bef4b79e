"""SQL functions of a session: defined in SQL, so that they are planned and compiled with the query that calls them."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, arguments, type, body.
FUNCTIONS = [
    ("token_estimate", "t STRING", "INT", "greatest(1, length(t) div 4)"),
    ("words_of", "t STRING", "ARRAY<STRING>", "coalesce(regexp_extract_all(lower(t), '[a-z0-9_]+', 0), array())"),
    ("dot_product", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)"),
    ("cosine_similarity", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN size(a) = size(b) AND dot_product(a, a) > 0 AND dot_product(b, b) > 0 THEN dot_product(a, b) / (sqrt(dot_product(a, a)) * sqrt(dot_product(b, b))) END"),
    ("rrf", "ranks ARRAY<INT>, k INT", "DOUBLE", "aggregate(filter(ranks, r -> r IS NOT NULL), 0D, (s, r) -> s + 1D / (k + r))"),
]


def register(spark: SparkSession) -> list[str]:
    """Define the functions as temporary ones of the session and return their names."""
    for name, arguments, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return [f[0] for f in FUNCTIONS]

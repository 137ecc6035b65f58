"""Functions for SQL users: names registered with a session (2.P)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from prefixlake.functions.digits import SCHEME_RANGES
from prefixlake.functions.names import sequence_ratio

_SCHEMES = ", ".join(f"case when length(q) >= {len(a)} and substr(q, 1, {len(a)}) between '{a}' and '{b}' then '{s}' end" for s, a, b in SCHEME_RANGES)

SQL_FUNCTIONS = {
    "clean_digits": "(q string) returns string return regexp_replace(q, '[^0-9]', '')",
    "prefix_low": "(q string) returns int return cast(rpad(substr(q, 1, 8), 8, '0') as int)",
    "prefix_high": "(q string) returns int return cast(rpad(substr(q, 1, 8), 8, '9') as int)",
    "luhn_ok": """(q string) returns boolean return aggregate(
        transform(filter(split(reverse(q), ''), x -> x <> ''), (x, i) -> case when i % 2 = 0 then cast(x as int) when cast(x as int) * 2 > 9 then cast(x as int) * 2 - 9 else cast(x as int) * 2 end),
        0, (s, x) -> s + x) % 10 = 0""",
    "scheme_of": f"(q string) returns string return case when size(array_distinct(array_compact(array({_SCHEMES})))) = 1 then array_compact(array({_SCHEMES}))[0] end",
}


def register(spark: SparkSession) -> list[str]:
    """Register every function for this session; returns their names."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}{body}")
    spark.udf.register("sequence_ratio", sequence_ratio)
    return [*SQL_FUNCTIONS, "sequence_ratio"]

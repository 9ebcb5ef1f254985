"""Personal columns derived from the keys of the test tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def digits(expr: str, n: int) -> str:
    return f"lpad({text(f'({expr}) % {10**n}')}, {n}, '0')"


K = "c_custkey"
#: Name -> expression over ``customer``. Some values are null, short, blank or malformed.
COLUMNS = {
    "email": f"CASE WHEN {K} % 10 = 0 THEN 'ab@x.co' WHEN {K} % 10 = 1 THEN 'plain' WHEN {K} % 10 = 2 THEN NULL WHEN {K} % 10 = 3 THEN ' ' ELSE concat('user', {text(K)}, '.n@mail', {text(f'{K} % 5')}, '.example.com') END",
    "phone": f"CASE WHEN {K} % 10 = 1 THEN '123' WHEN {K} % 10 = 2 THEN NULL ELSE concat('+1 (', {text(f'200 + {K} % 800')}, ') 555-', {digits(K, 4)}) END",
    "card": f"CASE WHEN {K} % 10 = 3 THEN '4242424242424242' ELSE concat('4242 ', {digits(K, 4)}, ' ', {digits(f'{K} * 7', 4)}, ' ', {digits(f'{K} * 13', 4)}) END",
    "ssn": f"concat({digits(f'{K} * 3 + 100', 3)}, '-', {digits(f'{K} + 10', 2)}, '-', {digits(f'{K} * 11', 4)})",
    "sin": f"CASE WHEN {K} % 3 = 0 THEN {digits(f'{K} * 7919', 9)} ELSE concat({digits(K, 3)}, '-', {digits(f'{K} * 3', 3)}, '-', {digits(f'{K} * 5', 3)}) END",
    "tin": f"CASE WHEN {K} % 4 = 0 THEN '123' ELSE concat({digits(f'{K} * 7919', 9)}, 'RC', {digits(K, 4)}) END",
    "ip": f"CASE WHEN {K} % 7 = 0 THEN 'not.an.ip' ELSE concat({text(f'{K} % 256')}, '.', {text(f'{K} % 200')}, '.', {text(f'{K} % 100')}, '.', {text(f'{K} % 50')}) END",
    "iban": f"CASE WHEN {K} % 9 = 0 THEN 'GB82' ELSE concat('GB', {digits(K, 2)}, 'WEST', {digits(f'{K} * 7', 6)}, {digits(f'{K} * 31', 8)}) END",
    "person": f"CASE WHEN {K} % 5 = 0 THEN 'A' WHEN {K} % 5 = 1 THEN '  Jo   Li ' ELSE concat('John', {text(K)}, ' Smith') END",
    "place": f"concat({text(K)}, ' Main Street ', CASE WHEN {K} % 2 = 0 THEN 'San Francisco' ELSE 'Rome' END)",
    "us_bank": f"concat('Routing: ', {digits(f'{K} * 7919', 9)}, ', Account: ', {digits(f'{K} * 104729', 10)})",
    "ca_bank": f"concat({digits(f'{K} * 3', 5)}, '-', {digits(K, 3)}, '-', {digits(f'{K} * 7919', 7)})",
    "secret": f"concat('value-', {text(K)})",
    "nick": f"CASE WHEN {K} % 4 = 0 THEN NULL ELSE concat('n', {text(f'{K} % 8')}) END",
    "score": f"CASE WHEN {K} % 6 = 0 THEN NULL ELSE CAST({K} % 100 AS DOUBLE) END",
}


def people(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """c_custkey and the named columns."""
    return table(spark, sf_dir, "customer").selectExpr(K, *(f"{COLUMNS[n]} AS {n}" for n in names))


def people_sql(*names: str) -> str:
    return f"(SELECT {K}, {', '.join(f'{COLUMNS[n]} AS {n}' for n in names)} FROM customer)"

"""Table access and SQL pieces that plans share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The class of white space, as SQL; \\s of the two engines differ.
WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collapse_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'))"


def hash_sql(x: str) -> str:
    return f"sha256({collapse_sql(f'lower({x})')})"


def modulo_sql(key: str, modulus: int) -> str:
    """SHA-1 of a key as a number, modulo: five words, most significant first."""
    words = ", ".join(f"('0x' || substr(sha1({key}), {8 * i + 1}, 8))::BIGINT" for i in range(5))
    return f"list_reduce([0::BIGINT, {words}], lambda a, w: (a * 4294967296 + w) % {modulus})"

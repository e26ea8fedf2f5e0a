"""Encrypted record tables: JSON rows under AES-GCM, the key derived from a pass phrase."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fixed value of the format.
ITERATIONS = 210_000


def derive_key(phrase: str, salt: bytes, iterations: int = ITERATIONS) -> bytes:
    """The 256-bit key; derived once, on the driver."""
    return hashlib.pbkdf2_hmac("sha256", phrase.encode(), salt, iterations)


def encrypt(rows: DataFrame, key: bytes) -> DataFrame:
    """One column, sealed: each row as JSON under a fresh nonce."""
    return rows.select(F.base64(F.aes_encrypt(F.to_json(F.struct("*")), F.lit(key), F.lit("GCM"))).alias("sealed"))


def decrypt(sealed: DataFrame, key: bytes, schema: StructType) -> DataFrame:
    plain = F.aes_decrypt(F.unbase64("sealed"), F.lit(key), F.lit("GCM")).cast("string")
    return sealed.select(F.from_json(plain, schema).alias("r")).select("r.*")


def save(rows: DataFrame, path: str, key: bytes) -> None:
    encrypt(rows, key).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, key: bytes, schema: StructType) -> DataFrame:
    return decrypt(spark.read.parquet(path), key, schema)

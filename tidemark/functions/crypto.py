"""Encryption of values: AES-256-GCM with a nonce derived from key, run and version.

The nonce and the authenticated data bind a value to its run and seqno, so swapped runs, moved
values, changed bytes and wrong keys are all noticed. Stored bytes are nonce (12), ciphertext, tag
(16): 28 more than the value. The key travels as a column of a one-row table, so it is not a
literal of any plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_BYTES, OVERHEAD = 32, 28
_KEY = "_encryption_key"


class EncryptionKey:
    """32 secret bytes; never shown."""

    def __init__(self, data: bytes):
        if len(data) != KEY_BYTES:
            raise ValueError(f"a key has {KEY_BYTES} bytes, not {len(data)}")
        self._data = bytes(data)

    def __repr__(self) -> str:
        return "EncryptionKey(redacted)"

    def attach(self, df: DataFrame) -> DataFrame:
        spark: SparkSession = df.sparkSession
        row = spark.createDataFrame([(bytearray(self._data),)], f"{_KEY} binary")
        return df.join(F.broadcast(row))  # one row


def derive_nonce(run: Column, seqno: Column) -> Column:
    """12 bytes from key, run and seqno; distinct writes have distinct inputs."""
    text = F.concat(F.lower(F.hex(_KEY)), F.lit(":"), run.cast("string"), F.lit(":"), seqno.cast("string"))
    return F.unhex(F.substring(F.sha2(text, 256), 1, 24))


def _bound_to(run: Column, seqno: Column) -> Column:
    return F.concat(F.lit("run="), run.cast("string"), F.lit(";seqno="), seqno.cast("string"))


def encrypt_values(log: DataFrame, key: EncryptionKey, run: str = "run_id") -> DataFrame:
    """``log`` with encrypted values; null values (tombstones) stay null."""
    run_, seqno = F.col(run), F.col("seqno")
    sealed = F.aes_encrypt(F.col("value").cast("binary"), F.col(_KEY), F.lit("GCM"), F.lit("DEFAULT"), derive_nonce(run_, seqno), _bound_to(run_, seqno))
    return key.attach(log).withColumn("value", sealed).drop(_KEY)


def decrypt_values(log: DataFrame, key: EncryptionKey, run: str = "run_id", strict: bool = True) -> DataFrame:
    """The values again. ``strict``: bytes that fail authentication are an error; otherwise their
    value is null and ``authentic`` tells."""
    run_, seqno = F.col(run), F.col("seqno")
    function = F.aes_decrypt if strict else F.try_aes_decrypt
    plain = function(F.col("value"), F.col(_KEY), F.lit("GCM"), F.lit("DEFAULT"), _bound_to(run_, seqno))
    out = key.attach(log).withColumn("_plain", plain)
    if not strict:
        out = out.withColumn("authentic", F.col("value").isNull() | F.col("_plain").isNotNull())
    return out.withColumn("value", F.col("_plain")).drop("_plain", _KEY)

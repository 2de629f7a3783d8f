"""A store whose values are encrypted at rest. Every value is bound to the folder of the run in which it
lies: a random name of each attempt to write a run, so no name, and with it no nonce, is used twice, even where
run ids and seqnos are given out again after a failure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.crypto import EncryptionKey, decrypt_values, encrypt_values
from ..functions.names import fresh
from .runs import RunStore


class EncryptedStore(RunStore):
    """The runs of ``inner``, encrypted before they are written and decrypted (and authenticated) when they
    are read. ``inner`` gives the stored ciphertext. Compaction seals values anew for the merged run."""

    def __init__(self, inner: RunStore, key: EncryptionKey):
        if inner.schema["value"].dataType != T.BinaryType():
            raise ValueError("the inner store must hold binary values")
        super().__init__(inner.spark, inner.root, inner.options, inner.schema["user_key"].dataType.simpleString())
        self.inner, self._key = inner, key

    def _sealed(self, rows: DataFrame, folder: str) -> DataFrame:
        name = fresh("run_folder", rows.columns)
        return encrypt_values(rows.withColumn(name, F.lit(folder)), self._key, name).drop(name)

    def _opened(self, rows: DataFrame) -> DataFrame:
        name = fresh("run_folder", rows.columns)
        folder = F.element_at(F.split("_metadata.file_path", "/"), -2)
        return decrypt_values(rows.withColumn(name, folder), self._key, name).drop(name)

"""Deterministic authenticated encryption of columns, and keys from passphrases.

The nonce is derived from the plaintext by a keyed hash with a key of its own, so
equal values have equal ciphertexts and can be joined on.  This is like SIV, but it
is not RFC 5297.  Keys are derived on the driver and never printed: they meet the rows
as the values of a one-row table, not as literals, since Spark shows literals in plans,
event logs and error messages.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITERATIONS, SALT_BYTES, KEY_BYTES = 100_000, 32, 64
CANARY = "veilspark-canary"
#: Stands for the empty string inside a ciphertext.
_EMPTY = "\x00"
_TABLE = "_cipher binary, _inner binary, _outer binary"


@dataclass(frozen=True)
class Keys:
    cipher: bytes = field(repr=False)
    nonce: bytes = field(repr=False)

    @classmethod
    def of(cls, secret: bytes) -> Keys:
        return cls(secret[:32], secret[32:KEY_BYTES])


def new_salt() -> bytes:
    return os.urandom(SALT_BYTES)


def new_secret() -> bytes:
    """Random bytes for Keys.of()."""
    return os.urandom(KEY_BYTES)


def derive(passphrase: str, salt: bytes, iterations: int = ITERATIONS) -> Keys:
    """Two 32-byte keys by PBKDF2-HMAC-SHA256."""
    return Keys.of(hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, iterations, KEY_BYTES))


def _with_keys(df: DataFrame, keys: Keys, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    block = keys.nonce.ljust(64, b"\0")
    row = (bytearray(keys.cipher), bytearray(b ^ 0x36 for b in block), bytearray(b ^ 0x5C for b in block))
    table = df.sparkSession.createDataFrame([row], _TABLE)
    return change(df.join(F.broadcast(table))).drop("_cipher", "_inner", "_outer")  # one row


def _hmac(message: Column) -> Column:
    first = F.unhex(F.sha2(F.concat(F.col("_inner"), message), 256))
    return F.unhex(F.sha2(F.concat(F.col("_outer"), first), 256))


def encrypted(df: DataFrame, columns: list[str], keys: Keys) -> DataFrame:
    """df with Base64 ciphertexts in place of the columns' values; null for null."""

    def one(c: str) -> Column:
        plain = F.encode(F.when(F.col(c) == "", F.lit(_EMPTY)).otherwise(F.col(c)), "UTF-8")
        return F.base64(F.aes_encrypt(plain, F.col("_cipher"), F.lit("GCM"), F.lit("DEFAULT"), F.substring(_hmac(plain), 1, 12)))

    return _with_keys(df, keys, lambda rows: rows.withColumns({c: one(c) for c in columns}))


def decrypted(df: DataFrame, columns: list[str], keys: Keys, strict: bool = True) -> DataFrame:
    """df with plaintexts; a changed ciphertext or a wrong key is an error, or null if strict is off."""
    decrypt = F.aes_decrypt if strict else F.try_aes_decrypt

    def one(c: str) -> Column:
        plain = F.decode(decrypt(F.unbase64(F.col(c)), F.col("_cipher"), F.lit("GCM")), "UTF-8")
        return F.when(plain == _EMPTY, "").otherwise(plain)

    return _with_keys(df, keys, lambda rows: rows.withColumns({c: one(c) for c in columns}))


def with_keyed_hashes(df: DataFrame, values: dict[str, Column], keys: Keys) -> DataFrame:
    """df with columns of 64 hexadecimal digits by HMAC-SHA256: without the keys they can't be guessed from values."""
    one = lambda v: F.lower(F.hex(_hmac(F.encode(v, "UTF-8"))))
    return _with_keys(df, keys, lambda rows: rows.withColumns({name: one(v) for name, v in values.items()}))


def _one_value(spark, value: str) -> DataFrame:
    return spark.createDataFrame([(value,)], "value string")


def wrapped(spark, secret: bytes, keys: Keys) -> str:
    """A secret, encrypted by other keys; the driver alone sees either."""
    return encrypted(_one_value(spark, secret.hex()), ["value"], keys).first()[0]


def unwrapped(spark, found: str, keys: Keys) -> bytes | None:
    """The secret, or None if the keys aren't those that wrapped it."""
    value = decrypted(_one_value(spark, found), ["value"], keys, strict=False).first()[0]
    return None if value is None else bytes.fromhex(value)


def canary(spark, keys: Keys) -> str:
    return encrypted(_one_value(spark, CANARY), ["value"], keys).first()[0]


def fits(spark, found: str, keys: Keys) -> bool:
    """Whether the keys open a canary."""
    return decrypted(_one_value(spark, found), ["value"], keys, strict=False).first()[0] == CANARY

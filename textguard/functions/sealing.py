"""AES-256-GCM sealing of values and the key check."""

from __future__ import annotations

import base64
import binascii
import os

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from textguard.functions.binding import bind

KEY_ENV = "TEXTGUARD_KEY"
KEY_BYTES = 32
NONCE_BYTES = 12
TAG_BYTES = 16
REDACTION = "spark.sql.redaction.string.regex"
HEX_KEY = r"(?:0x|0X|X'|x')[0-9a-fA-F]{64}'?"


class KeyConfigError(ValueError):
    """The key is missing or unusable. Never carries key material."""


def check_key(key: str | None) -> bytes:
    """Decode a Base64 key and require exactly 32 bytes."""
    if key is None or not key.strip():
        raise KeyConfigError(f"No encryption key. Set {KEY_ENV} to a Base64 32-byte key.")
    text = key.strip()
    try:
        raw = base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        raise KeyConfigError("The encryption key is not valid Base64.") from None
    if len(raw) != KEY_BYTES:
        raise KeyConfigError("The encryption key must decode to exactly 32 bytes.")
    return raw


def key_problem(key: Column) -> Column:
    """What ``check_key`` would say of a key in a table: ``missing``, ``not Base64``, ``not 32 bytes``; null
    if it can be used. For lists of keys to be rolled out; never write such a table in the clear."""
    text = F.regexp_replace(key, r"^\s+|\s+$", "")
    padded = F.concat(text, F.repeat(F.lit("="), F.pmod(-F.length(text), F.lit(4))))
    raw = F.try_to_binary(padded, F.lit("base64"))
    return (
        F.when(key.isNull() | (text == ""), F.lit("missing"))
        .when(~text.rlike("^[A-Za-z0-9+/]*={0,2}$") | raw.isNull(), F.lit("not Base64"))
        .when(F.octet_length(raw) != KEY_BYTES, F.lit("not 32 bytes"))
    )


def key_from_env() -> str | None:
    return os.environ.get(KEY_ENV)


def hide_keys(spark: SparkSession) -> None:
    """Redact 32-byte hex literals from explain output and the event log, beside what the user
    redacts already."""
    known = spark.conf.get(REDACTION, None) or spark.conf.get("spark.redaction.string.regex", None)
    if not known:
        spark.conf.set(REDACTION, HEX_KEY)
    elif HEX_KEY not in known:
        spark.conf.set(REDACTION, f"(?:{known})|{HEX_KEY}")


def _key(key: str | None) -> Column:
    return F.lit(check_key(key))


def seal(value: Column, key: str | None) -> Column:
    """``nonce(12) || ciphertext || tag(16)`` with a fresh nonce for every value.

    ``value`` must be a column: a literal would be folded and sealed only once.
    A null value is an error.
    """
    plain = F.when(value.isNull(), F.raise_error(F.lit("Cannot seal a null value."))).otherwise(
        value
    )
    return F.aes_encrypt(F.encode(plain, "UTF-8"), _key(key), F.lit("GCM"))


def open_sealed(sealed: Column, key: str | None) -> Column:
    """The sealed text; tampering, a wrong key or malformed bytes fail the task."""
    return F.decode(F.aes_decrypt(sealed, _key(key), F.lit("GCM")), "UTF-8")


def try_open(sealed: Column, key: str | None) -> Column:
    """Like ``open_sealed`` but null where the value cannot be authenticated."""
    return F.decode(F.try_aes_decrypt(sealed, _key(key), F.lit("GCM")), "UTF-8")


def to_base64_pair(sealed: Column) -> Column:
    """``struct<ciphertext_base64, iv_base64>`` on single lines."""

    def line(part: Column) -> Column:
        return F.translate(F.base64(part), "\r\n", "")

    return F.struct(
        line(F.substring(sealed, NONCE_BYTES + 1, 2**31 - 1)).alias("ciphertext_base64"),
        line(F.substring(sealed, 1, NONCE_BYTES)).alias("iv_base64"),
    )


def from_base64_pair(ciphertext: Column, iv: Column) -> Column:
    """Join a Base64 pair into sealed bytes; null if either half is malformed."""
    nonce = F.try_to_binary(iv, F.lit("base64"))
    body = F.try_to_binary(ciphertext, F.lit("base64"))
    return bind(
        nonce, lambda n: F.when(F.octet_length(n) == NONCE_BYTES, F.concat(n, body))
    )

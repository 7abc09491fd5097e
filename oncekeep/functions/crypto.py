"""AES-256-GCM envelopes: base64 of version byte 01, IV, ciphertext and tag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_VERSION = "01"


def encrypt(plain: Column, key: Column) -> Column:
    """Null in, null out. ``key`` is a 32-byte binary column."""
    sealed = F.aes_encrypt(plain, key, F.lit("GCM"))
    return F.base64(F.concat(F.unhex(F.lit(_VERSION)), sealed))


def decrypt_bytes(envelope: Column, key: Column) -> Column:
    """Plain bytes; null where the envelope is damaged, of another version or under another key."""
    data = F.try_to_binary(envelope, F.lit("base64"))
    body = F.when(F.hex(F.substring(data, 1, 1)) == _VERSION, F.substring(data, F.lit(2), F.octet_length(data)))
    return F.try_aes_decrypt(F.when(F.octet_length(body) >= 28, body), key, F.lit("GCM"))


def decrypt(envelope: Column, key: Column) -> Column:
    return decrypt_bytes(envelope, key).cast("string")


def rewrap(wrapped: Column, old_key: Column, new_key: Column) -> Column:
    """Move a data key from one wrapping key to another; the payloads stay as they are."""
    return encrypt(decrypt_bytes(wrapped, old_key), new_key)

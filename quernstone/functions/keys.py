"""Partition names, ids, signatures and sealed keys."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def kb_part(kb_id: Column) -> Column:
    """The first 12 hexadecimal digits of the SHA-256 of a knowledge base's id."""
    return F.substring(F.sha2(kb_id, 256), 1, 12)


def short_id(*parts: Column) -> Column:
    """A repeatable id from its parts."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 12)


@lru_cache(1024)
def _begun(secret: str):
    """SHA-256 begun with what HMAC puts before the text and before its digest; a secret's are made once in a process."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return hashlib.sha256(bytes(c ^ 0x36 for c in key)), hashlib.sha256(bytes(c ^ 0x5C for c in key))


def signature(secret: str, payload: str) -> str:
    """HMAC-SHA256 of a payload as `sha256=<hex>`."""
    inner, outer = _begun(secret)
    inner, outer = inner.copy(), outer.copy()
    inner.update(payload.encode())
    outer.update(inner.digest())
    return "sha256=" + outer.hexdigest()


def sign(secret: str):
    """The same for a column."""

    @F.pandas_udf("string")
    def run(payload: pd.Series) -> pd.Series:
        return payload.map(lambda p: None if p is None else signature(secret, p))

    return run


def seal(text: Column, key: Column) -> Column:
    return F.aes_encrypt(text, key, F.lit("GCM"))


def unseal(data: Column, key: Column) -> Column:
    return F.aes_decrypt(data, key, F.lit("GCM")).cast("string")

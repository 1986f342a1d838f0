"""Salted hashes and keyed pseudonyms as native column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK_BYTES = 64


def hmac_pads(key: str) -> tuple[bytes, bytes]:
    """Inner and outer pad of an HMAC-SHA256 key (RFC 2104), computed on the driver."""
    raw = key.encode("utf-8")
    if len(raw) > _BLOCK_BYTES:
        raw = hashlib.sha256(raw).digest()
    block = raw.ljust(_BLOCK_BYTES, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def hmac_hex(inner_pad: Column, outer_pad: Column, message: Column) -> Column:
    """Lower-case hex HMAC-SHA256 of a text column.

    The pads are columns, never literals: a literal would show the key in the
    query plan and in the event log.
    """
    inner = F.unhex(F.sha2(F.concat(inner_pad, message.cast("binary")), 256))
    return F.sha2(F.concat(outer_pad, inner), 256)


def salted_hash(text: Column, salt: Column) -> Column:
    """Lower-case hex SHA-256 of ``text|salt``; NULL when the text is NULL."""
    return F.sha2(F.concat(text, F.lit("|"), salt), 256)

"""Hashes, content-derived identifiers and page cursors as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_ref(c: Column) -> Column:
    """'sha256:' and the hex digest."""
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def canonical_json(c: Column) -> Column:
    """JSON text with sorted keys; null where it isn't JSON. Numbers that are equal may become
    the same text (1.0 and 1)."""
    return F.to_json(F.try_parse_json(c))


def uuid3(*parts: Column, sep: str = "|") -> Column:
    """Name-based UUID (version 3, no namespace) of the joined parts."""
    h = F.md5(F.concat_ws(sep, *parts).cast("binary"))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def encode_cursor(c: Column) -> Column:
    """base64url without padding."""
    return F.translate(F.regexp_replace(F.base64(c.cast("binary")), "\\s", ""), "+/=", "-_")


def decode_cursor(cursor: str) -> str:
    import base64

    try:
        return base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode()
    except ValueError as e:
        raise ValueError("cursor isn't base64url text") from e


def match_key(c: Column) -> Column:
    """Lower case without outer white space; blank becomes null."""
    t = F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(t != "", t)

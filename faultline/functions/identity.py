"""Deterministic identifiers from column values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.time import _col, iso_utc

# Fixed value: the DNS namespace of RFC 4122, as hex.
DNS_NAMESPACE_HEX = "6ba7b8109dad11d180b400c04fd430c8"


def incident_id(service: Column | str, seq: Column | str, separator: str = "|") -> Column:
    """Upper-case hex SHA-256 of service and session number; NULL when either is.

    The separator keeps ``svc-1`` + ``11`` apart from ``svc-11`` + ``1``. Pass
    ``separator=""`` for the plain concatenation.
    """
    text = F.concat(_col(service), F.lit(separator), _col(seq).cast("string"))
    return F.upper(F.sha2(text, 256))


def stable_incident_id(service: Column | str, start_minute_at: Column | str) -> Column:
    """Id that does not move when earlier signals arrive late: service and start minute."""
    start = iso_utc(F.date_trunc("minute", _col(start_minute_at)))
    return F.upper(F.sha2(F.concat(_col(service), F.lit("@"), start), 256))


def bucket10(hex_id: Column | str) -> Column:
    """Bucket 0-9 from the first 32 bits of a hex id."""
    head = F.conv(F.substring(_col(hex_id), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(10)).cast("int")


def uuid5(name: Column | str, namespace_hex: str = DNS_NAMESPACE_HEX) -> Column:
    """Version-5 UUID of a name, in columns only."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(_col(name), "UTF-8")))
    # The variant digit keeps its two low bits and gets the high bits 10.
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(nibble.bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )

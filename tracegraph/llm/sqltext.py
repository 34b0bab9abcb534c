"""Pieces of checking SQL that DuckDB has no function for."""

from __future__ import annotations


def crc32_sql(octets: str) -> str:
    """Unsigned CRC-32 of a list of byte values."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(f"{value}::UBIGINT")
    step = f"xor([{', '.join(table)}][(xor(c, b) & 255)::BIGINT + 1], c >> 8)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {octets}), lambda c, b: {step}), 4294967295::UBIGINT)::BIGINT"


def octets_sql(text: str) -> str:
    """The bytes of a text in UTF-8 as a list of numbers."""
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::UBIGINT)"

"""CRC-32 as DuckDB spells it (Spark has it built in)."""

from __future__ import annotations


def _table() -> list[int]:
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a SQL string expression's UTF-8 bytes."""
    codes = (f"list_transform(range(0, CAST(octet_length(encode({text})) AS BIGINT)), "
             f"lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))")
    step = f"xor(c >> 8, {_table()}[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {step}), CAST(4294967295 AS BIGINT))"

"""CRC-32 as DuckDB SQL, which has no such function: a byte at a time over a table made by its rule."""

from __future__ import annotations


def _table() -> list[int]:
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of the UTF-8 bytes of an SQL expression that is a string and not null."""
    byte = f"('0x' || substr(hex(encode({text})), (2 * i - 1)::BIGINT, 2))::BIGINT"
    bytes_ = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: {byte})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: xor(c >> 8, ({_table()}::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295)"

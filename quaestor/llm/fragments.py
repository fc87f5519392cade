"""DuckDB expressions that several operators' SQL needs and DuckDB lacks."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a VARCHAR expression."""
    digits = f"hex(encode({text}))"
    data = f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || substr({digits}, 2 * i + 1, 2))::BIGINT)"
    step = "list_reduce(list_prepend(xor(c, b), range(8)), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: {step}), 4294967295)"


def lower_ascii(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

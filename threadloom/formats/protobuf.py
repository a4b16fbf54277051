"""The wire format of protocol buffers, read as far as it makes sense."""

from __future__ import annotations

from collections.abc import Iterable

Fields = list[tuple[int, int | bytes]]


def _varint(data: bytes, i: int) -> tuple[int, int] | None:
    value = shift = 0
    while i < len(data) and shift < 64:
        value |= (data[i] & 127) << shift
        i += 1
        if data[i - 1] < 128:
            return value & ((1 << 64) - 1), i
        shift += 7
    return None


def fields(data: bytes) -> Fields:
    """(number, value); what follows a broken place is left out."""
    out: Fields = []
    i = 0
    while i < len(data):
        head = _varint(data, i)
        if head is None or not 0 < head[0] >> 3 < 1 << 32:
            break
        kind, i = head[0] & 7, head[1]
        if kind in (0, 2):
            got = _varint(data, i)
            if got is None or kind == 2 and got[1] + got[0] > len(data):
                break
            value, i = (got[0], got[1]) if kind == 0 else (data[got[1] : got[1] + got[0]], got[1] + got[0])
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            if i + size > len(data):
                break
            value, i = None, i + size  # fixed numbers carry nothing here
        else:
            break
        if value is not None:
            out.append((head[0] >> 3, value))
    return out


def subs(message: Fields, number: int) -> list[bytes]:
    return [v for n, v in message if n == number and isinstance(v, bytes)]


def sub(message: Fields, *path: int) -> bytes | None:
    """The first part at a path of numbers."""
    found = subs(message, path[0])
    if not found:
        return None
    return found[0] if len(path) == 1 else sub(fields(found[0]), *path[1:])


def inner(message: Fields, *path: int) -> Fields:
    return fields(sub(message, *path) or b"")


def string(message: Fields, *path: int) -> str | None:
    raw = sub(message, *path)
    try:
        return None if raw is None else raw.decode()
    except UnicodeDecodeError:
        return None


def number(message: Fields, n: int) -> int | None:
    return next((v for k, v in message if k == n and isinstance(v, int)), None)


def encode_varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def encode(parts: Iterable[tuple[int, int | str | bytes | None]]) -> bytes:
    """A message of numbers, texts and messages; None and empty texts are left
    out."""
    out = bytearray()
    for n, value in parts:
        if value is None or value == "":
            continue
        if isinstance(value, int):
            out += encode_varint(n << 3) + encode_varint(value)
        else:
            raw = value.encode() if isinstance(value, str) else value
            out += encode_varint(n << 3 | 2) + encode_varint(len(raw)) + raw
    return bytes(out)

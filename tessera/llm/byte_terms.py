"""Terms of a text as runs of bytes.

Every byte from 0x80 belongs to a code point beyond ASCII, so a class of characters that holds all of these is a class of
bytes: a translation that blanks the other bytes and lower-cases A-Z, then a split, finds the maximal runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

LETTERS = b"abcdefghijklmnopqrstuvwxyz"


def translation(others: bytes = b"") -> bytes:
    """A table for bytes.translate that keeps letters, bytes from 0x80 and ``others`` and blanks the rest."""
    kept = {*LETTERS, *others, *range(0x80, 0x100)}
    return bytes(b if b in kept else ord(" ") for b in bytes(range(0x100)).lower())


def texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text of a string column; a null is empty."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""

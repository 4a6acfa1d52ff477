"""Words of ASCII letters, ASCII digits and all characters beyond ASCII, A-Z lower-cased, as bytes."""

from __future__ import annotations

_fold = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(data: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text in order; of null as of the empty text."""
    return data.translate(_fold).split() if data else []

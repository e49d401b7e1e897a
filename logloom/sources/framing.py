"""Byte framing of stream sources: lines, octet counts, or whichever of the two the bytes look like."""

from __future__ import annotations

MOST_DIGITS = 10
MOST_BYTES = 10_000_000


class FramingError(ValueError):
    pass


class Framer:
    """Bytes in, whole messages out; what is not complete stays until more comes.

    ``line``: up to a newline, trailing CR, space and tab cut. ``len``: "<count> <payload>". ``auto``: a count if the
    bytes begin with one, else a line; a count that has begun is waited for.
    """

    def __init__(self, mode: str = "auto", most: int = MOST_BYTES):
        if mode not in ("auto", "line", "len"):
            raise FramingError(f"unknown framing {mode}")
        self.mode, self.most, self.held = mode, most, bytearray()

    def feed(self, data: bytes) -> list[bytes]:
        self.held += data
        out = []
        while (m := self._next()) is not None:
            out.append(m)
        if len(self.held) > self.most + MOST_DIGITS + 1:
            raise FramingError("a message is longer than allowed")
        return [m for m in out if m]

    def close(self) -> list[bytes]:
        """The last line without a newline."""
        rest, self.held = bytes(self.held).rstrip(b"\r\n \t"), bytearray()
        return [rest] if rest and self.mode != "len" else []

    def _next(self) -> bytes | None:
        if self.mode in ("len", "auto"):
            digits = 0
            while digits < len(self.held) and 48 <= self.held[digits] <= 57:
                digits += 1
            if digits and digits <= MOST_DIGITS:
                if digits == len(self.held):
                    return None
                if self.held[digits] == 32:
                    size = int(self.held[:digits])
                    if size >= self.most:
                        raise FramingError(f"a message of {size} bytes is longer than allowed")
                    if len(self.held) < digits + 1 + size:
                        return None
                    out = bytes(self.held[digits + 1 : digits + 1 + size])
                    del self.held[: digits + 1 + size]
                    return out
            if self.mode == "len":
                if self.held and (not digits or digits > MOST_DIGITS or len(self.held) > digits):
                    raise FramingError("a length is expected")
                return None
        end = self.held.find(b"\n")
        if end < 0:
            return None
        out = bytes(self.held[:end]).rstrip(b"\r \t")
        del self.held[: end + 1]
        return out

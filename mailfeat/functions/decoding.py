"""Permissive decoding: whatever a message claims about its bytes, the result is a text and a reason, never an error."""

from __future__ import annotations


def permissive(octets: bytes, charset: str) -> tuple[str | None, str | None]:
    """The text in that charset, undecodable bytes left out; or None and the name of what went wrong.

    A charset may be unknown, no text encoding at all, or one whose decoder
    raises in spite of errors="ignore"; anything it raises counts as a reason.
    """
    try:
        return storable(octets.decode(charset, "ignore")), None
    except Exception as e:  # noqa: BLE001 - codecs raise what they like
        return None, type(e).__name__


def storable(text: str) -> str:
    """Without lone surrogates, which some codecs give and no column can hold."""
    return text.encode("utf-8", "ignore").decode("utf-8")

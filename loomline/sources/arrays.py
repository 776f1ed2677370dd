"""JSON documents of any size, an entry of a list at a time."""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator

from loomline.sources import files

_BLANK = re.compile(r"[ \t\n\r]*")
#: What is found, or missed, this near to the end of what has been read may be so for want of more: literals and escapes are shorter.
_NEAR = 16


class Reader:
    """The values of a JSON file in their order; text goes once its values are told."""

    def __init__(self, uri: str, step: int = 1 << 20) -> None:
        self._parts = codecs.iterdecode(files.read_from(uri, 0, step), "utf-8")
        self._text, self._at, self._decode = "", 0, json.JSONDecoder().raw_decode

    def _more(self, least: int = 1) -> bool:
        parts, n = [self._text[self._at :]], 0
        for part in self._parts:
            parts.append(part)
            n += len(part)
            if n >= least:
                break
        if n:
            self._text, self._at = "".join(parts), 0
        return n > 0

    def peek(self) -> str:
        """The next character that isn't blank; none at the end."""
        while True:
            self._at = _BLANK.match(self._text, self._at).end()
            if self._at < len(self._text):
                return self._text[self._at]
            if not self._more():
                return ""

    def take(self, wanted: str) -> str:
        """The next character, which must be one of some."""
        found = self.peek()
        if not found or found not in wanted:
            raise ValueError(f"{found!r} stands where one of {wanted} should")
        self._at += 1
        return found

    def value(self):
        """The next value."""
        self.peek()
        while True:
            try:
                found, end = self._decode(self._text, self._at)
            except json.JSONDecodeError as e:
                broken = e.pos < len(self._text) - _NEAR and not e.msg.startswith("Unterminated string")
                if broken or not self._more(len(self._text) - self._at):  # as much again, so long values aren't begun too often
                    raise
                continue
            if end < len(self._text) - _NEAR or not self._more():  # a number near the end may go on
                self._at = end
                return found

    def items(self, close: str) -> Iterator[None]:
        """Once for each item up to a closing bracket; whoever asks takes the item."""
        if self.peek() == close:
            self.take(close)
            return
        while True:
            yield
            if self.take("," + close) == close:
                return


def entries(uri: str, key: str, step: int = 1 << 20) -> Iterator[tuple[int, object]]:
    """(n, entry) of the lists of a JSON document: of the document itself, or of what it has under a key.

    Where the key is repeated, the lists are numbered, and the last one counts,
    as it does to json.loads().  (n, None) comes before the entries of each, and
    alone where it is no list.  A malformed document raises ValueError, maybe
    after some of its entries.
    """
    text, n = Reader(uri, step), 0
    if text.take("[{") == "[":
        yield n, None
        for _ in text.items("]"):
            yield n, text.value()
    else:
        for _ in text.items("}"):
            name = text.value()
            if not isinstance(name, str):
                raise ValueError(f"{name!r} is no key")
            text.take(":")
            if name == key:
                n += 1
                yield n, None
            if name == key and text.peek() == "[":
                text.take("[")
                for _ in text.items("]"):
                    yield n, text.value()
            else:
                text.value()
    if text.peek():
        raise ValueError("the document goes on after its end")

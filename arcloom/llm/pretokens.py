"""Pre-token caches for the tokenizer operators.

A byte-pair tokenizer treats each pre-token by itself, and few distinct
pre-tokens make up most of a text, so a worker keeps the ids of the pre-tokens
it has met.  A cache is emptied when it reaches its bound, and holds no long pre-token:
a text without spaces is one.
"""

from __future__ import annotations

import re

#: All but the characters on which the tokenizers' own pattern library and Python's agree
#: about letters, digits and white space; a text with others takes the library's path.
_STRANGE = re.compile(r"[^\t\n\x0b\x0c\r\x20-\x7e\xa1-ſ‐-‧‰-⁞]")


#: a pre-token of more characters is seldom met again; entries up to it bound a cache in bytes too
LONGEST = 128


class Cache(dict):
    """pre-token -> value, made on a miss; emptied beyond ``bound`` entries, of LONGEST characters at most."""

    def __init__(self, make, bound: int):
        super().__init__()
        self.make, self.bound = make, bound

    def __missing__(self, key):
        if len(key) > LONGEST:
            return self.make(key)
        if len(self) >= self.bound:
            self.clear()
        value = self[key] = self.make(key)
        return value


def plain(text: str) -> bool:
    return _STRANGE.search(text) is None


def words_after_spaces(text: str) -> list[str] | None:
    """The text split at its spaces, if each stands alone between two other
    characters than white space (or first); None for all other texts."""
    if "  " in text or " \n" in text or "\n " in text or text[-1:] == " ":
        return None
    if "\t" in text or "\r" in text or "\x0b" in text or "\x0c" in text:
        return None
    return text.split(" ")


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte:
    printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}

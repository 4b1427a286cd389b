"""Token ids of whole texts by a public byte-level BPE vocabulary, with a cache of pre-tokens."""

from __future__ import annotations

import re
import sys
from array import array
from functools import cache

#: Characters for which the pattern below splits exactly as the vocabulary's own one does: all others (rare scripts,
#: other white space, other digits) send the whole text through the tokenizer itself.
UNCOMMON = re.compile("[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧‰-⁞€]")
#: The vocabulary's splitting rule for the characters that are left.
SPLIT = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Words and other pre-tokens kept in a worker's memory (about 200 MB together); a full cache starts anew.
WORDS, PARTS = 1_000_000, 100_000
#: A longer one isn't kept.
LONG = 64


def uneven(text: str) -> bool:
    """Whether white space is other than single spaces between words and single line ends between lines."""
    return text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or "\t" in text or "\r" in text


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def specials(path: str) -> re.Pattern | None:
    found = [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]
    return re.compile("|".join(map(re.escape, found))) if found else None


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit integers; equal to the tokenizer's own, checked by the tests.

    The vocabulary splits before every space that a word follows, and around every single line end. So where white
    space is even, a text's ids are those of its words, each with the space or line end before it, and these repeat
    and are remembered. Other texts are split by SPLIT into pre-tokens, which are remembered too."""

    def __init__(self, path: str):
        self.path, self.words, self.parts = path, {}, {}
        self.encode = tokenizer(path).encode

    def __call__(self, text: str) -> bytes:
        special = specials(self.path)
        if not text or UNCOMMON.search(text) or special is not None and special.search(text):
            return self.whole(text)
        if uneven(text):
            return self.split(text)
        words, get = self.words, self.words.get
        first, *rest = text.replace("\n", " \n").split(" ")
        found = list(map(get, rest))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    w = rest[i]
                    x = get(w)
                    if x is None:
                        x = self.word(w)
                        if len(w) <= LONG:
                            if len(words) >= WORDS:
                                words.clear()
                            words[w] = x
                    found[i] = x
        return self.split(first) + b"".join(found)

    def word(self, w: str) -> bytes:
        """Ids of a word and the space before it, or of a line end and the word after it."""
        if w.isalpha():
            return self.whole(" " + w)
        if w[-1] in ".,;:!?" and w[:-1].isalpha():
            return self.part(" " + w[:-1]) + self.part(w[-1])
        if w[0] == "\n":
            return self.part("\n") + self.part(w[1:]) if w[1:].isalpha() else self.split(w)
        return self.split(" " + w)

    def split(self, text: str) -> bytes:
        return b"".join(map(self.part, SPLIT.findall(text)))

    def part(self, p: str) -> bytes:
        """Ids of a pre-token; one of a space and letters is kept with the words."""
        known, key, most = (self.words, p[1:], WORDS) if p[0] == " " and p[1:].isalpha() else (self.parts, p, PARTS)
        x = known.get(key)
        if x is None:
            x = self.whole(p)
            if len(p) <= LONG:
                if len(known) >= most:
                    known.clear()
                known[key] = x
        return x

    def whole(self, text: str) -> bytes:
        ids = array("I", self.encode(text, add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


@cache
def encoder(path: str) -> Encoder:
    """One encoder a worker process; the cache lives as long as the worker."""
    return Encoder(path)

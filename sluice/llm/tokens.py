"""Token ids of whole texts by the tokenizers library, each distinct word encoded once a worker.

A pre-tokenised word's ids depend on that word only, so they can be kept: split a text where the tokenizer's own
rules always split it (white space), look each piece up, and let the library's model encode the pieces not seen
yet. Texts outside the simple range of characters, and those with special strings, go to the library whole.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array

import public_tokenizers
import regex

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"

#: Characters below U+0250 that are stable under NFC, but for controls and a capital whose lower case is two characters.
_SIMPLE = re.compile("[\t\n\r\x20-\x7e\xa0-įı-ɏ]*")
#: How byte-level pre-tokenizers break a text; fixed by the vocabulary files' "ByteLevel" rule.
_BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Pieces that no word of that rule crosses; where white space stands alone, a split at each space or line end gives them.
_PIECES = re.compile(r" ?[^\t\n\r\x20\xa0]+|[\t\n\r\x20\xa0]+(?![^\t\n\r\x20\xa0])|[\t\n\r\x20\xa0]+")
#: Characters of a long text that are encoded at once, and where it may be cut.
PART, _BETWEEN = 1 << 20, re.compile(r"(?<=\S) (?=\S)")
_UNEVEN = ("\t", "\r", "\xa0", "  ", " \n", "\n ", "\n\n")


def byte_characters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(plain))}}


class MemoEncoder:
    """ids(text): little-endian unsigned 16-bit ids, as Tokenizer.encode(text, add_special_tokens=False) gives them."""

    def __init__(self, path: str, keep: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        rules = json.load(open(path, encoding="utf-8"))
        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.model, self.keep, self.memo = self.library.model, keep, {}
        self.special = [x["content"] for x in rules["added_tokens"]]
        self.alphabet = byte_characters()
        self.space = self.alphabet[32]
        self.words = rules["model"].get("end_of_word_suffix") == "</w>"
        if self.words:
            self.rule = regex.compile(rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        else:
            self.rule = _BYTE_LEVEL

    def _word(self, word: str) -> bytes:
        written = word.replace(" ", self.space) if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.alphabet)
        return array("H", [t.id for t in self.model.tokenize(written)]).tobytes()

    def _encode(self, piece: str) -> bytes:
        bare = piece[1:] if piece[:1] == " " else piece
        if bare.isalpha():
            return self._word(piece)
        if bare[-1:] in (",", ".") and bare[:-1].isalpha():
            return self._known(piece[:-1]) + self._known(bare[-1])
        return b"".join([self._word(x) for x in self.rule.findall(piece)])

    def _known(self, piece: str) -> bytes:
        if piece not in self.memo:
            self.memo[piece] = self._encode(piece)
        return self.memo[piece]

    def _pieces(self, text: str) -> list[str]:
        if self.words:
            return text.lower().split()
        if text[:1] in " \n" or text[-1:] in " \n" or any(x in text for x in _UNEVEN):
            return _PIECES.findall(text)
        # one line end or one space between words: the space goes with the word after it
        return text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00")

    def ids(self, text: str, part: int = PART) -> bytes:
        if len(text) <= part:
            return self._ids(text)
        # a single space between words always begins a new one, so ids of the texts on either side follow one another
        out, at = [], 0
        while at < len(text):
            cut = _BETWEEN.search(text, at + part)
            out.append(self._ids(text[at : cut.start() if cut else len(text)]))
            at = cut.start() if cut else len(text)
        return b"".join(out)

    def _ids(self, text: str) -> bytes:
        if not _SIMPLE.fullmatch(text) or any(x in text for x in self.special):
            return array("H", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        pieces, memo = self._pieces(text), self.memo
        try:
            return b"".join([memo[x] for x in pieces])
        except KeyError:
            pass
        if len(memo) > self.keep:
            memo.clear()
        return b"".join([memo[x] if x in memo else self._known(x) for x in pieces])


@functools.cache
def encoder(name: str) -> MemoEncoder:
    """One encoder a worker process and vocabulary."""
    return MemoEncoder(public_tokenizers.path(name) if "/" not in name else name)

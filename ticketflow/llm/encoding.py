"""Token ids of whole texts, with pre-tokens remembered by a Python worker.

A byte-level tokenizer splits a text into pre-tokens and merges inside each one
alone, so a text's ids are its pre-tokens' ids in order. Pre-tokens repeat; a
worker asks the tokenizer's model once for each and keeps its ids.
"""

from __future__ import annotations

import json
import re
from array import array

REMEMBERED = 500_000  # pre-tokens, and words, a worker remembers the ids of
SLICE = 1 << 18       # characters split at once

_LETTER = "A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u024f"
# Texts of these characters only are split here: on them the byte-level pattern's classes are the ranges below.
_PLAIN = re.compile(rf"[ \n!-~{_LETTER}]*\Z")
# The byte-level pre-tokenizer's pattern, its classes written out for plain texts.
_PRE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^ \n0-9{_LETTER}]+|[ \n]+(?![^ \n])|[ \n]+")
# A space with a character that isn't white space on either side begins a pre-token in any text.
_START = re.compile(r"(?<=\S) (?=\S)")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself
    where it is visible in Latin-1, else the next free code point from 256."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(free)) for b in range(256)]


class _PreTokens(dict):
    """pre-token -> its ids as bytes of unsigned 32-bit numbers; asks the model for new ones."""

    def __init__(self, model):
        super().__init__()
        self.ask, self.letters = model.tokenize, dict(enumerate(_byte_letters()))

    def __missing__(self, pre: str) -> bytes:
        tokens = self.ask(pre.encode().decode("latin-1").translate(self.letters))
        ids = self[pre] = array("I", [t.id for t in tokens]).tobytes()
        return ids


class _Words(dict):
    """word -> ids of a space and the word, where that space begins a pre-token."""

    def __init__(self, pre: _PreTokens):
        super().__init__()
        self.pre = pre

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = b"".join(map(self.pre.__getitem__, _PRE.findall(" " + word)))
        return ids


class TextEncoder:
    """Ids of whole texts as the tokenizer file gives them, without begin, end
    or other added special tokens; special strings in a text as its default."""

    def __init__(self, file: bytes):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_buffer(file)
        spec = json.loads(file)
        pre = spec.get("pre_tokenizer") or {}
        if (spec.get("normalizer") is not None or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)
                or spec["model"]["type"] != "BPE" or spec["model"].get("dropout")):
            raise ValueError("only byte-level BPE tokenizers without normalizer or dropout are encoded by pre-tokens")
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        # texts may be cut at a space between words only where no added token can reach over it
        self.cuts = not any(re.search(r"\s", t.content) or t.lstrip or t.rstrip or t.single_word or t.normalized for t in added)
        self.pre = _PreTokens(self.tokenizer.model)
        self.words = _Words(self.pre)

    def _slices(self, text: str):
        at = 0
        while self.cuts and len(text) - at > SLICE:
            cut = _START.search(text, at + SLICE)
            if cut is None:
                break
            yield text[at:cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def _plain(self, part: str) -> bytes:
        """Ids of a plain text without added tokens."""
        if part[:1] == " " or part[-1:] == " " or "  " in part or " \n" in part or "\n " in part:
            return b"".join(map(self.pre.__getitem__, _PRE.findall(part)))
        first, *words = part.split(" ")  # each space begins a pre-token
        return b"".join([*map(self.pre.__getitem__, _PRE.findall(first)), *map(self.words.__getitem__, words)])

    def encode(self, text: str) -> bytes:
        """The ids of a text, as unsigned 32-bit numbers."""
        out = []
        for part in self._slices(text):
            if _PLAIN.match(part) and not any(a in part for a in self.added):
                out.append(self._plain(part))
                for known in (self.pre, self.words):
                    if len(known) > REMEMBERED:
                        known.clear()
            else:
                out.append(array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes())
        return out[0] if len(out) == 1 else b"".join(out)

    def count(self, text: str) -> int:
        return len(self.encode(text)) // 4


_MADE: dict = {}  # in a Python worker: the encoder of the broadcast used last


def encoder(file) -> TextEncoder:
    """The worker's encoder of a broadcast tokenizer file."""
    key = getattr(file, "_path", None) or id(file)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = TextEncoder(file.value)
    return _MADE[key]

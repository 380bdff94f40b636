"""Places where a text may be cut without changing its byte-level BPE ids.

A match of the split pattern never goes on from a character that is not white space into white
space, nor from a letter or digit into ASCII punctuation. Chunks cut there and encoded one by one
have the ids of the whole text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np

#: White space as the split pattern's ``\s`` sees it (Unicode White_Space); fixed values.
SPACES = (
    "\t\n\x0b\x0c\r \x85\xa0            "
    "    　"
)
#: Letters and digits after which ASCII punctuation is a safe place to cut.
_WORD = "A-Za-z0-9À-ÖØ-öø-ɏ"
_MARKS = r"!-&(-/:-@\[-`{-~"
_CHUNK = re.compile(rf"[{SPACES}]*+(?:[{_WORD}]++(?:(?=[{_MARKS}])|[^{SPACES}]*+)|[^{SPACES}]++)|[{SPACES}]++")
_RUN = re.compile(rf"[{SPACES}]+")
_EDGES = frozenset(SPACES)
#: A run of white space longer than this is handed over as one match, without the pattern.
LONG_RUN = 1_000
#: Characters of a piece of a long text; a piece ends at the first safe place after them.
PIECE = 100_000
#: A longer run has ten of every hundredth characters in a row.
_STEP = LONG_RUN // 10
_SAMPLED_RUN = re.compile(rf"[{SPACES}]{{10}}")
#: Chunks longer than this many characters are encoded but not remembered.
LONG_CHUNK = 64


def cut_runs(text: str) -> Iterator[tuple[str, bool]]:
    """The text in order as (part, whether the part is a long run of white space and one match).

    The pattern takes a run of white space up to its last character, which it keeps for what
    follows, and all of a run that ends the text.
    """
    at = 0
    for run in _RUN.finditer(text):
        if run.end() - run.start() > LONG_RUN:
            stop = run.end() if run.end() == len(text) else run.end() - 1
            yield text[at : run.start()], False
            yield text[run.start() : stop], True
            at = stop
    yield text[at:], False


def has_long_run(text: str) -> bool:
    """False only if no run of white space is longer than ``LONG_RUN``; looks at few characters."""
    return _SAMPLED_RUN.search(text[::_STEP]) is not None


def pieces(text: str, size: int = PIECE) -> Iterator[tuple[str, bool]]:
    """Like ``cut_runs``, with other parts cut before white space once they reach ``size``.

    A stretch without white space stays whole.
    """
    for part, one_match in cut_runs(text) if has_long_run(text) else ((text, False),):
        at = 0
        while not one_match and len(part) - at > size:
            run = _RUN.search(part, at + size)
            # Only the start of a run is safe; one that began before is passed over.
            while run and part[run.start() - 1] in _EDGES:
                run = _RUN.search(part, run.end())
            if run is None:
                break
            yield part[at : run.start()], False
            at = run.start()
        yield part[at:], one_match


class _Memory(dict):
    """A bounded memory of two generations; what is asked for again moves to the younger one."""

    def __init__(self, make: Callable[[str], tuple[bytes, bool]], most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value, keep = self.old.get(key), True
        if value is None:
            value, keep = self.make(key)
        if keep:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class ChunkEncoder:
    """Encodes texts to little-endian 32-bit ids, and each frequent chunk once.

    ``encode`` gives the ids of a text under the split pattern, ``encode_match`` those of one match
    of it. ``most`` bounds the chunks remembered, which changes the time only. A null text is the
    empty text and has no ids.
    """

    def __init__(
        self,
        encode: Callable[[str], list[int]],
        encode_match: Callable[[str], list[int]],
        most: int = 500_000,
    ):
        self._encode, self._encode_match = encode, encode_match
        self._chunks = _Memory(self._fresh, most)

    def _fresh(self, chunk: str) -> tuple[bytes, bool]:
        if len(chunk) <= LONG_CHUNK:
            return array("I", self._encode(chunk)).tobytes(), True
        ids = array("I")
        for part, one_match in cut_runs(chunk):
            if part:
                ids.extend(self._encode_match(part) if one_match else self._encode(part))
        return ids.tobytes(), False

    def packed(self, text: str | None) -> bytes:
        """The ids of a whole text, four bytes each."""
        return b"".join(map(self._chunks.__getitem__, _CHUNK.findall(text or "")))

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.packed(text), "<u4")

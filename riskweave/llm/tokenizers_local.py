"""Tokenizers read from local files, one per Python worker."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import tiktoken

from riskweave.llm.chunks import ChunkEncoder, pieces

#: Letters only, after one space at most: one match of the split pattern.
_ONE_WORD = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
#: Bytes that stand for themselves, and spaces.
_PLAIN = re.compile("[ -~]*")
#: A split pattern that leaves a text whole.
ONE_MATCH = r"(?s:.)+"


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


@lru_cache(maxsize=4)
def rank_encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """A tiktoken encoding from a local rank file, without special tokens."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def rank_ids(text: str | None, path: str, pattern: str) -> list[int]:
    """The ids of a whole text; long texts are encoded piece by piece. ``pattern`` must be one that
    the cuts of ``chunks`` are safe for. A null text has no ids."""
    ids: list[int] = []
    encoding = rank_encoding(path, pattern)
    for part, one_match in pieces(text or ""):
        if one_match:
            ids += rank_encoding(path, ONE_MATCH).encode_ordinary(part)
        else:
            ids += encoding.encode_ordinary(part)
    return ids


@lru_cache(maxsize=4)
def json_encoder(path: str) -> ChunkEncoder:
    """Chunked encoder over a byte-level BPE file of the tokenizers library.

    Strings of special tokens in a text are ordinary text.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    model, letters, plain = tokenizer.model, _byte_letters(), _PLAIN.fullmatch

    def encode_match(text: str) -> list[int]:
        if plain(text):
            stand_in = text.replace(" ", letters[32])
        else:
            stand_in = text.encode("utf-8", "replace").decode("latin-1").translate(letters)
        return [token.id for token in model.tokenize(stand_in)]

    def encode(text: str) -> list[int]:
        if _ONE_WORD.fullmatch(text):
            return encode_match(text)
        return tokenizer.encode(text, add_special_tokens=False).ids

    return ChunkEncoder(encode, encode_match)


@lru_cache(maxsize=4)
def json_vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)

"""Public tokenizers inside tasks, and places where a text may be cut without changing its tokens."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

PIECE_BYTES = 4096  # longer texts are cut at the first safe place after so many bytes


def vocabulary(name: str) -> str:
    """The file of a public vocabulary; on a cluster the package with the files is installed on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def piece_model(path: str):
    """A sentencepiece processor, one per worker process."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def byte_model(path: str):
    """A byte-level BPE of ranks, one per worker process."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# A single space between two letters or digits of ASCII. A piece model starts a new piece there, and
# gives a cut-off part the same leading mark that the space would have been.
_PIECE_CUT = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])", re.ASCII)
# The byte model's own pre-split puts the space in front of the word that follows.
_BYTE_CUT = re.compile(r"(?<=[A-Za-z0-9])(?= [A-Za-z0-9])", re.ASCII)


def cut(text: str, pattern: re.Pattern, size: int = PIECE_BYTES) -> list[str]:
    """The parts of ``text``, each at least ``size`` characters up to the next safe place; one part if there is none."""
    if len(text) <= 2 * size:
        return [text]
    parts, at = [], 0
    while len(text) - at > 2 * size:
        found = pattern.search(text, at + size)
        if found is None:
            break
        parts.append(text[at : found.start()])
        at = found.end()
    parts.append(text[at:])
    return parts


def piece_parts(text: str) -> list[str]:
    """Parts of a text whose token lists, joined, are those of the whole text under a piece model."""
    return cut(text, _PIECE_CUT)


def byte_parts(text: str) -> list[str]:
    """The same for a byte-level model."""
    return cut(text, _BYTE_CUT)

"""Public tokenizers by file; their folder is a parameter and nothing of them is kept in this repository."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

#: Folder of the vocabulary files; PAPERLOOM_TOKENIZERS overrides it.
FOLDER = os.environ.get("PAPERLOOM_TOKENIZERS", "/opt/tokenizers")
DEFAULT = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokenization of the byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def byte_encoding(name: str = DEFAULT, folder: str = FOLDER):  # noqa: ANN201
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str, name: str = DEFAULT, folder: str = FOLDER) -> int:
    return len(byte_encoding(name, folder).encode_ordinary(text))


def starts(text: str, name: str = DEFAULT, folder: str = FOLDER) -> list[int]:
    """The character in which each token starts."""
    enc = byte_encoding(name, folder)
    return enc.decode_with_offsets(enc.encode_ordinary(text))[1]

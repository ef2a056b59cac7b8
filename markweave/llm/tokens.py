"""Token ids of the public byte-level BPE vocabulary, inside tasks.

The rank file holds the same vocabulary as the tokenizers file and is several times
faster; it takes texts of common scripts. Any other text, or one that spells the special
token, goes through the tokenizers file, whose ids are the definition.
"""

from __future__ import annotations

import base64
import re

import numpy as np

END = 50256
_COMMON = re.compile(r"[^\t\n\r\x20-\x7e¡-ɏ‐-‧₠-₵]|<\|endoftext\|>")
_loaded: dict[str, object] = {}


def _fast():
    if "fast" not in _loaded:
        import public_tokenizers as public
        import tiktoken

        with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded["fast"] = tiktoken.Encoding("byte_bpe_50k", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded["fast"]


def _exact(ordinary: bool):
    key = f"exact-{ordinary}"
    if key not in _loaded:
        import public_tokenizers as public
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
        t.encode_special_tokens = ordinary
        _loaded[key] = t
    return _loaded[key]


def ids(text: str, ordinary: bool = False) -> np.ndarray:
    """uint32 ids without added special tokens. ordinary: the special token's string in a
    text is ordinary text; else it is the special id, as the tokenizers file has it."""
    if _COMMON.search(text):
        return np.array(_exact(ordinary).encode(text, add_special_tokens=False).ids, np.uint32)
    return np.array(_fast().encode_ordinary(text), np.uint32)

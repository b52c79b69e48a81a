"""Byte-level BPE ids, the same as the ``tokenizers`` library gives, at several times its speed."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

# Fixed value: the split pattern of byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts with longer unbroken runs go to the library whose merge has no quadratic case.
LONG_RUN = re.compile(r"\S{1000}|\s{1000}")
#: Of such a run at least one block of this many characters, counted from the text's beginning, is a part.
BLOCK = 500


def has_long_run(text: str) -> bool:
    """Whether ``LONG_RUN`` matches; it is only tried if a block has no blank between other characters."""
    blocks = (text[i : i + BLOCK] for i in range(0, len(text) - BLOCK + 1, BLOCK))
    return any(" " not in b or b.isspace() for b in blocks) and LONG_RUN.search(text) is not None


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """``ids(text)`` for a tokenizers file; special tokens' strings are ordinary text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self._exact = Tokenizer.from_file(path)
        self._exact.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = _byte_symbols()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        self._fast = None
        if spec["model"]["type"] == "BPE" and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec.get("normalizer"):
            ranks = {bytes(symbols[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
            self._fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        """Latin-1 texts take the fast way, whose character classes agree there; all others the library."""
        if self._fast is not None and not has_long_run(text):
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                return self._fast.encode_ordinary(text)
        return self._exact.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)

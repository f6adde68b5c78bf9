"""Public tokenizer files, loaded once in each Python process."""

from __future__ import annotations

import functools
import os

import public_tokenizers


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file; an absolute path is taken as it is."""
    return name if os.path.isabs(name) else public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def load_tokenizer(name: str):
    """A tokenizer of the tokenizers library, without truncation or padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer

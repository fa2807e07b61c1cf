"""Where the files of public tokenizers are."""

from __future__ import annotations

import os
from pathlib import Path


def path(name: str) -> str:
    """In the folder that TOKENIZER_FILES names, or where the installed package of public tokenizers keeps them."""
    folder = os.environ.get("TOKENIZER_FILES")
    if folder:
        return str(Path(folder) / name)
    import public_tokenizers

    return public_tokenizers.path(name)


def read(name: str) -> str:
    """The text of a vocabulary file; tasks get it with their work and need no file."""
    return Path(path(name)).read_text(encoding="utf-8")

"""Where the public vocabulary files are; every operator takes the path as a parameter."""

from __future__ import annotations

import os


def path(name: str, folder: str | None = None) -> str:
    """A file in ``folder``, or in the installed package of public tokenizers."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_pattern() -> str:
    """The pattern by which the byte-level vocabularies cut a text before merging."""
    import public_tokenizers

    return public_tokenizers.PATTERN

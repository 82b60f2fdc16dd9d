"""Public tokenizers as executors use them: loaded once a worker, from a path that is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from functools import lru_cache

#: Splits text before the merges of the rank file (a fixed value that belongs to the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a block; a run of twice as many of one kind holds a whole block.
BLOCK = 500


def public(name: str) -> str:
    """The path of one of the public vocabulary files."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def encoder(path: str, ranks: str | None = None) -> Callable[[str], list[int]]:
    """Text -> ids, as ``tokenizers`` gives them for the JSON file ``path`` with ``add_special_tokens=False``.

    The strings of added tokens in a text are those tokens. ``ranks`` is a ``.tiktoken``
    file of the same vocabulary: ``tiktoken`` encodes by it several times faster, but
    knows no added tokens and fails on very long runs of white space, so a text goes
    there only if it holds neither an added token nor a run of ``2 * BLOCK`` characters,
    all of them white space or none.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def exact(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    if ranks is None:
        return exact
    import tiktoken

    with open(ranks, "rb") as lines:
        known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    quick = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=known, special_tokens={}).encode_ordinary
    added = [token.content for token in tokenizer.get_added_tokens_decoder().values()]

    def odd(text: str) -> bool:
        for i in range(0, len(text) - BLOCK + 1, BLOCK):
            block = text[i : i + BLOCK]
            if block.isspace() or len(block.split(None, 1)) == 1:
                return True
        return any(token in text for token in added)

    return lambda text: exact(text) if odd(text) else quick(text)

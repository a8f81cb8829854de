"""Token ids of public vocabularies inside tasks.

``byte_bpe_50k`` is read through its rank file, which gives the same ids as its ``tokenizers`` file several times
faster (held against it in the tests).  A text that spells a special token goes to ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable

_cache: dict[str, Callable[[str], list[int]]] = {}


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _ranks(name: str) -> dict[bytes, int]:
    with open(path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def _plain(file: str) -> Callable[[str], list[int]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(file)
    return lambda s: t.encode(s, add_special_tokens=False).ids


def encoder(name: str = "byte_bpe_50k.json") -> Callable[[str], list[int]]:
    """text -> ids of the tokenizer file ``name`` (.json, .tiktoken or .model), without added special tokens.  One per worker process."""
    if name not in _cache:
        if name == "byte_bpe_50k.json":
            import public_tokenizers
            import tiktoken

            fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks("byte_bpe_50k.tiktoken"), special_tokens={})
            slow: list[Callable] = []

            def encode(s: str) -> list[int]:
                if "<|endoftext|>" in s:
                    if not slow:
                        slow.append(_plain(path(name)))
                    return slow[0](s)
                return fast.encode_ordinary(s)

            _cache[name] = encode
        elif name.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            _cache[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(name), special_tokens={}).encode_ordinary
        elif name.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path(name))
            _cache[name] = lambda s: sp.encode(s, num_threads=1)
        else:
            _cache[name] = _plain(path(name))
    return _cache[name]

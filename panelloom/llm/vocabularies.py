"""Files of public vocabularies, found on the machine that reads them."""

from __future__ import annotations

import os
from functools import lru_cache


def path_of(file: str) -> str:
    """A path stays; a bare name is looked up in the installed package of vocabulary files."""
    if os.path.dirname(file):
        return file
    import public_tokenizers

    return public_tokenizers.path(file)


@lru_cache(maxsize=2)
def pieces_model(file: str):
    """A sentencepiece model."""
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path_of(file))


@lru_cache(maxsize=2)
def byte_level_tokenizer(file: str):
    """A byte-level tokenizer that takes special strings as plain text, with one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path_of(file))
    made.no_truncation()
    made.no_padding()
    made.encode_special_tokens = True
    return made

"""What the vocabularies of public tokenizers tell about how words are written."""

from __future__ import annotations

import base64
import math
import os
from functools import lru_cache

from rillstone.llm.tokens import RANKS, TOKENIZER_DIR

#: Vocabularies in the order of learning, so that a token's rank tells how common it is: mostly English, and many languages.
VOCABULARIES = (RANKS, "byte_bpe_multi_50k.tiktoken")
#: The rank that stands for words a vocabulary does not hold.
UNSEEN = 60_000


@lru_cache(maxsize=2)
def ranks(folder: str = TOKENIZER_DIR) -> dict[str, int]:
    """The best rank of each whole word (a token after a space) over the vocabularies."""
    out: dict[str, int] = {}
    for name in VOCABULARIES:
        with open(os.path.join(folder, name), "rb") as f:
            for token, rank in map(bytes.split, f):
                raw = base64.b64decode(token)
                if raw[:1] == b" " and len(raw) > 2:
                    try:
                        word = raw[1:].decode()
                    except UnicodeDecodeError:
                        continue
                    if word.isalpha():
                        out[word] = min(int(rank), out.get(word, UNSEEN))
    return out


_at = [TOKENIZER_DIR]


def use(folder: str) -> None:
    """Take the vocabularies from ``folder`` in this process."""
    _at[0] = folder


@lru_cache(maxsize=2)
def _small(folder: str) -> frozenset[str]:
    """The words of three letters or more that are mostly written small."""
    known = ranks(folder)
    return frozenset(word for word, rank in known.items() if len(word) > 2 and rank < known.get(word.title(), UNSEEN))


def _compound(word: str) -> bool:
    """Whether two words that are mostly written small make up the word."""
    small = _small(_at[0])
    for i in range(3, len(word) - 2):
        if word[:i] in small and word[i:] in small:
            return True
    return False


def form_class(word: str) -> str:
    """How a word is mostly written: ``a`` small and very common, ``n``, ``o`` small, ``m`` either way, ``l`` rather with a capital, ``k`` with a
    capital; of words in no vocabulary ``c`` if made up of two small ones, else ``u``."""
    known = ranks(_at[0])
    low, title = word.lower(), word[:1].upper() + word[1:].lower()
    small, large = known.get(low, UNSEEN), known.get(title, UNSEEN)
    if small == large == UNSEEN:
        return "c" if _compound(low) else "u"
    ratio = math.log2(large + 1) - math.log2(small + 1)
    if ratio > 1.5:
        return "a" if small < 1_500 else "n"
    return "o" if ratio > 0.4 else "m" if ratio > -0.5 else "l" if ratio > -2.5 else "k"

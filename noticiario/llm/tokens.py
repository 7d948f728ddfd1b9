"""Token counts and token boundaries of a public byte-pair tokenizer.

The vocabulary file is a parameter; it is read where it lies and never copied. A text is cut into
chunks at white space exactly where the tokenizer's own pattern always cuts, so the counts of the
chunks add up to the count of the text, and a chunk seen before costs one dictionary look-up.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The pre-tokenisation pattern that belongs to the vocabulary file (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the tokenizer sees it: Python's also has four control characters.
_WS, _INK = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
CHUNK = re.compile(rf" ?{_INK}+|{_WS}+(?!{_INK})|{_WS}")
#: The memo is emptied at this size; a chunk longer than LONG isn't kept.
MEMO, LONG = 400_000, 40


class Counter:
    def __init__(self, vocabulary: str = VOCABULARY):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.memo: dict[str, int] = {}

    def chunks(self, text: str) -> list[str]:
        return CHUNK.findall(text)

    def counts(self, chunks: list[str]) -> list[int]:
        """Tokens of each chunk."""
        memo = self.memo
        try:
            return list(map(memo.__getitem__, chunks))
        except KeyError:
            pass
        if len(memo) > MEMO:
            memo.clear()
        long: dict[str, int] = {}
        for c in set(chunks).difference(memo):
            (memo if len(c) <= LONG else long)[c] = len(self.encoding.encode_ordinary(c))
        return [memo[c] if len(c) <= LONG else long[c] for c in chunks] if long else list(map(memo.__getitem__, chunks))

    def count(self, text: str | None) -> int:
        """Tokens of a text; 0 for None and the empty text."""
        return sum(self.counts(CHUNK.findall(text))) if text else 0

    def lengths(self, text: str) -> list[int]:
        """Bytes of each token in turn."""
        return [len(self.encoding.decode_single_token_bytes(t)) for t in self.encoding.encode_ordinary(text)]


@lru_cache(maxsize=4)
def counter(vocabulary: str = VOCABULARY) -> Counter:
    """One counter a worker process and vocabulary."""
    return Counter(vocabulary)

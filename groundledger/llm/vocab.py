"""Word by word encoding with a ``tokenizers`` file whose pre-tokeniser drops white space."""

from __future__ import annotations

import os
import struct
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import regex

#: Pre-tokens of a lower-case word, as the pattern in the file cuts it.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")
#: Printable ASCII and the Latin letters and signs up to U+024F without the one whose lower case is two code points.
LATIN = regex.compile(r"[\x21-\x7e\u00a1-\u012f\u0131-\u024f]*")


@lru_cache(2)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def word_ids(path: str) -> Callable[[list[bytes]], list[bytes]]:
    """Ids, as little-endian unsigned 32-bit numbers, of words cut at ASCII blanks. No pre-token crosses white space and
    normalisation doesn't look across it, so the ids of a text are those of its words in order. Latin words in normal form
    C go to the model pre-token by pre-token, in lower case and as byte-level symbols; other words, and those that hold an added
    token of the file, take its whole path. As with the library's own call, the string of a special token in a text is that
    token, whether or not special tokens are put around texts."""
    from tokenizers.pre_tokenizers import ByteLevel

    tok = load(path)
    tokenize, symbols = tok.model.tokenize, ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    added = [t.content.lower() for t in tok.get_added_tokens_decoder().values()]  # none has a blank, so a word holds all of it
    short: dict[str, bytes] = {}
    packed = [struct.Struct(f"<{n}I").pack for n in range(64)]

    def pack(ids: list[int]) -> bytes:
        return packed[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}I", *ids)

    def ids_of(pre: str) -> bytes:
        if (ids := short.get(pre)) is None:
            if len(short) > 250_000:
                short.clear()
            ids = short[pre] = pack([t.id for t in tokenize(pre if pre.isascii() else symbols(pre)[0][0])])
        return ids

    def solve(words: list[bytes]) -> list[bytes]:
        out: list = [None] * len(words)
        rest = []
        for i, w in enumerate(words):
            s = w.decode("utf-8", "replace")
            if not s.isascii() and not (LATIN.fullmatch(s) and unicodedata.is_normalized("NFC", s)):
                rest.append((i, s))
                continue
            whole, s = s, s.lower()
            if s.isalpha():
                out[i] = ids_of(s)
            elif s[:-1].isalpha() and s[-1] in ".,;:!?":
                out[i] = ids_of(s[:-1]) + ids_of(s[-1])
            elif s.isprintable() and not any(t in s for t in added):
                out[i] = b"".join(map(ids_of, PRE_TOKEN.findall(s)))
            else:
                rest.append((i, whole))
        if rest:
            for (i, _), e in zip(rest, tok.encode_batch([s for _, s in rest], add_special_tokens=False)):
                out[i] = pack(e.ids)
        return out

    solve.forget = short.clear
    return solve

"""Token ids of whole texts with public vocabularies. The vocabulary's path is a parameter.

Tokenizers are loaded once per Python worker. Nothing here is trained.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import regex

REMEMBERED = 500_000
#: Runs of white space from this length on go to the tokenizer itself.
LONGEST_BLANK = 10_000
#: What may stand behind a word as a token run of its own (no apostrophe: it may start a suffix).
_MARKS = ".,!?;:%&$*#|"
#: Characters that a whitespace split may leave to the memory of words: ASCII and Latin letters,
#: whose case and composition do not depend on what stands next to them.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_PLAIN = re.compile("[\x09\x0a\x0d\x20-\x7e\xa1-\xac\xae-įı-ɏ]*")


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer as its file describes it: special tokens in a text have their own ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _needs_tokenizer(path: str) -> Callable[[str], bool]:
    """Whether a text is left to the tokenizer itself: it holds the name of an added token in any
    case, or white space without end, which other implementations of the pattern do not survive."""
    with open(path, encoding="utf-8") as file:
        names = [added["content"].lower() for added in json.load(file)["added_tokens"]]
    half = LONGEST_BLANK // 2

    def needs(text: str) -> bool:
        low = text.lower() if any(name[0] in text for name in names) else text
        # a run of that length holds a whole block of half of it
        return any(name in low for name in names) or (len(text) >= LONGEST_BLANK and any(
            text[at].isspace() and text[at:at + half].isspace() for at in range(0, len(text) - half + 1, half)))

    return needs


@lru_cache(maxsize=4)
def split_by_words(path: str) -> Callable[[Sequence[str]], list[np.ndarray]]:
    """Encoder for vocabularies that drop white space, lower-case and mark the ends of words.

    White space is never part of such a token, nor does a token reach from letters into the marks
    behind them; so the ids of a text are those of its pieces, one after the other. Pieces are
    remembered up to ``REMEMBERED`` of them. A text with characters beyond Latin, or with the name of
    an added token, goes to the tokenizer as a whole.
    """
    tokenizer, needs = load(path), _needs_tokenizer(path)
    last = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
    last[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
    memory: dict[str, bytes] = {}
    words: dict[str, bytes] = {}

    def direct(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def together(pieces: list[str]) -> list[bytes]:
        """Ids of each piece, from one encoding of all: every word ends with one marked token."""
        ids = np.array(tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, dtype="<u4")
        words = np.cumsum([1 if p.isalpha() else len(_WORDS.findall(p)) for p in pieces])
        ends = np.flatnonzero(last[ids]) + 1
        if len(ends) != words[-1]:
            return [direct(p) for p in pieces]
        data, cuts = ids.tobytes(), [0, *(4 * ends[words - 1]).tolist()]
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def fill(news: list[str]) -> dict[str, bytes]:
        """Ids of pieces that are not remembered; marks behind a word are looked up on their own."""
        parts = {}
        for piece in news:
            core = piece.rstrip(_MARKS)
            if core and not core[-1].isalnum():
                core = piece
            parts[piece] = (core, piece[len(core):])
        wanted = list({x for pair in parts.values() for x in pair if x and x not in words})
        fresh = {}
        for at in range(0, len(wanted), 256):
            part = wanted[at:at + 256]
            fresh.update(zip(part, together(part)))
        for word in wanted[:max(0, REMEMBERED - len(words))]:
            words[word] = fresh[word]

        def ids(part: str) -> bytes:
            return (words.get(part) or fresh[part]) if part else b""

        return {p: ids(core) + ids(tail) for p, (core, tail) in parts.items()}

    def encode(texts: Sequence[str]) -> list[np.ndarray]:
        pieces = [t.lower().split() if _PLAIN.fullmatch(t) and not needs(t) else None for t in texts]
        fresh = fill(list({p for ps in pieces if ps for p in ps if p not in memory}))
        if len(memory) + len(fresh) <= REMEMBERED:
            memory.update(fresh)
        known = memory.get
        return [np.frombuffer(direct(t) if ps is None else b"".join([known(p) or fresh[p] for p in ps]), dtype="<u4")
                for t, ps in zip(texts, pieces)]

    return encode


@lru_cache(maxsize=4)
def byte_level(path: str) -> Callable[[Sequence[str]], list[np.ndarray]]:
    """Encoder for byte-level vocabularies.

    Runs the vocabulary's merges, read from the same file, by the faster of the two installed
    libraries; ids and splitting rule are the same, which the tests check. Texts with names of
    added tokens or with very long white space go to the tokenizer itself.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocabulary = spec["model"]["vocab"]
    back = {c: b for b, c in _byte_letters().items()}
    ranks = {bytes(back[c] for c in token): i for token, i in vocabulary.items() if all(c in back for c in token)}
    for added in spec["added_tokens"]:
        ranks.pop(added["content"].encode(), None)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    needs = _needs_tokenizer(path)

    def ids(text: str) -> list[int]:
        return load(path).encode(text, add_special_tokens=False).ids if needs(text) else encoding.encode_ordinary(text)

    def encode(texts: Sequence[str]) -> list[np.ndarray]:
        return [np.asarray(ids(t), dtype="<u4") for t in texts]

    return encode


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabulary files."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return letters

"""Tokenising words once per worker instead of once per occurrence."""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np

from plantpulse.llm.memo import Memo

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
#: Words with characters from here on are encoded one by one: they may be recomposed with neighbours.
_COMBINING = 0x300
#: Words in one call of the tokenizer.
_CALL = 8192
#: Words a worker remembers, about 270 bytes each.
REMEMBERED = 1_600_000


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file without truncation or padding."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def windows(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """Cut at white space into pieces of about `size`, so that a very long text is never split whole."""
    start = 0
    while len(data) - start > size:
        found = _SPACE.search(data, start + size)
        if found is None:
            break
        yield data[start : found.start()]
        start = found.start()
    yield data[start:]


_CUT = re.compile(rb"(?<=[A-Za-z])(?=[!-&(-@\[-`{-~])|(?<=[!-&(-@\[-`{-~])(?=[A-Za-z])")


@contextmanager
def uncollected():
    """Without the collector of cycles, which would go through hundreds of thousands of short lists again and again."""
    active = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if active:
            gc.enable()


@lru_cache(maxsize=4)
def parted(path: str) -> tuple[bytes, ...] | None:
    """The added tokens of a tokenizer that cuts between ASCII letters and other ASCII signs; None if it does not.

    The apostrophe is left out: some tokenizers keep it with the letters behind
    it. Nor may letters of the other case give other ids. A word is then as good
    as its parts, unless an added token stands in it.
    """
    tok = tokenizer(path)
    signs = [c for c in map(chr, range(33, 127)) if not c.isalpha() and c != "'"]

    def ids(text: str) -> list[int]:
        return tok.encode(text, add_special_tokens=False).ids

    apart = all(ids(f"ab{c}ab") == [*ids("ab"), *ids(c), *ids("ab")] and ids(f"AB{c}") == ids(f"ab{c}") for c in signs)
    return tuple(t.content.encode() for t in tok.get_added_tokens_decoder().values()) if apart else None


@uncollected()
def encode_words(path: str, words: list[bytes]) -> list[bytes]:
    """The ids of each word, as little-endian unsigned 32-bit numbers.

    For tokenizers that drop white space and never join over it. Where the
    tokenizer cuts within words too, their parts are encoded, each once for all
    the words and calls that hold it.
    """
    added = parted(path)
    if added is None:
        return _encoded(path, words)
    text = b"\n".join(words)  # words hold no white space
    if b"\0" in text or any(t in text for t in added):
        cut = [b"\0" not in w and not any(t in w for t in added) for w in words]
        whole = iter(_encoded(path, [w for w, fine in zip(words, cut) if not fine]))
        rest = iter(encode_words(path, [w for w, fine in zip(words, cut) if fine]))
        return [next(rest if fine else whole) for fine in cut]
    marked = _CUT.sub(b"\0", text)
    marked = [m.lower() if m.isascii() else m for m in marked.split(b"\n")] if words else []
    split = [m.split(b"\0") for m in marked]
    known = _parts(path)
    new = known.missing(chain.from_iterable(split))
    known.update(zip(new, _encoded(path, new)))
    return [known[parts[0]] if len(parts) == 1 else b"".join([known[p] for p in parts]) for parts in split]


@lru_cache(maxsize=4)
def _parts(path: str) -> Memo:
    return Memo(300_000)


def _encoded(path: str, words: list[bytes]) -> list[bytes]:
    """Many words go through one call, and the tokens' places in the text say whose they are."""
    tok = tokenizer(path)
    out: list[bytes] = []
    for at in range(0, len(words), _CALL):
        texts = [w.decode("utf-8", "replace") for w in words[at : at + _CALL]]
        alone = [not t.isascii() and ord(max(t)) >= _COMBINING for t in texts]
        joined = [t for t, odd in zip(texts, alone) if not odd]
        found: list[bytes] = []
        if joined:
            got = tok.encode(" ".join(joined), add_special_tokens=False)
            ids = np.array(got.ids, dtype="<u4")
            first = np.fromiter(chain.from_iterable(got.offsets), dtype=np.int64, count=2 * len(ids))[::2]
            starts = np.zeros(len(joined) + 1, dtype=np.int64)
            np.cumsum(np.fromiter(map(len, joined), dtype=np.int64, count=len(joined)) + 1, out=starts[1:])
            cut = (4 * np.searchsorted(first, starts)).tolist()
            raw = ids.tobytes()
            found = [raw[a:b] for a, b in zip(cut, cut[1:])]
        together = iter(found)
        out += [
            np.array(tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() if odd else next(together)
            for t, odd in zip(texts, alone)
        ]
    return out


class WordIds:
    """Ids of words seen lately; at most `limit` are kept, then those not asked for again go."""

    def __init__(self, path: str, limit: int = REMEMBERED):
        self.path, self.known = path, Memo(limit)

    def learn(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        new = self.known.claim().missing(words)
        self.known.update(zip(new, encode_words(self.path, new)))
        return self.known

    def of_text(self, text: str) -> bytes:
        done = []
        for piece in windows(text.encode("utf-8", "replace")):
            words = piece.split()
            done.append(b"".join(map(self.learn(words).__getitem__, words)))
        return b"".join(done)

    def of_texts(self, texts: list[str], together: int = 1 << 21) -> Iterator[bytes]:
        """The same for many texts; short ones are learned together, and equal ones in a row joined once."""
        at = 0
        while at < len(texts):
            size, end = len(texts[at]), at + 1
            while end < len(texts) and size + len(texts[end]) <= together:
                size, end = size + len(texts[end]), end + 1
            if end == at + 1 and size > together:
                yield self.of_text(texts[at])
            else:
                split = [t.encode("utf-8", "replace").split() for t in texts[at:end]]
                known = self.learn(chain.from_iterable(split))
                done: dict[str, bytes] = {}
                for text, words in zip(texts[at:end], split):
                    if text not in done:
                        done[text] = b"".join(map(known.__getitem__, words))
                    yield done[text]
            at = end


@lru_cache(maxsize=4)
def word_ids(path: str, limit: int = REMEMBERED) -> WordIds:
    """One table of words for each worker and tokenizer."""
    return WordIds(path, limit)

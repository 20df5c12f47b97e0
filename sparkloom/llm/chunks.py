"""Worker caches for what a tokenizer makes of a chunk of text.

A chunk is a word with the single space, or the line end, before it. Both
pre-tokenizers used here never join characters across its beginning, so a
text's tokens are those of its chunks in order, and the few chunks that most of
a text consists of need encoding only once in each worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import islice

#: White space that is joined to what comes before: a space before further white space or at the end, a line end before
#: other white space, three line ends, or two at the end.
_OTHER = rb"[ \t\v\f\r\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
IRREGULAR = re.compile(rb" (?:\n|\Z|" + _OTHER + rb")|\n(?:\n(?:\n|\Z)|" + _OTHER + rb")")

#: Longer chunks are encoded, but not kept.
LONGEST = 64


class WorkerCache:
    """What ``encode_many`` gives for a key, kept for up to ``limit`` keys.

    ``fixed`` holds answers that stay. When the limit is reached, the later half
    is forgotten (what came first is mostly what is frequent), so memory is
    bounded whatever the input.
    """

    def __init__(self, encode_many: Callable[[list[bytes]], Iterable], limit: int, fixed: dict | None = None):
        self.encode_many, self.limit, self.fixed = encode_many, limit, fixed or {}
        self.held = dict(self.fixed)

    def lookup(self, keys: list[bytes]) -> list:
        """The answers for all ``keys``, in order; what is missing is encoded together."""
        found = list(map(self.held.get, keys))
        missing = list(dict.fromkeys([key for key, answer in zip(keys, found) if answer is None]))
        if missing:
            fresh = dict(zip(missing, self.encode_many(missing)))
            found = [fresh[key] if answer is None else answer for key, answer in zip(keys, found)]
            if len(self.held) > self.limit:
                self.held = dict(islice(self.held.items(), max(len(self.fixed), self.limit // 2)))
            self.held.update(fresh if len(max(fresh, key=len)) <= LONGEST else {k: v for k, v in fresh.items() if len(k) <= LONGEST})
        return found


def split_chunks(text: bytes) -> list[bytes] | None:
    """The chunks, all but the first without their leading space (those after a line end begin with it); None if the text has irregular white space."""
    return None if IRREGULAR.search(text) else text.replace(b"\n", b" \n").split(b" ")


def whole_chunks(chunks: list[bytes]) -> bytes:
    """The text of chunks that are not the first."""
    return (b" " + b" ".join(chunks)).replace(b" \n", b"\n")

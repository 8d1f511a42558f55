"""Words of many texts at once: byte classes, word bounds and 64-bit hashes, vectorised over one buffer."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: Spaces and punctuation outside ASCII that part words like ASCII ones do.
_PARTING = re.compile("[ ¡«»¿ -⁯　-〃]")
_WORD = np.zeros(256, dtype=np.int8)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1

_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)
_K = np.uint64(0xD6E8FEB86659FD93)
#: Bytes that are hashed at once, unless one text has more.
CHUNK = 1 << 20


def folded(text: str | None) -> bytes:
    """A text in lower case, as bytes, with all parting characters in ASCII."""
    text = (text or "").lower()
    return (text if text.isascii() else _PARTING.sub(" ", text)).encode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return run(_P), run(_INVERSE)


def mixed(h: np.ndarray) -> np.ndarray:
    """h with every bit depending on all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end in bytes."""
    step = np.diff(_WORD[data], prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word that doesn't depend on its place."""
    size = 1 << max(12, int(len(data)).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = words[:n].copy()
    for k in range(1, width):
        out = out * _K + words[k : k + n]
    return mixed(out)


def chunks(texts: list[bytes], most: int = CHUNK):
    """Ranges of texts whose bytes together stay below most, or of one longer text."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if texts:
        yield at, len(texts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with a line end after each, and where each begins (and the last ends)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])

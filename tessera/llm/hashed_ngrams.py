"""Character n-grams as hashed buckets, a stretch of the text at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tessera.llm.tables import decoded

#: Characters that are hashed at once; their n-grams go on across the seams.
PORTION = 1 << 20


def folded(raw: bytes) -> str:
    """Lower case, one space for each run of white space and at both ends."""
    return " " + " ".join(decoded(raw).lower().split()) + " "


def buckets(text: str, orders: range, bits: int) -> Iterator[np.ndarray]:
    """The bucket of each n-gram, order by order for each portion."""
    longest = orders.stop - 1
    for at in range(0, max(1, len(text) - longest + 1), PORTION):
        part = text[at : at + PORTION + longest - 1]
        last = at + PORTION + longest > len(text)  # the others' shorter n-grams at the end belong to the next
        codes = np.frombuffer(part.encode("utf-32-le"), "<u4")
        h = codes
        for n in range(1, orders.stop):
            if n > 1:
                if len(h) < 2:
                    break
                h = h[:-1] * np.uint32(16_777_619) ^ codes[n - 1 :]
            if n in orders:
                own = h if last else h[:PORTION]
                yield ((own + np.uint32(n)) * np.uint32(2_654_435_761) >> np.uint32(32 - bits)).astype(np.int32)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

"""Stand-ins for models that aren't shipped: same interface, plain arithmetic on the text."""

from __future__ import annotations

import numpy as np

VOWELS = "aeiou"


def length_classifier():
    """Labels by the text's length modulo 3, scores by its length modulo 97."""
    return lambda texts: [[{"label": f"LABEL_{len(x) % 3}", "score": (len(x) % 97 + 1) / 98}, {"label": "other", "score": 0.0}] for x in texts]


def vowel_encoder():
    """A first token that holds the shares of five letters in the text, and a second of zeros."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 2, len(VOWELS)))
        for i, x in enumerate(texts):
            out[i, 0] = [x.count(v) / max(1, len(x)) for v in VOWELS]
        return out

    return encode

"""Deterministic models for the checked scoring queries.

They are closures, so workers get them by value and need no package installed.
"""

from __future__ import annotations


def length_model():
    """Two logits that depend on the length of the text."""

    def make():
        import numpy as np

        def predict(texts):
            lengths = np.array([len(t) for t in texts.ravel()])
            second = (lengths % 61 - 30) / 10
            return np.stack([np.zeros(len(lengths)), second], axis=1).astype("float32")

        return predict

    return make


def yes_no_model():
    """Logits of yes and no that depend on the length of the prompt."""

    def make():
        import numpy as np

        def predict(prompts):
            lengths = np.array([len(p) for p in prompts.ravel()])
            yes = (lengths % 37) / 10
            return np.stack([yes, np.full(len(lengths), 1.75)], axis=1).astype("float32")

        return predict

    return make

"""A deterministic stand-in for a speech model, for tests and examples: it "hears" words by the loudness of a window."""

from __future__ import annotations

import numpy as np

from sonara.plans.scoring import Alignment, Decoded

#: What is said at each level of loudness.
SAID = (" the rain is here", " and then it ends", " there is a train on the line", " nothing else")


class StubModel:
    """Uses only single-byte ids, which any byte-level vocabulary with bytes in order has as 0 to 255."""

    n_mels = 80

    def __init__(self) -> None:
        from sonara.catalogue import toy_tokenizer
        from sonara.operators.tokens import Tokenizer

        self.tokenizer = Tokenizer.from_json(toy_tokenizer())

    def detect(self, mels: list[np.ndarray]) -> list[tuple[str, float]]:
        return [("en", 0.9)] * len(mels)

    def decode(self, mels: list[np.ndarray], prompts: list[list[int]], temperature: float, options: dict) -> list[Decoded]:
        out = []
        for mel in mels:
            loud = int(np.count_nonzero(mel.max(axis=1) > 0.5))
            begin, end = self.tokenizer.time_begin, self.tokenizer.time_begin + min(1500, loud // 2)
            ids = self.tokenizer.encode(SAID[loud % len(SAID)])
            out.append(Decoded([begin, *ids, end], -0.3 * (1 - temperature) if loud else -3.0, 0.05 if loud else 0.9))
        return out

    def align(self, mels: list[np.ndarray], start: list[int], tokens: list[list[int]], frames: list[int]) -> list[Alignment]:
        out = []
        for ids, n in zip(tokens, frames, strict=True):
            steps = np.linspace(0, max(1, n // 2), len(ids) + 2).astype(int).tolist()
            out.append(Alignment(list(range(len(ids) + 1)), steps[: len(ids) + 1], [0.8] * len(ids)))
        return out

"""Parts of bounded size of a column that Python works on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd

PIECE_SIZE = 1 << 20


def pieces(s: pd.Series, size: Callable = len, step: int = 1) -> Iterator[pd.Series]:
    """A column in parts of about so many characters, each of a multiple of step values but for the last."""
    start, held = 0, 0
    for i, x in enumerate(s):
        if held >= PIECE_SIZE and (i - start) % step == 0:
            yield s.iloc[start:i]
            start, held = i, 0
        held += 64 if x is None else size(x) + 64
    if start < len(s):
        yield s.iloc[start:]

"""Small parts of the batches that Python workers get."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd


def parts(batches: Iterator[pd.Series], rows: int = 250) -> Iterator[pd.Series]:
    """Each batch in parts of at most ``rows`` rows, so that results of few texts are held at once, whatever the session's batches hold."""
    for batch in batches:
        for at in range(0, max(len(batch), 1), rows):
            yield batch.iloc[at : at + rows]

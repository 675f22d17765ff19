"""Complete groups out of sorted partitions, for work in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of some ``rows`` rows in which no group is cut.

    The batches must be sorted by ``keys``. What is held at once is ``rows`` rows and one group.
    """
    held: list[pa.Table] = []
    count = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.concat_tables(held).combine_chunks()
        changes = np.zeros(table.num_rows, bool)
        for key in keys:
            column = table[key].to_numpy()
            changes[1:] |= column[1:] != column[:-1]
        last = np.flatnonzero(changes)
        cut = int(last[-1]) if len(last) else 0
        if cut:
            yield table.slice(0, cut)
        held = [table.slice(cut)]
        count = table.num_rows - cut
    if count:
        yield pa.concat_tables(held).combine_chunks()

"""Groups of bounded size, many at a time, in one Arrow pass over sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key together and in one task; for :func:`whole_groups`."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def whole_groups(batches, keys: list[str]) -> Iterator[tuple]:
    """Tables that hold whole groups, each with the bounds of its groups."""
    import numpy as np
    import pyarrow as pa

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        bounds = _bounds(table, keys, np)
        if len(bounds) > 2:
            yield table.slice(0, bounds[-2]).combine_chunks(), bounds[:-1]
        rest = table.slice(bounds[-2])
    if rest is not None:
        rest = rest.combine_chunks()
        yield rest, _bounds(rest, keys, np)


def _bounds(table, keys, np):
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        values = table.column(k).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.concatenate([np.flatnonzero(new), [table.num_rows]])

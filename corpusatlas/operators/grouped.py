"""Python over the ordered rows of each key, many keys to a call: groups of pandas cost a millisecond each."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.types import _parse_datatype_string


def fold_groups(rows: DataFrame, key: str, order: list[str], run: Callable[[object, Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """run(key, rows as tuples in order) for each key gives rows of `schema`. A key's rows stream by; none are held."""
    at = rows.columns.index(key)
    wanted = _parse_datatype_string(schema).jsonValue()
    def stream(batches):
        from itertools import chain, groupby

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        form, out = to_arrow_schema(StructType.fromJson(wanted)), []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), form, strict=True)], schema=form)

        every = chain.from_iterable(zip(*[c.to_pylist() for c in part.columns], strict=True) for b in batches for part in (b.slice(i, 1024) for i in range(0, b.num_rows, 1024)))
        for value, group in groupby(every, key=lambda r: r[at]):
            for row in run(value, group):
                out.append(row)
                if len(out) >= 4096:
                    yield batch()
                    out.clear()
        if out:
            yield batch()

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(stream, schema)

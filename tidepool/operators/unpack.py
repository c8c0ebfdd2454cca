"""Several values packed in one field: one row for each value, with its position."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions.packed import flatten_labels, split_labels


def unpack_values(df: DataFrame, key: str, packed: str, pos: str = "pos", value: str = "tag") -> DataFrame:
    """(key, pos, value) of every value packed in column ``packed``; pos counts from 1.

    The work is one narrow pass over Arrow batches, without a shuffle: only the two columns are
    read, and a hot or very long field costs no more than its own length. Null, empty and blank
    fields give no row; a null key is kept; repeated rows give their values once each; an empty
    table gives an empty result. Other columns, whatever their names, are not read.
    """
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField(pos, T.IntegerType()), T.StructField(value, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parents, places, labels = flatten_labels(split_labels(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(parents), places, labels], names=[key, pos, value])

    return df.select(F.col(key), F.col(packed).cast("string")).mapInArrow(run, schema)

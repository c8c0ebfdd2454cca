"""Texts that look the same but are stored with different characters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.llm.canonical import transducer
from tidepool.llm.sketch import digests
from tidepool.sources.shared import cut, drop


def consistent(text: Column | str) -> Column:
    """The consistent form of a text column; null stays null and the empty text stays empty.

    Full and half width variants, accents after their letter, marks without width, blanks of any
    width and look-alike letters of other scripts are rewritten; case, accents, the number of
    blanks, line breaks, tabs and raised or circled digits stay as they are.
    """

    @F.arrow_udf(T.StringType())
    def forms(texts: pa.Array) -> pa.Array:
        form = transducer().shown
        return pa.array([None if x is None else form(x) for x in texts.to_pylist()], pa.string())

    return forms(text)


def _digested(least_core: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form, core = transducer().shown, transducer().core
        for batch in batches:
            if least_core:
                batch = batch.filter(pa.array([len(core(x)) >= least_core for x in batch.column(1).to_pylist()], pa.bool_()))
            texts = batch.column(1).to_pylist()
            raw = [x.encode("utf-8", "surrogatepass") for x in texts]
            forms = digests([form(x).encode("utf-8", "surrogatepass") for x in texts])
            stored = digests(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (forms[:, 0], forms[:, 1], stored[:, 0], stored[:, 1]))], names=["id", "f1", "f2", "t1", "t2"])

    return run


def _pairs(df: DataFrame, key: str, text: str, least_core: int = 0) -> DataFrame:
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    # written once: texts are rewritten and digested in one pass, however often the digests are read
    rows, path = cut(rows.mapInArrow(_digested(least_core), "id bigint, f1 bigint, f2 bigint, t1 bigint, t2 bigint"), "digests")
    texts = rows.groupBy("f1", "f2", "t1", "t2").agg(F.count("*").alias("n"))
    mixed = texts.groupBy("f1", "f2").agg(F.count("*").alias("variants")).where("variants > 1")
    variants = texts.join(mixed.select("f1", "f2"), ["f1", "f2"]).select("f1", "f2", "t1", "t2")
    other = variants.toDF("f1", "f2", "o1", "o2")
    # unordered pairs of different stored texts of one form; equal texts never meet
    classes = variants.join(other, ["f1", "f2"]).where("t1 < o1 OR t1 = o1 AND t2 < o2").select("t1", "t2", "o1", "o2")
    mine = rows.select("t1", "t2", F.col("id").alias("x"))
    theirs = rows.select(F.col("t1").alias("o1"), F.col("t2").alias("o2"), F.col("id").alias("y"))
    out = classes.join(mine, ["t1", "t2"]).join(theirs, ["o1", "o2"]).where("x <> y")
    done, _ = cut(out.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")), "alike")
    drop(df.sparkSession, path)
    return done


def alike_pairs(*sources: tuple[str, DataFrame, str, str] | tuple[str, DataFrame, str, str, int]) -> DataFrame:
    """(src, id_a, id_b): every pair of rows of a source with equal forms and different stored texts.

    A source is (name, table, key, text), and maybe the least length of the core of a text that counts.
    Forms and stored texts are compared by 128-bit digests, so no text is shuffled. Equal stored texts are one class; only pairs of different classes of one
    form are made and then joined with their members, so the many rows that share a short text never
    meet each other and the output is exactly the pairs asked for. Hot classes are split by the
    adaptive skew join, the class pairs being small.

    Null ids and null texts are in no pair; empty texts have the empty form; repeated ids pair with other ids
    only; an empty table gives no rows.
    """
    parts = [_pairs(df, *how).select(F.lit(name).alias("src"), "id_a", "id_b") for name, df, *how in sources]
    return reduce(DataFrame.union, parts)

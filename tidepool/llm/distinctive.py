"""How distinctive a term is for a record: smoothed language-model divergence."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.sources.shared import cut, drop

_RUN = re.compile("[a-z0-9_]+")
_LETTER = re.compile("[a-z]")


def terms_of(text: str) -> list[str]:
    """The terms of a text: runs of a-z, 0-9 and _ in lower case, of three or more with a letter."""
    return [x for x in _RUN.findall(text.lower()) if len(x) >= 3 and _LETTER.search(x)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parent, terms, counts, sizes = [], [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            found = Counter(terms_of(text))
            size = found.total()
            parent += [i] * len(found)
            terms += found.keys()
            counts += found.values()
            sizes += [size] * len(found)
        keys = batch.column(0).take(pa.array(parent, pa.int64()))
        yield pa.RecordBatch.from_arrays([keys, pa.array(terms, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["rec_key", "term", "tf", "size"])


def term_scores(df: DataFrame, key: str, text: str, mu: float = 50.0, least_df: int = 2, least_tf: int = 1, most_df: int | None = None) -> DataFrame:
    """(rec_key, term, tf, df, score) of each term of each record.

    With p the record's distribution, smoothed by a Dirichlet prior of weight mu on the collection's
    distribution c, the score is p ln(p / c), the term's part of the relative entropy: low for common
    terms, high for terms much more frequent here than elsewhere. c and df are counted over all rows.
    Terms in fewer than ``least_df`` records get no row; ``least_tf`` and ``most_df`` keep only the
    terms so frequent in the record or so rare in the collection.

    Counting within a record is a narrow pass over the texts, whose counts are written once; the
    vocabulary is aggregated from them with a combine before its shuffle, which also spreads hot terms,
    and the total of the collection is that of the vocabulary before its cutoffs. Every row is a record of its own, even if keys or
    whole rows repeat; a null text or one without terms gives no row; a null key is kept as null; an
    empty table gives an empty result; other columns are not read.
    """
    texts = df.select(F.col(key).cast("string").alias("rec_key"), F.col(text).alias("text")).where("text IS NOT NULL")
    rows, rows_path = cut(texts.mapInArrow(_counted, "rec_key string, term string, tf bigint, size bigint"), "terms")
    words, words_path = cut(rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), "vocabulary")
    total = words.agg(F.sum("cf").alias("total"))
    words = words.where(F.col("df") >= least_df)
    if most_df is not None:
        words = words.where(F.col("df") <= most_df)
    joined = rows.where(F.col("tf") >= least_tf).join(words, "term").crossJoin(F.broadcast(total))
    c = F.col("cf") / F.col("total")
    p = (F.col("tf") + F.lit(mu) * c) / (F.col("size") + F.lit(mu))
    done, _ = cut(joined.select("rec_key", "term", "tf", "df", (p * F.log(p / c)).alias("score")), "scores")
    drop(df.sparkSession, rows_path, words_path)
    return done


def memories_and_tools(memories: DataFrame, tools: DataFrame, **options) -> DataFrame:
    """term_scores() of memory contents and of tool names with descriptions, each among its own kind."""
    described = tools.select("name", F.concat_ws(" ", "name", "description").alias("text"))
    parts = [("memories", term_scores(memories, "id", "content", **options)), ("tools", term_scores(described, "name", "text", **options))]
    return reduce(DataFrame.union, [df.select(F.lit(src).alias("src"), "*") for src, df in parts])

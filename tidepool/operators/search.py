"""Phrase search with BM25 ranking, and its fallback scan."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.text import strip, tags_text
from tidepool.sources.shared import cut, drop

#: Phrases shorter than this are not in a trigram index.
LEAST_PHRASE = 3
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Keywords that are sent to all executors at once; more are searched in blocks of about so many.
SENT = 20_000


def _blocks(words: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """(keyword, phrase) rows in lists of bounded size, at least one list."""
    rows = words.limit(SENT + 1).collect()
    if len(rows) <= SENT:
        yield [tuple(r) for r in rows]
        return
    n = 2 * -(-words.count() // SENT)
    for i in range(n):
        yield [tuple(r) for r in words.where(F.pmod(F.xxhash64("keyword"), F.lit(n)) == i).collect()]


def _occurrences(rows: DataFrame, words: list[tuple[str, str]], texts: int) -> DataFrame:
    """(keyword, the columns of rows but the last ``texts``, tf): occurrences, overlapping ones too, of phrases in texts.

    One pass over the texts for all phrases, by an automaton that each worker builds once. A row with a
    null keyword ends each batch: tf is its number of rows, and ``dl``, if there is that column, its sum.
    """
    kept = rows.columns[: len(rows.columns) - texts]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        of: dict[str, list[str]] = {}
        for keyword, phrase in words:
            of.setdefault(phrase, []).append(keyword)
        automaton = ahocorasick.Automaton()
        for phrase in of:
            automaton.add_word(phrase, phrase)
        automaton.make_automaton()
        for batch in batches:
            place, keyword, tf = [], [], []
            columns = [c.to_pylist() for c in batch.columns[len(kept) :]] if of else []
            for i, own in enumerate(zip(*columns, strict=True)):
                found = Counter(x for text in own for _, x in automaton.iter(text))
                for phrase, n in found.items():
                    place += [i] * len(of[phrase])
                    keyword += of[phrase]
                    tf += [n] * len(of[phrase])
            own = [batch.column(k).take(pa.array(place, pa.int64())) for k in range(len(kept))]
            total = [pa.array([sum(batch.column(k).to_pylist())] if c == "dl" else [None], batch.column(k).type) for k, c in enumerate(kept)]
            for head, columns, counts in ((keyword, own, tf), ([None], total, [batch.num_rows])):
                yield pa.RecordBatch.from_arrays([pa.array(head, pa.string()), *columns, pa.array(counts, pa.int64())], names=["keyword", *kept, "tf"])

    return rows.mapInArrow(run, "keyword string, " + ", ".join(f"{c} {kinds[c]}" for c in kept) + ", tf bigint")


def phrase_search(memories: DataFrame, keywords: DataFrame, limit: int = 5, owner: str | None = None) -> DataFrame:
    """(keyword, rank, id, score) of the best matches of each keyword as a phrase of content or tags.

    The score is BM25 over trigrams, negative, best lowest; ties go to the smaller id. All rows are
    searched, whatever their status; an owner restricts only what is returned. Memories are scanned
    once for each block of keywords (a column ``keyword``), however many rows a keyword matches; of
    the matches, which are written once, the best of each keyword are kept before they are shuffled.
    A phrase does not straddle content and tags; case does not count; phrases under three characters
    and empty ones find nothing; null contents and tags are empty.
    """
    text = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    phrases = keywords.select("keyword", F.lower(strip(F.col("keyword"))).alias("phrase")).where(F.length("phrase") >= LEAST_PHRASE).distinct()
    rows = memories.select("id", "owner", text("content").alias("c"), text("tags").alias("t"))
    rows = rows.select("id", "owner", (F.greatest(F.length("c") - 2, F.lit(0)) + F.greatest(F.length("t") - 2, F.lit(0))).cast("bigint").alias("dl"), "c", "t")
    parts, paths = [], []
    for words in _blocks(phrases):
        hits, path = cut(_occurrences(rows, words, 2), "hits")
        paths.append(path)
        whole = hits.where("keyword IS NULL").agg(F.sum("tf").alias("n_all"), (F.sum("dl") / F.sum("tf")).alias("avgdl"))
        found = hits.where("keyword IS NOT NULL").groupBy("keyword").agg(F.count("*").alias("n"))
        idf = F.log((F.col("n_all") - F.col("n") + 0.5) / (F.col("n") + 0.5))
        scored = hits.join(found, "keyword").crossJoin(F.broadcast(whole)).withColumn("idf", F.when(idf > 0, idf).otherwise(LEAST_IDF))
        score = -F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        scored = scored.select("keyword", "id", "owner", F.round(score, 9).alias("score"))
        if owner is not None:
            scored = scored.where(F.col("owner") == owner)
        rank = F.row_number().over(Window.partitionBy("keyword").orderBy("score", "id"))
        parts.append(scored.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= limit).select("keyword", "rank", "id", "score"))
    done, _ = cut(reduce(DataFrame.union, parts), "ranked")
    drop(memories.sparkSession, *paths)
    return done


def scan_search(memories: DataFrame, keywords: DataFrame, owner: str, limit: int = 5) -> DataFrame:
    """(keyword, rank, id): the first active memories of an owner, by id, that hold a keyword.

    Tags, as text, and content are searched as one; case does not count. Empty keywords find nothing.
    """
    words = keywords.where("keyword <> ''").select("keyword", F.lower("keyword").alias("word")).distinct()
    rows = memories.where((F.col("owner") == owner) & (F.col("status") == "active"))
    rows = rows.select("id", F.lower(F.concat(tags_text(F.col("tags")), F.coalesce("content", F.lit("")))).alias("text"))
    hits = reduce(DataFrame.union, [_occurrences(rows, block, 1) for block in _blocks(words)])
    rank = F.row_number().over(Window.partitionBy("keyword").orderBy("id"))
    return hits.where("keyword IS NOT NULL").withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= limit).select("keyword", "rank", "id")


def search(memories: DataFrame, keywords: DataFrame, owner: str, limit: int = 5) -> DataFrame:
    """(keyword, rank, id): phrase search, and for keywords without a match the scan."""
    ranked = phrase_search(memories, keywords, limit).select("keyword", "rank", "id")
    rest = keywords.select("keyword").distinct().join(ranked.select("keyword").distinct(), "keyword", "left_anti")
    return ranked.union(scan_search(memories, rest, owner, limit))

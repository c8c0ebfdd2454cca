"""Encoding of texts with a public byte-level BPE vocabulary, by recursive queries in DuckDB."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files of public tokenizers are, unless a call names another folder.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern that splits a text into words before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words a worker keeps with their ids (beyond these it forgets the rarest), and rows a recursive query may make, both to bound memory.
KEPT_WORDS, QUERY_ROWS = 200_000, 1_500_000

CONTRACT = """
WITH RECURSIVE step(w, p, t, done) AS (
    SELECT w, p, t, false FROM tokens
  UNION ALL
    SELECT w, p, t, done FROM (
        SELECT w, p, CASE WHEN took THEN merged ELSE t END AS t, best IS NULL AS done,
               lag(took, 1, false) OVER (PARTITION BY w ORDER BY p) AS gone
        FROM (
            SELECT *, hit AND (i - max(CASE WHEN hit THEN 0 ELSE i END) OVER (PARTITION BY w ORDER BY p ROWS UNBOUNDED PRECEDING)) % 2 = 1 AS took
            FROM (
                SELECT *, coalesce(rank = best, false) AS hit
                FROM (
                    SELECT a.w, a.p, a.t, a.i, m.rank, m.merged, min(m.rank) OVER (PARTITION BY a.w) AS best
                    FROM (
                        SELECT w, p, t, t * 65536 + lead(t) OVER o AS pair, row_number() OVER o AS i
                        FROM step WHERE NOT done WINDOW o AS (PARTITION BY w ORDER BY p)
                    ) a LEFT JOIN merges m ON m.pair = a.pair
                )
            )
        )
    ) WHERE NOT gone
)
SELECT w, list(t ORDER BY p) AS ids FROM step WHERE done GROUP BY w ORDER BY w
"""


@lru_cache(maxsize=4)
def load_ranks(folder: str, name: str = "byte_bpe_50k") -> dict[bytes, int]:
    """The id of each piece of a vocabulary, read on the driver; executors are sent it."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def load_merges(folder: str, name: str = "byte_bpe_50k") -> dict[str, np.ndarray]:
    """Merge table (left * 65536 + right, rank, merged) and the id of each byte."""
    with open(f"{folder}/{name}.json", encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    rows = [(vocab[a] * 65536 + vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])]
    table = np.array(rows, np.int64)
    ranks = load_ranks(folder, name)
    single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
    return {"pair": table[:, 0], "rank": table[:, 1], "merged": table[:, 2], "byte": single}


class Encoder:
    """Encodes words once each for a worker; words are tables of token positions in DuckDB."""

    def __init__(self, merges: dict[str, np.ndarray]) -> None:
        import duckdb
        import regex

        self.byte = merges["byte"]
        self.split = regex.compile(PATTERN).findall
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB"})
        self.db.register("given", pa.table({k: merges[k] for k in ("pair", "rank", "merged")}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self._empty()

    def _empty(self) -> None:
        self.index: dict[str, int] = {}
        self.parts: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.used = np.zeros(0, np.int64)

    def _keep_common(self, most: int) -> None:
        """Forget all words but the ones met most often, of late above all."""
        kept = np.sort(np.argsort(-self.used, kind="stable")[:most])
        ids, sizes = self.parts[0], self.sizes[0]
        starts, n = (np.cumsum(sizes) - sizes)[kept], sizes[kept]
        ends = np.cumsum(n)
        places = np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n, n) + np.repeat(starts, n)
        words = list(self.index)
        self.index = {words[k]: i for i, k in enumerate(kept.tolist())}
        self.parts, self.sizes, self.used = [ids[places]], [n], self.used[kept] // 2

    def _contract(self, words: list[bytes]) -> None:
        raw = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(x) for x in words], np.int64)
        starts = np.cumsum(sizes) - sizes
        w = np.repeat(np.arange(len(words)), sizes)
        tokens = pa.table({"w": w, "p": np.arange(len(raw)) - starts[w], "t": self.byte[raw]})
        self.db.register("tokens", tokens)
        found = self.db.sql(CONTRACT).to_arrow_table()
        self.db.unregister("tokens")
        lists = found.column("ids").combine_chunks()
        self.parts.append(lists.flatten().to_numpy().astype(np.int32))
        self.sizes.append(np.diff(lists.offsets.to_numpy()).astype(np.int64))

    def learn(self, words: list[str]) -> None:
        """Encode the words not yet known, in queries of bounded size."""
        part, rows = [], 0
        for word in words:
            raw = word.encode("utf-8", "surrogatepass")
            cost = len(raw) * (min(len(raw), 64) + 2) // 2
            if part and rows + cost > QUERY_ROWS:
                self._contract(part)
                part, rows = [], 0
            self.index[word] = len(self.index)
            part.append(raw)
            rows += cost
        if part:
            self._contract(part)

    def encode(self, texts: list[str]) -> pa.ListArray:
        """The ids of each text; a long text's words are known words like any other's."""
        split = [self.split(x) if x else [] for x in texts]
        new = dict.fromkeys(w for words in split for w in words if w not in self.index)
        if self.index and len(self.index) + len(new) > KEPT_WORDS:
            self._keep_common(max(0, KEPT_WORDS // 2 - len(new)))
            new = dict.fromkeys(w for words in split for w in words if w not in self.index)
        if new:
            self.learn(list(new))
            self.parts, self.sizes = [np.concatenate(self.parts)], [np.concatenate(self.sizes)]
        index = self.index
        flat = np.array([index[w] for words in split for w in words], np.int64)
        self.used = np.append(self.used, np.zeros(len(index) - len(self.used), np.int64))
        self.used += np.bincount(flat, minlength=len(index))
        ends = np.zeros(len(texts) + 1, np.int64)
        if not len(flat):
            return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array([], pa.int32()))
        ids, sizes = self.parts[0], self.sizes[0]
        starts = np.cumsum(sizes) - sizes
        n = sizes[flat]
        stops = np.cumsum(n)
        places = np.arange(stops[-1]) - np.repeat(stops - n, n) + np.repeat(starts[flat], n)
        word_ends = np.cumsum([len(words) for words in split])
        ends[1:] = np.concatenate([[0], stops])[word_ends]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids[places]))


def encoded(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, ids): the ids of each text in a byte-level BPE vocabulary, without special tokens.

    Each partition splits its texts into words, loads the bytes of its distinct words as
    token-position rows into DuckDB, and a recursive query joins them with the merge table and
    contracts each word's minimum-rank pair, from the left, until no pair of any word is in the
    table; occurrences of that pair in a word do not depend on each other and are contracted in one
    step, so a long run of one character takes a logarithmic number of steps. An ordered aggregation
    gives the ids. No shuffle; the vocabulary, 50,000 merges whatever the data, is the one thing
    sent to all.

    Null and empty texts give the empty list; strings that look like special tokens are ordinary
    text; repeated keys give a row each, null keys stay; other columns are not read.
    """
    spark = df.sparkSession
    merges = spark.sparkContext.broadcast(load_merges(folder, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(merges.value)
        for batch in batches:
            # pieces of bounded text, so that neither words nor ids of a batch fill the memory
            texts, start, size = batch.column(1).to_pylist(), 0, 0
            for i, x in enumerate(texts):
                size += len(x or "")
                if size > 2_000_000 or i == len(texts) - 1:
                    ids = encoder.encode(texts[start : i + 1])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, i + 1 - start), ids], names=[key, "ids"])
                    start, size = i + 1, 0

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decoded(df: DataFrame, key: str = "doc_id", ids: str = "ids", folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, text): the texts that lists of ids stand for; the empty or null list gives the empty text."""
    spark = df.sparkSession
    table = spark.sparkContext.broadcast({b: a for a, b in load_ranks(folder, name).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = table.value.__getitem__
        for batch in batches:
            texts = [b"".join(map(get, x or ())).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def token_counter(ranks: dict[bytes, int]):
    """Function from a list of texts to the numbers of their tokens, for sizes where ids are not asked for."""
    import tiktoken

    coder = tiktoken.Encoding("sizes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(coder.encode_ordinary(x)) if x else 0 for x in texts]

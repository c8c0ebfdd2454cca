"""Near-duplicate records with small edits: circulant MinHash, banding, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm import sketch
from tidepool.llm.components import components
from tidepool.sources.shared import cut, drop

BANDS, ROWS = 12, 3
#: Members of a bucket before each, in the order of their sketches, whose sketches are compared with its own, and
#: how many of those alike go on to be verified: the nearest, and the bucket's first member.
REACH, PARTNERS = 4096, 16
#: Members of a large bucket that one task holds when its rest is compared.
CHUNK = 20_000


def _words(values: np.ndarray) -> list[np.ndarray]:
    """Pairs of int32 columns as int64 columns."""
    return list(np.ascontiguousarray(values).view(np.int64).T)


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, cores in sketch.batches_of_cores(batches):
        owners = batch.column(2).to_pylist()
        same = sketch.digests([f"{o}\0{c}".encode("utf-8", "surrogatepass") for o, c in zip(owners, cores, strict=True)])
        signature = sketch.signatures(cores)
        s1, s2 = sketch.sketches(signature)
        keys = _words(sketch.band_keys(signature, sketch.owner_hash(owners), BANDS, ROWS))
        columns = [same[:, 0], same[:, 1], *keys, s1, s2]
        yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, columns)], names=_NAMES)


_NAMES = ["id", "g1", "g2", *(f"k{i}" for i in range(BANDS // 2)), "s1", "s2"]
_SCHEMA = ", ".join(f"{x} bigint" for x in _NAMES)


def bucket_neighbours(most: int, partners: int = PARTNERS, reach: int = REACH):
    """mapInArrow function over (key, id, s1, s2), sorted by key and sketch within each partition.

    A bucket streams by: each member is compared by sketch with up to ``reach`` members before it, the
    nearest first, until ``partners`` of them may be alike, and with the bucket's first member. What
    may be alike comes out as (a, b). Memory is a batch and ``reach`` rows, however hot the bucket,
    and its output is linear in its members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int32), *(np.zeros(0, np.int64) for _ in range(3))]
        lead = None  # the first member of the bucket that the held rows are of
        for batch in batches:
            fresh = [c.to_numpy() for c in batch.columns]
            if not len(fresh[0]):
                continue
            key, ids, s1, s2 = (np.concatenate(x) for x in zip(held, fresh, strict=True))
            n, old = len(key), len(held[0])
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            first = np.repeat(starts, np.diff(np.append(starts, n)))
            rank = np.arange(n) - first
            l_id, l1, l2 = ids[first], s1[first], s2[first]
            if lead is not None and lead[0] == key[0]:
                run_end = starts[1] if len(starts) > 1 else n
                l_id[:run_end], l1[:run_end], l2[:run_end] = lead[1:]
            met, found = np.zeros(n, np.int32), []
            open_, d = np.arange(old, n), 1
            while d <= reach and len(open_ := open_[(rank[open_] >= d) & (met[open_] < partners)]):
                at = open_[sketch.near(s1[open_], s2[open_], s1[open_ - d], s2[open_ - d], most)]
                met[at] += 1
                found.append((ids[at], ids[at - d]))
                d += 1
            passed = np.arange(old, n)
            # rows before the held ones are counted by what is held: a bucket that fills it was not seen whole
            short = passed[(met[passed] >= partners) | (rank[passed] >= reach)]
            far = passed
            far = far[sketch.near(s1[far], s2[far], l1[far], l2[far], most)]
            found.append((ids[far], l_id[far]))
            lead = (key[-1], l_id[-1], l1[-1], l2[-1])
            kept = max(int(starts[-1]), n - reach)
            held = [x[kept:] for x in (key, ids, s1, s2)]
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            pairs = np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b]
            pairs = np.unique(np.concatenate([pairs, np.stack([ids[short], ids[short]], axis=1)]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def split_buckets(named: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(key, part, asked, id, group, s1, s2) of buckets (key, id, group, s1, s2), in parts of about ``chunk`` members.

    Every member is once in one part; those that are not of their bucket's largest group are asked in
    each of its parts too, so no task holds more than a part, however hot the bucket.
    """
    sizes = named.groupBy("key", "group").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.max_by("group", F.struct("n", "group")).alias("major"))
    rows = named.join(sizes.select("key", "major", F.ceil(F.col("n") / chunk).cast("int").alias("parts")), "key")
    held = rows.select("key", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.lit(False).alias("asked"), "id", "group", "s1", "s2")
    asked = rows.where("group <> major").select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asked"), "id", "group", "s1", "s2")
    return held.union(asked).repartition("key", "part").sortWithinPartitions("key", "part", "asked")


def rest_of_buckets(most: int, block: int = 64):
    """mapInArrow function over split_buckets(): (a, b) of all pairs of a bucket that may be alike and are in different
    groups so far. Pairs within the largest group need no look. A part is held, who is asked streams by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []
        for batch in batches:
            key, part, asked, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (asked[1:] != asked[:-1]))) if len(key) else []
            for start, end in zip(new, [*new[1:], len(key)], strict=True):
                if place != (key[start], part[start]):
                    place, held = (key[start], part[start]), [np.zeros(0, np.int64)] * 4
                own = [c[start:end] for c in columns]
                if not asked[start]:
                    held = [np.concatenate(x) for x in zip(held, own, strict=True)]
                    continue
                ids, group, s1, s2 = held
                for at in range(0, len(own[0]), block):
                    i, g, t1, t2 = (x[at : at + block, None] for x in own)
                    ask, other = np.nonzero(sketch.near(s1[None], s2[None], t1, t2, most) & (group[None] != g))
                    a, b = i[ask, 0], ids[other]
                    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                    if len(pairs):
                        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def near_duplicates(df: DataFrame, key: str = "id", owner: str = "owner", text: str = "content", least: float = 0.6) -> DataFrame:
    """(id_a, id_b) of every member but the smallest of each group of near-duplicates of one owner.

    Records of an owner with equal cores are one class, found by an aggregation of digests; only
    the smallest id of each class is banded. Candidates of equal band keys are filtered by 128-bit
    sketches, verified by exact likeness of the whole cores, and the verified links' components are
    the groups. Where a bucket was too large to compare each member with all others, its members that
    are in different groups by then are compared too, in parts over many tasks, and the groups are made
    again. Banding of 12 x 3 finds a link of likeness 0.65 in 98 of 100 cases, of 0.75 in 998 of 1000;
    members of groups are mostly joined by several links.

    Null ids, null owners, null or empty texts and cores under 12 characters are in no group; rows that
    repeat an id are one record; columns besides the three are not read; an empty table gives an
    empty result.
    """
    spark = df.sparkSession
    docs = df.select(F.col(text).alias("text"), F.col(key).cast("bigint").alias("id"), F.col(owner).alias("owner")).where("id IS NOT NULL AND owner IS NOT NULL AND text IS NOT NULL")
    rows, rows_path = cut(docs.mapInArrow(_sketch_rows, _SCHEMA), "sketches")
    rest = [x for x in _NAMES if x not in ("id", "g1", "g2")]
    classes = rows.groupBy("g1", "g2").agg(F.min("id").alias("id"), F.max("id").alias("last"), *(F.first(x).alias(x) for x in rest))
    key_of = lambda i: (F.shiftright(f"k{i // 2}", 32) if i % 2 else F.col(f"k{i // 2}").bitwiseAND(0xFFFFFFFF)).cast("bigint")
    as_int = lambda c: F.when(c >= 1 << 31, c - (1 << 32)).otherwise(c).cast("int")
    banded = classes.select("id", "s1", "s2", F.explode(F.array(*(as_int(key_of(i)) for i in range(BANDS)))).alias("key"))
    buckets = banded.select("key", "id", "s1", "s2").repartition("key").sortWithinPartitions("key", "s1", "s2")
    most = sketch.differing_bits(least)
    pairs, pairs_path = cut(buckets.mapInArrow(bucket_neighbours(most), "a bigint, b bigint").distinct(), "candidates")
    texts = docs.select("id", "text")
    links, links_path = cut(sketch.verified(pairs.where("a <> b"), texts, texts, least, cores=False), "links")
    label = components(links, "groups")
    short = pairs.where("a = b").select(F.col("a").alias("id"))
    paths = [rows_path, pairs_path, links_path]
    if not short.isEmpty():
        keys = banded.join(short, "id", "left_semi").select("key").distinct()
        named = banded.join(keys, "key", "left_semi").join(label, banded.id == label.u, "left")
        named, named_path = cut(named.select("key", "id", F.coalesce("v", "id").alias("group"), "s1", "s2"), "named")
        paths.append(named_path)
        rest, rest_path = cut(split_buckets(named).mapInArrow(rest_of_buckets(most), "a bigint, b bigint").distinct().join(pairs, ["a", "b"], "left_anti"), "rest")
        label = components(links.union(sketch.verified(rest, texts, texts, least, cores=False)), "groups")
        paths.append(rest_path)
    copied = rows.groupBy("g1", "g2").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("last > rep").select("g1", "g2", "rep")
    copies = rows.select("id", "g1", "g2").join(copied, ["g1", "g2"]).where("id <> rep").select("id", "rep")
    of_copies = copies.join(label, copies.rep == label.u, "left").select(F.coalesce("v", "rep").alias("id_a"), F.col("id").alias("id_b"))
    out = label.select(F.col("v").alias("id_a"), F.col("u").alias("id_b")).union(of_copies).distinct()
    done, _ = cut(out, "near")
    drop(spark, *paths)
    return done

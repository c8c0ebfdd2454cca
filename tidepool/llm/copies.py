"""Duplicates hidden by formatting differences: Merkle digests of normalised records."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions.packed import split_labels
from tidepool.llm import sketch
from tidepool.sources.shared import cut, drop


def _leaf(kind: str, text: str) -> bytes:
    return blake2b(f"{kind}\0{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Root digest, id and normalised structure of each record (text, id, owner, tags)."""
    for batch, cores in sketch.batches_of_cores(batches):
        leaves: dict[str, bytes] = {}
        roots, shapes = [], []
        for owner, core, labels in zip(batch.column(2).to_pylist(), cores, split_labels(batch.column(3)).to_pylist(), strict=True):
            tags = sorted({x.lower() for x in labels})
            for tag in tags:
                if tag not in leaves:
                    leaves[tag] = _leaf("tag", tag)
            node = blake2b(b"set" + b"".join(sorted(leaves[x] for x in tags)), digest_size=16).digest()
            root = blake2b(b"record" + _leaf("owner", owner) + _leaf("core", core) + node, digest_size=24).digest()
            roots.append(root)
            shapes.append("\x1e".join([owner, core, "\x1f".join(tags)]))
        words = np.frombuffer(b"".join(roots), np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(words[:, i]) for i in range(3)), pa.array(shapes, pa.string())], names=["id", "d1", "d2", "d3", "shape"])


def _normalised(df: DataFrame, key: str, owner: str, text: str, tags: str) -> DataFrame:
    docs = df.select(F.col(text), F.col(key).cast("bigint"), F.col(owner), F.col(tags)).where(F.col(key).isNotNull() & F.col(owner).isNotNull() & F.col(text).isNotNull())
    return docs.mapInArrow(_records, "id bigint, d1 bigint, d2 bigint, d3 bigint, shape string")


def _groups(rows: DataFrame) -> DataFrame:
    grouped = rows.groupBy("d1", "d2", "d3", "shape").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    return grouped.select("id", "copies", "d1", "d2", "d3")


def collapsed(df: DataFrame, key: str = "id", owner: str = "owner", text: str = "content", tags: str = "tags") -> DataFrame:
    """(id, copies, d1, d2, d3): one row for each distinct record, its smallest id and its copies.

    Records are equal if their owners, the cores of their texts and the sets of their labels, in
    lower case, are. A record's root digest is made bottom-up: leaves are normalised and hashed, the
    digests of the unordered labels are sorted, and the root covers owner, core and labels. Rows are
    grouped by root digest and normalised structure, so that the whole structures are compared; the
    aggregation is combined before the shuffle, so a third of all rows may be copies of one record.

    Null ids, null owners, null or empty texts and cores under 12 characters are in no group; null, empty and
    blank tags are the empty set; rows that repeat an id count as copies; an empty table gives an
    empty result; other columns are not read.
    """
    return _groups(_normalised(df, key, owner, text, tags))


def copies(df: DataFrame, key: str = "id", owner: str = "owner", text: str = "content", tags: str = "tags") -> DataFrame:
    """(id_a, id_b): smallest id of each group of collapsed() and each other member.

    Digests and structures are written once and read twice: to confirm the groups, and to find their
    members by the 192-bit root digests. A hot group is one small row on one side of that join, so
    the adaptive skew join splits it.
    """
    rows, path = cut(_normalised(df, key, owner, text, tags), "records")
    groups = _groups(rows).where("copies > 1").select(F.col("id").alias("id_a"), "d1", "d2", "d3")
    members = rows.select("id", "d1", "d2", "d3").join(groups, ["d1", "d2", "d3"]).where("id <> id_a").select("id_a", F.col("id").alias("id_b")).distinct()
    done, _ = cut(members, "copies")
    drop(df.sparkSession, path)
    return done

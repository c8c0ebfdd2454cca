"""Deduplicating new batches against all history: a prefix-tree hash forest in sorted runs.

The state is a folder of runs. A run has, for each accepted record, one row in each of TREES trees,
sorted by key: a permutation of the record's signature read as a string of prefixes, the owner mixed
into the first, so the records under a prefix are a range. Beside these narrow rows it has the cores
of its records, sorted by id. Both lie in small row groups whose bounds are known: a batch reads those
row groups of the history into which prefixes of its own entries fall, and of the cores those of the
candidates found there, whatever the size of the rest.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import sketch
from tidepool.sources.shared import cut, drop, new_path

TREES, DEPTH = 8, 3
#: Candidates of one entry in one tree that are verified first, by how much that grows for entries that these do not
#: make a duplicate, and the sketch distance at which a candidate of the history is so surely one that widening waits.
FIRST, GROWTH, SURE = 16, 16, 14
#: Runs of about one size (within a factor of FAN) after which they are merged into one.
FAN = 4
#: Rows of one tree in a part of a run's index, records in a part of its cores, and bytes of a row group in both.
PART_ROWS, PART_CORES, GROUP_BYTES = 500_000, 50_000, 1 << 18
#: Links up to which duplicates among a batch's own entries are resolved in one task (24 bytes each).
ONE_TASK = 2_000_000
#: Candidate pairs that one task verifies.
PAIRS = 10_000
_KEYS = [f"t{i}" for i in range(TREES)]
_INDEX = ["tree", "key", "id", "s1", "s2"]
_ROW = "id bigint, at bigint, batch int, g1 bigint, g2 bigint, " + ", ".join(f"{x} bigint" for x in [*_KEYS, "s1", "s2"]) + ", core string"


def least_depth(likeness: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair so alike is found in some tree with the recall aimed at."""
    return next((d for d in range(depth, 1, -1) if 1 - (1 - likeness**d) ** trees >= recall), 1)


def _tree_keys(signature: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """uint64 keys (records x trees): 32 bits of owner and first coordinate, 16 of each further one."""
    out = np.empty((len(signature), TREES), np.uint64)
    first = sketch.band_keys(signature[:, :: DEPTH], owners, TREES, 1)
    for tree in range(TREES):
        key = first[:, tree].view(np.uint32).astype(np.uint64)
        for value in signature[:, tree * DEPTH + 1 : tree * DEPTH + DEPTH].T:
            key = key << np.uint64(16) | value.astype(np.uint64)
        out[:, tree] = key
    return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, cores in sketch.batches_of_cores(batches):
        owners = batch.column(3).to_pylist()
        same = sketch.digests([f"{o}\0{c}".encode("utf-8", "surrogatepass") for o, c in zip(owners, cores, strict=True)])
        signature = sketch.signatures(cores)
        s1, s2 = sketch.sketches(signature)
        keys = _tree_keys(signature, sketch.owner_hash(owners)).view(np.int64)
        columns = [same[:, 0], same[:, 1], *keys.T, s1, s2, pa.array(cores, pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(4), *map(pa.array, columns[:-1]), columns[-1]], names=["id", "at", "batch", "g1", "g2", *_KEYS, "s1", "s2", "core"])


def sketched(records: DataFrame) -> DataFrame:
    """Sketch rows of records (text, id, at, owner, maybe batch_no); at orders the records, ties by id."""
    batch = F.col("batch_no").cast("int") if "batch_no" in records.columns else F.lit(0)
    return records.select("text", "id", "at", "owner", batch.alias("batch")).where("id IS NOT NULL AND owner IS NOT NULL AND text IS NOT NULL AND at IS NOT NULL").mapInArrow(_sketched, _ROW)


def first_of_class(rows: DataFrame) -> DataFrame:
    """The first record, by at and id, of each class of one owner's equal cores."""
    rest = [F.first(x).alias(x) for x in (*_KEYS, "s1", "s2", "core")]
    return rows.groupBy("g1", "g2").agg(F.min(F.struct("at", "id")).alias("f"), *rest).select("f.id", "f.at", *_KEYS, "s1", "s2", "core")


@dataclass(frozen=True)
class Run:
    """A sorted run: where it is, its records, the parts of each tree (a power of two) and the parts of its cores."""

    path: str
    rows: int
    splits: int
    cores: int

    @property
    def level(self) -> int:
        return (max(self.rows, 1).bit_length() - 1) // (FAN.bit_length() - 1)


class HashForest:
    """Accepted records of all owners, searched by prefixes and grown batch by batch; the folder is the state."""

    def __init__(self, spark: SparkSession, folder: str, least: float = 0.6, recall: float = 0.97) -> None:
        self.spark, self.folder, self.least = spark, folder.rstrip("/"), least
        depth = least_depth(least, recall)
        #: Bits of the key left out at each widening, from the whole key to the prefix that meets the recall target.
        self.shifts = [16 * (DEPTH - d) for d in range(DEPTH, depth - 1, -1)]
        self.runs = self._kept()
        #: Bytes of row groups that the last batch read of the history's index.
        self.bytes_read = 0

    # -- runs ---------------------------------------------------------------------------------

    def _files(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _kept(self) -> list[Run]:
        """The runs that an earlier process completed in the folder."""
        fs, where = self._files(self.folder)
        found = []
        for entry in fs.listStatus(where) if fs.exists(where) else []:
            name = entry.getPath().getName()
            if name.startswith("run-") and fs.exists(self._files(f"{self.folder}/{name}/_complete")[1]):
                found.append(Run(f"{self.folder}/{name}", *map(int, name.split("-")[2:5])))
        return sorted(found, key=lambda r: -r.rows)

    def _indexed(self, rows: DataFrame, splits: int, path: str, *more: str) -> None:
        """Write a row for each record and tree, sorted by key within its part: tree and leading bits of the key."""
        trees = F.array(*(F.struct(F.lit(i).cast("int").alias("tree"), F.col(k).alias("key")) for i, k in enumerate(_KEYS)))
        spread = rows.select("id", "s1", "s2", *more, F.inline(trees))
        self._sorted(spread.select(self._part(splits).alias("part"), *_INDEX, *more), splits, path)

    @staticmethod
    def _part(splits: int) -> Column:
        """Keys are signed: the leading bit is turned, so that parts follow the order of the keys."""
        lead = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), 65 - splits.bit_length()) if splits > 1 else F.lit(0)
        return (F.col("tree") * splits + lead).cast("int")

    def _sorted(self, rows: DataFrame, splits: int, path: str) -> None:
        tasks = min(TREES * splits, 4096) if splits > 1 else TREES
        rows.repartition(tasks, "part").sortWithinPartitions("part", "key").write.option("parquet.block.size", GROUP_BYTES).option("parquet.enable.dictionary", "false").partitionBy("part").parquet(path)

    def _add(self, n: int, index, cores) -> Run:
        """A run of about n records; index and cores write what they are given a path and a number of parts for."""
        splits = 1 << max(0, (n - 1) // PART_ROWS).bit_length()
        parts = 1 + n // PART_CORES
        run = Run(f"{self.folder}/run-{uuid.uuid4().hex[:12]}-{n}-{splits}-{parts}", n, splits, parts)
        texts = cores(parts).repartition(parts, "part").sortWithinPartitions("part", "id").write.option("parquet.block.size", GROUP_BYTES).partitionBy("part")
        with ThreadPoolExecutor(2) as both:
            for job in [both.submit(index, splits, f"{run.path}/index"), both.submit(texts.parquet, f"{run.path}/cores")]:
                job.result()
        fs, done = self._files(f"{run.path}/_complete")
        fs.create(done).close()
        self.runs = sorted([*self.runs, run], key=lambda r: -r.rows)
        return run

    def append(self, rows: DataFrame, n: int) -> None:
        """Persist the sketch rows of about n accepted records as a new sorted run; runs of one size are merged."""
        self._add(n, lambda splits, path: self._indexed(rows, splits, path), lambda parts: rows.select(_core_part(parts).alias("part"), "id", "core"))
        while alike := next((g for level in {r.level for r in self.runs} if len(g := [r for r in self.runs if r.level == level]) >= FAN), None):
            self.merge(alike)

    def merge(self, runs: list[Run]) -> None:
        """Merge runs into one; a record is rewritten as often as the logarithm of the history, not with each batch."""
        read = lambda kind, name: reduce(DataFrame.union, [self.spark.read.schema(kind).parquet(f"{r.path}/{name}") for r in runs])
        index, cores = read("tree int, key bigint, id bigint, s1 bigint, s2 bigint", "index"), read("id bigint, core string", "cores")
        again = lambda splits, path: self._sorted(index.select(self._part(splits).alias("part"), *_INDEX), splits, path)
        self._add(sum(r.rows for r in runs), again, lambda parts: cores.select(_core_part(parts).alias("part"), "id", "core"))
        self.runs = [r for r in self.runs if r not in runs]
        drop(self.spark, *(r.path for r in runs))

    # -- search -------------------------------------------------------------------------------

    def _candidates(self, own: Run, first: int, wanted: DataFrame | None = None) -> tuple[DataFrame, str, dict]:
        """(a, b, run, more): entry a, of the wanted (a) or of all, may be a duplicate of record b of a run.

        ``own`` is the batch's index and stands last among the runs; of it only entries before a count.
        In each tree an entry's range under the whole key is searched, then prefixes are widened to the
        depth that meets the recall target. An entry stops in a tree at ``first`` candidates, or at one
        of the history whose sketch is nearly its own; ``more`` says so.
        """
        runs = [*self.runs, own]
        shifts, most = self.shifts, sketch.differing_bits(self.least)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = [_Index(r, own=r is runs[-1]) for r in runs]
            for batch in batches:
                tree = batch.column(0).to_numpy()
                for t in np.unique(tree):
                    columns = [c.to_numpy() for c in batch.filter(pa.array(tree == t)).columns[1:]]
                    yield from _search(index, int(t), columns, shifts, most, first)
            read = sum(x.read for x in index[:-1])
            yield _found_rows([None], [None], [-1], [False], [read])

        asked = self.spark.read.schema("tree int, key bigint, id bigint, s1 bigint, s2 bigint, at bigint").parquet(f"{own.path}/index")
        if wanted is not None:
            asked = asked.join(wanted.select(F.col("a").alias("id")), "id", "left_semi")
        rows = asked.select("tree", "key", "id", "at", "s1", "s2").mapInArrow(run, _FOUND)
        seen = Observation()
        rows = rows.groupBy("a", "b").agg(F.min("run").alias("run"), F.max("more").alias("more"), F.sum("read").alias("read"))
        rows = rows.observe(seen, F.count("b").alias("pairs"), F.count_if("more").alias("capped"), F.sum("read").alias("read"))
        found, path = cut(rows, "forest-candidates")
        return found.where("b IS NOT NULL"), path, seen.get

    def _verified(self, found: DataFrame, entries: DataFrame, own: int, n: int) -> DataFrame:
        """(a, b, old) of the candidates whose exact likeness is enough; of the history's cores only theirs are read.

        The n candidates are few bytes and much work, so tasks are made by their number.
        """
        runs = list(self.runs)
        part = F.lit(0)
        for i, r in enumerate(runs):
            part = F.when(F.col("run") == i, F.pmod(F.xxhash64("b"), F.lit(r.cores)).cast("int")).otherwise(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: OrderedDict[tuple[int, int], list[_Groups]] = OrderedDict()
            for batch in batches:
                which, place, ids = (c.to_numpy() for c in batch.columns)
                for i, p in {*zip(which.tolist(), place.tolist(), strict=True)}:
                    if (i, p) not in held:
                        held[i, p] = [_Groups(x, "id") for x in _listed(f"{runs[i].path}/cores/part={p}")]
                    held.move_to_end((i, p))
                    while len(held) > 16:
                        held.popitem(last=False)
                    yield from _cores_of(held[i, p], np.sort(ids[(which == i) & (place == p)]))

        asked = found.where(F.col("run") < own).select("run", part.alias("part"), "b").distinct()
        old = asked.repartition("run", "part").sortWithinPartitions("run", "part", "b").mapInArrow(run, "b bigint, core string")
        mine = entries.select("id", "core")
        pairs = found.select("a", "b", (F.col("run") < own).alias("old")).repartition(1 + n // PAIRS, "a").sortWithinPartitions("a")
        return sketch.verified(pairs, mine, old.union(mine), self.least).distinct()

    def ingest(self, records: DataFrame, keep: bool = True) -> DataFrame:
        """(id) of the records of a batch that repeat what was accepted before; the others are accepted.

        records has (text, id, at, owner) and is taken by at, then id: a record is a duplicate if its
        likeness with an accepted one of its owner, of the history or earlier in ``records``, is
        ``least`` or more; duplicates are not accepted and nothing is compared with them. With ``keep``
        the accepted are appended to the state.

        Null ids, null owners, null times, null or empty texts and cores under 12 characters are no
        duplicates and are not compared; of equal cores all but the first are duplicates.
        """
        rows, path = cut(sketched(records), "batch")
        out, _ = cut(self._ingest(rows, keep), "cases")
        self._forget()
        drop(self.spark, path)
        return out

    def _forget(self) -> None:
        drop(self.spark, *self._open)
        self._open: list[str] = []

    def _ingest(self, rows: DataFrame, keep: bool) -> DataFrame:
        """ingest() of sketch rows; what the answer still reads is removed by _forget() once it is written."""
        self._open = []
        seen = Observation()
        entries, path = cut(first_of_class(rows).observe(seen, F.count("*").alias("n")), "entries")
        self._open.append(path)
        n = seen.get["n"]
        if not n:
            return rows.select("id").limit(0)
        splits = 1 << max(0, (n - 1) // PART_ROWS).bit_length()
        own = Run(new_path(self.spark, "own"), n, splits, 0)
        self._open.append(own.path)
        self._indexed(entries, splits, f"{own.path}/index", "at")
        first, links, verified, cases, wanted, capped, self.bytes_read = FIRST, None, None, None, None, None, 0
        while True:
            found, path, told = self._candidates(own, first, wanted)
            self._open.append(path)
            self.bytes_read += told["read"] or 0
            if told["pairs"]:
                counted = Observation()
                fresh = found if verified is None else found.join(verified, ["a", "b"], "left_anti")
                good = self._verified(fresh, entries, len(self.runs), told["pairs"])
                verified = found.select("a", "b") if verified is None else verified.union(fresh.select("a", "b"))
                good = (good if links is None else links.union(good).distinct()).observe(counted, F.count_if(~F.col("old")).alias("fresh"))
                links, path = cut(good, "links")
                self._open.append(path)
                cases, path = self._resolve(links, counted.get["fresh"])
                self._open.append(path)
            # entries that stopped early and are no duplicate so far are searched further, in rounds: as a round
            # makes others no duplicates, whose links were to these, entries of any earlier round may be among them
            if not told["capped"] and capped is None:
                break
            now = found.where("more").select("a").distinct()
            capped = now if capped is None else capped.join(wanted, "a", "left_anti").union(now)
            left = Observation()
            wanted, path = cut(capped.join(cases, capped.a == cases.id, "left_anti").observe(left, F.count("*").alias("n")), "rest")
            self._open.append(path)
            if not left.get["n"]:
                break
            first *= GROWTH
        accepted = entries if cases is None else entries.join(cases, "id", "left_anti")
        if keep:
            self.append(accepted, n)
        return rows.select("id").distinct().join(accepted.select("id"), "id", "left_anti")

    def _resolve(self, links: DataFrame, fresh: int) -> tuple[DataFrame, str]:
        """(id) of the duplicates: each link's a is later than its b; old b are accepted.

        An entry all of whose links were to duplicates is accepted, which makes those linked to it
        duplicates. So many links among the batch's entries as fit in one task are resolved there;
        more in rounds over tables, until no open link is left.
        """
        if fresh <= ONE_TASK:
            old = links.where("old").select(F.col("a").alias("id")).distinct()
            if not fresh:
                return cut(old, "cases")
            # of those that the history makes duplicates the links fall away before
            open_ = _without(links.where("NOT old").select("a", "b"), old)
            return cut(old.union(open_.coalesce(1).mapInArrow(_resolved, "id bigint")).distinct(), "cases")
        cases, case_path = cut(links.where("old").select(F.col("a").alias("id")).distinct(), "cases")
        open_, open_path = cut(_without(links.where("NOT old").select("a", "b"), cases), "open")
        while not open_.isEmpty():
            heads = open_.select("b").distinct().join(open_.select(F.col("a").alias("b")).distinct(), "b", "left_anti")
            more, next_case = cut(cases.union(open_.join(heads, "b").select(F.col("a").alias("id")).distinct()), "cases")
            left, next_open = cut(_without(open_, more), "open")
            drop(self.spark, case_path, open_path)
            cases, case_path, open_, open_path = more, next_case, left, next_open
        drop(self.spark, open_path)
        return cases, case_path


def _core_part(parts: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")


def _without(links: DataFrame, cases: DataFrame) -> DataFrame:
    """Links neither of whose ends is a duplicate."""
    left = links.join(cases.select(F.col("id").alias("a")), "a", "left_anti")
    return left.join(cases.select(F.col("id").alias("b")), "b", "left_anti").select("a", "b")


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The duplicates among the ends of links (later, earlier), in one task."""
    parts = [[c.to_numpy() for c in batch.columns] for batch in batches]
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2
    ids, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = code[: len(a)], code[len(a) :]
    case = np.zeros(len(ids), bool)
    while len(a):
        late = np.zeros(len(ids), bool)
        late[a] = True
        case[a[~late[b]]] = True
        kept = ~case[a] & ~case[b]
        a, b = a[kept], b[kept]
    yield pa.RecordBatch.from_arrays([pa.array(ids[case])], names=["id"])


# -- reading of runs where they are searched ------------------------------------------------------


def _listed(folder: str) -> list:
    """The parquet files of a folder of any file system, opened; none if it is not there."""
    from pyarrow import fs, parquet

    # object stores go by other names in Spark than in Arrow
    uri = folder.replace("s3a://", "s3://", 1) if folder.startswith("s3a://") else folder
    system, path = fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return []
    return [parquet.ParquetFile(system.open_input_file(x.path)) for x in system.get_file_info(fs.FileSelector(path)) if x.path.endswith(".parquet")]


class _Groups:
    """The row groups of a sorted file, with their bounds; the last few that were read are held."""

    def __init__(self, file, by: str) -> None:
        self.file, meta = file, file.metadata
        place = file.schema_arrow.names.index(by)
        bounds = [meta.row_group(i).column(place).statistics for i in range(meta.num_row_groups)]
        self.low, self.high = (np.array([getattr(x, m) for x in bounds], np.int64) for m in ("min", "max"))
        self.sizes = [meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)]
        self.held: OrderedDict[int, list] = OrderedDict()
        self.read = 0

    def rows(self, i: int, columns: list[str], plain: bool = True) -> list:
        if i not in self.held:
            table = self.file.read_row_group(i, columns=columns)
            self.read += self.sizes[i]
            self.held[i] = [table.column(x).to_numpy() if plain else table.column(x) for x in columns]
            if len(self.held) > 8:
                self.held.popitem(last=False)
        return self.held[i]


class _Index:
    """The index of a run: the row groups of a tree into which ranges of keys fall."""

    def __init__(self, run: Run, own: bool) -> None:
        self.run, self.own = run, own
        self.columns = ["key", "id", "s1", "s2"] + (["at"] if own else [])
        self.parts: OrderedDict[int, list[_Groups]] = OrderedDict()
        self.past = 0

    @property
    def read(self) -> int:
        return self.past + sum(g.read for groups in self.parts.values() for g in groups)

    def groups(self, tree: int, low: int, high: int) -> Iterator[tuple[_Groups, int]]:
        """(file, row group) of all that overlap keys from low to high."""
        lead = lambda key: ((key + (1 << 63)) >> (65 - self.run.splits.bit_length())) if self.run.splits > 1 else 0
        for part in range(tree * self.run.splits + lead(low), tree * self.run.splits + lead(high) + 1):
            if part not in self.parts:
                self.parts[part] = [_Groups(x, "key") for x in _listed(f"{self.run.path}/index/part={part}")]
                if len(self.parts) > TREES:
                    self.past += sum(g.read for g in self.parts.popitem(last=False)[1])
            self.parts.move_to_end(part)
            for groups in list(self.parts[part]):
                for i in np.flatnonzero((groups.low <= high) & (groups.high >= low)).tolist():
                    yield groups, i


_FOUND = "a bigint, b bigint, run int, more boolean, read bigint"


def _found_rows(a, b, run, more, read) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((a, b, run, more, read), kinds, strict=True)], names=["a", "b", "run", "more", "read"])


def _steps(low: np.ndarray, high: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(range, place, the ranges asked): places of all ranges, some of each range at a time, ever more; blocks are of
    bounded size. The receiver may close ranges by setting their high to their low."""
    low, step = low.copy(), 64
    while len(open_ := np.flatnonzero(low < high)):
        for start in range(0, len(open_), max(1, most // step)):
            some = open_[start : start + max(1, most // step)]
            n = np.minimum(high[some] - low[some], step)
            n = np.maximum(n, 0)
            entry = np.repeat(some, n)
            place = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n) + low[entry]
            yield entry, place, some
        low[open_] += step
        step = min(step * 8, most)


def _search(index: list[_Index], tree: int, columns: list[np.ndarray], shifts: list[int], most: int, first: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(columns[0], kind="stable")
    key, ids, at, s1, s2 = (x[order] for x in columns)
    taken, closed = np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    inner = None
    for shift in shifts:
        low = key >> np.int64(shift) << np.int64(shift)
        high = low | np.int64((1 << shift) - 1)
        for number, run in enumerate(index):
            for groups, i in run.groups(tree, int(low[0]), int(high[-1])):
                asked = np.arange(np.searchsorted(high, groups.low[i]), np.searchsorted(low, groups.high[i], "right"))
                asked = asked[~closed[asked]]
                if not len(asked):
                    continue
                r_key, r_id, r1, r2, *r_at = groups.rows(i, run.columns)
                begin, end = np.searchsorted(r_key, low[asked], "left"), np.searchsorted(r_key, high[asked], "right")
                ranges = [(begin, end)]
                if inner is not None:
                    # what was found under the longer prefix is not searched again
                    ranges = [(begin, np.searchsorted(r_key, inner[0][asked], "left")), (np.searchsorted(r_key, inner[1][asked], "right"), end)]
                for lo, hi in ranges:
                    for which, place, _ in _steps(lo, hi):
                        entry = asked[which]
                        bits = np.bitwise_count((s1[entry] ^ r1[place]).view(np.uint64)) + np.bitwise_count((s2[entry] ^ r2[place]).view(np.uint64))
                        ok = np.flatnonzero(bits <= most)
                        which, entry, place, bits = which[ok], entry[ok], place[ok], bits[ok]
                        ok = r_id[place] != ids[entry]
                        if run.own:
                            ok &= (r_at[0][place] < at[entry]) | (r_at[0][place] == at[entry]) & (r_id[place] < ids[entry])
                        which, entry, place, bits = which[ok], entry[ok], place[ok], bits[ok]
                        if not len(entry):
                            continue
                        start = np.flatnonzero(np.append(True, entry[1:] != entry[:-1]))
                        rank = np.arange(len(entry)) - np.repeat(start, np.diff(np.append(start, len(entry)))) + taken[entry]
                        taken += np.bincount(entry, minlength=len(key))
                        sure = np.zeros(len(key), bool)
                        if not run.own and first == FIRST:
                            sure[entry[bits <= SURE]] = True
                        full = sure | (taken > first)
                        closed |= full
                        hi[which[full[entry]]] = 0
                        kept = rank <= first
                        entry, place = entry[kept], place[kept]
                        yield _found_rows(ids[entry], r_id[place], np.full(len(entry), number), full[entry], np.zeros(len(entry), np.int64))
        inner = (low, high)


def _cores_of(files: list[_Groups], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(b, core) of sorted ids, from the row groups that may hold them."""
    for groups in files:
        for i in range(len(groups.low)):
            asked = ids[np.searchsorted(ids, groups.low[i]) : np.searchsorted(ids, groups.high[i], "right")]
            if len(asked):
                own, cores = groups.rows(i, ["id", "core"], plain=False)
                hit = pa.array(np.isin(own.to_numpy(), asked))
                for batch in pa.table([own, cores], names=["b", "core"]).filter(hit).to_batches():
                    yield batch


def _micros(text: Column) -> Column:
    """Microseconds of a written time, whatever the session's zone: times without a zone are compared as they stand."""
    return F.unix_micros(F.coalesce(F.try_to_timestamp(F.concat(text, F.lit("+00:00"))), F.try_to_timestamp(text)))


def parsed_time(text: Column) -> Column:
    """Microseconds of a time written as date, blank or T, and time, with - or / and maybe a fraction; else null."""
    return _micros(F.replace(F.replace(F.trim(text), F.lit("/"), F.lit("-")), F.lit("T"), F.lit(" ")))


def batched(memories: DataFrame, batches: DataFrame) -> DataFrame:
    """(text, id, at, owner, batch_no) of the memories whose created_at lies in a batch."""
    bound = lambda c: _micros(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    bounds = batches.select("batch_no", bound("opened_at").alias("opened"), bound("closed_at").alias("closed"))
    rows = memories.select(F.col("content").alias("text"), F.col("id").cast("bigint").alias("id"), parsed_time(F.col("created_at")).alias("at"), "owner")
    return rows.join(bounds, (F.col("at") >= F.col("opened")) & (F.col("at") < F.col("closed"))).select("text", "id", "at", "owner", "batch_no")


def repeated_memories(memories: DataFrame, batches: DataFrame, folder: str) -> DataFrame:
    """(batch_no, id) of the memories of batches after the first that repeat an accepted one of their owner.

    The memories are sketched in one pass and laid down by batch, as batches would arrive. Batch 0 is
    the history: all of it is accepted and written to the state in ``folder``. Each later batch, in
    order, is searched against the state as it is by then, and what it adds is appended; of the state
    a batch reads what its own prefixes and candidates ask for. A batch is a few jobs, so there should
    be as many batches as arrivals, not as records.
    """
    spark = memories.sparkSession
    landed, answers = new_path(spark, "landed"), new_path(spark, "answers")
    sketched(batched(memories, batches)).write.partitionBy("batch").parquet(landed)
    rows = spark.read.schema(_ROW).parquet(landed)
    forest = HashForest(spark, folder)
    numbers = sorted(r[0] for r in batches.select(F.col("batch_no").cast("int")).where("batch_no IS NOT NULL").distinct().collect())
    history, path = cut(first_of_class(rows.where("batch = 0")), "history")
    drop(spark, f"{landed}/batch=0")
    forest.append(history, history.count())
    drop(spark, path)
    spark.createDataFrame([], "id bigint").write.parquet(f"{answers}/batch_no=0")
    for number in (n for n in numbers if n > 0):
        forest._ingest(rows.where(F.col("batch") == number), keep=True).write.parquet(f"{answers}/batch_no={number}")
        forest._forget()
    drop(spark, landed)
    return spark.read.schema("batch_no int, id bigint").parquet(answers).select("batch_no", "id")

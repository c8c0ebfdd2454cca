"""The write chain: gates, duplicate and supersede verdicts, turns and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.config import DEFAULT_TURN_TAG, EXEMPT_MARKER, FIRST_TURN_TAG, NEGATIONS, TURN_TAGS, Write
from tidepool.functions.text import bigram_codes, contains_any, normalised, overlap_rate, strip
from tidepool.operators.heat import protected
from tidepool.operators.records import numbered
from tidepool.sources.shared import cut, drop


def is_shell(text: Column, p: Write = Write()) -> Column:
    """Whether a text says nothing: null, too short, or only the names of speakers."""
    bare = strip(text)
    for speaker in p.speakers:
        bare = F.replace(bare, F.lit(speaker), F.lit(""))
    return F.coalesce((F.length(strip(text)) < p.least_length) | (strip(bare) == ""), F.lit(True))


def is_noise(text: Column, p: Write = Write()) -> Column:
    """Whether a text holds a marker of what a host injects; case counts."""
    return contains_any(text, p.noise)


def gate(text: Column, p: Write = Write()) -> Column:
    """The first gate that rejects a text: shell or noise; else pass."""
    return F.when(is_shell(text, p), "shell").when(is_noise(text, p), "noise").otherwise("pass")


def layer_of(tags: Column) -> Column:
    """Layer of a new memory: core with a protecting tag, else plain (own rule; core_conflicts() says what is blocked)."""
    return F.when(protected(F.lit(None).cast("string"), tags), "core").otherwise("plain")


def turn_text(user: Column, assistant: Column, p: Write = Write()) -> Column:
    """One text of a turn, each side cut for display; null sides are empty."""
    a, b = p.speakers
    cut = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, p.turn_cut)
    return F.concat(F.lit(a), cut(user), F.lit("\n" + b), cut(assistant))


def turn_tag(user: Column, counter: Column) -> Column:
    """Tag of a turn: the first turn's, else of the first group with a word the user said."""
    out = F.when(counter == 1, FIRST_TURN_TAG)
    for tag, words in TURN_TAGS:
        out = out.when(contains_any(user, words), tag)
    return out.otherwise(DEFAULT_TURN_TAG)


def _recent_pairs(rows: DataFrame, window: int, seq: str = "seq", group: str = "owner") -> DataFrame:
    """Each row (n_...) with the rows (o_...) of its group up to ``window`` places before it.

    Rows are keyed by group and block of ``window`` places and meet their own and the former block, so
    the join is an equality on small blocks and no group meets itself.
    """
    block = F.floor((F.col(seq) - 1) / window)
    new = rows.select(*(F.col(c).alias(f"n_{c}") for c in rows.columns), F.explode(F.array(block, block - 1)).alias("block"))
    old = rows.select(*(F.col(c).alias(f"o_{c}") for c in rows.columns), block.alias("block"))
    joined = new.join(old, (F.col(f"n_{group}") == F.col(f"o_{group}")) & (new.block == old.block))
    return joined.where((F.col(f"o_{seq}") < F.col(f"n_{seq}")) & (F.col(f"o_{seq}") >= F.col(f"n_{seq}") - window)).drop("block")


#: Words of 64 bits in the bitmap of a text's pairs of characters.
BITMAP = 4


def _bits(codes: Column) -> Column:
    """A bit of the bitmap for each code."""
    return F.transform(codes, lambda x: F.pmod(F.xxhash64(x), F.lit(64 * BITMAP)).cast("int"))


def _bitmap(bits: Column) -> list[Column]:
    """Words in which the bits are set."""
    none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def word(i: int) -> Column:
        # a shift counts modulo 64
        return F.aggregate(bits, none, lambda acc, b: F.when(F.shiftright(b, 6) == i, acc.bitwiseOR(F.call_function("shiftleft", one, b))).otherwise(acc))

    return [word(i) for i in range(BITMAP)]


def _grams(memories: DataFrame) -> tuple[DataFrame, str]:
    rows = memories.where("content IS NOT NULL").select("owner", "id", "content", "tags")
    rows = numbered(rows, "owner", "id")
    grams = rows.select("owner", "id", "seq", bigram_codes(F.col("content")).alias("grams"), F.length(normalised(F.col("content"))).alias("len"), contains_any(F.col("tags"), (EXEMPT_MARKER,)).alias("exempt"))
    grams = grams.select("*", F.size("grams").alias("size"), _bits(F.col("grams")).alias("bits"))
    grams = grams.select("*", *(w.alias(f"m{i}") for i, w in enumerate(_bitmap(F.col("bits"))))).drop("bits")
    # written once: each row is met as the new and as the old one of its pairs
    return cut(grams, "grams")


def _alike_recent(memories: DataFrame, window: int, least: float, keep: str) -> tuple[DataFrame, str]:
    """(id, old, overlap) of rows and those up to ``window`` places before them whose overlap is ``least`` or more.

    Pairs are made of narrow rows. Bits of one bitmap that the other lacks stand for as many pairs of
    characters that it lacks at least, which bounds the overlap from above; what the bound leaves is
    joined with the pairs of characters themselves.
    """
    grams, path = _grams(memories)
    narrow = grams.select("owner", "id", "seq", "len", "exempt", "size", *(f"m{i}" for i in range(BITMAP)))
    pairs = _recent_pairs(narrow, window).where(keep)
    lacks = lambda a, b: sum((F.bit_count(F.col(f"{a}_m{i}").bitwiseAND(F.bitwise_not(f"{b}_m{i}"))) for i in range(BITMAP)), F.lit(0))
    most = F.least(F.col("n_size") - lacks("n", "o"), F.col("o_size") - lacks("o", "n"))
    pairs = pairs.where(most >= F.lit(least) * F.least("n_size", "o_size")).select(F.col("n_id").alias("id"), F.col("o_id").alias("old"))
    mine, theirs = grams.select("id", F.col("grams").alias("a")), grams.select(F.col("id").alias("old"), F.col("grams").alias("b"))
    found = pairs.join(mine, "id").join(theirs, "old").select("id", "old", overlap_rate(F.col("a"), F.col("b")).alias("overlap"))
    return found.where(F.col("overlap") >= least), path


def duplicates_recent(active: DataFrame, p: Write = Write()) -> DataFrame:
    """(id, duplicate_of, overlap): memories that repeat one of their owner's last ``dedup_window`` rows.

    The window is over the input rows, by id; of several the latest with the highest overlap counts.
    Short texts, null texts and null owners are no duplicates.
    """
    pairs, path = _alike_recent(active, p.dedup_window, p.duplicate, f"n_len >= {p.least_dedup_length}")
    best = pairs.groupBy("id").agg(F.max(F.struct("overlap", "old")).alias("best"))
    done, _ = cut(best.select("id", F.col("best.old").alias("duplicate_of"), "best.overlap"), "repeats")
    drop(active.sparkSession, path)
    return done


def supersedes(active: DataFrame, p: Write = Write()) -> DataFrame:
    """(id, outdated, overlap): for a memory the latest of the ``supersede_window`` before it that it replaces.

    Exempt memories are never replaced, and one is at most for each new memory.
    """
    pairs, path = _alike_recent(active, p.supersede_window, p.supersede, "NOT o_exempt")
    best = pairs.groupBy("id").agg(F.max(F.struct("old", "overlap")).alias("best"))
    done, _ = cut(best.select("id", F.col("best.old").alias("outdated"), "best.overlap"), "superseded")
    drop(active.sparkSession, path)
    return done


def core_conflicts(new: DataFrame, core: DataFrame) -> DataFrame:
    """(id, core_id): new memories (id, owner, content) that say the opposite of a core one of their owner (own rule).

    Two texts are opposite if they are equal once white space, punctuation, case and words of negation
    are dropped, and just one of them had such a word. The first core memory by id is named. They meet
    by equality of what is left, so neither side is sent anywhere whole; null and empty texts oppose
    nothing.
    """

    def said(df: DataFrame, key: str) -> DataFrame:
        low = normalised(F.lower("content"))
        bare = F.regexp_replace(low, "|".join(NEGATIONS), "")
        return df.select(F.col("id").alias(key), "owner", bare.alias("bare"), (bare != low).alias(f"{key}_not")).where("bare <> ''")

    both = said(new, "id").join(said(core, "core_id"), ["owner", "bare"]).where("id_not <> core_id_not")
    return both.groupBy("id").agg(F.min("core_id").alias("core_id"))


def current_state(ledger: DataFrame, key: str = "id") -> DataFrame:
    """The latest entry of each record of an append-only ledger, by (at, seq); nothing is ever deleted."""
    rest = [c for c in ledger.columns if c != key]
    return ledger.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("at", "seq")).alias("r")).select(key, "r.*")

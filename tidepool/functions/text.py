"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, stated in full since pattern engines differ in what \\s holds.
SPACE = r"\t\n\x0b\f\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Fixed value: what normalising drops besides white space.
PUNCTUATION = r"，。！？、；：\"（）【】《》,.!?;:()\[\]<>"
CJK = "[一-鿿]"
#: The same characters one by one, for functions that take no pattern.
SPACE_CHARACTERS = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
PUNCTUATION_CHARACTERS = PUNCTUATION.replace("\\", "")


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def normalised(text: Column) -> Column:
    """Without white space and punctuation; a single quote stays."""
    return F.translate(text, SPACE_CHARACTERS + PUNCTUATION_CHARACTERS, "")


def _pairs(items: Column, joint: Column) -> Column:
    """Each item joined with the next; nothing for fewer than two."""
    pairs = F.zip_with(items, F.slice(items, F.lit(2), F.size(items)), lambda a, b: F.concat(a, joint, b))
    return F.filter(pairs, lambda x: x.isNotNull())


def character_pairs(text: Column) -> Column:
    """Pairs of successive characters, one for each place but the last.

    One pass of a pattern that looks ahead; only texts with characters beyond the basic plane, which
    the pattern engine steps through in halves, are taken apart first.
    """
    ahead = F.regexp_extract_all(text, F.lit("(?s)(?=(..))"), F.lit(1))
    apart = _pairs(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), F.lit(""))
    return F.when(text.rlike(r"[\x{10000}-\x{10FFFF}]"), apart).otherwise(ahead)


def char_bigrams(text: Column) -> Column:
    """Distinct pairs of successive characters of the normalised text."""
    return F.array_distinct(character_pairs(normalised(text)))


def bigram_codes(text: Column) -> Column:
    """char_bigrams() as distinct numbers, two code points in each: compared much faster than texts."""
    code = lambda g: F.ascii(g).cast("bigint") * (1 << 21) + F.ascii(F.substring(g, 2, 1))
    return F.array_distinct(F.transform(character_pairs(normalised(text)), code))


def tokens(text: Column) -> Column:
    """Runs of a-z, 0-9 and _ in lower case, then every CJK character; null gives no token."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.concat(F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0)), F.regexp_extract_all(low, F.lit(CJK), F.lit(0)))


def token_bigrams(items: Column) -> Column:
    """Distinct pairs of successive tokens, joined by _."""
    return F.array_distinct(_pairs(items, F.lit("_")))


def overlap_rate(a: Column, b: Column) -> Column:
    """Share of the smaller of two sets that the other holds; 0 if one is empty (own choice of formula)."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def token_estimate(text: Column) -> Column:
    """Rough number of a chat model's tokens: CJK characters, and 1.3 for each word."""
    text = F.coalesce(text, F.lit(""))
    cjk = F.regexp_count(text, F.lit(CJK))
    words = F.regexp_count(text, F.lit("[A-Za-z0-9_]+"))
    return F.floor(cjk + words * 1.3).cast("bigint")


def concepts(text: Column, stop_words: tuple[str, ...], most: int = 8) -> Column:
    """Runs of 2 to 6 CJK characters or of 3 and more letters, without stop words, the first few."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[一-鿿]{2,6}|[A-Za-z]{3,}"), F.lit(0))
    return F.slice(F.filter(found, lambda w: ~w.isin(*stop_words)), 1, most)


def tags_text(tags: Column) -> Column:
    """A JSON array of tags joined by commas; any other text as it is; null as empty."""
    listed = F.from_json(tags, "array<string>", {"allowSingleQuotes": "false"})
    is_list = tags.rlike(r"^\s*\[") & listed.isNotNull()
    return F.when(is_list, F.array_join(listed, ",")).otherwise(F.coalesce(tags, F.lit("")))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the text holds one of the words, by case; false for null."""
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return F.coalesce(out, F.lit(False))


def clock(text: Column) -> Column:
    """The leading YYYY-MM-DD HH:MM:SS of a text as a time without zone; null if it is none."""
    head = F.substring(text, 1, 19)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), head.try_cast("timestamp_ntz"))


def seconds_between(earlier: Column, later: Column) -> Column:
    """Whole seconds from one time without zone to another, free of the session's zone."""
    return F.floor((later - earlier).cast("interval second").cast("decimal(20,6)")).cast("bigint")


def event_time(text: Column, now: Column) -> Column:
    """When what a text tells of happened, as text; empty if it does not say.

    The day before yesterday and yesterday count from now and keep its clock time; month and day
    are taken in now's year and not validated; else the first ISO date.
    """
    shape = "yyyy-MM-dd HH:mm:ss"
    month, day = (F.regexp_extract(text, r"(\d{1,2})月(\d{1,2})日", i) for i in (1, 2))
    iso = F.regexp_extract(text, r"(\d{4})-(\d{2})-(\d{2})", 0)
    return (
        F.when(F.contains(text, F.lit("昨天")), F.date_format(now - F.expr("INTERVAL 1 DAY"), shape))
        .when(F.contains(text, F.lit("前天")), F.date_format(now - F.expr("INTERVAL 2 DAYS"), shape))
        .when(month != "", F.concat(F.date_format(now, "yyyy"), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"), F.lit(" 00:00:00")))
        .when(iso != "", F.concat(iso, F.lit(" 00:00:00")))
        .otherwise(F.lit(""))
    )

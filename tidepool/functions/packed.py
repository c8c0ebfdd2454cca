"""Splitting of packed label fields, vectorised over Arrow string buffers.

Nothing here loops over rows: each batch becomes one array of code points, quote parity and
delimiter masks are computed for all of it at once, child offsets are read off the masks and the
labels are built as an Arrow list array. Only rows that mix several kinds of quotation marks, or
whose marks do not balance, go through the scalar scanner, which has the same rules.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Marks that quote a label, by opening and closing mark.
PAIRS = {"「": "」", "『": "』", "【": "】", "〔": "〕", "《": "》", "〈": "〉", "“": "”", "‘": "’", "«": "»", "（": "）"}
# Marks a label may hold without being quoted.
JOINERS = ".·・+&_-/"

SEP, LETTER, JOIN, SLASH, BLANK = 0, 1, 2, 3, 4
DQ, SQ, BS = 34, 39, 92
_LIMIT = 0x30000


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.zeros(_LIMIT + 1, np.uint8)
    for code in range(_LIMIT):
        cat = unicodedata.category(chr(code))
        if cat[0] in "LNM" or cat in ("So", "Cf", "Co"):
            table[code] = LETTER
        elif cat == "Zs":
            table[code] = BLANK
    for mark in JOINERS:
        table[ord(mark)] = SLASH if mark == "/" else JOIN
    table[_LIMIT] = LETTER
    return table


def _kinds(codes: np.ndarray) -> np.ndarray:
    return _classes()[np.minimum(codes, _LIMIT)]


def _codes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string array without nulls, and where each row starts."""
    strings = strings.cast(pa.large_string())
    _, offsets, data = strings.buffers()
    off = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    chars = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=chars[1:])
    return codes, chars[off - off[0]]


def _plain_kept(kind: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Mask of the unquoted characters that belong to a label; kind is SEP for all quoted ones."""
    before = np.where(first, SEP, np.roll(kind, 1))
    after = np.where(last, SEP, np.roll(kind, -1))
    blank_l, blank_r = before == BLANK, after == BLANK
    kind = np.where((kind == SLASH) & (blank_l | blank_r | first | last), SEP, kind)
    kind = np.where((kind == JOIN) & blank_l & blank_r, SEP, kind)
    before = np.where(first, SEP, np.roll(kind, 1))
    after = np.where(last, SEP, np.roll(kind, -1))
    solid = (LETTER, JOIN, SLASH)
    inner = (kind == BLANK) & np.isin(before, solid) & np.isin(after, solid)
    return np.isin(kind, solid) | inner


def _unescape(text: str) -> str:
    try:
        return json.loads(f'"{text.replace(chr(10), chr(92) + "n")}"')
    except ValueError:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _scan(text: str) -> list[str]:
    """The same rules for one row, one character at a time: for mixed or unbalanced marks."""
    kinds = _kinds(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)).copy()
    n, quoted, i = len(text), [], 0
    boundary = lambda j: j < 0 or j >= n or kinds[j] in (SEP, BLANK)
    while i < n:
        ch, end = text[i], -1
        if ch in PAIRS:
            end = text.find(PAIRS[ch], i + 1)
            body = text[i + 1 : end]
        elif ch == '"' or ch == "'" and boundary(i - 1):
            j = i + 1
            while j < n:
                if text[j] == "\\":
                    j += 2
                elif text[j] == ch and text[j + 1 : j + 2] == ch and (j > i + 1 or not boundary(j + 2)):
                    j += 2
                elif text[j] == ch and (ch == '"' or boundary(j + 1)):
                    end = j
                    break
                else:
                    j += 1
            body = text[i + 1 : end].replace(ch * 2, ch)
            body = _unescape(body.replace('"', '\\"').replace('\\\\"', '\\"')) if "\\" in body else body
        if end > 0:
            quoted.append((i, end, body))
            kinds[i : end + 1] = SEP
            i = end
        i += 1
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        first[0] = last[-1] = True
    kept = _plain_kept(kinds, first, last)
    out, i, marks = [], 0, {a: (b, body) for a, b, body in quoted}
    listed = text.strip().startswith("[")
    while i < n:
        if i in marks:
            out.append(marks[i][1])
            i = marks[i][0] + 1
        elif kept[i]:
            j = i
            while j < n and kept[j] and j not in marks:
                j += 1
            if not (listed and text[i:j] in ("null", "None")):
                out.append(text[i:j])
            i = j
        else:
            i += 1
    return [y for y in (x.strip() for x in out) if y]


def _split_distinct(strings: pa.Array) -> pa.ListArray:
    codes, starts = _codes(strings)
    rows, n = len(strings), len(codes)
    if not n:
        return pa.ListArray.from_arrays(pa.array(np.zeros(rows + 1, np.int32)), pa.array([], pa.string()))
    row = np.repeat(np.arange(rows), np.diff(starts))
    place = np.arange(n)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    full = np.diff(starts) > 0
    first[starts[:-1][full]] = True
    last[starts[1:][full] - 1] = True
    kind = _kinds(codes)
    # a mark after an odd run of backslashes is escaped
    solid = np.maximum.accumulate(np.where(codes != BS, place, -1))
    solid = np.maximum(np.where(place > 0, np.roll(solid, 1), -1), starts[row] - 1)
    escaped = ((place - 1 - solid) & 1).astype(bool)

    def parity(mask: np.ndarray) -> np.ndarray:
        total = np.cumsum(mask)
        return (total - (total - mask)[starts[row]]) & 1

    edge_l = first | np.isin(np.roll(kind, 1), (SEP, BLANK))
    edge_r = last | np.isin(np.roll(kind, -1), (SEP, BLANK))
    double = (codes == DQ) & ~escaped
    single = (codes == SQ) & ~escaped & (edge_l | edge_r)
    opens = np.isin(codes, [ord(x) for x in PAIRS])
    closes = np.isin(codes, [ord(x) for x in PAIRS.values()])
    per_row = lambda mask: np.bincount(row[mask], minlength=rows)
    n_double, n_single, n_open, n_close = map(per_row, (double, single, opens, closes))
    families = (n_double > 0).astype(int) + (n_single > 0) + (n_open + n_close > 0)
    # pairs must alternate, each opening mark followed by its own closing mark
    at = np.flatnonzero(opens | closes)
    bad = np.zeros(rows, bool)
    if len(at):
        partner = {ord(a): ord(b) for a, b in PAIRS.items()}
        expected = np.array([partner.get(int(x), 0) for x in codes[at]])
        wrong = opens[at] & (np.append(codes[at][1:], 0) != expected) | (closes[at] & ~np.insert(opens[at][:-1], 0, False))
        bad[row[at[wrong]]] = True
    slow = (families > 1) | (n_double & 1).astype(bool) | (n_single & 1).astype(bool) | (n_open != n_close) | bad

    quote = double | single
    inside = parity(quote).astype(bool)
    opening, closing = quote & inside, quote & ~inside
    again = closing & ~last & np.roll(opening, -1)  # a doubled mark stands for itself
    doubled = np.roll(again, 1) & ~first
    level = np.cumsum(opens) - np.cumsum(closes)
    level = level - np.where(starts[row] > 0, level[starts[row] - 1], 0)
    begin = (opening & ~doubled) | opens
    content = (inside & ~quote) | (again & quote) | ((level > 0) & ~opens)
    content &= ~(closes)
    stopped = content | quote | opens | closes
    plain = _plain_kept(np.where(stopped, SEP, kind), first, last)
    begin |= plain & (first | ~np.roll(plain, 1))
    kept = plain | content
    fast = ~slow[row]
    begin, kept = begin & fast, kept & fast
    label = np.cumsum(begin) - 1
    n_labels = int(label[-1]) + 1
    label_row = row[begin]
    text_codes = codes[kept]
    width = 1 + (text_codes > 0x7F).astype(np.int64) + (text_codes > 0x7FF) + (text_codes > 0xFFFF)
    sizes = np.bincount(label[kept], weights=width, minlength=n_labels).astype(np.int64) if n_labels else np.zeros(0, np.int64)
    offsets = np.zeros(n_labels + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    data = text_codes.astype("<u4").tobytes().decode("utf-32-le").encode()
    labels = pa.LargeStringArray.from_buffers(n_labels, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)).cast(pa.string())
    # escapes inside quotation marks are given back plain
    quoted_label = np.zeros(n_labels, bool)
    quoted_label[label[begin & ~plain]] = True
    with_escape = np.zeros(n_labels, bool)
    with_escape[label[kept & (codes == BS)]] = True
    with_escape &= quoted_label
    if with_escape.any():
        which = np.flatnonzero(with_escape)
        fixed = [_unescape(x) for x in labels.take(pa.array(which)).to_pylist()]
        mask = pa.array(with_escape)
        labels = pc.replace_with_mask(labels, mask, pa.array(fixed, pa.string()))
    labels = pc.utf8_trim_whitespace(labels)
    # an unquoted null in a bracketed list is no label
    head = np.zeros(rows, bool)
    ink = np.flatnonzero(kind != BLANK)
    lead = ink[np.unique(row[ink], return_index=True)[1]]
    head[row[lead]] = codes[lead] == 91
    nulls = pc.is_in(labels, pa.array(["null", "None"])).to_numpy(zero_copy_only=False) & ~quoted_label & head[label_row]
    good = (pc.binary_length(labels).to_numpy(zero_copy_only=False) > 0) & ~nulls
    labels, label_row = labels.filter(pa.array(good)), label_row[good]
    if slow.any():
        which = np.flatnonzero(slow)
        lists = [_scan(x) for x in strings.take(pa.array(which)).to_pylist()]
        more = pa.array([x for xs in lists for x in xs], pa.string())
        more_row = np.repeat(which, [len(xs) for xs in lists])
        order = np.argsort(np.concatenate([label_row, more_row]), kind="stable")
        labels = pa.concat_arrays([labels, more]).take(pa.array(order))
        label_row = np.concatenate([label_row, more_row])[order]
    ends = np.zeros(rows + 1, np.int64)
    np.cumsum(np.bincount(label_row, minlength=rows), out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), labels)


def split_labels(strings: pa.Array | pa.ChunkedArray) -> pa.ListArray:
    """The labels of each packed field, in order; null, empty and blank fields give an empty list.

    Rows that repeat a field are split once for each batch: the scan runs over the distinct fields
    of a dictionary encoding and the lists are taken back by index.
    """
    if isinstance(strings, pa.ChunkedArray):
        strings = strings.combine_chunks()
    coded = pc.fill_null(strings.cast(pa.string()), "").dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return _split_distinct(coded.dictionary).take(coded.indices)


def flatten_labels(lists: pa.ListArray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Parent ordinal, position from 1, and label of every label."""
    parents = pc.list_parent_indices(lists)
    p = parents.to_numpy(zero_copy_only=False).astype(np.int64)
    counts = np.bincount(p, minlength=len(lists)) if len(p) else np.zeros(len(lists), np.int64)
    starts = np.cumsum(counts) - counts
    return parents, pa.array((np.arange(len(p)) - starts[p] + 1).astype(np.int32)), lists.flatten()

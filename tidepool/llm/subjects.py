"""Subject areas of documents: anchored non-negative factorisation of the sentence-term matrix."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.canonical import transducer

TERMS = 1 << 16
#: Components for how an area is talked about, whatever the area, and for what belongs to none.
FRAMES, BACKGROUND = 4, 12
#: Most labelled documents the factors are fitted on, and the rounds of alternating updates.
SAMPLE, ROUNDS = 3000, 15
#: Areas there may be at most.
MOST_AREAS = 1000
#: Entries by which a term's rates in the areas are smoothed.
PRIOR = 10.0
#: Longer documents are not fitted on (they are classified like any other).
SAMPLE_LENGTH = 20_000
#: A sentence belongs to its strongest area if areas and frames explain so much of it, the area so much.
TALK, SHARE = 0.5, 0.01
#: A document has an area if so many of its sentences or list lines have it.
LEAST_SENTENCES = 3


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """0: other, 1: a letter of a word, 2: a character that is a token of its own, 3: a sentence's end, 4: a full stop."""
    out = np.zeros(0x30001, np.uint8)
    for code in range(0x30000):
        if chr(code).isalpha():
            out[code] = 2 if 0x3040 <= code <= 0x30FF or 0x3400 <= code <= 0x9FFF or code >= 0x20000 else 1
    out[[ord(x) for x in "。!?;；！？\n\r\x85  "]] = 3
    out[ord(".")] = 4
    return out


def sentence_terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of each sentence, sentence of each term, term): terms are runs of one to three tokens.

    Tokens are words and single CJK characters of the consistent form in lower case; a single CJK
    character is no term. Sentences end at closing marks and line ends. Terms are hashed to TERMS.
    """
    form = transducer().form
    lines = [form(x).lower() if x else "" for x in texts]
    code = np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(x) + 1 for x in lines], np.int64)
    doc = np.repeat(np.arange(len(lines)), sizes)
    kind = _kinds()[np.minimum(code, 0x30000)]
    after = np.append(code[1:], 10)
    before = np.append(10, code[:-1])
    stop = (kind == 3) | (kind == 4) & ((after == 32) | (after == 10) | (after == 13)) & ~((before >= 48) & (before <= 57))
    sentence = np.cumsum(stop) - stop
    word = kind == 1
    begin = word & ~np.append(False, word[:-1]) | (kind == 2)
    part = word | (kind == 2)
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(len(code)) - np.maximum.accumulate(np.where(begin, np.arange(len(code)), 0))
    plural = word & (code == 115) & ~np.append(word[1:], False) & (place > 2)
    value = np.where(part & ~plural, _mix(code.astype(np.uint64) * np.uint64(0x9E3779B1) + place.astype(np.uint64) * np.uint64(0x85EBCA77C2B2AE63)), np.uint64(0))
    token = _mix(np.add.reduceat(value, starts))
    single = kind[starts] == 2
    in_sentence = sentence[starts]
    two = _mix(token[:-1] * np.uint64(3) + token[1:])
    ok2 = in_sentence[:-1] == in_sentence[1:]
    three = _mix(two[:-1] * np.uint64(5) + token[2:])
    ok3 = ok2[:-1] & ok2[1:]
    terms = np.concatenate([token[~single], two[ok2], three[ok3]])
    of = np.concatenate([in_sentence[~single], in_sentence[:-1][ok2], in_sentence[:-2][ok3]])
    order = np.argsort(of, kind="stable")
    terms, of = (terms[order] >> np.uint64(48)).astype(np.int64), of[order]
    kept, of = np.unique(of, return_inverse=True)
    first = np.searchsorted(sentence, kept)
    return doc[first], of, terms


def _blocks(row: np.ndarray, entries: int = 250_000) -> Iterator[slice]:
    """Slices of whole rows with about so many entries, so that work arrays stay small."""
    at = 0
    while at < len(row):
        end = min(at + entries, len(row))
        end = int(np.searchsorted(row, row[end - 1], "right"))
        yield slice(at, end)
        at = end


def solve(h: np.ndarray, row: np.ndarray, term: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Mixtures of the rows over the fixed components h (terms x components), by multiplicative updates."""
    out = np.zeros((int(row[-1]) + 1 if len(row) else 0, h.shape[1]), np.float32)
    for part in _blocks(row):
        local = row[part] - row[part.start]
        starts = np.flatnonzero(np.append(True, local[1:] != local[:-1]))
        w = np.full((len(starts), h.shape[1]), 1.0 / h.shape[1], np.float32)
        columns = h[term[part]]
        for _ in range(rounds):
            both = w[local] * columns
            both *= (1.0 / np.maximum(both.sum(axis=1), 1e-30))[:, None]
            w = np.add.reduceat(both, starts, axis=0)
            w /= w.sum(axis=1, keepdims=True)
        out[row[part.start] : row[part.stop - 1] + 1] = w
    return out


def _rates(counts: np.ndarray, prior: float) -> np.ndarray:
    """Rates of terms (rows) in groups (columns), relative to the groups' sizes and smoothed by so many entries."""
    base = np.maximum(counts.sum(axis=0), 1e-9)
    return counts / (base / base.sum()) + prior


def anchors(own: np.ndarray, term: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """How much each term (rows) may count in each area's component, in a frame and in the background.

    own has, for each entry of the matrix, the areas of its document (shared evenly). Two comparisons
    of smoothed rates are made. Between the areas: a term belongs to one area or is spread evenly; what
    is spread may not count for an area, nor what belongs to one for a frame, so frames cannot take
    over the vocabulary of the largest area. Between documents with and without an area: what is as
    frequent without one may not count for a frame, nor what is not for the background.
    """
    n_areas = own.shape[1]
    rate = _rates(np.stack([np.bincount(term, weights=own[:, a], minlength=TERMS) for a in range(n_areas)], axis=1), prior)
    share = rate / rate.sum(axis=1, keepdims=True)
    spread = np.exp(-(share * np.log(share)).sum(axis=1))
    even = np.clip((spread - 1) / max(n_areas - 1, 1), 0, 1)[:, None]
    idle = ~own.any(axis=1)
    usual = np.ones((TERMS, 1))
    if idle.any() and not idle.all():
        r = _rates(np.stack([np.bincount(term, weights=w, minlength=TERMS) for w in (idle, ~idle)], axis=1), prior)
        usual = (2 * r[:, 0] / r.sum(axis=1))[:, None]
    frame, background = even**3 * np.clip(2 - usual, 0, 1) ** 2, np.clip(usual, 0, 1) ** 2
    return np.hstack([share * n_areas * (1 - even), np.repeat(frame, FRAMES, axis=1), np.repeat(background, BACKGROUND, axis=1)]).astype(np.float32)


def fit(texts: list[str], areas: list[set[int]], n_areas: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Components (terms x (areas + frames + background)), each summing to one.

    The rows are the sentences of labelled texts. A row may use the components of its document's
    areas, the frames if there are any, and the background, no others; a term may count in an area
    or a frame as anchors() says. From a seeded start, mixtures and components are updated in turn
    for the KL divergence.
    """
    doc, row, term = sentence_terms(texts)
    k = n_areas + FRAMES + BACKGROUND
    allowed = np.zeros((len(texts), k), np.float32)
    own_areas = np.zeros((len(texts), n_areas), np.float32)
    allowed[:, n_areas + FRAMES :] = 1
    for i, own in enumerate(areas):
        allowed[i, list(own)] = 1
        allowed[i, n_areas : n_areas + FRAMES] = bool(own)
        own_areas[i, list(own)] = 1 / max(len(own), 1)
    mask = allowed[doc]
    held = anchors(own_areas[doc][row], term)
    rng = np.random.default_rng(seed)
    h = (1 + 0.5 * rng.random((TERMS, k))).astype(np.float32) * held
    h /= np.maximum(h.sum(axis=0), 1e-30)
    w = mask * (1 + 0.1 * rng.random(mask.shape)).astype(np.float32)
    w /= np.maximum(w.sum(axis=1, keepdims=True), 1e-30)
    for _ in range(rounds):
        fresh = np.full((TERMS, k), 1e-3, np.float32)
        for part in _blocks(row):
            r, t = row[part], term[part]
            both = w[r] * h[t]
            both *= (1.0 / np.maximum(both.sum(axis=1), 1e-30))[:, None]
            own = slice(r[0], r[-1] + 1)
            new = np.add.reduceat(both, np.flatnonzero(np.append(True, r[1:] != r[:-1])), axis=0) * mask[own] + 1e-6 * mask[own]
            w[own] = new / new.sum(axis=1, keepdims=True)
            by_term = np.argsort(t, kind="stable")
            seen, starts = np.unique(t[by_term], return_index=True)
            fresh[seen] += np.add.reduceat(both[by_term], starts, axis=0)
        h = fresh * held
        h /= np.maximum(h.sum(axis=0), 1e-30)
    return h


def area_counts(h: np.ndarray, n_areas: int, texts: list[str | None]) -> np.ndarray:
    """Sentences and list lines of each text (rows) that belong to each area (columns)."""
    out = np.zeros((len(texts), n_areas), np.int64)
    doc, row, term = sentence_terms(texts)
    if len(row):
        w = solve(h, row, term)
        best = w[:, :n_areas].argmax(axis=1)
        talk = (w[:, : n_areas + FRAMES].sum(axis=1) >= TALK) & (w[np.arange(len(w)), best] >= SHARE)
        np.add.at(out, (doc[talk], best[talk]), 1)
    return out


def learn_areas(documents: DataFrame, labels: DataFrame, areas: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, list[str]]:
    """Components fitted on at most ``sample`` labelled documents, and the areas in their order.

    Labels are compared without regard to case and surrounding blanks; those that are neither an
    area nor 'none' are no labels. The documents are taken by a hash of their id; of a repeated id one
    text is. More than MOST_AREAS areas are an error: each is a component of the factor matrix.
    """
    names = [r[0] for r in areas.select("area").where("area IS NOT NULL").distinct().orderBy("area").limit(MOST_AREAS + 1).collect()]
    if len(names) > MOST_AREAS:
        raise ValueError(f"more than {MOST_AREAS} areas")
    known = {x.strip().lower(): i for i, x in enumerate(names)}
    clean = labels.select("doc_id", F.lower(F.trim("area")).alias("area")).where(F.col("area").isin(*known, "none"))
    chosen = clean.groupBy("doc_id").agg(F.collect_set("area").alias("own")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = documents.where(F.length("text") <= SAMPLE_LENGTH).select("doc_id", "text")
    rows = sorted(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("own").alias("own")).collect())
    if not rows:
        return np.full((TERMS, len(names) + FRAMES + BACKGROUND), 1.0 / TERMS, np.float32), names
    return fit([r[1] for r in rows], [{known[x] for x in r[2] if x in known} for r in rows], len(names)), names


def subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame, least: int = LEAST_SENTENCES, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, area, sentences) of the areas to which a document gives at least ``least`` sentences or list lines.

    The sentence-term matrix of a bounded sample of labelled documents is factored into anchored
    components: one for each area, frames (how any area is talked about) and background (talk about
    the memory, the session and errands, and mentions in passing, which documents without an area
    teach). Every sentence of every document is then expressed by the fixed components and counted
    for its strongest area if areas and frames explain it. One narrow pass over whole texts; what is
    sent to all is the factor matrix, of a fixed size.

    Null, empty and blank texts have no area; repeated ids give rows each; labels of missing
    documents are ignored; without labels nothing is found; an empty table gives an empty result.
    """
    h, names = learn_areas(documents, labels, areas, sample)
    factors = documents.sparkSession.sparkContext.broadcast(h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, start, size = batch.column(1).to_pylist(), 0, 0
            for i, x in enumerate(texts):
                size += len(x or "")
                if size > 500_000 or i == len(texts) - 1:
                    counts = area_counts(factors.value, len(names), texts[start : i + 1])
                    d, a = np.nonzero(counts >= least)
                    keys = batch.column(0).take(pa.array(start + d))
                    yield pa.RecordBatch.from_arrays([keys, pa.array([names[j] for j in a], pa.string()), pa.array(counts[d, a])], names=["doc_id", "area", "sentences"])
                    start, size = i + 1, 0

    return documents.select(F.col("doc_id").cast("bigint"), "text").where("text IS NOT NULL").mapInArrow(run, "doc_id bigint, area string, sentences bigint")


def composition(found: DataFrame) -> DataFrame:
    """(area, documents, sentences) of a corpus from the rows of subjects()."""
    return found.groupBy("area").agg(F.count("*").alias("documents"), F.sum("sentences").alias("sentences"))

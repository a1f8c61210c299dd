"""Problem 7: evaluation passages inside a corpus.

A passage counts as leaked if a run of its words stands in a document with at most a few edits. By
the q-gram lemma a run of L characters with e edits shares at least L - q + 1 - q * e of its q-grams
with the document, on diagonals that drift by at most e. Shared q-grams are counted in overlapping
bands of diagonals, regions that reach the bound are kept, and each is verified by an alignment
inside its band.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.text import mixed, words_of

#: Characters of passages that are broadcast at once, the longest passage aside; more are searched for block by block.
ITEM_CHARS = 8_000_000
#: A q-gram with more places than this among the passages is counted only where a run has too few others.
COMMON = 8
#: Runs of regions that are counted at once.
PAIRS_AT_ONCE = 2_000_000
#: Characters of documents that are searched at once.
BATCH_CHARS = 2_000_000
SPACE, BREAK = 32, 10


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(chars: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every ``q`` consecutive characters, put together from halves."""
    base = 0x9E3779B97F4A7C15
    if len(chars) < q:
        return np.zeros(0, np.uint64)
    power, width = mixed(chars.astype(np.uint64)), 1
    out, done = None, 0
    while True:
        if q & width:
            step = np.uint64(pow(base, width, 2**64))
            out = power if out is None else out[: len(power) - done] * step + power[done : done + len(out)][: len(power) - done]
            done += width
        if done == q:
            return mixed(out)
        power = power[:-width] * np.uint64(pow(base, width, 2**64)) + power[width:]
        width *= 2


@dataclass
class Passages:
    """The passages of a block with the places of their q-grams, and the bound of each run of words."""

    ids: pa.Array
    text: np.ndarray
    starts: np.ndarray
    q: int
    edits: int
    grams: np.ndarray
    first: np.ndarray
    places: np.ndarray
    filter: np.ndarray
    run_item: np.ndarray
    run_from: np.ndarray
    run_to: np.ndarray
    run_bound: np.ndarray
    item_runs: np.ndarray
    item_bound: np.ndarray
    counted: np.ndarray


def prepared(ids: pa.Array, texts: list[str | None], words: int, edits: int) -> Passages | None:
    """The index of a block of passages; none if no passage has ``words`` words."""
    kept, chars, runs = [], [], []
    at = 0
    for i, text in enumerate(texts):
        found = words_of(text)
        if len(found) < words:
            continue
        lengths = np.array([len(w) for w in found])
        begin = np.r_[0, np.cumsum(lengths + 1)[:-1]]
        runs += [(len(kept), at + begin[k], at + begin[k + words - 1] + lengths[k + words - 1]) for k in range(len(found) - words + 1)]
        own = characters(" ".join(found) + "\n")
        kept.append(i), chars.append(own)
        at += len(own)
    if not kept:
        return None
    text = np.concatenate(chars)
    starts = np.cumsum([0] + [len(c) for c in chars[:-1]])
    item, low, high = np.array(runs).T
    q = max(1, min(16, int((high - low).min()) // (edits + 1)))
    hashes = gram_hashes(text, q)
    inside = np.convolve(text == BREAK, np.ones(q, int))[q - 1 : q - 1 + len(hashes)] == 0
    values, number, count = np.unique(hashes, return_inverse=True, return_counts=True)
    rare = inside & (count[number.ravel()] <= COMMON)
    upto = np.r_[0, np.cumsum(rare)]
    bound = upto[high - q + 1] - upto[low] - q * edits
    counted = rare.copy()
    for r in np.nonzero(bound < 1)[0]:  # too few rare q-grams: all of the run's
        counted[low[r] : high[r] - q + 1] = True
    upto = np.r_[0, np.cumsum(counted)]
    bound = np.maximum(1, upto[high - q + 1] - upto[low] - q * edits)
    places = np.nonzero(counted)[0]
    places = places[np.argsort(hashes[places], kind="stable")]
    grams, first = np.unique(hashes[places], return_index=True)
    bits = np.zeros(1 << 20, bool)
    bits[(grams >> np.uint64(44)).astype(np.int64)] = True
    item_bound = np.full(len(kept), np.iinfo(np.int64).max)
    np.minimum.at(item_bound, item, bound)
    item_runs = np.searchsorted(item, np.arange(len(kept) + 1))
    return Passages(ids.take(pa.array(kept)), text, starts, q, edits, grams, np.r_[first, len(places)], places, bits, item, low, high, bound, item_runs, item_bound, upto)


def aligned(own: Passages, runs: np.ndarray, text: np.ndarray, shift: np.ndarray, slack: int) -> np.ndarray:
    """Fewest edits that turn each run into a piece of ``text`` starting up to ``slack`` characters around its place plus ``shift``."""
    low, size = own.run_from[runs], own.run_to[runs] - own.run_from[runs]
    width = 2 * slack + 1
    padded = np.concatenate([np.full(slack + 1, BREAK, np.uint32), text, np.full(slack + int(size.max()) + 1, BREAK, np.uint32)])
    place = np.clip(low + shift, -slack - 1, len(text)) + 1  # of the first character, slack to the left, in padded
    cost = np.zeros((width, len(runs)), np.int32)
    best = np.full(len(runs), np.iinfo(np.int32).max)
    for i in range(int(size.max())):
        live = i < size
        letter = own.text[np.minimum(low + i, len(own.text) - 1)]
        new = np.empty_like(cost)
        for j in range(width):
            new[j] = cost[j] + (padded[np.minimum(place + i + j, len(padded) - 1)] != letter)
            if j + 1 < width:
                np.minimum(new[j], cost[j + 1] + 1, out=new[j])
            if j:
                np.minimum(new[j], new[j - 1] + 1, out=new[j])
        cost = np.where(live, new, cost)
        over = i + 1 == size
        best[over] = cost[:, over].min(axis=0)
    return best


def search(own: Passages, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(run, place in text, edits)`` of the runs of passages that regions of ``text`` hold."""
    none = (np.zeros(0, np.int64),) * 3
    hashes = gram_hashes(text, own.q)
    at = np.nonzero(own.filter[(hashes >> np.uint64(44)).astype(np.int64)])[0]
    slot = np.minimum(np.searchsorted(own.grams, hashes[at]), len(own.grams) - 1)
    hit = own.grams[slot] == hashes[at]
    at, slot = at[hit], slot[hit]
    many = own.first[slot + 1] - own.first[slot]
    doc = np.repeat(at, many)
    place = own.places[np.repeat(own.first[slot], many) + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)]
    if not len(doc):
        return none
    item = np.searchsorted(own.starts, place, side="right") - 1
    diagonal = doc - place + len(own.text)
    width = own.edits + 1
    band = diagonal // width
    item, band, place = np.tile(item, 2), np.concatenate([band, band - 1]), np.tile(place, 2)
    if own.edits == 0:
        item, band, place = (x[: len(doc)] for x in (item, band, place))
    order = np.lexsort((place, item, band))
    item, band, place = item[order], band[order], place[order]
    edge = np.r_[True, (np.diff(band) != 0) | (np.diff(item) != 0)]
    begin = np.nonzero(edge)[0]
    count = np.diff(np.r_[begin, len(item)])
    enough = count >= own.item_bound[item[begin]]
    begin, count = begin[enough], count[enough]
    if not len(begin):
        return none
    # of a region's runs only those that its q-grams touch; runs ascend over all passages
    region = np.repeat(np.arange(len(begin)), count)
    mine = place[np.repeat(begin, count) + np.arange(len(region)) - np.repeat(np.cumsum(count) - count, count)]
    low, high = np.searchsorted(own.run_to, place[begin] + own.q), np.searchsorted(own.run_from, place[begin + count - 1], side="right")
    wide = np.int64(len(own.text) + 1)
    key = region * wide + mine
    runs, shifts = [], []
    ends = np.cumsum(np.maximum(high - low, 0))
    step = 0
    while step < len(begin):  # a bounded number of runs at a time
        till = max(step + 1, int(np.searchsorted(ends, (ends[step - 1] if step else 0) + PAIRS_AT_ONCE)))
        many = np.maximum(high[step:till] - low[step:till], 0)
        r = np.repeat(low[step:till], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        g = np.repeat(np.arange(step, till), many)
        shared = np.searchsorted(key, g * wide + own.run_to[r] - own.q + 1) - np.searchsorted(key, g * wide + own.run_from[r])
        keep = shared >= own.run_bound[r]
        runs.append(r[keep]), shifts.append(band[begin[g[keep]]] * width - len(own.text))
        step = till
    if not sum(map(len, runs)):
        return none
    run, shift = np.concatenate(runs), np.concatenate(shifts)
    edits = np.concatenate([aligned(own, run[k : k + 20_000], text, shift[k : k + 20_000] + own.edits, 2 * own.edits) for k in range(0, len(run), 20_000)])
    fine = edits <= own.edits
    return run[fine], (own.run_from[run] + shift)[fine], edits[fine]


def whole_words(own: Passages, run: np.ndarray, place: np.ndarray, edits: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which runs stand in ``text`` without an edit, as whole words, at their place or up to the slack of their band beside it."""
    found = np.zeros(len(run), bool)
    candidates = np.nonzero(edits == 0)[0]
    size = own.run_to[run] - own.run_from[run]
    padded = np.r_[np.uint32(BREAK), text, np.uint32(BREAK)]
    apart = (padded == SPACE) | (padded == BREAK)
    for offset in range(-own.edits, 3 * own.edits + 1):
        p = place[candidates] + offset
        n = size[candidates]
        inside = (p >= 0) & (p + n <= len(text))
        here, p, n = candidates[inside], p[inside], n[inside]
        edge = apart[p] & apart[p + n + 1]  # the character before and the one behind
        here, p, n = here[edge], p[edge], n[edge]
        if len(here):
            starts = np.cumsum(n) - n
            at = np.arange(n.sum()) - np.repeat(starts, n)
            same = text[np.repeat(p, n) + at] == own.text[np.repeat(own.run_from[run[here]], n) + at]
            found[here] |= np.logical_and.reduceat(same, starts)
    return found


def leaks(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", words: int = 12, edits: int = 1) -> DataFrame:
    """``(doc, item, edits, whole)``: documents that contain at least ``words`` consecutive words of a passage.

    Texts are compared as lower-cased words joined by single spaces; up to ``edits`` characters of a run may be inserted,
    deleted or replaced. ``edits`` in the result is the fewest found for the pair, ``whole`` tells whether a run stands in the document
    without any, word for word. The bound of the q-gram lemma loses nothing: q is chosen so that it is positive for
    every run, and frequent q-grams are left uncounted only in runs whose bound holds without them.

    Null texts count as empty; empty texts and passages of fewer than ``words`` words match nothing; rows with null ids
    are left out; repeated ids count once. Ids may be of any type. Other columns are ignored. Empty tables give an empty result. Documents are
    read once for every ``ITEM_CHARS`` characters of passages; only that many, or the longest passage, are held at once.
    """
    spark = df.sparkSession
    doc_kind, item_kind = dict(df.dtypes)[id_col], dict(items.dtypes)[item_id_col]
    wanted = items.where(F.col(item_id_col).isNotNull()).select(F.col(item_id_col).alias("i"), F.col(item_text_col).alias("t"))
    total = wanted.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // ITEM_CHARS))
    docs = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    schema = f"doc {doc_kind}, item {item_kind}, edits int, whole boolean"
    found = spark.createDataFrame([], schema)
    for block in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block) if blocks > 1 else wanted
        rows = part.orderBy("i", "t").toArrow()
        own = prepared(rows.column("i").combine_chunks(), rows.column("t").to_pylist(), words, edits) if rows.num_rows else None
        if own is None:
            continue
        shared = spark.sparkContext.broadcast(own)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value

            def flush(docs: pa.Array, texts: list[str]) -> pa.RecordBatch:
                apart = "\n" * (own.edits + 1)  # too many characters for a run to reach into the next text
                whole = characters(apart.join(texts))
                starts = np.cumsum([0] + [len(t) + len(apart) for t in texts[:-1]])
                run, place, cost = search(own, whole)
                exact = whole_words(own, run, place, cost, whole)
                middle = place + own.edits + (own.run_to[run] - own.run_from[run]) // 2
                doc = np.searchsorted(starts, np.clip(middle, 0, len(whole)), side="right") - 1
                pair = doc * len(own.ids) + own.run_item[run]
                order = np.lexsort((cost, pair))
                first = np.nonzero(np.r_[True, np.diff(pair[order]) != 0])[0] if len(order) else order
                exact = np.logical_or.reduceat(exact[order], first) if len(order) else exact
                best = order[first]
                return pa.RecordBatch.from_arrays([docs.take(pa.array(doc[best])), own.ids.take(pa.array(own.run_item[run[best]])), pa.array(cost[best], pa.int32()), pa.array(exact)], names=["doc", "item", "edits", "whole"])

            for batch in batches:
                texts, size, begin = [], 0, 0
                for at, text in enumerate(batch.column("t").to_pylist()):
                    texts.append(" ".join(words_of(text)))
                    size += len(texts[-1]) + 1
                    if size > BATCH_CHARS or at + 1 == batch.num_rows:
                        yield flush(batch.column("doc").slice(begin, len(texts)), texts)
                        texts, size, begin = [], 0, at + 1

        found = found.unionByName(docs.mapInArrow(scan, schema))
    return found.groupBy("doc", "item").agg(F.min("edits").alias("edits"), F.bool_or("whole").alias("whole"))

"""Problem 8: pages made of keywords, links, menus or product tags instead of sentences.

A text is cut into windows of about a sentence. Each window is measured (function words,
repetition, entropy, markup, separators, runs without function words), compared with the robust
centre and scatter of all windows of its language, and flagged if its Mahalanobis distance, counted in
the directions of spam only, is large. A text is spam if flagged windows make up more than half of it.

The function words and the vocabulary of each language are learned from the corpus. Texts in a language that was not learned
are judged by everything but their function words.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsieve.llm.text import words_at
from docsieve.plans.durable import durable, release

_END = re.compile(r"[.!?;·…]+[\"'”»“’)]*(?:\s+|$)")
_MARKUP = re.compile(r"<[^<>]*>|\]\([^()\s]*\)|https?://\S+|www\.\S+|//\S+\.\S+|[\w-]+(?:\.[\w-]+)+/\S*|#\w[\w-]*")
_MARKS = ("/", "<", "#", "](", "www.")  # no markup without one of these
_BREAK = re.compile(r"[|•»«→›/]|\s-\s|\b\w+-\d+\b|\d+[.,]\d\d\b|,")

FEATURES = ("function", "repetition", "entropy", "markup", "breaks", "run")
#: In which direction each feature speaks for spam.
TOWARDS = np.array([-1.0, 1.0, -1.0, 1.0, 1.0, 1.0])
#: Scatter below which a feature is not taken to vary: most windows of prose have no markup at all.
LEAST_SCATTER = np.array([0.08, 0.08, 0.08, 0.05, 0.08, 0.12])
#: Scatters that a feature counts at most in a window that ends as a sentence does: there, a lack of function words alone, as in notes, makes no spam.
MOST_FAR = np.array([3.6, np.inf, np.inf, np.inf, np.inf, 3.6])
#: A window ends with a sentence once it has so many words, or so many if the line ends, too; at last after so many.
SENTENCE_WORDS, LINE_WORDS, WINDOW_WORDS = 14, 5, 30
#: A rest of fewer words belongs to the window before it.
TAIL_WORDS = 3

#: Rows that a label needs to be a language.
LANGUAGE_ROWS = 50
#: Texts whose words are found at once.
PIECE_ROWS = 1_000
#: A function word stands in this share of a language's texts, in no other language in more than three times that share, and follows no one word more often than this.
FREQUENT, BOUND = 0.04, 0.5
#: Words that make the vocabulary of a language, and the share of a text's other words that must be in it.
VOCABULARY, KNOWN = 20_000, 0.35
UNKNOWN = ""
# Codes for undetermined, several, uncoded and no languages.
NO_LANGUAGE = ("und", "mul", "mis", "zxx", "unk")

#: The two letters (ISO 639-1) of codes of three letters (ISO 639-2) that do not begin with them.
TWO_LETTERS = dict(x.split() for x in (
    "ave ae, arg an, bul bg, bih bh, bam bm, ben bn, tib bo, bos bs, che ce, ces cs, cze cs, chu cu, chv cv, wel cy, ger de, div dv, ewe ee, gre el, epo eo, spa es, "
    "est et, baq eu, per fa, ful ff, fao fo, gle ga, gla gd, grn gn, glv gv, hmo ho, hat ht, arm hy, her hz, ina ia, ind id, ile ie, ibo ig, ipk ik, ido io, ice is, "
    "iku iu, jpn ja, jav jv, geo ka, kon kg, kua kj, kaz kk, kal kl, khm km, kan kn, kau kr, kas ks, kom kv, cor kw, kir ky, ltz lb, lug lg, lin ln, lao lo, lit lt, "
    "lav lv, mlg mg, mah mh, mri mi, mao mi, mac mk, mal ml, mon mn, mar mr, may ms, mlt mt, bur my, nob nb, ndo ng, dut nl, nbl nr, nav nv, orm om, pli pi, pol pl, "
    "pus ps, por pt, roh rm, run rn, rum ro, kin rw, srd sc, snd sd, sme se, sag sg, slk sk, slo sk, alb sq, sot st, swe sv, tuk tk, tgl tl, tsn tn, tur tr, tat tt, "
    "tah ty, uig ug, wln wa, zha za, chi zh"
).split(", "))


@dataclass
class Languages:
    """``function`` and ``vocabulary``: the words of each language, in the order of ``names``."""

    names: list[str]
    function: list[frozenset[str]]
    vocabulary: list[frozenset[str]]


def label_of(column: F.Column) -> F.Column:
    """The language code in two letters, in lower case: codes of three letters by ``TWO_LETTERS``, of others the first two letters; '' for codes that name no language."""
    code = F.lower(F.trim(F.coalesce(column.cast("string"), F.lit(""))))
    three = F.regexp_extract(code, "^([a-z]{3})(?![a-z])", 1)
    two = F.try_element_at(F.create_map(*[F.lit(x) for pair in TWO_LETTERS.items() for x in pair]), three)
    return F.when(F.substring(code, 1, 3).isin(*NO_LANGUAGE), "").otherwise(F.coalesce(two, F.substring(code, 1, 2)))


def learned(source: DataFrame) -> Languages:
    """The languages of ``(id, label, t)``, from all of its rows.

    Words are counted by the number of texts that have them; those that are frequent enough for function words are then counted with the words they follow.
    """
    schema = "label string, word string, before string, n long"

    def counts(batches: Iterator[pa.RecordBatch], pairs: dict[str, list[str]] | None = None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, of = np.unique(np.array(batch.column("label").to_pylist(), object), return_inverse=True)
            number: defaultdict[str, int] = defaultdict()
            number.default_factory = number.__len__
            tokens: list[list[np.ndarray]] = [[] for _ in names]
            for begin in range(0, batch.num_rows, PIECE_ROWS):
                found, _, size = words_at([t.lower() for t in batch.column("t").slice(begin, PIECE_ROWS).to_pylist()])
                word = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
                doc = np.repeat(np.arange(len(size)), size)
                label = of[begin : begin + PIECE_ROWS][doc]
                for i, name in enumerate(names):
                    if name and pairs is None:
                        own = label == i
                        tokens[i].append(np.unique(doc[own] << 40 | word[own]) & (1 << 40) - 1)
                    elif name in (pairs or ()):
                        wanted = np.zeros(len(number), bool)
                        wanted[[number[w] for w in pairs[name] if w in number]] = True
                        second = np.flatnonzero((label[1:] == i) & (doc[1:] == doc[:-1]) & wanted[word[1:]]) + 1
                        tokens[i].append(word[second] << 32 | word[second - 1])
            vocabulary = np.array([*number, None], object)
            columns: list[tuple] = []
            for i, name in enumerate(names):
                if not tokens[i]:
                    continue
                keys = np.concatenate(tokens[i])
                if pairs is not None:
                    keys, n = np.unique(keys, return_counts=True)
                    columns.append((name, vocabulary[keys >> 32], vocabulary[keys & (1 << 32) - 1], n))
                else:
                    n = np.bincount(keys, minlength=len(number))
                    at = np.flatnonzero(n)
                    columns.append((name, vocabulary[np.r_[at, -1]], np.full(len(at) + 1, None), np.r_[n[at], np.count_nonzero(of == i)]))
            for name, word, before, n in columns:
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), pa.array(word, pa.string()), pa.array(before, pa.string()), pa.array(n, pa.int64())], names=["label", "word", "before", "n"])

    rows = source.select("label", "t")
    counted = durable(rows.mapInArrow(counts, schema).groupBy("label", "word").agg(F.sum("n").alias("n")))
    texts = {r["label"]: r["n"] for r in counted.where(F.col("word").isNull() & (F.col("n") >= LANGUAGE_ROWS)).collect()}
    names = sorted(texts)
    if not names:
        return Languages([], [], [])
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "word"))
    words = counted.where(F.col("label").isin(names) & F.col("word").isNotNull() & (F.col("n") > 1)).withColumn("place", place).where(F.col("place") <= VOCABULARY).select("label", "word", "n").collect()
    release(counted)
    shares: dict[str, dict[str, float]] = {name: {} for name in names}
    for r in words:
        shares[r["label"]][r["word"]] = r["n"] / texts[r["label"]]
    highest: Counter = Counter()
    for own in shares.values():
        for w, x in own.items():
            highest[w] = max(highest[w], x)
    frequent = {name: [w for w, x in shares[name].items() if x >= FREQUENT and x * 3 >= highest[w] and not w.isdigit()] for name in names}
    pairs = rows.where(F.col("label").isin(names)).mapInArrow(partial(counts, pairs=frequent), schema).groupBy("label", "word", "before").agg(F.sum("n").alias("n"))
    most = {(r["label"], r["word"]): r["most"] / r["all"] for r in pairs.groupBy("label", "word").agg(F.max("n").alias("most"), F.sum("n").alias("all")).collect()}
    function = [frozenset(w for w in frequent[name] if most.get((name, w), 0) < BOUND) for name in names]
    return Languages(names, function, [frozenset(shares[name]) for name in names])


def cut_text(low: str, starts: list[int]) -> tuple[list[int], np.ndarray, list[tuple[int, int]], np.ndarray]:
    """Where the windows of a text begin, as numbers of words and as places, its spans of markup, and which windows hold the end of a sentence."""
    n = len(starts)
    spans = [m.span() for m in _MARKUP.finditer(low)] if any(x in low for x in _MARKS) else []
    cuts, begin = [0], 0
    at = np.array(starts)
    ends = [(m.start(), "\n" in m.group()) for m in _END.finditer(low)]
    after = np.searchsorted(at, [e for e, _ in ends], side="right").tolist()  # the first word behind each end
    closing = [b for _, b in spans]
    e = 0
    while e < len(ends):
        i, line = after[e], ends[e][1]
        e += 1
        while e < len(ends) and after[e] == i:
            line, e = line or ends[e][1], e + 1
        if i >= n:
            break
        while i - begin > WINDOW_WORDS:
            begin += WINDOW_WORDS
            cuts.append(begin)
        size = i - begin
        if size >= SENTENCE_WORDS or size >= LINE_WORDS:
            if size < SENTENCE_WORDS and not line:  # links and tags after a sentence are not part of it
                s = int(np.searchsorted(closing, starts[i], side="right")) if spans else 0
                if s >= len(spans) or spans[s][0] > starts[i]:
                    continue
            cuts.append(i)
            begin = i
    while n - begin > WINDOW_WORDS:
        begin += WINDOW_WORDS
        cuts.append(begin)
    if len(cuts) > 1 and n - cuts[-1] < TAIL_WORDS:
        cuts.pop()
    edges = np.array([0, *[starts[c] for c in cuts[1:]], len(low)])
    ended = np.searchsorted(np.array([e for e, _ in ends]), edges)
    return cuts, edges, spans, ended[1:] > ended[:-1]


def measured(texts: list[str], labels: list[str], own: Languages, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(language of each text, text of each window, its length, its features)``; a language of -1 is unknown. Texts of few words have no windows.

    The length of a window without the end of a sentence is given as a negative number.
    """
    number: defaultdict[str, int] = defaultdict()
    number.default_factory = number.__len__
    owners, firsts, lengths, marks, breaks, ending = [], [], [], [], [], []
    lower = [t.lower() for t in texts]
    found, places_of, size = words_at(lower)
    words = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
    bases = [0, *np.cumsum(size).tolist()]
    for d, low in enumerate(lower):
        base, end = bases[d], bases[d + 1]
        if end - base < max(1, least_words):
            continue
        cuts, edges, spans, closed = cut_text(low, places_of[base:end].tolist())
        inside = np.zeros(len(edges), np.int64)
        if spans:
            marked = np.zeros(len(low) + 1, np.int32)
            for a, b in spans:
                marked[a + 1 : b + 1] = 1
            inside = np.cumsum(marked)[edges]
        places = np.searchsorted(np.array([m.start() for m in _BREAK.finditer(low)]), edges)
        owners += [d] * len(cuts)
        firsts += [base + c for c in cuts]
        lengths.append(edges[1:] - edges[:-1]), marks.append(inside[1:] - inside[:-1]), breaks.append(places[1:] - places[:-1]), ending.append(closed)
    vocabulary = list(number)
    function, listed = (np.zeros((len(own.names), len(vocabulary)), bool) for _ in range(2))
    for i in range(len(own.names)):
        function[i] = np.fromiter(map(own.function[i].__contains__, vocabulary), bool, len(vocabulary))
        listed[i] = np.fromiter(map(own.vocabulary[i].__contains__, vocabulary), bool, len(vocabulary))
    digit = np.array([w.isdigit() for w in vocabulary], bool)
    language = languages_of(words, size, function, listed, digit, labels, own.names)
    if not firsts:
        return language, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(FEATURES)))
    owner, first = np.array(owners), np.array(firsts)
    length, mark, break_ = (np.concatenate(x).astype(np.float64) for x in (lengths, marks, breaks))
    ends = np.cumsum(size)[owner]
    last = np.minimum(np.r_[first[1:], len(words)], ends)
    n = last - first
    keep = np.arange(first[0], len(words))
    window = np.searchsorted(first, keep, side="right") - 1
    fits = keep < last[window]
    token, window = words[keep[fits]], window[fits]
    starts = np.cumsum(n) - n
    hits = np.stack([np.add.reduceat(f[token].astype(np.int64), starts) for f in function]) if len(own.names) else np.zeros((1, len(n)), np.int64)
    mine = language[owner]
    best = hits.argmax(axis=0)  # a sentence quoted from another language is a sentence, too
    chosen = np.where((mine >= 0) & (hits[np.maximum(mine, 0), np.arange(len(n))] >= hits.max(axis=0)), mine, best)
    little = function[chosen[window], token] if len(own.names) else np.zeros(len(token), bool)
    unknown = mine < 0
    short = np.array([len(w) <= 3 for w in vocabulary], bool)
    little = np.where(unknown[window], short[token], little)  # in a language that is not known, short words may repeat
    content = ~little & ~digit[token]
    all_words, each = np.unique(window * np.int64(len(vocabulary)) + token, return_counts=True)
    at = all_words // len(vocabulary)
    share = each / n[at]
    entropy = np.bincount(at, -share * np.log2(share), minlength=len(n)) / np.log2(np.maximum(n, 2))
    many = np.bincount(window[content], minlength=len(n))
    different = np.bincount(np.unique(window[content] * np.int64(len(vocabulary)) + token[content]) // len(vocabulary), minlength=len(n))
    place = np.arange(len(token))
    barrier = np.maximum.accumulate(np.maximum(np.where(little, place, -1), starts[window] - 1))
    run = np.maximum.reduceat(place - barrier, starts)
    features = np.stack([
        np.add.reduceat(little.astype(np.int64), starts) / n,
        (many - different) / (many + 3),  # 3: a short sentence may repeat a noun
        np.where(n > 1, entropy, 1.0),
        mark / np.maximum(1, length),
        break_ / n,
        run / n,
    ], axis=1)
    features[unknown, 0] = features[unknown, 5] = np.nan
    return language, owner, np.where(np.concatenate(ending), length, -length).astype(np.int64), features


def languages_of(words: np.ndarray, size: np.ndarray, function: np.ndarray, listed: np.ndarray, digit: np.ndarray, labels: list[str], names: list[str]) -> np.ndarray:
    """The language of each text: the one that most of its words are of, function words counting twice and its label deciding ties, if enough of its other words are known there; else -1."""
    if not names:
        return np.full(len(size), -1)
    doc = np.repeat(np.arange(len(size)), size)
    per = lambda flags: np.bincount(doc, flags, minlength=len(size))
    hits = np.stack([per(f[words].astype(float)) for f in function])
    label = np.array([names.index(x) if x in names else -1 for x in labels])
    bonus = np.zeros_like(hits)
    bonus[np.maximum(label, 0), np.arange(len(size))] = np.where(label >= 0, 0.5, 0)
    others = np.stack([per((~f & ~digit)[words].astype(float)) for f in function])
    known = np.stack([per((v & ~f & ~digit)[words].astype(float)) for f, v in zip(function, listed, strict=True)])
    best = (hits + known / 2 + bonus).argmax(axis=0)
    at = best, np.arange(len(size))
    return np.where((known[at] >= KNOWN * others[at]) & (hits[at] + known[at] > 0), best, -1)


def spam_share(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", distance: float = 4.6, least_words: int = 8) -> DataFrame:
    """``(id, language, share)``: the share of each text's length in windows that are spam.

    ``distance`` is the robust Mahalanobis distance, in the directions of spam, beyond which a window is flagged.
    Centre and scatter come from all windows of all texts, language by language: medians, median absolute
    deviations and quadrant correlations. What function words a language has is learned from all rows by their labels (without any
    label, all texts are one language); a label of fewer than ``LANGUAGE_ROWS`` rows is no language. A text whose words are those of no language learned
    has language '' and is judged by repetition, entropy, markup and separators, against the windows of all such texts and of all others. Texts of fewer than ``least_words`` words are never flagged:
    a short heading has neither grammar nor repetition to judge by. Null and empty texts have share 0; rows with a null
    id are left out; a repeated id gives a row for each repetition. Other columns are ignored. An empty table gives an empty result.
    """
    kind = dict(df.dtypes)[id_col]
    label = label_of(F.col(lang_col)) if lang_col else F.lit("all")
    source = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), label.alias("label"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    languages = learned(source)
    shared = df.sparkSession.sparkContext.broadcast(languages)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, PIECE_ROWS):
                part = batch.slice(begin, PIECE_ROWS)
                language, owner, length, features = measured(part.column("t").to_pylist(), part.column("label").to_pylist(), own, least_words)
                edges = pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32))
                six = pa.array(np.arange(0, features.size + 1, len(FEATURES), dtype=np.int32))
                names = np.array([*own.names, UNKNOWN], object)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(names[language], pa.string()), pa.ListArray.from_arrays(edges, pa.array(length.astype(np.int32))), pa.ListArray.from_arrays(edges, pa.ListArray.from_arrays(six, pa.array(features.ravel().astype(np.float32))))],
                    names=["id", "language", "lengths", "features"],
                )

    rows = durable(source.mapInArrow(measure, f"id {kind}, language string, lengths array<int>, features array<array<float>>"))
    models = language_models(rows)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("lengths")
            sizes = np.diff(lists.offsets.to_numpy())
            length = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            features = batch.column("features").flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)).astype(np.float64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            language = np.array(batch.column("language").to_pylist(), object)[owner] if len(owner) else np.zeros(0, object)
            flagged = np.zeros(len(owner), bool)
            for name in set(language.tolist()) & set(models):
                own = np.nonzero(language == name)[0]
                centre, scatter, inverse = models[name]
                z = np.nan_to_num((features[own] - centre) / scatter * TOWARDS, nan=0.0)
                z = np.minimum(np.maximum(z, 0), np.where(length[own, None] > 0, MOST_FAR, np.inf))
                flagged[own] = np.einsum("ij,jk,ik->i", z, inverse, z) > distance**2
            length = np.abs(length)
            total = np.bincount(owner, length, minlength=len(sizes))
            share = np.bincount(owner, length * flagged, minlength=len(sizes)) / np.maximum(total, 1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("language"), pa.array(share)], names=["id", "language", "share"])

    return rows.mapInArrow(judge, f"id {kind}, language string, share double")


def language_models(rows: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each language the medians, the scatters and the inverse correlation of the features, in spam direction, over all windows.

    The model of texts of unknown language is that of the windows of all texts.
    """
    each = rows.select("language", F.explode("features").alias("f")).select("language", *[F.nanvl(F.element_at("f", i + 1), F.lit(None).cast("float")).alias(c) for i, c in enumerate(FEATURES)])
    each = each.where(F.col("language") != UNKNOWN).unionByName(each.withColumn("language", F.lit(UNKNOWN)))
    middle = {r["language"]: r for r in each.groupBy("language").agg(*[F.percentile_approx(c, 0.5, 10_000).alias(c) for c in FEATURES]).collect()}
    if not middle:
        return {}
    centre_of = lambda c: F.element_at(F.create_map(*[x for language, r in middle.items() for x in (F.lit(language), F.lit(float(r[c] or 0.0)))]), F.col("language"))
    centred = each.select("language", *[((F.col(c) - centre_of(c)) * float(TOWARDS[i])).alias(c) for i, c in enumerate(FEATURES)])
    sides = [F.avg(F.signum(a) * F.signum(b)).alias(f"{a}_{b}") for i, a in enumerate(FEATURES) for b in FEATURES[:i]]
    spread = centred.groupBy("language").agg(*[F.percentile_approx(F.abs(c), 0.5, 10_000).alias(c) for c in FEATURES], *sides).collect()
    models = {}
    for r in spread:
        scatter = np.maximum(np.array([1.4826 * (r[c] or 0.0) for c in FEATURES]), LEAST_SCATTER)
        correlation = np.eye(len(FEATURES))
        for i, a in enumerate(FEATURES):
            for j, b in enumerate(FEATURES[:i]):
                correlation[i, j] = correlation[j, i] = np.sin(np.pi / 2 * (r[f"{a}_{b}"] or 0.0))
        values, vectors = np.linalg.eigh(0.8 * correlation + 0.2 * np.eye(len(FEATURES)))
        inverse = (vectors / np.maximum(values, 0.2)) @ vectors.T
        models[r["language"]] = (np.array([middle[r["language"]][c] or 0.0 for c in FEATURES], float), scatter, inverse)
    return models


def spam_pages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", distance: float = 4.6) -> DataFrame:
    """``(id)`` of the texts of which spam makes up more than half; see ``spam_share``."""
    return spam_share(df, id_col, text_col, lang_col, distance).where("share > 0.5").select("id").distinct()

import random
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docsieve.llm import leaks as leaks_module
from docsieve.llm import neardup as neardup_module
from docsieve.llm.bagminhash import GRID, BagMinHash
from docsieve.llm.copies import collapse_copies
from docsieve.llm.leaks import leaks
from docsieve.llm.neardup import near_duplicates, record_pairs
from docsieve.llm.packing import Bins, packed_containers, token_counts
from docsieve.llm.spam import label_of, learned, spam_pages, spam_share
from docsieve.llm.text import WORD, words_at, words_of

SCHEMA = "id string, name string, text string, at timestamp, h long, n int, w string, key string, rid string"


def docs(spark, rows):
    """Records with further columns whose names the operators use themselves."""
    full = [(i, n, t, None, 1, 2, "w", "k", "r") for i, n, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def edited(rng, words, vocabulary, share):
    return [rng.choice(vocabulary) if rng.random() < share else w for w in words]


def corpus(seed=5, bases=30, copies=6):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3_000)]
    rows = []
    for b in range(bases):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        for c in range(copies):
            words = edited(rng, base, vocabulary, c * 0.04)
            rng.shuffle(words)
            rows.append((f"r{b:03}{c}", " ".join(words[:5]), " ".join(words[5:])))
    return rows + [("copy", rows[0][2], rows[0][1]), ("null", None, None), ("empty", "", ""), ("short", "a b c", "d"), ("long", "x", " ".join(f"l{i}" for i in range(40_000)))]


def truth(rows, threshold, multiset=False):
    bags = {i: Counter(words_of(f"{n or ''} {t or ''}")) for i, n, t in rows}
    if not multiset:
        bags = {i: Counter(set(b)) for i, b in bags.items()}
    bags = {i: b for i, b in bags.items() if len(b) >= 8}
    return {(a, b) for a in bags for b in bags if a < b and (bags[a] & bags[b]).total() >= threshold * (bags[a] | bags[b]).total() - 1e-9}


@pytest.mark.parametrize("multiset", [False, True])
def test_near_duplicates_against_brute_force(spark, multiset):
    rows = corpus()
    found = record_pairs(*near_duplicates(docs(spark, rows + [rows[3]]).repartition(3), multiset=multiset)).collect()
    want = truth(rows, 0.7, multiset)
    got = {(r["id_a"], r["id_b"]) for r in found}
    assert len(found) == len(got) and got <= want
    assert len(want - got) <= 0.01 * len(want) and len(want) > 100


def test_hot_bands_and_hot_classes_are_spread(spark, monkeypatch):
    monkeypatch.setattr(neardup_module, "HOT_ROWS", 20)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    rows = [(f"h{i:03}", "", " ".join(base[: 59 - i % 3] + [f"x{i}"])) for i in range(90)] + [(f"s{i:03}", " ".join(base), " " * i) for i in range(40)]
    rows += [(f"o{i:03}", "", " ".join(rng.choice(vocabulary) for _ in range(40))) for i in range(60)]
    df = docs(spark, rows)
    found = record_pairs(*near_duplicates(df.repartition(3))).collect()
    assert neardup_module.hot_bands(neardup_module.word_classes(df, "id", ["text"], None, 8, False), BagMinHash(216, neardup_module.DAMPED), 36, 6) is not None
    assert len(found) == len(set(found)) and {(r["id_a"], r["id_b"]) for r in found} == truth(rows, 0.7)


def test_equal_sets_with_other_counts_are_one_class(spark):
    words = " ".join(f"a{i}" for i in range(20))
    df = docs(spark, [("x", "", words), ("y", words, " ".join([words] * 9))])
    assert [tuple(r) for r in record_pairs(*near_duplicates(df)).collect()] == [("x", "y")]
    assert record_pairs(*near_duplicates(df, multiset=True)).count() == 0


def test_near_duplicates_take_the_newest_version(spark):
    words = " ".join(f"a{i}" for i in range(20))
    rows = [("x", words, "2025-01-01"), ("x", "gone", "2025-01-02"), ("y", words, "2025-01-01"), ("z", words, "2025-01-01"), (None, words, None)]
    df = spark.createDataFrame(rows, "id string, text string, at string").withColumn("at", F.col("at").cast("timestamp"))
    found = record_pairs(*near_duplicates(df, text_cols=("text",), order_col="at")).collect()
    assert [(r["id_a"], r["id_b"]) for r in found] == [("y", "z")]
    members, links = near_duplicates(df.limit(0), text_cols=("text",), order_col="at")
    assert members.count() == 0 and links.count() == 0


def test_signatures_estimate_weighted_similarity():
    words = np.arange(1, 41, dtype=np.uint32) * np.uint32(2_654_435_761)
    a, b = np.array([1, 2, 3, 4] * 10, float), np.array([2, 1, 4, 8] * 10, float)
    hashing = BagMinHash(4_096, GRID)
    signatures = hashing.signatures(np.concatenate([words, words]), np.concatenate([a, b]), np.array([0, 40]))
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((signatures[0] == signatures[1]).mean() - want) < 0.03
    sets = BagMinHash(4_096).signatures(np.concatenate([words[:30], words[10:]]), None, np.array([0, 30]))
    assert abs((sets[0] == sets[1]).mean() - 0.5) < 0.03


def copies_truth(rows):
    groups = defaultdict(list)
    for i, n, t in rows:
        if len(set(words_of(f"{n or ''} {t or ''}"))) >= 8:
            squeeze = lambda x: "".join(words_of(x))
            groups[tuple(sorted((squeeze(n), squeeze(t))))].append(i)
    return {(min(g), x) for g in groups.values() for x in g if x != min(g)}


def test_copies(spark):
    base = [(f"b{i:02}", f"Title number {i} of all", f"The first, second and third Été of text {i} go here") for i in range(20)]
    rows = list(base)
    rows += [(f"c{i:02}", n.upper() + "!", t.replace(" ", "  ")) for i, (_, n, t) in enumerate(base[:10])]
    rows += [(f"a{i:02}", t + " ", "\t" + n) for i, (_, n, t) in enumerate(base[5:15])]
    rows += [("acc", "Title number 0 of all", "The first, second and third Ete of text 0 go here"), ("null", None, None), ("dup", "a", "b")]
    rows += [(f"h{i:05}", "One hot title", "with the same seven further words in it. " + "!" * (i % 5)) for i in range(2_500)]
    kept, members = collapse_copies(docs(spark, rows + rows[:3]).repartition(5), salts=8)
    got = {(r["keep_id"], r["id"]) for r in members.where("id <> keep_id").collect()}
    assert got == copies_truth(rows)
    copies = {r["keep_id"]: r["copies"] for r in kept.collect()}
    assert copies["h00000"] == 2_500 and copies["acc"] == 1 and sum(copies.values()) == len(rows) - 2
    kept, members = collapse_copies(docs(spark, []))
    assert kept.count() == 0 and members.count() == 0


def leak_truth(texts, items, words=12):
    index = defaultdict(set)
    for i, t in items:
        w = words_of(t)
        for k in range(len(w) - words + 1):
            index[tuple(w[k : k + words])].add(i)
    out = set()
    for d, t in texts:
        w = words_of(t)
        for k in range(len(w) - words + 1):
            out |= {(d, i) for i in index.get(tuple(w[k : k + words]), ())}
    return out


def leak_tables(seed=9):
    rng = random.Random(seed)
    vocabulary = ["a", "of", "the", "notice", "αυτό", "élan"] + [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 40)))) for i in range(60)] + [(98, None), (99, "")]
    texts = []
    for d in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        if d % 3 == 0:
            source = words_of(rng.choice(items[:60])[1])
            size = rng.choice([10, 11, 12, 13, 20])
            at = rng.randint(0, max(0, len(source) - size))
            words[len(words) // 2 : len(words) // 2] = source[at : at + size]
        texts.append((d, ", ".join(words).upper() if d % 2 else "\n".join(words)))
    return texts + [(1_000, None), (1_001, ""), (1_002, "x " * 300_000)], items


def leak_frames(spark):
    texts, items = leak_tables()
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("doc", F.lit(1)).withColumn("t", F.lit(2)).repartition(3)
    return texts, items, df, spark.createDataFrame(items, "item_id long, text string").withColumn("i", F.lit(0))


@pytest.mark.parametrize("at_once,edits", [(10**7, 0), (3_000, 0), (10**7, 1), (3_000, 2)])
def test_leaks_against_brute_force(spark, monkeypatch, at_once, edits):
    monkeypatch.setattr(leaks_module, "ITEM_CHARS", at_once)
    texts, items, df, passages = leak_frames(spark)
    found = leaks(df.unionByName(df.where("doc_id < 10")), passages, edits=edits).where("whole").collect()
    got = {(r["doc"], r["item"]) for r in found}
    assert got == leak_truth(texts, items) and len(got) == len(found) > 40
    assert {r["edits"] for r in found} == {0}
    assert leaks(df.limit(0), passages).count() == 0 and leaks(df, passages.limit(0)).count() == 0


def test_leaks_of_ids_of_other_types(spark):
    text = " ".join(f"w{i}" for i in range(14))
    df = spark.createDataFrame([("d", text), (None, text)], "doc_id string, text string")
    items = spark.createDataFrame([(text, 1.5)], "text string, x double").select(F.to_date(F.lit("2025-01-01")).alias("item_id"), "text")
    assert [(r["doc"], str(r["item"]), r["whole"]) for r in leaks(df, items).collect()] == [("d", "2025-01-01", True)]


def test_a_run_does_not_reach_into_the_next_document(spark):
    words = [f"w{i}" for i in range(14)]
    df = spark.createDataFrame([(1, " ".join(words[:7])), (2, " ".join(words[7:]))], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(5, " ".join(words))], "item_id long, text string")
    assert leaks(df, items, edits=1).count() == 0 and leaks(df, items, edits=2).count() == 0


def test_a_long_leaked_passage_is_searched_in_no_time():
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(5_000))
    own = leaks_module.prepared(pa.array([7]), [text], 12, 1)
    whole = leaks_module.characters("other words " + text + " and more")
    began = time.process_time()
    run, place, cost = leaks_module.search(own, whole)
    exact = leaks_module.whole_words(own, run, place, cost, whole)
    assert len(set(run[exact].tolist())) == 4_989 and time.process_time() - began < 3


def semi_global(run, text, edits):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(run, 1):
        last, row[0] = row[0], i
        for j, x in enumerate(text, 1):
            last, row[j] = row[j], min(last + (c != x), row[j] + 1, row[j - 1] + 1)
    return min(row) <= edits


def test_leaks_with_edits_against_alignment(spark):
    rng = random.Random(2)
    vocabulary = [f"word{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(14))) for i in range(12)]
    texts = []
    for d in range(60):
        core = list(rng.choice(items)[1]) if d % 2 else list(" ".join(rng.choice(vocabulary) for _ in range(14)))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(core))
            core[at : at + 1] = rng.choice([[], ["q"], [core[at], "q"]])
        texts.append((d, " ".join(rng.choice(vocabulary) for _ in range(5)) + " " + "".join(core) + " end"))
    want = set()
    for d, t in texts:
        joined = " ".join(words_of(t))
        for i, s in items:
            w = words_of(s)
            if any(semi_global(" ".join(w[k : k + 12]), joined, 2) for k in range(3)):
                want.add((d, i))
    found = leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), edits=2).collect()
    assert {(r["doc"], r["item"]) for r in found} == want and len(want) > 15


# Prose in languages that the tables do not have, and notes without sentences.
PROSE = {
    "ru": "Вчера вечером мы долго гуляли по набережной, и ветер с реки был холодным, но никто не хотел возвращаться домой. Старый рыбак сидел у воды и рассказывал детям о том, как раньше здесь ходили большие пароходы. Потом начался дождь, и все побежали к остановке, где уже стояло много людей.",
    "pl": "W zeszłym roku pojechaliśmy nad morze, ponieważ dzieci chciały zobaczyć latarnię, o której czytały w szkole. Pogoda była zmienna, ale prawie codziennie chodziliśmy na plażę i zbieraliśmy muszle. Wieczorami dziadek opowiadał nam historie o rybakach, którzy kiedyś mieszkali w tym domu.",
    "fi": "Eilen kävimme vanhassa kirjastossa, jossa oli paljon kirjoja ja hiljaisia nurkkia lukemiseen. Kirjastonhoitaja kertoi meille, että rakennus on yli sata vuotta vanha ja että sen katto korjattiin viime kesänä. Kotimatkalla alkoi sataa lunta, mutta lapset olivat iloisia, koska he saivat vihdoin laskea mäkeä.",
    "it": "Ieri pomeriggio siamo andati a trovare la nonna, che abita in una casa piccola vicino al fiume. Mentre lei preparava il caffè, mio fratello guardava dalla finestra gli uccelli che passavano sopra i tetti. Quando è arrivata la sera, nessuno voleva tornare in città, perché lì si stava troppo bene.",
    "note": "Background: chronic kidney disease, older adults, limited evidence. Methods: retrospective cohort study, 412 patients, two hospitals, median follow-up 38 months. Results: lower mortality, fewer readmissions, better adherence after structured discharge planning. Conclusion: early outpatient review probably beneficial; randomised trials needed.",
}


@pytest.mark.parametrize("labelled", [True, False])
def test_prose_in_other_languages_is_no_spam(spark, labelled):
    rng = random.Random(2)
    nouns, verbs = ["library", "garden", "painter", "council", "bridge", "letter", "museum", "ferry"], ["opened", "sold", "painted", "moved", "described"]
    sentence = lambda: f"The {rng.choice(nouns)} of the {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice(nouns)}, because it was late and nobody had asked for the {rng.choice(nouns)}."
    rows = [(i, " ".join(sentence() for _ in range(rng.randint(1, 8))), "en") for i in range(200)]
    rows += [(1_000 + i, text, ("en" if name == "note" else name) if labelled else None) for i, (name, text) in enumerate(PROSE.items())]
    menu = "Главная | Контакты | Корзина | Хлеб | Главная | Помощь | Хлеб | Контакты | Корзина | Главная | Хлеб | Помощь"
    links = " ".join(f"https://shop.example/kauppa/{i} leipä" for i in range(20))
    rows += [(2_000, menu, "ru" if labelled else None), (2_001, links, "fi" if labelled else None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["id"] for r in spam_pages(df).collect()} == {2_000, 2_001}


def test_function_words_are_learned(spark):
    rng = random.Random(7)
    nouns = [f"noun{i}" for i in range(6)]
    rows = [(i, f"ka {rng.choice(nouns)} lo ka {rng.choice(nouns)} mi ka {rng.choice(nouns)} na ka {rng.choice(nouns)}.", "xx-YY") for i in range(80)] + [(99, "zu zu", "yy")]
    own = learned(spark.createDataFrame(rows, "id long, t string, l string").select("id", label_of(F.col("l")).alias("label"), "t"))
    assert own.names == ["xx"] and "ka" in own.function[0] and not own.function[0] & set(nouns) and own.vocabulary[0] >= {"ka", "noun1"}
    assert learned(spark.createDataFrame(rows[-1:], "id long, t string, l string").select("id", F.lit("yy").alias("label"), "t")).names == []


def test_languages_are_learned_from_all_rows(spark):
    rng = random.Random(11)
    rows = []
    for i in range(60_000):
        late = i >= 45_000  # words that are frequent on the whole, but not in every part of the table
        words = [f"{rng.choice('abcdef')}{rng.randrange(40)}" for _ in range(4)] + ["lo"] * (rng.random() < 0.5)
        words += ["ka", "mi"] if rng.random() < (0.2 if late else 0.012) else ["mi"] if rng.random() < 0.01 else []
        words += [f"x{rng.randrange(9)}", "mi"] if late and rng.random() < 0.12 else []
        rows.append((" ".join(words), "aa" if i % 10 else "bb"))
    rows[7::1200] = [(f"zu {i} tak zu", "rare") for i in range(50)]
    own = learned(spark.createDataFrame(rows, "t string, label string").withColumn("id", F.lit(1)).coalesce(1))
    texts, words, pairs = Counter(label for _, label in rows), Counter(), Counter()
    for text, label in rows:
        found = words_of(text)
        words.update((label, w) for w in set(found))
        pairs.update((label, w, before) for w, before in zip(found[1:], found, strict=False))
    share = {(label, w): n / texts[label] for (label, w), n in words.items() if n > 1}
    most, every = Counter(), Counter()
    for (label, w, _), n in pairs.items():
        most[label, w], every[label, w] = max(most[label, w], n), every[label, w] + n
    highest = {w: max(x for (_, v), x in share.items() if v == w) for _, w in share}
    function = {k for k, x in share.items() if x >= 0.04 and x * 3 >= highest[k[1]] and most[k] < 0.5 * max(1, every[k]) and not k[1].isdigit()}
    assert own.names == ["aa", "bb", "rare"]
    assert {(name, w) for name, f in zip(own.names, own.function, strict=True) for w in f} == function
    assert {(name, w) for name, v in zip(own.names, own.vocabulary, strict=True) for w in v} == set(share)


def test_language_codes(spark):
    codes = {"en": "en", "EN-us": "en", "eng": "en", "ger": "de", "deu": "de", "gre-x": "el", "spa": "es", "est": "et", "fra": "fr", "und": "", "mul-x": "", None: "", "xx-YY": "xx", "german": "ge"}
    df = spark.createDataFrame([(c, want) for c, want in codes.items()], "code string, want string").withColumn("label", label_of(F.col("code")))
    assert [(r["code"], r["label"]) for r in df.collect()] == list(codes.items())


def test_words_at():
    texts = ["", "_a_b", "ΟΔΟΣ ΟΔΟΣ. Σ", "İstanbul ²½Ⅷ 一二 x\u0301y \x1c\x85a b\n\nc", "𝒳𝟙 é_é", "\n", "a"]
    lower = [t.lower() for t in texts]
    words, starts, sizes = words_at(lower)
    assert words == [w for t in texts for w in words_of(t)] and sizes.tolist() == [len(words_of(t)) for t in texts]
    assert starts.tolist() == [m.start() for t in lower for m in WORD.finditer(t)]


def test_spam(spark):
    rng = random.Random(1)
    nouns, verbs, places = ["library", "garden", "painter", "council", "bridge", "letter", "museum", "ferry"], ["opened", "sold", "painted", "moved", "described"], ["Torvik", "Halmor", "Sildel", "Penve"]
    sentence = lambda: f"The {rng.choice(nouns)} of {rng.choice(places)} {rng.choice(verbs)} the {rng.choice(nouns)}, because it was late and nobody had asked for the {rng.choice(nouns)}."
    prose = [" ".join(sentence() for _ in range(rng.randint(1, 12))) for _ in range(300)]
    links = " ".join(f'<a href="https://shop.example/{i}">cheap {rng.choice(nouns)}</a>' for i in range(30))
    keywords = " ".join(rng.choice(["bread", "cheap bread", "bread sale", "best bread"]) for _ in range(60))
    glued = " ".join(f"{rng.choice(['bread', 'soup'])} {rng.choice(['for the', 'and', 'in', 'with a'])}" for _ in range(50))
    menu = " | ".join(rng.choice(["Home", "Contact", "Cart", "Help", "Bread", "Soup", "Next"]) for _ in range(40))
    tags = " ".join(f"#{rng.choice(nouns)}{i % 4}" for i in range(30))
    spam = [links, keywords, keywords.upper(), glued, menu, tags, sentence() + "\n" + links, keywords + "\n" + sentence()]
    honest = [" ".join(prose[:4]) + " #library #garden #ferry", " ".join(prose[4:7]) + "\nHome | About us | Contact", "The ferry, Torvik, June 1979", "12. the letter - the bridge", None, "", "!!! ???"]
    rows = [(i, t, "en" if i % 5 else None) for i, t in enumerate(prose + honest + spam)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("share", F.lit(1)).withColumn("features", F.lit("x"))
    flagged = {r["id"] for r in spam_pages(df.repartition(3)).collect()}
    assert flagged == set(range(len(prose) + len(honest), len(rows)))
    share = {r["id"]: r["share"] for r in spam_share(df).collect()}
    assert len(share) == len(rows) and all(0 <= s <= 1 for s in share.values())
    assert spam_pages(df.limit(0)).count() == 0


def test_bins():
    rng = random.Random(4)
    bins, load = Bins(100, 8), Counter()
    for _ in range(2_000):
        size = rng.randint(0, 100)
        load[bins.put(size)] += size
        assert bins.count <= 8 and bins.count == sum(map(len, bins.by_space.values()))
        assert all(bool(bins.bits >> s & 1) == (s in bins.by_space) for s in range(101))
    assert max(load.values()) <= 100 and sum(load.values()) > 0.9 * 100 * len(load)
    assert all(load[b] == size for b, size in bins.open())


def test_containers(spark):
    rng = random.Random(6)
    sizes = [(i, rng.choice([0, 3, 40, 77, 128, 129, 300]) if i % 7 else rng.randint(1, 60)) for i in range(3_000)]
    df = spark.createDataFrame(sizes + sizes[:5] + [(None, 4), (9_999, None)], "id long, tokens long")
    found = packed_containers(df.repartition(7), 128, open_bins=16, shard_rows=500, shards_at_once=4).collect()
    load, parts = Counter(), defaultdict(list)
    for r in found:
        load[r["container"]] += r["tokens"]
        parts[r["id"]].append((r["part"], r["token_from"], r["tokens"]))
    assert max(load.values()) <= 128
    for i, size in [*sizes, (9_999, 0)]:
        own = sorted(parts[i])
        assert [p for p, _, _ in own] == list(range(max(1, -(-size // 128)))) and sum(t for _, _, t in own) == size
        assert all(a[1] + a[2] == b[1] for a, b in zip(own, own[1:], strict=False))
    assert sum(load.values()) > 0.97 * 128 * len(load)
    deep = packed_containers(df, {3: 128, 5: 1_000}, open_bins=4, shard_rows=100, shards_at_once=3).collect()  # several levels
    held = Counter()
    for r in deep:
        held[r["size_id"], r["container"]] += r["tokens"]
    assert all(n <= {3: 128, 5: 1_000}[c] for (c, _), n in held.items()) and sum(held.values()) == 2 * sum(load.values())
    assert sum(n for (c, _), n in held.items() if c == 5) > 0.97 * 1_000 * sum(c == 5 for c, _ in held)
    again = packed_containers(df.repartition(2), 128, open_bins=16, shard_rows=500, shards_at_once=4).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))
    assert packed_containers(df.limit(0), 128).count() == 0
    with pytest.raises(ValueError, match="capacity"):
        packed_containers(df, 0)


def test_token_counts(spark):
    tiktoken = pytest.importorskip("tiktoken")
    assert tiktoken
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "a" * 250_000)], "doc_id long, text string")
    got = {r["id"]: r["tokens"] for r in token_counts(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 10_000

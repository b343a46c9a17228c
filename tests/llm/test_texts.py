"""Text operators: leakage, languages, packing."""

from __future__ import annotations

import random

import numpy as np
import pytest

from inkmesh.llm import languages, leakage, packing, subtitles


def cue(k, *lines):
    return f"{k}\r\n00:00:0{k % 9},000 --> 00:00:0{k % 9},900\r\n" + "\r\n".join(lines) + "\r\n\r\n"


def test_spoken_text():
    t = "﻿1\r\n00:01 --> 00:02\r\n<i>One</i> [NOISE] two\r\n12\r\n{\\an8}three (aside) four\r\n"
    assert subtitles.words(subtitles.spoken(t)) == ["one", "two", "three", "four"]
    assert subtitles.cues("") == [] and subtitles.cues("12\n--> \n34\n") == []
    assert [c.strip() for c in subtitles.cues(cue(1, "a b") + cue(2, "c", "d"))] == ["a b", "c\nd"]


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 40)))) for i in range(20)]
    docs = []
    for d in range(40):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        if d % 2:
            own = rng.choice(items)[1].split()
            k = rng.randint(0, max(0, len(own) - 11))
            w[5:5] = own[k : k + rng.randint(9, 16)]
        docs.append((d, "".join(cue(k, " ".join(w[k : k + 4]), " ".join(w[k + 4 : k + 7])) for k in range(0, len(w), 7))))
    docs += [(100, None), (101, ""), (1, docs[1][1]), (102, cue(1, items[0][1]) * 50), (None, items[0][1])]
    grams = {}
    for i, t in items:
        w = subtitles.words(t)
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = set()
    for d, t in docs:
        w = subtitles.words(subtitles.spoken(t or ""))
        want |= {(d, i) for k in range(len(w) - 11) for i in grams.get(tuple(w[k : k + 12]), ()) if d is not None}
    documents = spark.createDataFrame([(d, t, "en", 0) for d, t in docs], "doc_id bigint, text string, gram string, item_id int")
    bench = spark.createDataFrame([*items, (77, None), (78, ""), items[0]], "item_id bigint, text string")
    for rare in (leakage.RARE_DF, 0):  # exact runs do not depend on rarity
        found = leakage.leaks(documents, bench, rare_df=rare).where("longest_run >= 12")
        assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want
    assert leakage.leaks(documents.limit(0), bench).count() == leakage.leaks(documents, bench.limit(0)).count() == 0


def test_leaks_in_frequent_passages(spark):
    item = [f"w{k}" for k in range(24)]
    edited = [w if k % 8 else f"x{k}" for k, w in enumerate(item)]  # runs of seven words
    text = cue(1, " ".join(edited[:12])) + cue(2, " ".join(edited[12:])) + cue(3, "short and sweet")
    docs = spark.createDataFrame([(d, text) for d in range(1100)] + [(2000, cue(1, "nothing of it"))], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "Short and sweet!"), (3, "w1 w2 w3 w4 w5 w6")], "item_id bigint, text string")
    found = leakage.leaks(docs, bench).select("doc_id", "item_id", "longest_run").collect()
    assert {tuple(r) for r in found} == {(d, i, n) for d in range(1100) for i, n in ((1, 7), (2, 3), (3, 6))}


def test_alignment_scores_edits():
    item = np.arange(1, 31)
    edited = np.r_[item[:10], [99], item[10:18], item[20:]]
    run, score, end, _ = leakage.align(np.r_[[50, 51], edited, [52]], item)
    assert run == 10 and score == 2 * 28 - 1 - 2 and end == 2 + len(edited)
    slow = np.zeros((len(item) + 1, len(edited) + 1), int)
    for i, a in enumerate(item, 1):
        for j, b in enumerate(edited, 1):
            slow[i, j] = max(0, slow[i - 1, j - 1] + (2 if a == b else -1), slow[i - 1, j] - 1, slow[i, j - 1] - 1)
    assert leakage.align(edited, item)[1] == slow.max()


PHRASES = {
    "en": "the night was cold and they found their house near a river;we never believed this story about your brother;she opened every door with the old key",
    "de": "die nacht war kalt und sie fanden ihr haus neben dem fluss;wir glaubten nie diese geschichte von deinem bruder;sie öffnete jede tür mit dem alten schlüssel",
    "fr": "la nuit était froide et ils ont trouvé leur maison près de la rivière;nous ne croyons jamais cette histoire de ton frère;elle ouvre chaque porte avec la vieille clé",
    "ru": "ночь была холодной и они нашли дом у реки;мы никогда не верили этой истории о брате;она открыла каждую дверь старым ключом",
}


def corpus():
    rng = random.Random(9)
    say = lambda lang, n: "".join(cue(k, rng.choice(PHRASES[lang].split(";"))) for k in range(n))
    docs, truth = [], {}
    for d in range(200):
        lang = rng.choice(list(PHRASES))
        label, text, own = lang, say(lang, 10), {lang}
        if d % 7 == 0:
            other = rng.choice([x for x in PHRASES if x != lang])
            text, own = text + say(other, 10), {lang, other}
        if d % 11 == 0:
            label = rng.choice([None, "", "und", "xx", "ru" if lang != "ru" else "de"])
        if d % 13 == 0:
            label = languages.NAMES[lang][-1].title() if label == lang else label
        docs.append((d, label, text))
        names = {lang, languages.NAMES[lang][-1].title()}
        if len(own) > 1 or label not in names:
            truth[d] = own
    return docs, truth


def test_languages_of_documents(spark):
    docs, truth = corpus()
    odd = [(900, "en", None), (901, None, ""), (902, "de", "1\n0 --> 1\n\n"), (903, None, cue(1, "Subtitles by SomeTeam", "www.site.example")), docs[0]]
    df = spark.createDataFrame([(*r, "x") for r in [*docs, *odd]], "doc_id bigint, lang string, text string, segments string")
    found = languages.detect(df).cache()
    got: dict = {}
    for r in languages.mislabelled(found).collect():
        got.setdefault(r["doc_id"], set()).add(r["lang_found"])
    assert got == truth
    assert all(0.9 < r["confidence"] <= 1.000001 for r in languages.languages(found).collect())
    mixed = next(d for d, own in truth.items() if len(own) > 1)
    assert {r["lang"] for r in languages.segments(found).where(f"doc_id = {mixed}").collect()} == truth[mixed]


def test_languages_of_long_files(spark):
    docs, truth = corpus()
    docs = [(d, label, text + "12\r\n" * 6000) for d, label, text in docs]  # every file has over 20,000 characters
    df = spark.createDataFrame(docs, "doc_id bigint, lang string, text string")
    got: dict = {}
    for r in languages.mislabelled(languages.detect(df)).collect():
        got.setdefault(r["doc_id"], set()).add(r["lang_found"])
    assert got == truth


def test_sample_of_a_text_is_bounded():
    long = "".join(cue(k, f"cue number {k}") for k in range(2000)) + cue(1, "one cue without end " * 20_000)
    own = languages.drawn_cues(long)
    assert len(own) == languages.SAMPLE_CUES and max(map(len, own)) <= languages.CUE_CHARS
    assert own == languages.drawn_cues(long) and len(set(own)) > 200
    assert languages.drawn_cues(cue(1, "a b") + cue(2, "c", "d")) == subtitles.cues(cue(1, "a b") + cue(2, "c", "d"))


def test_adverts_are_learned():
    names = ["Alpha7", "Bravo Team", "Charlie", "Delta9", "Echo Group", "Foxtrot"]
    talk = ["in 1924 the year was long", "our team was here in 2024", "we saw the old house", "we went home", "we all know", "you saw it before", "he saw nothing"]
    sample = [(k, [c.lower().split() for c in (f"subtitles by {n}", *talk, f"we saw {n}")]) for k, n in enumerate(names)]
    ads = languages.learn_adverts(sample)
    has = lambda c: ads.has(c, subtitles.words(c))
    assert has("Subtitles by Golf12") and has("visit www.site.org today") and has("https://a.b")
    assert not any(map(has, [*talk, "It happened in 2024.", "Das Team ist hier.", "by the river", ""]))
    one_title = [(1, own) for _, own in sample]
    assert not languages.learn_adverts(one_title).templates
    assert languages.learn_adverts([]) == languages.Adverts()


def test_wrong_encodings_are_repaired():
    ru, it = "И он знает этот дом.\nРусский язык Ёж", "Lei portò la città è già lì"
    for text, page in ((ru, "cp1251"), (it, "cp1252"), (it, "latin-1"), (ru, "latin-1")):
        assert languages.repaired(text.encode().decode(page, "replace")) == text
    for text in (ru, it, "plain", "", "Ã", "naïve café", "Îí çíàåò", "a\n" + it, "Tradu\ufffd\ufffdo", "日本語 – “x”"):
        assert languages.repaired(text) == text
    assert languages.repaired("città\n" + it.encode().decode("cp1252")) == "città\n" + it


def test_languages_without_labels(spark):
    df = spark.createDataFrame([(1, None, cue(1, "some words"))], "doc_id bigint, lang string, text string")
    assert languages.mislabelled(languages.detect(df)).count() == 0
    assert languages.mislabelled(languages.detect(df.limit(0))).count() == 0


@pytest.mark.parametrize(("label", "code"), [("EN", "en"), ("de-AT", "de"), ("es-419", "es"), ("Swedish", "sv"), ("fre", "fr"), ("und", None), ("unknown", None), ("", None), ("ja", None)])
def test_labels(spark, label, code):
    from pyspark.sql import functions as F

    assert spark.range(1).select(languages.label_code(F.lit(label))).first()[0] == code


def test_packing(spark):
    rng = random.Random(4)
    counts = [(i, rng.choice([rng.randint(1, 900), rng.randint(1, 4096)])) for i in range(700)]
    counts += [(800, 0), (801, 4096), (802, 8192), (803, 10_001), (0, counts[0][1]), (804, None), (None, 5)]
    df = spark.createDataFrame([(d, n, "c") for d, n in counts], "doc_id bigint, tokens bigint, container string")
    rows = packing.pack(df, shard=150).collect()
    whole: dict = {}
    bins: dict = {}
    for r in rows:
        whole[r["doc_id"]] = whole.get(r["doc_id"], 0) + r["size"]
        if r["container"]:
            bins.setdefault(r["container"], []).append(r)
    assert whole == {d: n for d, n in counts if d is not None and n is not None}
    for own in bins.values():
        used = sum(r["size"] for r in own)
        assert used <= 4096 and all((r["used"], r["unused"]) == (used, 4096 - used) for r in own)
    assert {(r["piece"], r["start"], r["size"]) for r in rows if r["doc_id"] == 803} == {(0, 0, 4096), (1, 4096, 4096), (2, 8192, 1809)}
    least = -(-sum(whole.values()) // 4096)
    assert len(bins) <= 1.03 * least + 1
    assert packing.pack(df.limit(0)).count() == 0


def test_crossover_keeps_every_item():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1000, 300)
    people = packing.first_groupings(sizes, 1000, 4, rng)
    for _ in range(50):
        child = packing.crossover(people[int(rng.integers(4))], people[int(rng.integers(4))], sizes, 1000, rng)
        assert len(child.bin) == 300 and child.fill.max() <= 1000 and child.fill.sum() == sizes.sum()
        people[int(rng.integers(4))] = child


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello, world"), (2, ""), (3, None), (4, "<|endoftext|> é")], "doc_id bigint, text string")
    counts = {r["doc_id"]: r["tokens"] for r in packing.token_counts(df).collect()}
    assert set(counts) == {1, 2, 4} and counts[2] == 0 and counts[1] > 0


def test_genetic_packing_beats_best_fit():
    """Triples that fill containers exactly, and sizes of a fifth to two fifths of one, where best fit wastes space."""
    rng = np.random.default_rng(5)
    first = rng.integers(1025, 2048, 150)
    second = (4096 - first) // 2 + rng.integers(-256, 256, 150)
    for sizes in (np.r_[first, second, 4096 - first - second], rng.integers(820, 1640, 450)):
        sizes = np.sort(sizes)[::-1].astype(np.int64)
        fill: list = []
        packing.best_fit(np.full(len(sizes), -1), fill, np.arange(len(sizes)), sizes, 4096)
        best: list = []
        for epoch in range(packing.EPOCHS):
            bins, _ = packing.evolve(sizes, 4096, epoch, best, packing.GENERATIONS)
            best = [bins]
        used = np.bincount(bins, weights=sizes)
        least = -(-int(sizes.sum()) // 4096)
        assert used.max() <= 4096 and used.sum() == sizes.sum() and used.min() > 0
        assert len(used) <= least + 2 and len(used) < len(fill) - 3


def test_packing_ends_where_nothing_fits(spark):
    df = spark.createDataFrame([(d, 2100 + d % 1900) for d in range(400)], "doc_id bigint, tokens bigint")
    rows = packing.pack(df, shard=50).collect()
    assert len({r["container"] for r in rows}) == len(rows) == 400

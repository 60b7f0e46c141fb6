"""Operators against versions without numpy or anchors: language machines by loops, and very long texts by their parts."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from depscope.llm import langid, private, simhash

BITS = 8
WORDS = {
    "en": "the house with water and thought through which would there",
    "de": "das haus mit wasser und gedanke durch welche w\u00fcrde dort",
    "nl": "het huis met water en gedachte door welke zou daar",
    "fr": "la maison avec eau et pens\u00e9e par laquelle serait ici",
    "es": "la casa con agua y pensamiento por cual ser\u00eda all\u00ed",
    "fi": "talo jossa vesi ja ajatus kautta joka olisi siell\u00e4 t\u00e4m\u00e4",
}


def plain_features(text):
    points = [ord(c) for c in " " + re.sub(r"[^a-z\u00e0-\u00ff]+", " ", text.lower()) + " "]
    counts = {}
    for k in range(len(points) - 1):
        two = (points[k] * 0x9E3779B1 ^ points[k + 1] * 0x85EBCA77) % 2**32
        places = [two * 0x165667B1]
        if k + 2 < len(points):
            three = (two * 0x27D4EB2F ^ points[k + 2] * 0xC2B2AE3D) % 2**32
            places.append(three * 0x9E3779B1)
        for place in places:
            at = place % 2**32 >> 32 - BITS
            counts[at] = counts.get(at, 0) + 1
    norm = math.sqrt(sum(counts.values()))
    return {at: math.sqrt(n) / norm for at, n in counts.items()} | {1 << BITS: 1.0}


def dot(w, x):
    return sum(w[at] * v for at, v in x.items())


def plain_machine(good, bad):
    w = v = [0.0] * ((1 << BITS) + 1)
    lessons = [(x, 1, 0.5 / len(good)) for x in good] + [(x, -1, 0.5 / len(bad)) for x in bad]
    for k in range(80):
        slope = [1e-4 * one for one in v]
        for x, y, share in lessons:
            slack = max(0.0, 1 - y * dot(v, x))
            for at, value in x.items():
                slope[at] -= 2 * share * y * slack * value
        moved = [one - 0.2 * s for one, s in zip(v, slope, strict=True)]
        v = [m + k / (k + 3) * (m - old) for m, old in zip(moved, w, strict=True)]
        w = moved
    return w


def test_languages_as_by_loops(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choices(WORDS[lang].split(), k=rng.randrange(3, 9))), lang) for k, lang in enumerate(list(WORDS) * 12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(frame, F.col("doc_id") % 4 > 0, bits=BITS, windows=0).collect()}
    taught = sorted({(lang, text) for k, text, lang in rows if k % 4})
    by_lang = {lang: [plain_features(text) for other, text in taught if other == lang] for lang in WORDS}
    families = {}
    for lang in WORDS:
        families.setdefault(langid.family(lang), []).append(lang)
    outer = {}
    for f in families:
        sides = [[x for lang in WORDS if (langid.family(lang) == f) == side for x in by_lang[lang]] for side in (True, False)]
        outer[f] = plain_machine(*sides)
    inner = {(a, b): plain_machine(by_lang[a], by_lang[b]) for m in families.values() for a in m for b in m if a < b}
    for k, text, _ in rows:
        x = plain_features(text)
        margins = sorted(((dot(w, x), f) for f, w in outer.items()), reverse=True)
        members = families[margins[0][1]]
        wins = {lang: 0.0 for lang in members}
        for (a, b), w in inner.items():
            if a in members and b in members:
                p = 1 / (1 + math.exp(-2 * dot(w, x)))
                wins[a] += (p >= 0.5) + 1e-3 * p
                wins[b] += (p < 0.5) + 1e-3 * (1 - p)
        best = max(sorted(wins), key=wins.get)
        score = 1 / (1 + math.exp(margins[1][0] - margins[0][0]))
        for (a, b), w in inner.items():
            if best in (a, b) and a in members:
                score /= 1 + math.exp((-2 if best == a else 2) * dot(w, x))
        assert got[k]["lang_pred"] == best and got[k]["score"] == pytest.approx(score, abs=1e-3)


def test_very_long_texts(spark):
    unit = "write to some.one@mail.example.org or 10.1.2.3 today, card 4111 1111 1111 1111. "
    text = unit * 20_000
    frame = spark.createDataFrame([(1, text), (2, text + "end"), (3, "short")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in private.personal_data(frame, redacted=False).collect()}
    assert (found[1]["n_email"], found[1]["n_ip"], found[1]["n_card"]) == (20_000, 20_000, 20_000)
    first = private.describe([s for s in private.find(unit)]).split(",")
    assert found[1]["spans"].split(",")[: len(first)] == first and found[3]["spans"] == ""
    prints = {r["doc_id"]: r["fp"] for r in simhash.with_fingerprint(frame).collect()}
    assert (prints[1] ^ prints[2]).bit_count() <= 3 and prints[1] == simhash.fingerprint(text)

"""Hierarchical language identification.

A linear machine picks the language family; within it, linear support vector machines
of one language against another vote. All work on hashed counts of character bigrams
and trigrams of the whole text, folded to lower case, with every non-letter a blank.

The machines are fitted on the driver to a bounded sample of the labelled texts: of every
language the ``per_language`` different texts with the least hashes, fewer if all languages
together would have over ``total_texts``, but four at least. So every language is learned, copies
count once, and the sample is the same whatever the partitions are. Tasks make the features;
the driver gets four vectors of 2**bits numbers a text, at most 270 MB with the defaults and up to a
thousand languages. Prediction reads every text in full.

Defined results: a null text, and one with no letter, gets ``und`` with score 0; rows
without a label teach nothing; without any labelled row every text gets ``und``;
repeated rows get equal results; an empty table gives an empty result; input columns named as
a result column give way to it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depscope.llm.arrow import add_columns
from depscope.scratch import materialise

#: Language families by ISO 639-1 code. A language not here is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "baltic": ("lt", "lv"),
    "turkic": ("az", "kk", "tr", "uz"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("am", "ar", "he", "mt"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
UNKNOWN = "und"


def family(lang: str) -> str:
    code = lang.lower().replace("_", "-").partition("-")[0]
    return FAMILY_OF.get(code, lang)


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, runs of non-letters as one blank each, or none."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    table = np.frombuffer(bytes(map(str.isalpha, map(chr, range(0x250)))), dtype=bool)
    alpha = np.zeros(len(points), bool)
    low = points < 0x250
    alpha[low] = table[points[low]]
    if not low.all():
        high = np.unique(points[~low])
        alpha[~low] = np.isin(points[~low], [p for p in high.tolist() if chr(p).isalpha()])
    if not alpha.any():
        return points[:0]
    points = np.where(alpha, points, 32)
    keep = alpha | np.concatenate([[True], alpha[:-1]])
    return np.concatenate([[32], points[keep], [32]]).astype(np.uint32)


def features(points: np.ndarray, bits: int) -> np.ndarray:
    """Hashed bigram and trigram counts, damped by a square root and scaled to length 1."""
    a, b = points[:-1], points[1:]
    two = a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0x27D4EB2F) ^ points[2:] * np.uint32(0xC2B2AE3D)
    shift = np.uint32(32 - bits)
    mixed = np.concatenate([two * np.uint32(0x165667B1), three * np.uint32(0x9E3779B1)]) >> shift
    counts = np.sqrt(np.bincount(mixed, minlength=1 << bits).astype(np.float32))
    return counts / max(1e-9, float(np.sqrt(counts @ counts)))


def fit_svm(x: np.ndarray, y: np.ndarray, reg: float = 1e-4, rounds: int = 80) -> np.ndarray:
    """Weights, the last one a bias, of a linear machine under squared hinge loss; y is -1 or 1."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    step = 0.2
    for k in range(rounds):  # Nesterov's accelerated gradient
        slack = np.maximum(0, 1 - y * (x @ v))
        moved = v - step * (reg * v - 2 * x.T @ (share * y * slack))
        v = moved + (k / (k + 3)) * (moved - w)
        w = moved
    return w


@dataclass
class Model:
    """Families one against the rest, then languages one against one within a family."""

    bits: int
    languages: dict[str, list[str]] = field(default_factory=dict)
    outer: dict[str, np.ndarray] = field(default_factory=dict)
    inner: dict[str, list[tuple[str, str, np.ndarray]]] = field(default_factory=dict)  # by family

    def predict(self, text: str | None) -> tuple[str, float]:
        points = letters(text or "")
        if not len(points) or not self.languages:
            return UNKNOWN, 0.0
        x = np.append(features(points, self.bits), np.float32(1))
        margins = {f: float(w @ x) for f, w in self.outer.items()}
        best = max(sorted(self.languages), key=lambda f: margins.get(f, 0.0))
        rest = max((m for f, m in margins.items() if f != best), default=None)
        score = 1.0 if rest is None else sigmoid(margins[best] - rest)
        votes = dict.fromkeys(self.languages[best], 0.0)
        pairs = [(a, b, float(w @ x)) for a, b, w in self.inner.get(best, ())]
        for a, b, margin in pairs:
            p = sigmoid(2 * margin)
            votes[a] += (p >= 0.5) + 1e-3 * p
            votes[b] += (p < 0.5) + 1e-3 * (1 - p)
        lang = max(sorted(votes), key=votes.get)
        for a, b, margin in pairs:
            if lang in (a, b):
                score *= sigmoid((2 if lang == a else -2) * margin)
        return lang, round(min(1.0, max(0.0, score)), 6)


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def lessons(text: str, bits: int, windows: int, seed: int) -> list[bytes]:
    """Features of a text whole, and of ``windows`` short cuts, so that short texts are learned too; none without letters."""
    points = letters(text)
    if not len(points):
        return []
    rng = np.random.default_rng(seed % (1 << 64))
    made = [features(points, bits)]
    for _ in range(windows):
        size = int(rng.integers(6, 120))
        at = int(rng.integers(0, max(1, len(points) - size)))
        made.append(features(points[at : at + size], bits))
    return [x.astype("<f4").tobytes() for x in made]


def fit(rows: list[tuple[str, int, list[bytes]]], bits: int = 12) -> Model:
    """A model from (lang, number of the text, its lessons). The rows' order doesn't matter."""
    ordered = sorted(rows, key=lambda r: r[:2])
    langs = [lang for lang, _, made in ordered for _ in made]
    model = Model(bits)
    if not langs:
        return model
    x = np.frombuffer(b"".join(v for *_, made in ordered for v in made), "<f4").reshape(len(langs), 1 << bits)
    names = np.array(langs)
    for lang in sorted(set(langs)):
        model.languages.setdefault(family(lang), []).append(lang)
    kinds = np.array([family(n) for n in langs])
    if len(model.languages) > 1:
        model.outer = {f: fit_svm(x, np.where(kinds == f, 1, -1).astype(np.float32)) for f in model.languages}
    for f, members in model.languages.items():
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                two = (names == a) | (names == b)
                w = fit_svm(x[two], np.where(names[two] == a, 1, -1).astype(np.float32))
                model.inner.setdefault(f, []).append((a, b, w))
    return model


def training_texts(labelled: DataFrame, per_language: int, total_texts: int) -> DataFrame:
    """(lang, draw, text): the chosen texts of ``labelled`` (text, lang), both non-null. Each language's come from its
    least hashes, of which a task hands on no more than are wanted."""
    hashed = labelled.withColumn("draw", F.xxhash64("text"))
    known = hashed.select("lang", "draw").distinct()
    languages = labelled.select("lang").distinct().count()
    wanted = max(4, min(per_language, total_texts // max(1, languages)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    drawn = materialise(known.withColumn("rank", rank).where(F.col("rank") <= wanted).select("lang", "draw"), "langid-drawn")
    return hashed.join(F.broadcast(drawn), ["lang", "draw"]).groupBy("lang", "draw").agg(F.min("text").alias("text"))


def identify(
    docs: DataFrame,
    teach: Column,
    text: str = "text",
    lang: str = "lang",
    per_language: int = 150,
    total_texts: int = 4096,
    bits: int = 12,
    windows: int = 3,
) -> DataFrame:
    """``docs`` with lang_pred and score, learned from the rows where ``teach`` holds."""
    labelled = docs.where(teach & F.col(f"`{text}`").isNotNull() & F.col(f"`{lang}`").isNotNull()).select(
        F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")
    )
    chosen = training_texts(labelled, per_language, total_texts)
    both = F.struct("text", "draw").alias("x")

    def teach_one(values: list[dict]) -> list[list]:
        return [[lessons(v["text"], bits, windows, v["draw"]) for v in values]]

    made = add_columns(chosen.select("lang", "draw", both), "x", [("made", T.ArrayType(T.BinaryType()))], teach_one, drop=True)
    model = fit([(r["lang"], r["draw"], [bytes(v) for v in r["made"]]) for r in made.collect()], bits)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(values: list[str | None]) -> list[list]:
        pairs = [shared.value.predict(v) for v in values]
        return [[p[0] for p in pairs], [p[1] for p in pairs]]

    return add_columns(docs, text, [("lang_pred", T.StringType()), ("score", T.DoubleType())], compute)

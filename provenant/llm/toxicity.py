"""Toxicity from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: case, look-alike letters of other scripts, digits that
stand for letters inside words, and invisible characters; accents of Latin
letters stay, for they tell words apart. Everything that is no letter becomes a
space, so that terms match from a word's start. The lexicon is learned from
labelled rows: words that toxic texts use far more often, and beginnings that
many such words share, weighed by log odds. A beginning that one longer term
covers as well gives way to it, so that plain words with the same first letters
stay clean. A term inside an exception phrase doesn't count. The weighted
matches, absolute and by length, give the score through a fitted logistic curve.

Null, empty and blank texts score as texts without matches, texts of any length
are read whole, equal texts score alike however often they are repeated, and an
empty table gives no rows; ties between terms are broken by length and spelling.
Columns of the caller's are passed by, whatever their names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows that the lexicon and the curve are learned from, at most.
MAX_TRAIN = 12_000
MAX_TERMS, MIN_DOCS, MIN_ODDS = 400, 6, 20.0
#: Letters of a beginning, and the share of its uses that a longer term must have to replace it.
STEM, COVERS = range(5, 13), 0.6

# Letters that look like a Latin letter, digits and signs used in place of letters.
LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ß": "ss", "ı": "i", "ɑ": "a", "ɡ": "g", "ø": "o", "ł": "l", "đ": "d",
}
STAND_IN = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
EXCEPTIONS = ("the trash", "trash can", "trash cans", "trash bin", "trash bag", "trash bags", "clown fish", "clown nose", "scum line", "pond scum", "loser bracket", "worthless currency", "idiot proof")


def _table() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for code in [*range(0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000), *range(0xFF00, 0xFF5F)]:
        latin = code < 0x250 or 0x1E00 <= code < 0x1F00
        base = unicodedata.normalize("NFKC", chr(code)).lower() if latin else "".join(c for c in unicodedata.normalize("NFKD", chr(code)).lower() if not unicodedata.combining(c))
        base = "".join(LOOK_ALIKE.get(c, c) for c in base).replace("l", "i")
        if base != chr(code) or not (base.isalpha() or base in STAND_IN):
            table[code] = base if base and all(c.isalpha() or c in STAND_IN for c in base) else " "
    table |= {ord("l"): "i", ord("L"): "i", ord("|"): "i"}  # "1" stands for both, so both fold to one letter
    return table | {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370))}


_TABLE = _table()
_NUMBER = re.compile(r"[0-9@$]+")
_WITH_STAND_IN = re.compile(r"[^\W\d_]*[0-9@$]+[^\W\d_]+[^\W_]*|[^\W\d_]+[0-9@$]+[^\W_]*")


def fold(text: str | None) -> str:
    """The folded text between two spaces; digits stay out unless their word has letters too."""
    text = text or ""
    text = (text if text.isascii() else unicodedata.normalize("NFC", text)).translate(_TABLE)
    if _NUMBER.search(text):
        text = _WITH_STAND_IN.sub(lambda m: "".join(STAND_IN.get(c, c) for c in m.group()), text)
        text = _NUMBER.sub(" ", text)
    return f" {' '.join(text.split())} "


@dataclass
class Lexicon:
    """Terms with weights (a closing space asks for the whole word) and the curve's coefficients."""

    terms: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, float, float] = (-3.0, 1.0, 0.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            found.add_word(f" {term}", (len(term) + 1, weight))
            if term.endswith(" "):
                found.add_word(f" {term[:-1]}s ", (len(term) + 2, weight))
        for phrase in EXCEPTIONS:
            found.add_word(fold(phrase), (len(fold(phrase)), None))
        found.make_automaton()
        return found

    def features(self, automaton, text: str | None) -> tuple[float, float]:
        folded = fold(text)
        hits, calm = {}, []
        for end, (size, weight) in automaton.iter(folded):
            start = end - size + 1
            if weight is None:
                calm.append((start, end))
            else:
                hits[start] = max(weight, hits.get(start, 0.0))
        total = sum(w for at, w in hits.items() if not any(a <= at < b for a, b in calm))
        return math.log1p(total), min(5.0, 100.0 * total / (folded.count(" ") + 20))

    def score(self, x: tuple[float, float]) -> float:
        z = self.curve[0] + self.curve[1] * x[0] + self.curve[2] * x[1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _words(text: pd.Series) -> pd.Series:
    return text.map(lambda t: sorted({w for w in fold(t).split() if len(w) > 2}))


def choose(found: list[tuple[str, int, float]]) -> dict[str, float]:
    """Terms and weights out of (term, uses in toxic texts, odds), most used first; a term that begins with a chosen one adds nothing."""
    uses, terms = {t: p for t, p, _ in found}, {}
    covered: set[str] = set()
    for t, p, _ in found:
        covered.update(t[:k] for k in STEM if k < len(t.rstrip()) + t.endswith(" ") and p >= COVERS * uses.get(t[:k], p + p))
    for t, _, odd in found:
        if len(terms) < MAX_TERMS and t not in covered and not any(t[:k] in terms for k in range(1, len(t))):
            terms[t] = round(min(4.0, math.log(odd) / 2), 3)
    return terms


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> Lexicon:
    """Learn from at most max_train labelled rows, taken in order of a hash of the id. labels: (doc_id, toxic).

    Rows without a label of 0 or 1 teach nothing; without toxic rows the lexicon is empty.
    """
    sample = labels.filter("toxic IN (0, 1)").select(F.col("doc_id").alias("__id"), F.col("toxic").alias("__y")).dropna().dropDuplicates(["__id"]).orderBy(F.xxhash64("__id"), "__id").limit(max_train)
    # The sample is bounded by a parameter: at most max_train pairs of numbers are broadcast.
    train = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(sample), "__id").select("__y", "__text").persist()
    try:
        n1, n0 = (train.agg(F.sum("__y"), F.sum(1 - F.col("__y"))).first() or (0, 0))[:2]
        if not n1 or not n0:
            return Lexicon()
        words = train.select("__y", F.explode(_words("__text")).alias("w")).groupBy("w").agg(F.sum("__y").alias("p"), F.sum(1 - F.col("__y")).alias("n"))
        # 0 stands for the whole word.
        sizes = F.concat(F.array(F.lit(0)), F.filter(F.array(*map(F.lit, STEM)), lambda k: k < F.length("w")))
        stems = words.select("p", "n", "w", F.explode(sizes).alias("k")).withColumn("t", F.when(F.col("k") == 0, F.concat("w", F.lit(" "))).otherwise(F.substring("w", F.lit(1), F.col("k"))))
        odds = ((F.col("p") + 0.1) / n1) / ((F.col("n") + 0.1) / n0)
        best = stems.groupBy("t").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).withColumn("odds", odds).filter((F.col("p") >= MIN_DOCS) & (F.col("odds") >= MIN_ODDS))
        lexicon = Lexicon(choose(best.orderBy(F.desc("p"), F.length("t"), "t").select("t", "p", "odds").limit(MAX_TERMS * 20).collect()))
        rows = train.select("__y", lexicon_features(lexicon)("__text").alias("x")).select("__y", "x.*").collect()
        lexicon.curve = _fit(np.array([[r[1], r[2]] for r in rows]), np.array([r[0] for r in rows], dtype=float))
        return lexicon
    finally:
        train.unpersist()


def _fit(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small ridge, slopes not below 0."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    ridge = np.diag([1e-3, 0.1, 0.1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge + 1e-9 * np.eye(3), a.T @ (p - y) + ridge @ w)
    if w[1] < 0 or w[2] < 0:
        keep = 1 if w[2] < 0 else 2
        return _fit(np.column_stack([x[:, 0] if keep == 1 else 0 * x[:, 0], x[:, 1] if keep == 2 else 0 * x[:, 1]]), y, steps) if (x[:, 2 - keep] != 0).any() else tuple(np.maximum(w, [-30, 0, 0]))
    return tuple(float(v) for v in w)


def lexicon_features(lexicon: Lexicon):
    @F.pandas_udf("struct<hits:double,rate:double>")
    def features(text: pd.Series) -> pd.DataFrame:
        automaton = lexicon.automaton()
        return pd.DataFrame([lexicon.features(automaton, t) for t in text], columns=["hits", "rate"], index=text.index)

    return features


def scorer(lexicon: Lexicon):
    """A column function: text -> score from 0 to 1. Null and empty texts score as texts without matches."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        automaton = lexicon.automaton()
        return text.map(lambda t: lexicon.score(lexicon.features(automaton, t)), na_action=None).astype("float64")

    return score

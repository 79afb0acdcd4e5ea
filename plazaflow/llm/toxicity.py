"""Toxicity by boosted trees over dense features, with isotonic calibration.

A lexicon is learned from two thirds of a bounded labelled sample: words, and beginnings of words, that stand out in toxic
texts by Dunning's log-likelihood ratio. The trees are grown on these two thirds; there, the features of either half come
from the lexicon of the other half, so no tree sees a text through a lexicon that the text shaped. The last third, which
neither the lexicon nor the trees have seen, calibrates them on the features that scoring uses, those by the whole lexicon.
Scoring maps every whole text to some twenty rates.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazaflow.llm.boosting import Boosted, calibrated, fit_isotonic, fit_trees
from plazaflow.llm.common import batches, cut, held_out, texts
from plazaflow.llm.labelled import labelled_sample

#: Labelled rows that are learned from, at most.
SAMPLE = 24_000
#: Lexicon entries, at most; the least number of toxic texts and odds ratio of an entry.
ENTRIES, LEAST_TEXTS, LEAST_ODDS = 4000, 3, 4.0
PREFIXES = (4, 5, 6)
#: Letters of a word that unrelated texts hardly share.
LONG_WORD = 10
#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos ti tú tus usted ustedes vosotros".split())
#: Digits and signs that stand for letters in disguised words.
DISGUISE = str.maketrans("013457@$!|€", "oieastasile")
#: A second-person word this near to a lexicon word counts.
NEAR = 4

NOT_LETTERS = re.compile(r"[\W\d_]+")
RUN = re.compile(r"(.)\1{2,}")


def plain(token: str) -> str:
    """The token's letters in lower case."""
    return NOT_LETTERS.sub("", token).lower()


def undisguised(token: str) -> str:
    """The letters that a token with digits, signs or drawn-out letters may stand for."""
    core = token.strip(".,;:!?\"'()[]{}-*#%&$").lower()
    return RUN.sub(r"\1", NOT_LETTERS.sub("", core.translate(DISGUISE)))


def units(word: str) -> list[str]:
    """What is looked up of a word: itself, and its beginnings, marked by a hyphen."""
    return [word, *(word[:n] + "-" for n in PREFIXES if len(word) > n)] if len(word) > 2 else []


def log_ratio(n1: Column, n0: Column, all1: float, all0: float) -> Column:
    """Dunning's G2 of being in n1 of all1 toxic and n0 of all0 other texts."""
    part = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
    share = (n1 + n0) / (all1 + all0)
    miss = F.greatest(1 - share, F.lit(1e-12))
    return 2 * (part(n1, all1 * share) + part(n0, all0 * share) + part(all1 - n1, all1 * miss) + part(all0 - n0, all0 * miss))


def least_ratio(all1: float) -> float:
    """Ratio that chance hardly reaches among the units of so many toxic texts: the more are tried, the higher."""
    return 2 * float(np.log(50 * max(all1, 1))) + 4


def learn_lexicons(sample: DataFrame) -> list[dict[str, float]]:
    """{unit: log odds ratio} of the sample's half 0, of its half 1, and of all of it. Texts are counted once however often
    a unit stands in them; of texts with the same least hash of a long word, which are near copies as a rule, only one
    counts: else whatever words a copied toxic text has would stand out. What reaches the driver is bounded by ENTRIES."""
    long_words = F.filter(F.split("text", r"\s+"), lambda w: F.length(w) >= LONG_WORD)
    key = F.coalesce(F.array_min(F.transform(long_words, lambda w: F.xxhash64(w))), F.xxhash64("text"))
    once = sample.groupBy(key.alias("_key")).agg(F.min_by("text", F.struct("half", "doc_id")).alias("text"), F.min_by("label", F.struct("half", "doc_id")).alias("label"), F.min("half").alias("half"))
    names = [f"n{half}{label}" for half in (0, 1) for label in (0, 1)]

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Counter() for _ in names]
        for batch in source:
            for text, label, half in zip(texts(batch.column("text")), batch.column("label").to_pylist(), batch.column("half").to_pylist()):
                words = {w for t in set(text.split()) if (w := plain(t))}
                found[2 * half + (label > 0)].update({"", *(u for w in words for u in units(w))})
        every = sorted(set().union(*found))
        if every:
            yield pa.RecordBatch.from_arrays([pa.array(every), *(pa.array([c[u] for u in every], pa.int64()) for c in found)], ["unit", *names])

    counts = once.select("text", "label", "half").mapInArrow(count, "unit string, " + ", ".join(f"{n} bigint" for n in names)).groupBy("unit").agg(*(F.sum(n).alias(n) for n in names))
    counts = cut(counts.where((F.col("n01") + F.col("n11") >= LEAST_TEXTS) | (F.col("unit") == "")))
    total = counts.where("unit = ''").first()
    out = []
    for halves in ((0,), (1,), (0, 1)):
        all0, all1 = (float(sum(total[f"n{h}{label}"] for h in halves)) if total else 0.0 for label in (0, 1))
        if not all0 or not all1:
            out.append({})
            continue
        n0, n1 = (sum((F.col(f"n{h}{label}") for h in halves), F.lit(0)) for label in (0, 1))
        odds = (n1 + 0.5) / (all1 + 1) / ((n0 + 0.5) / (all0 + 1))
        rated = counts.where("unit <> ''").select("unit", n1.alias("n1"), log_ratio(n1, n0, all1, all0).alias("g2"), odds.alias("odds"))
        chosen = rated.where((F.col("n1") >= LEAST_TEXTS) & (F.col("g2") >= least_ratio(all1)) & (F.col("odds") >= LEAST_ODDS))
        out.append({r.unit: math.log(r.odds) for r in chosen.orderBy(F.desc("g2"), "unit").limit(ENTRIES).collect()})
    return out


#: Columns of a token's facts.
HIT, WEIGHT, HIDDEN, PERSON, CAPS, CAPITAL, MARKS, EXCLAIM, MIXED, DRAWN, LETTERS, SINGLE = range(12)
NAMES = ("hits", "hit_rate", "weight_rate", "top_weight", "distinct", "hidden", "hidden_rate", "near_person", "near_rate", "person_rate", "caps_rate", "capital_rate", "marks_rate", "exclaim_rate", "mixed_rate", "drawn_rate", "word_length", "spelled", "words")


class Features:
    """Rates of a text; facts of tokens are kept, up to a number."""

    KEPT = 400_000

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.numbers: dict[str, int] = {}
        self.facts = np.zeros((1024, 12), np.float32)

    def weight(self, word: str) -> float:
        return max((self.lexicon.get(u, 0.0) for u in units(word)), default=0.0)

    def number(self, token: str) -> int:
        k = self.numbers[token] = len(self.numbers)
        if k == len(self.facts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
        word = plain(token)
        weight = self.weight(word)
        mixed = any(not c.isalpha() for c in token.strip(".,;:!?\"'()[]{}-"))
        drawn = bool(RUN.search(token))
        hidden = 0.0 if weight or not (mixed or drawn) else self.weight(undisguised(token))
        upper = sum(c.isupper() for c in token)
        self.facts[k] = (weight > 0, weight, hidden, word in SECOND_PERSON, upper > 1 and upper == len(word), upper == 1, sum(not c.isalnum() for c in token), token.count("!") + token.count("?"), mixed, drawn, len(word), len(word) == 1)
        return k

    def row(self, text: str) -> list[float]:
        tokens = text.split()
        n = len(tokens)
        if not n:
            return [0.0] * len(NAMES)
        if len(self.numbers) > self.KEPT:
            self.numbers.clear()
        get, number = self.numbers.get, self.number
        at = np.fromiter((k if (k := get(t)) is not None else number(t) for t in tokens), np.int64, n)
        facts = self.facts[at]
        total = facts.sum(0, dtype=np.float64)
        hit = np.flatnonzero((facts[:, HIT] > 0) | (facts[:, HIDDEN] > 0))
        near = 0
        if len(hit) and total[PERSON]:
            person = np.flatnonzero(facts[:, PERSON])
            gap = np.searchsorted(person, hit)
            near = int(((np.abs(person[np.minimum(gap, len(person) - 1)] - hit) <= NEAR) | (np.abs(person[np.maximum(gap - 1, 0)] - hit) <= NEAR)).sum())
        spelled = 0
        if total[SINGLE] >= 3:  # words spelled letter by letter
            single = np.flatnonzero(facts[:, SINGLE])
            for run in np.split(single, np.flatnonzero(np.diff(single) > 1) + 1):
                spelled += len(run) > 2 and self.weight("".join(plain(tokens[i]) for i in run)) > 0
        hits = len(hit)
        weights = np.maximum(facts[hit, WEIGHT], facts[hit, HIDDEN]) if hits else np.zeros(1)
        hidden = int((facts[:, HIDDEN] > 0).sum())
        return [float(hits), hits / n, float(weights.sum()) / n, float(weights.max()), float(len(np.unique(at[hit]))), float(hidden), hidden / n, float(near), near / n, total[PERSON] / n, total[CAPS] / n, total[CAPITAL] / n, total[MARKS] / n, total[EXCLAIM] / n, total[MIXED] / n, total[DRAWN] / n, total[LETTERS] / n, float(spelled), float(np.log1p(n))]


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Boosted
    knots: tuple[np.ndarray, np.ndarray]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return calibrated(self.trees.raw(rows), self.knots)


def feature_rows(source: Iterator[pa.RecordBatch], lexicon: dict[str, float]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    own = Features(lexicon)
    for batch in batches(source, "text"):
        yield batch, np.array([own.row(t) for t in texts(batch.column("text"))], np.float64).reshape(-1, len(NAMES))


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", most: int = SAMPLE) -> Model:
    """A model from at most `most` labelled rows that may be learned from. With none of either label it says their share.
    Where a sample is so small that its last third lacks a label, the trees are grown and calibrated on all of it."""
    hashed = F.xxhash64("doc_id", F.lit(1))
    sample = labelled_sample(docs, labels, column, most).withColumns({"half": F.pmod(hashed, F.lit(2)), "fold": F.pmod(F.shiftright(hashed, 8), F.lit(3))})
    *halves, lexicon = learn_lexicons(sample.where("fold < 2"))

    def features(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = [Features(halves[1]), Features(halves[0]), Features(lexicon)]
        for batch in batches(source, "text"):
            rows = [by[2 if fold == 2 else half].row(t) for t, half, fold in zip(texts(batch.column("text")), batch.column("half").to_pylist(), batch.column("fold").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("label"), batch.column("fold"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "label", "fold", "x"])

    rest = sample.mapInArrow(features, "doc_id bigint, label int, fold bigint, x array<double>").toPandas()
    rest = rest.sort_values("doc_id", kind="stable").drop_duplicates("doc_id")
    x, y = np.array(rest.x.tolist(), np.float64).reshape(-1, len(NAMES)), (rest.label.to_numpy() > 0).astype(float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(lexicon, Boosted([], 0.0), (np.zeros(1), np.array([share])))
    hold = (rest.fold == 2).to_numpy()
    both = 0 < y[hold].sum() < hold.sum() and 0 < y[~hold].sum() < (~hold).sum()
    grown, level = (~hold, hold) if both else (np.ones(len(y), bool),) * 2
    trees = fit_trees(x[grown], y[grown])
    return Model(lexicon, trees, fit_isotonic(trees.raw(x[level]), y[level]))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row: a map over whole texts. Null texts count as empty; repeated rows and null ids come out as they go in."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in feature_rows(source, model.lexicon):
            found = model.scores(rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(found), pa.array((found >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))

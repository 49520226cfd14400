"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

* Folding: lower case; homoglyphs (Greek, Cyrillic and full-width look-alikes),
  digit and sign substitutions become Latin letters, invisible characters go,
  signs become spaces. Accented letters are letters of their own in many
  languages, so a text is folded twice, with and without its accents:
  ``1D!0T``, ``idiоt`` (Cyrillic o) and ``idïot`` all read ``idiot`` in one of both.
* Lexicon: learned from a bounded sample of labelled rows. Folded words and word
  beginnings of ``STEM`` letters are counted by class over all sampled
  documents; an entry's weight is its log-odds of the toxic class. Entries need
  ``min_share`` of the toxic documents as support and ``min_weight``; a beginning
  must cover ``STEM_WORDS`` different words; an entry is dropped when a shorter
  beginning of it weighs about as much. Entries without accents also hold in the
  text without accents if their weight there is enough.
* Matching: one automaton holds the entries, anchored at word starts, and the
  exception phrases. A word counts once, with its heaviest entry, and not at all
  inside an exception phrase.
* Score: the summed weight and the weight per 100 words (both as log1p) go into a
  logistic function fitted on the same sample. Texts without a match all score
  the same low value.

Rows of the sample are those whose crc32(doc_id as text) mod 3 is not 1, in the
order of a hash of the id, ``sample_rows`` at most; copies of a text count once, as toxic
if any of them is.
Language, source and id are never inputs. Null and empty texts score like texts
without a match. Without any toxic or any clean labelled row the score is 0. An empty
table gives an empty result; an empty table of labels leaves no lexicon.
Repeated rows are scored one by one, several labels of one id count as toxic if
any is. Columns of the input are passed through and may have any name.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_crc, prepare, stage, table

#: Letters of a word beginning that may become an entry.
STEM = (4, 5, 6, 7, 8)

#: Words with that beginning that a stem must cover, else its words stand by themselves.
STEM_WORDS = 3

#: Digits and signs used for letters (fixed values).
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}

#: Letters of other scripts that look like Latin ones (fixed values).
LOOKALIKES = dict(zip(
    "абвгдеёзийкмнорстухьіјѕһԁԛԝαβγεηικνορτυχωıɡøłđħ",
    "abbrdeezuukmhopctyxbijshdqwabyenikvoptuxwigoldh",
))

#: Phrases with a lexicon word that are not insults.
EXCEPTIONS = ("class clown", "clown fish", "trash can", "trash bin", "pond scum", "loser takes", "sore loser")

_FOLDS: dict[int, str | None] = {}
for _c in [*range(0x80), *range(0xFF01, 0xFF5F)]:
    _ch = unicodedata.normalize("NFKC", chr(_c)).lower()
    _FOLDS[_c] = SUBSTITUTES.get(_ch, _ch if _ch.isalpha() else " ")
_FOLDS |= {ord(x): b for a, b in LOOKALIKES.items() for x in (a, a.upper()) if len(x) == 1}
_FOLDS |= {c: " " for c in (*range(0x80, 0xAA), *range(0xAB, 0xB5), *range(0x2000, 0x200B), *range(0x2010, 0x2030), 0x3000)}
#: Invisible characters put between letters disappear.
_FOLDS |= {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}

_ACCENTS = {c: b for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if (b := unicodedata.normalize("NFKD", chr(c))[0]).isascii()}
_ACCENTS |= {c: None for c in range(0x300, 0x370)}


def fold(text: str) -> str:
    """Words of folded letters, separated and enclosed by single spaces."""
    return f" {' '.join(text.lower().translate(_FOLDS).split())} "


def bare(folded: str) -> str:
    """A folded text without accents."""
    return folded if folded.isascii() else folded.translate(_ACCENTS)


@dataclass(frozen=True)
class Model:
    """Entries begin with a space; those that also end with one are whole words."""

    weights: dict[str, float]
    bare_weights: dict[str, float]
    exceptions: tuple[str, ...]
    coefficients: tuple[float, float, float] | None

    def automata(self) -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
        """For the folded text, and for the text without accents."""
        both = []
        for weights in (self.weights, self.bare_weights):
            a = ahocorasick.Automaton()
            for entry, w in weights.items():
                a.add_word(entry, (len(entry), w))
            for phrase in self.exceptions:
                entry = fold(phrase)
                a.add_word(entry, (len(entry), None))
            a.add_word("\0", (1, None))  # never empty
            a.make_automaton()
            both.append(a)
        return both[0], both[1]

    def features(self, automata, text: str | None) -> tuple[float, float]:
        folded = fold(text or "")
        total = weigh(automata[0], folded)
        if not folded.isascii():
            total = max(total, weigh(automata[1], bare(folded)))
        if not total:
            return 0.0, 0.0
        return math.log1p(total), math.log1p(100 * total / max(1, folded.count(" ") - 1))

    def score(self, features: tuple[float, float]) -> float:
        if self.coefficients is None:
            return 0.0
        z = self.coefficients[0] + self.coefficients[1] * features[0] + self.coefficients[2] * features[1]
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def weigh(automaton: ahocorasick.Automaton, folded: str) -> float:
    """Summed weight of the matched words outside exception phrases."""
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (n, w) in automaton.iter(folded):
        start = end - n + 1
        if w is None:
            spared.append((start, end))
        else:
            best[start] = max(w, best.get(start, 0.0))
    spared.sort()
    total, reach, k = 0.0, -1, 0
    for at in sorted(best):  # words and phrases side by side, each looked at once
        while k < len(spared) and spared[k][0] <= at:
            reach = max(reach, spared[k][1])
            k += 1
        if at >= reach:
            total += best[at]
    return total


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[float, float, float]:
    """Logistic regression with a ridge penalty on the slopes, by Newton's method."""
    a = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(3)
    penalty = np.diag([0.0, ridge, ridge])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        gradient = a.T @ (p - y) + penalty @ b
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(3), gradient)
        b -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in b)


def _entries(batches):
    """Toxic and clean documents of each word of a batch; ``bare`` is the word without accents."""
    for b in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
            counts[1 if toxic else 0].update(set(fold(text or "").split()))
        for n in (0, 1):
            words = list(counts[n])
            for i in range(0, len(words), 20_000):
                part = words[i : i + 20_000]
                found = pa.array([counts[n][w] for w in part], pa.int64())
                none = pa.array([0] * len(part), pa.int64())
                yield pa.RecordBatch.from_pydict({
                    "word": pa.array(part, pa.string()), "bare": pa.array([bare(w) for w in part], pa.string()),
                    "toxic": found if n else none, "clean": none if n else found,
                })


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """``text, toxic`` of the labelled rows that may be learned from, copies once.

    The sampled ids are at most ``sample_rows``: that bound lets them be broadcast,
    so the texts are scanned in place."""
    chosen = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (id_crc(F.col("doc_id")) % 3 != 1))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    return (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("text")
        .agg(F.max("toxic").alias("toxic"))
    )


def _without_longer(weights: dict[str, float]) -> dict[str, float]:
    """Without the entries that a beginning of theirs covers, which weighs about as much."""

    def covered(entry: str) -> bool:
        stems = [entry[: n + 1] for n in STEM if n + 1 < len(entry)]
        return any(weights.get(x, -math.inf) >= weights[entry] - 1 for x in stems)

    return {e: w for e, w in weights.items() if not covered(e)}


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    sample_rows: int = 20_000,
    min_share: float = 0.002,
    min_weight: float = 3.0,
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> Model:
    """A model from ``docs (doc_id, text)`` and ``labels (doc_id, toxic)``; the
    entries and two numbers for each sampled row are all that reaches the driver, and the
    sample bounds both."""
    spark = docs.sparkSession
    prepare(spark)
    sample = stage(spark, labelled_sample(docs, labels, sample_rows), "toxic-sample")
    of = {r["t"]: r["n"] for r in sample.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = of.get(True, 0), of.get(False, 0)
    if not toxic or not clean:
        return Model({}, {}, exceptions, None)
    found = sample.mapInArrow(_entries, "word string, bare string, toxic bigint, clean bigint")
    found = found.groupBy("word", "bare").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))

    def stems(word: str):
        beginnings = [F.when(F.length(word) >= n, F.concat(F.lit(" "), F.substring(word, 1, n))) for n in STEM]
        return F.transform(F.array(F.concat(F.lit(" "), word, F.lit(" ")), *beginnings), lambda e: F.struct(F.lit(word == "bare").alias("bare"), e.alias("entry")))

    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    heavy = (
        found.select(F.explode(F.concat(stems("word"), stems("bare"))).alias("e"), "toxic", "clean")
        .select("e.*", "toxic", "clean")
        .filter("entry IS NOT NULL")
        .groupBy("bare", "entry")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count_if(F.col("toxic") > 0).alias("words"))
        .filter(F.col("toxic") >= max(3.0, min_share * toxic))
        .filter((F.col("words") >= STEM_WORDS) | F.col("entry").endswith(" "))
        .withColumn("weight", weight)
        .filter(F.col("weight") >= min_weight)
    )
    got = heavy.select("bare", "entry", "weight").collect()
    weights = _without_longer({r["entry"]: r["weight"] for r in got if not r["bare"]})
    bare_weights = {r["entry"]: r["weight"] for r in got if r["bare"] and r["entry"] in weights}
    model = Model(weights, bare_weights, exceptions, None)

    def pairs(batches):
        automata = model.automata()
        for b in batches:
            got = [model.features(automata, t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"a": pa.array([g[0] for g in got], pa.float64()), "b": pa.array([g[1] for g in got], pa.float64()), "y": b.column("toxic").cast(pa.int64())})

    rows = sorted(sample.mapInArrow(pairs, "a double, b double, y bigint").collect())  # one order, whatever the tasks
    x = np.array([(r["a"], r["b"]) for r in rows])
    y = np.array([float(r["y"] > 0) for r in rows])
    return Model(weights, bare_weights, exceptions, _fit(x, y))


def toxicity(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with a struct column ``toxicity`` of ``score`` and ``toxic``."""

    prepare(docs.sparkSession)
    built: list = []  # once per task, not per batch

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if not built:
            built.append(model.automata())
        return pa.array([model.score(model.features(built[0], t)) for t in texts.to_pylist()], pa.float64())

    s = score(docs[text])
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), s.alias("score"))
    return row.select("row", F.struct("score", (F.col("score") >= threshold).alias("toxic")).alias("toxicity")).select("row.*", "toxicity")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    got = toxicity(docs, model)
    return got.select(
        "doc_id",
        (id_crc(F.col("doc_id")) % 3 == 1).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        F.col("toxicity.toxic").cast("int").alias("predicted"),
    )


def clean_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not toxic, with their own columns."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {c: f"c{i}" for i, c in reversed(list(enumerate(docs.columns)))}
    got = toxicity(plain, model, text=at["text"])
    return got.filter(~F.col("toxicity.toxic")).drop("toxicity").toDF(*docs.columns)

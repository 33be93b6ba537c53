"""Language identification in two steps: the language family, then the language within it.

Features are the square roots of the shares of hashed letter bigrams and
trigrams, so every text is a point on the unit sphere whatever its length.
Families are told apart by one-versus-rest linear support vector machines,
the languages of a family by one-versus-one machines and their votes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.common import batches, cut, free_name, worker_keep

DIMENSIONS = 8192
# The bound of the training sample: documents a language.
SAMPLE = 400
# Beyond this the languages are not labels of languages; their counts are broadcast.
MOST_LANGUAGES = 10_000
# Families of closely related languages. Others are a family of their own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "finnic": ("et", "fi"),
    "celtic": ("br", "cy", "ga", "gd"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "turkic": ("az", "kk", "ky", "tk", "tr", "ug", "uz"),
    "semitic": ("am", "ar", "he", "mt"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "malay": ("id", "jv", "ms", "tl"),
}
FAMILY_OF = {language: family for family, languages in FAMILIES.items() for language in languages}


def held_out(key: Column) -> Column:
    """Whether a row takes no part in learning: crc32 of its key as text leaves 2 divided by 4. A null key is held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def gram_counts(text: str | None, is_letter: np.ndarray) -> np.ndarray | None:
    """Counts of hashed bigrams and trigrams of the lower-cased letters, words set off by blanks; None without a letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = is_letter[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each run of letters
    codes = np.concatenate([[np.uint32(32)], codes[keep], [np.uint32(32)]]).astype(np.uint32)
    two = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + codes[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - (DIMENSIONS.bit_length() - 1))
    return np.bincount(np.concatenate([two, three * np.uint32(0x9E3779B1)]) >> shift, minlength=DIMENSIONS)


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights (the last one is the constant) of a linear SVM with squared hinge loss, by coordinate descent on the dual; y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    norm = (x * x).sum(1) + 0.5 / c
    w, alpha = np.zeros(x.shape[1], np.float64), np.zeros(len(x))
    turn = np.random.default_rng(7)
    for _ in range(rounds):
        most = 0.0
        for i in turn.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / c
            new = max(0.0, alpha[i] - gradient / norm[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-4:
            break
    return w.astype(np.float32)


class Model:
    """Weights by classifier: ("family", f) tells f from the rest, ("pair", a, b) a (positive) from b."""

    def __init__(self, languages: list[str], weights: dict[tuple[str, ...], np.ndarray]):
        self.families: dict[str, list[str]] = {}
        for language in sorted(languages):
            self.families.setdefault(FAMILY_OF.get(language, language), []).append(language)
        self.names = sorted(weights)
        self.matrix = np.array([weights[n] for n in self.names], np.float32).reshape(len(self.names), DIMENSIONS + 1)

    def predict(self, counts: np.ndarray) -> tuple[str, float]:
        """Language and score (0 to 1: the family's share times the mean win over its relatives)."""
        x = np.append(np.sqrt(counts / counts.sum()).astype(np.float32), np.float32(1))
        wins = dict(zip(self.names, 1 / (1 + np.exp(-4 * np.clip(self.matrix @ x, -20, 20).astype(float))), strict=True))
        share = {f: wins.get(("family", f), 1.0) for f in self.families}
        family = max(share, key=lambda f: (share[f], f))
        languages = self.families[family]
        against = {a: [wins["pair", a, b] if a < b else 1 - wins["pair", b, a] for b in languages if b != a] or [1.0] for a in languages}
        votes = {a: (sum(w > 0.5 for w in against[a]), sum(against[a])) for a in languages}
        best = max(languages, key=lambda a: (votes[a], a))
        return best, float(share[family] / sum(share.values()) * sum(against[best]) / len(against[best]))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model | None:
    """A model from the rows that are not held out and have a language; None without any.

    At most `sample` documents a language, those with the smallest hashes of
    their keys, are used, whole. Executors turn them into features and train one
    machine a task; only weights come to the driver.
    """
    rows = docs.where(~held_out(F.col(key)) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    # The smallest hashes lie below a bound that four times as many rows meet: only those are ranked.
    # The smallest one counts anyway, in case a few keys make up a language.
    totals = cut(rows.groupBy(F.col(lang).alias("label")).agg(F.count("*").alias("total"), F.min(F.xxhash64(key)).alias("least")))
    if totals.count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    keyed = rows.select(F.col(key).alias("id"), F.col(lang).alias("label"), F.xxhash64(key).alias("hash")).join(F.broadcast(totals), "label")
    is_low = F.col("hash") / F.lit(2.0**64) + 0.5 <= F.lit(4.0 * sample) / F.col("total")
    low = keyed.where(is_low | (F.col("hash") == F.col("least"))).select("id", "label", "hash").distinct()
    first = low.select("id", "label", F.row_number().over(Window.partitionBy("label").orderBy("hash", "id")).alias("n")).where(F.col("n") <= sample)
    chosen = cut(first.select("id", "label"))
    languages = sorted(r.label for r in chosen.select("label").distinct().collect())
    if not languages:
        return None
    classes: list[tuple[tuple[str, ...], list[str], list[str]]] = []
    families: dict[str, list[str]] = {}
    for language in languages:
        families.setdefault(FAMILY_OF.get(language, language), []).append(language)
    if len(families) > 1:
        classes += [(("family", f), own, [x for x in languages if x not in own]) for f, own in families.items()]
    classes += [(("pair", a, b), [a], [b]) for own in families.values() for a, b in combinations(own, 2)]
    if not classes:
        return Model(languages, {})

    def features(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter = worker_keep("letters", _letters)
        for batch in batches_:
            label, at, share = [], [], []
            for name, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (counts := gram_counts(body, is_letter)) is not None:
                    some = np.flatnonzero(counts)
                    label.append(name)
                    at.append(some.astype(np.int32))
                    share.append(np.sqrt(counts[some] / counts.sum()).astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))], ["label", "at", "share"])

    picked = docs.select(F.col(key).alias("id"), F.col(text).alias("body")).join(chosen, "id").select("label", "body")
    points = batches(picked, features, "label string, at array<int>, share array<float>")
    roles = F.array(*[
        F.when(F.col("label").isin(yes), F.struct(F.lit(n).alias("machine"), F.lit(1.0).alias("side")))
        .when(F.col("label").isin(no), F.struct(F.lit(n).alias("machine"), F.lit(-1.0).alias("side")))
        for n, (_, yes, no) in enumerate(classes)
    ])

    def train(group: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((len(group), DIMENSIONS), np.float32)
        group = group.reset_index(drop=True)
        for i, (at, share) in enumerate(zip(group["at"], group["share"], strict=True)):
            x[i, at] = share
        return pd.DataFrame({"machine": [group["machine"][0]], "weights": [train_svm(x, group["side"].to_numpy())]})

    dealt = points.withColumn("role", F.explode(roles)).where("role is not null").select("role.machine", "role.side", "at", "share")
    trained = dealt.groupBy("machine").applyInPandas(train, "machine int, weights array<float>").collect()
    return Model(languages, {classes[r.machine][0]: np.array(r.weights, np.float32) for r in trained})


def identify(docs: DataFrame, model: Model | None, text: str = "text", extra: tuple[str, ...] = ("doc_id",), into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `extra` of every row with the language and its score (named by `into`), from the whole text alone.

    A null text, one without a letter, or no model gives `und` and score 0. Rows
    stay as they are. No shuffle.
    """
    inner = docs.select(*[F.col(f"`{c}`") for c in extra], F.col(text).alias(free_name("body to read", extra)))

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter = worker_keep("letters", _letters)
        for batch in rows:
            found = []
            for body in batch.column(len(extra)).to_pylist():
                counts = gram_counts(body, is_letter) if model else None
                found.append(("und", 0.0) if counts is None else model.predict(counts))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(extra)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*extra, *into],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-1])
    return batches(inner, work, f"{kinds}, `{into[0]}` string, `{into[1]}` double")

"""Language ID by hyperdimensional letter profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. The vector of a letter
n-gram is the product of its letters' vectors, each rotated by its place. A text's vector is the sum
over all its n-grams (lower case, every run of other characters one space), a language's prototype
the sum of its texts' unit vectors. The mean of the prototypes is taken from both sides, since all
languages share it, and the language with the largest cosine is predicted.

Sums of prototypes are whole numbers (units of 1e-6), so they do not depend on the order in which
partitions are added. The model has one vector per language label; labels are few by nature.

Defined results: a null text, or one without letters, is ``und`` with score 0. Equal cosines go to
the smallest label. With no usable training rows every text is ``und``. Rows of null language are not
learned from. Extra columns are ignored.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "und"
# Letters are Unicode letters (category L); marks stay with them inside n-grams. Everything else,
# numbers of every kind included, is a space.
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
# In ASCII texts the letters are a to z after lower-casing; the same rule, by a faster pattern.
_ASCII_OTHER = re.compile(r"[^a-z]+")
_NONE = np.zeros(0, np.int64)
_UNIT = 1e6


@dataclass(frozen=True)
class Profile:
    """Settings: dimensions of the vectors, letters of an n-gram, seed of the letters' vectors."""

    dims: int = 1024
    grams: int = 3
    seed: int = 17

    def __post_init__(self):
        # An n-gram is numbered by its code points, 21 bits each, in one 64-bit integer.
        if not 1 <= self.grams <= 3:
            raise ValueError("n-grams have 1 to 3 letters")


class Bundler:
    """Vectors of texts. Letters' and n-grams' vectors that were used are kept up to a bound."""

    def __init__(self, profile: Profile, kept: int = 1 << 14):
        self.p, self.kept = profile, kept
        self.letters: dict[tuple[str, int], np.ndarray] = {}
        self.grams: dict[int, np.ndarray] = {}

    def letter(self, c: str, place: int = 0) -> np.ndarray:
        """The letter's vector rotated by ``place``."""
        found = self.letters.get((c, place))
        if found is None:
            if len(self.letters) >= self.kept:
                self.letters.clear()
            draw = np.random.default_rng((self.p.seed, ord(c)))
            found = draw.integers(0, 2, self.p.dims, dtype=np.int8) * np.int8(2) - np.int8(1)
            found = np.roll(found, place)
            self.letters[(c, place)] = found
        return found

    def gram(self, g: int) -> np.ndarray:
        """Vector of an n-gram given by its number (code points, 21 bits each, first one highest)."""
        found = self.grams.get(g)
        if found is None:
            if len(self.grams) >= self.kept:
                self.grams.clear()
            n = self.p.grams
            points = [(g >> (21 * (n - 1 - place))) & 0x1FFFFF for place in range(n)]
            found = self.letter(chr(points[0]))
            for place in range(1, n):
                found = found * self.letter(chr(points[place]), place)
            self.grams[g] = found
        return found

    def numbers(self, text: str | None) -> np.ndarray:
        """Numbers of the text's n-grams, one per place (lower case, every run of other characters one
        space, one space at each end)."""
        if not text:
            return _NONE
        if text.isascii():
            letters = _ASCII_OTHER.sub(" ", text.lower()).strip()
        elif _LETTER.search(text):
            letters = _OTHER.sub(" ", text.lower()).strip()
        else:
            return _NONE
        if not letters:
            return _NONE
        points = np.frombuffer(f" {letters} ".encode("utf-32-le"), np.uint32).astype(np.int64)
        n = self.p.grams
        last = len(points) - n + 1
        if last <= 0:
            return _NONE
        found = points[:last].copy()
        for place in range(1, n):
            found = (found << 21) | points[place:last + place]
        return found

    def counts(self, text: str | None) -> Counter:
        """How often each n-gram number occurs in the text."""
        return Counter(self.numbers(text).tolist())

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """One unit vector per text, all zeros without letters."""
        out = np.zeros((len(texts), self.p.dims), np.float64)
        for start in range(0, len(texts), 64):
            every = [self.numbers(t) for t in texts[start:start + 64]]
            flat = np.concatenate(every)
            if not len(flat):
                continue
            rows = np.repeat(np.arange(len(every)), [len(e) for e in every])
            # Entries sorted by n-gram, so that each block of 4096 n-grams is one slice.
            order = np.argsort(flat)
            ordered, rows = flat[order], rows[order]
            first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
            known, inverse = ordered[first], np.cumsum(first) - 1
            cuts = np.searchsorted(inverse, np.arange(0, len(known) + 4096, 4096))
            for block, at in enumerate(range(0, len(known), 4096)):
                lo, hi = cuts[block], cuts[block + 1]
                width = min(4096, len(known) - at)
                weights = np.bincount(rows[lo:hi] * width + (inverse[lo:hi] - at),
                                      minlength=len(every) * width).reshape(len(every), width)
                vectors = np.stack([self.gram(int(g)) for g in known[at:at + width]]).astype(np.float32)
                out[start:start + 64] += weights.astype(np.float32) @ vectors
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0)


@dataclass(frozen=True)
class Model:
    profile: Profile
    labels: tuple[str, ...]
    mean: np.ndarray
    prototypes: np.ndarray


def train(docs: DataFrame, profile: Profile = Profile()) -> Model:
    """Prototypes of all rows of ``docs`` (``text``, ``lang``) whose language is not null."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(
        F.col("lang").cast("string").alias("lang"), "text")

    def bundle(frames):
        bundler, total = Bundler(profile), {}
        for frame in frames:
            vectors = np.rint(bundler.bundle(frame["text"].tolist()) * _UNIT).astype(np.int64)
            for lang, at in frame.groupby("lang").indices.items():
                total[lang] = total.get(lang, 0) + vectors[at].sum(axis=0)
        for lang, vector in total.items():
            yield pd.DataFrame({"lang": lang, "place": np.arange(profile.dims), "value": vector})

    summed = (
        rows.mapInPandas(bundle, "lang string, place int, value long")
        .groupBy("lang", "place").agg(F.sum("value").alias("value")).toPandas()
    )
    if summed.empty:
        return Model(profile, (), np.zeros(profile.dims), np.zeros((0, profile.dims)))
    wide = summed.pivot(index="lang", columns="place", values="value").sort_index()
    vectors = wide.to_numpy(np.float64)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    usable = norms[:, 0] > 0
    vectors = vectors[usable] / norms[usable]
    mean = vectors.mean(axis=0) if len(vectors) > 1 else np.zeros(profile.dims)
    centred = vectors - mean
    centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)
    return Model(profile, tuple(str(x) for x in wide.index[usable]), mean, centred)


def language_of(spark: SparkSession, model: Model, text: str = "text") -> F.Column:
    """``lang_pred`` and ``score`` of a text column; the score is the cosine, negative ones being 0."""
    shared = spark.sparkContext.broadcast(model)

    def apply(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        bundler = Bundler(m.profile)
        for texts in series:
            vectors = bundler.bundle(texts.tolist())
            lettered = vectors.any(axis=1)
            label = np.full(len(texts), UNKNOWN, object)
            score = np.zeros(len(texts))
            if len(m.labels) and lettered.any():
                centred = vectors[lettered] - m.mean
                centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)
                # Nine decimals: products of other block shapes may differ in the last bits.
                cosines = np.round(centred @ m.prototypes.T, 9)
                label[lettered] = np.array(m.labels, object)[cosines.argmax(axis=1)]
                score[lettered] = np.clip(cosines.max(axis=1), 0, 1)
            yield pd.DataFrame({"lang_pred": label, "score": score})

    return F.pandas_udf(apply, "lang_pred string, score double")(text)


def has_letters():
    """Whether a text has letters, as language ID sees them."""
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: bool(t) and _LETTER.search(t) is not None).astype(bool)

    return F.pandas_udf(apply, "boolean")


def held_out() -> F.Column:
    """True for the third of documents that is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """Model of the documents that are not held out, applied to all: ``doc_id, held_out, lang_pred,
    score``."""
    model = train(docs.where(~held_out()), profile)
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
        language_of(docs.sparkSession, model).alias("found"),
    )
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def recognised(docs: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """The rows of ``docs`` whose text gets a language; rejected are those without any letter. Where no
    label can be learned, so that no text gets a language, the rows with letters stay all the same."""
    model = train(docs.where(~held_out()), profile)
    if not model.labels:
        return docs.where(has_letters()(F.col("text")))
    found = docs.withColumn("_found", language_of(docs.sparkSession, model))
    return found.where(F.col("_found.lang_pred") != UNKNOWN).drop("_found")

"""Language identification by a string kernel with Nystroem landmarks.

A text is the set of its character 1- to 3-grams (blended spectrum, presence only),
and two texts compare by shared grams over the root of both set sizes.  A few
landmark texts of each language stand in for the whole kernel matrix: a text becomes
the vector of its kernel values with the landmarks, and one-versus-rest kernel ridge
regression is solved in the landmarks' span.  Scoring is a product of two matrices
for each batch: gram presence times landmark grams, then kernel values times weights.

Only the sample that the classifier is fitted on is bounded (SAMPLE_PER_LANGUAGE rows
of a language, SAMPLE_TOTAL in all, those with the smallest keyed hash); grams are
those that two landmarks share, at most GRAMS.  Every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotaloom.llm.common import map_arrow

SAMPLE_PER_LANGUAGE = 240
SAMPLE_TOTAL = 12_000
LANDMARKS_PER_LANGUAGE = 32
LANDMARKS_TOTAL = 512
GRAMS = 8192
RIDGE = 1e-3
SHARPNESS = 4.0
FOLDS = 5
UNDECIDED = "und"
CHUNK_CHARS = 1 << 19
# Texts that are scored at a time.
TEXTS = 256
TABLE_BITS = 20
_NONE = np.uint64(0x1FFFFF)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
OUT = "lang_pred string, score double"


# -- grams -------------------------------------------------------------------
def code_points(text: str) -> np.ndarray:
    """Lower-case code points; ASCII characters that are no letters count as one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return np.where((codes < 97) | ((codes > 122) & (codes < 128)), np.uint64(32), codes)


def gram_codes(codes: np.ndarray) -> list[np.ndarray]:
    """The 1-, 2- and 3-grams that start at each place, as exact 63-bit numbers."""
    high, low = _NONE << np.uint64(42), _NONE << np.uint64(21)
    second = codes[1:] << np.uint64(21)
    return [codes | low | high, codes[:-1] | second | high, codes[:-2] | second[:-1] | (codes[2:] << np.uint64(42))]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    """Landmark grams, landmark set sizes and regression weights."""

    languages: list[str]
    grams: np.ndarray  # sorted gram codes
    landmarks: np.ndarray  # grams x landmarks, 0/1
    weights: np.ndarray  # landmarks x languages

    def table(self) -> np.ndarray:
        """Place of each gram under its hash; where two share one, the first stays."""
        slots = np.full(1 << TABLE_BITS, -1, np.int32)
        at = self.slot(self.grams)
        slots[at[::-1]] = np.arange(len(at) - 1, -1, -1)
        return slots

    @staticmethod
    def slot(codes: np.ndarray) -> np.ndarray:
        return ((codes * _MULTIPLIER) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def presence(self, texts: list[str], slots: np.ndarray) -> np.ndarray:
        """0/1 matrix of texts by grams."""
        out = np.zeros((len(texts), len(self.grams)), np.float32)
        for i, text in enumerate(texts):
            codes = code_points(text)
            row = out[i]
            for first in range(0, len(codes), CHUNK_CHARS):
                for found in gram_codes(codes[first : first + CHUNK_CHARS + 2]):
                    place = slots[self.slot(found)]
                    hit = place >= 0
                    place = place[hit]
                    row[place[self.grams[place] == found[hit]]] = 1
        return out

    def kernel(self, present: np.ndarray) -> np.ndarray:
        sizes = np.sqrt(np.maximum(present.sum(axis=1), 1))[:, None] * np.sqrt(np.maximum(self.landmarks.sum(axis=0), 1))
        return (present @ self.landmarks) / sizes

    def probabilities(self, present: np.ndarray) -> np.ndarray:
        values = SHARPNESS * (self.kernel(present) @ self.weights)
        values = np.exp(values - values.max(axis=1, keepdims=True))
        return values / values.sum(axis=1, keepdims=True)


# -- fitting -----------------------------------------------------------------
def fold(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents without an id are never learnt from either."""
    return F.coalesce(fold(doc_id) == 0, F.lit(True))


def _sample(docs: DataFrame) -> list:
    """(lang, grams) of the bounded training sample, in a fixed order."""
    usable = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    keyed = usable.select("doc_id", "lang", F.xxhash64(F.lit("lang"), "doc_id").alias("_key"))
    n_languages = max(keyed.select("lang").distinct().count(), 1)
    most = max(2, min(SAMPLE_PER_LANGUAGE, SAMPLE_TOTAL // n_languages))
    first = Window.partitionBy("lang").orderBy("_key", "doc_id")
    chosen = keyed.withColumn("_nr", F.row_number().over(first)).filter(F.col("_nr") <= most).drop("lang")
    chosen = F.broadcast(chosen.dropDuplicates(["doc_id"]))  # at most SAMPLE_TOTAL rows

    def distinct_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for text in batch.column(2).to_pylist():
                codes = code_points(text)
                parts = [
                    np.unique(np.concatenate(gram_codes(codes[i : i + CHUNK_CHARS + 2])))
                    for i in range(0, len(codes), CHUNK_CHARS)
                ]
                sets.append(np.unique(np.concatenate(parts)).astype(np.int64))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["_nr", "lang", "grams"]
            )

    rows = usable.join(chosen, "doc_id").select("_nr", "lang", "text")
    found = map_arrow(rows, distinct_grams, "_nr int, lang string, grams array<bigint>").collect()
    return sorted(found, key=lambda r: (r.lang, r._nr, r.grams))


def fit(docs: DataFrame) -> Model | None:
    """A model of the documents that are not held out; None if none of them has a language."""
    rows = _sample(docs)
    if not rows:
        return None
    languages = sorted({r.lang for r in rows})
    each = max(1, min(LANDMARKS_PER_LANGUAGE, LANDMARKS_TOTAL // len(languages)))
    sets = [np.array(r.grams, np.int64).astype(np.uint64) for r in rows]
    taken: dict[str, int] = {}
    chosen = []
    for i, r in enumerate(rows):
        taken[r.lang] = taken.get(r.lang, 0) + 1
        if taken[r.lang] <= each:
            chosen.append(i)
    grams, n = np.unique(np.concatenate([sets[i] for i in chosen]), return_counts=True)
    shared = n >= min(2, len(chosen))
    grams, n = grams[shared], n[shared]
    keep = np.sort(np.lexsort((grams, -n))[:GRAMS])
    grams = grams[keep]
    present = np.zeros((len(sets), len(grams)), np.float32)
    for i, s in enumerate(sets):
        if len(grams):
            at = np.minimum(np.searchsorted(grams, s), len(grams) - 1)
            present[i, at[grams[at] == s]] = 1
    model = Model(languages, grams, np.ascontiguousarray(present[chosen].T), np.zeros((len(chosen), len(languages))))
    k_all = model.kernel(present).astype(np.float64)
    k_land = k_all[chosen]
    goal = np.where(np.array([r.lang for r in rows])[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # Every language weighs the same, however many rows it has.
    count = {name: sum(r.lang == name for r in rows) for name in languages}
    weight = np.array([1.0 / count[r.lang] for r in rows])[:, None]
    left = k_all.T @ (k_all * weight) + RIDGE * (k_land + k_land.T) / 2 + 1e-9 * np.eye(len(chosen))
    model.weights = np.linalg.solve(left, k_all.T @ (goal * weight)).astype(np.float32)
    return model


# -- scoring -----------------------------------------------------------------
def identify(docs: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1, the weight of the predicted language among all).

    ``und`` with score 0 stands for texts that are null or have no letter, and for all
    texts if ``model`` is None.  Ties go to the language that sorts first.  An empty
    table stays empty; columns of ``docs`` named lang_pred or score give way.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    place = names.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        slots = fitted.table() if fitted else None
        for batch in batches:
            names_out: list[str] = [UNDECIDED] * batch.num_rows
            scores = np.zeros(batch.num_rows)
            # Never all texts of a batch as Python strings.
            for low in range(0, batch.num_rows if fitted else 0, TEXTS):
                texts = batch.column(place).slice(low, TEXTS).to_pylist()
                known = [i for i, t in enumerate(texts) if has_letter(t)]
                if not known:
                    continue
                probability = fitted.probabilities(fitted.presence([texts[i] for i in known], slots))
                best = probability.argmax(axis=1)
                scores[[low + i for i in known]] = probability[np.arange(len(known)), best]
                for i, b in zip(known, best.tolist()):
                    names_out[low + i] = fitted.languages[b]
            columns = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.record_batch(
                [*columns, pa.array(names_out), pa.array(np.clip(scores, 0, 1))], names=[*names, "lang_pred", "score"]
            )

    schema = rows.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    return map_arrow(rows, score, schema)


def predict(docs: DataFrame) -> DataFrame:
    """Fit on the labelled documents of ``docs`` that are not held out and score all of them: doc_id, held_out, lang_pred, score."""
    model = fit(docs)
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), "text", model).drop("text")

"""Language identification by nearest centroid.

Character n-grams (1 to 3 letters, words padded by a blank) are hashed into `DIMS`
columns, weighted by TF-IDF and scaled to length one.  Each language has several
centroids, found by spherical k-means over its training vectors; a text takes the
language of the centroid with the highest cosine.  A text whose cosine distance to
every centroid is over `max_distance` is rejected, and so is one whose cosine is under its
language's floor.  The floor comes from the training rows' own cosines (`FLOOR_SHARE` of
their 1 % quantile), since hash collisions alone give long texts of any script a cosine
that grows with their length; for n n-grams it is multiplied by n / (n + `FLOOR_GRAMS`), for
few n-grams of a language score low too.

Training reads at most `per_language` labelled rows of every language (those with the least
seeded hash of their id; rows of one id and label count once, null ids too).  Each language
is fitted in a task; the driver holds its centroids alone.  No language is left out: more than
`max_languages` are an error.  Prediction reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

DIMS = 4096
_CHUNK = 1 << 20
_MULT = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))
UNKNOWN = "und"
FLOOR_SHARE, FLOOR_GRAMS = 0.55, 50
FLOOR_ROWS = 20  # a language of fewer training rows takes the least floor of the others, if any has one


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    """The lower-case letter of each code point (itself, if that is several), zero for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _counts(text: str, dims: int = DIMS) -> tuple[np.ndarray, bool]:
    """Hashed n-gram counts, and whether the text has a letter; read a chunk at a time, which changes nothing."""
    total, lower, any_letter = np.zeros(dims, np.int64), _lower(), False
    shift = np.uint32(32 - dims.bit_length() + 1)
    before = np.zeros(1, np.uint32)  # the blank before the text; later the last two letters or blanks that were counted
    for at in range(0, len(text), _CHUNK):
        cp = lower[np.frombuffer(text[at : at + _CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)]
        any_letter = any_letter or bool(cp.any())
        if at + _CHUNK >= len(text):
            cp = np.r_[cp, np.uint32(0)]
        new = cp[(cp != 0) | (np.r_[before[-1:], cp[:-1]] != 0)]  # one blank between words
        seen, cp = len(before), np.concatenate([before, new])
        one = cp * _MULT[0]
        total += np.bincount((one[seen:] >> shift)[new != 0], minlength=dims)
        if len(cp) > 1:
            two = one[1:] ^ (cp[:-1] * _MULT[1] + np.uint32(1))
            two *= _MULT[2]
            total += np.bincount(two[seen - 1 :] >> shift, minlength=dims)
        if len(cp) > 2:
            three = (one[2:] ^ (two[:-1] + np.uint32(7))) * _MULT[1]
            begin = max(0, seen - 2)
            total += np.bincount(three[begin:][cp[1:-1][begin:] != 0] >> shift, minlength=dims)
        before = cp[-2:]
    return total, any_letter


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF with damped frequencies, of length one (all zero stays zero)."""
    v = np.log1p(counts).astype(np.float32) * idf
    norm = float(np.sqrt(v @ v))
    return v / np.float32(norm) if norm else v


@dataclass
class Centroids:
    languages: list[str]  # of each centroid
    centers: np.ndarray  # centroids x dims, rows of length one
    idf: np.ndarray
    floors: list[float]  # least cosine of each centroid's language in long texts


def _k_means(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(rounds):
        near = np.argmax(x @ centers.T, axis=1)
        moved = np.stack([x[near == c].sum(axis=0) if (near == c).any() else centers[c] for c in range(len(centers))])
        norm = np.linalg.norm(moved, axis=1, keepdims=True)
        centers = moved / np.where(norm == 0, 1, norm)
    return centers.astype(np.float32)


def _fit_language(rows: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, centroids: int, seed: int) -> tuple[np.ndarray, float | None]:
    """(centroids, floor) of one language's (columns, counts); None for the floor of few rows."""
    x = np.zeros((len(rows), DIMS), np.float32)
    for i, (at, n) in enumerate(rows):
        x[i, at] = n
    x = np.stack([vector(r, idf) for r in x])
    c = _k_means(x, centroids, seed)
    return c, FLOOR_SHARE * float(np.quantile((x @ c.T).max(axis=1), 0.01)) if len(x) >= FLOOR_ROWS else None


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = 400, max_languages: int = 1024, centroids: int = 4, seed: int = 11) -> Centroids:
    """Fit on rows with a text and a label; others, and an empty table, add nothing."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text")).filter("text is not null and label is not null")
    place = F.xxhash64(F.lit(seed), "id")
    counts = rows.groupBy("label").agg(F.approx_count_distinct(place)).limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages, at {centroids * DIMS * 4} bytes each")
    if not counts:
        return Centroids([], np.zeros((0, DIMS), np.float32), np.ones(DIMS, np.float32), [])
    # a uniform hash of the id, cut so that about twice per_language ids of each language stay before they are ranked
    chances = spark.createDataFrame([(name, min(1.0, 2 * per_language / n + 64 / n)) for name, n in counts], "label string, chance double")
    drawn = rows.select("id", "label").join(F.broadcast(chances), "label").filter(place / F.lit(2.0**64) + 0.5 < F.col("chance")).select("id", "label").distinct()
    order = Window.partitionBy("label").orderBy(place, "id")
    ids = drawn.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_language).select(F.col("id").alias("_id"), F.col("label").alias("_label"))
    # at most per_language * max_languages ids: a proven bound; of an id's rows the least text stays
    of_ids = rows.join(F.broadcast(ids), F.col("id").eqNullSafe(F.col("_id")) & (F.col("label") == F.col("_label")), "left_semi")
    few = of_ids.groupBy("id", "label").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(2):
                c, _ = _counts(text.as_py())
                at = np.flatnonzero(c)
                out.append((at.astype(np.int32), c[at]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a for a, _ in out], pa.list_(pa.int32())), pa.array([b for _, b in out], pa.list_(pa.int64()))], ["id", "label", "at", "n"])

    vectors = few.select(F.col("id").cast("bigint").alias("id"), "label", "text").mapInArrow(run, "id bigint, label string, at array<int>, n array<bigint>")
    vectors = materialize(vectors, "language-vectors")
    seen = np.zeros(DIMS, np.int64)
    for r in vectors.select(F.explode("at").alias("at")).groupBy("at").count().collect():
        seen[r["at"]] = r["count"]
    idf = (np.log((1 + vectors.count()) / (1 + seen)) + 1).astype(np.float32)

    def fit_one(pdf):
        import pandas as pd

        pdf = pdf.sort_values("id", kind="stable")
        centers, floor = _fit_language(list(zip(pdf["at"], pdf["n"])), idf, centroids, seed)
        return pd.DataFrame({"label": [pdf["label"].iloc[0]] * len(centers), "k": range(len(centers)), "center": [c.tobytes() for c in centers], "floor": [floor] * len(centers)})

    got = vectors.groupBy("label").applyInPandas(fit_one, "label string, k int, center binary, floor double").collect()
    got.sort(key=lambda r: (r["label"], r["k"]))
    least = min((r["floor"] for r in got if r["floor"] is not None), default=0.0)
    floors = [least if r["floor"] is None else r["floor"] for r in got]
    return Centroids([r["label"] for r in got], np.stack([np.frombuffer(r["center"], np.float32) for r in got]), idf, floors)


def classify(text: str | None, model: Centroids) -> tuple[str, float, bool]:
    """(language, cosine, whether the cosine reaches the language's floor)."""
    if not text:
        return UNKNOWN, 0.0, False
    counts, any_letter = _counts(text)
    if not any_letter or not model.languages:
        return UNKNOWN, 0.0, False
    near = model.centers @ vector(counts, model.idf)
    best, n = int(np.argmax(near)), int(counts.sum())
    score = min(1.0, max(0.0, round(float(near[best]), 6)))
    return model.languages[best], score, score >= model.floors[best] * n / (n + FLOOR_GRAMS)


def predict(spark: SparkSession, model: Centroids, text: Column, max_distance: float = 0.95) -> Column:
    """struct<lang_pred, lang_score (cosine), lang_rejected> of a text.

    Null, empty and letterless texts, and all texts under a model without languages, are
    `und` with score 0 and rejected.  Ties go to the language that sorts first.
    """
    # one centroid matrix: languages * centroids * DIMS floats, bounded by max_languages
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred: string, lang_score: double, lang_rejected: boolean>")
    def of(texts):
        import pandas as pd

        model = shared.value
        rows = [(name, score, not known or 1 - score > max_distance) for name, score, known in (classify(t, model) for t in texts)]
        return pd.DataFrame(rows, columns=["lang_pred", "lang_score", "lang_rejected"])

    return of(text)


RESULT = ("lang_pred", "lang_score", "lang_rejected")


def identify(docs: DataFrame, model: Centroids, text_col: str = "text", max_distance: float = 0.95) -> DataFrame:
    """`docs` plus the fields of predict(), which take the place of columns with their names."""
    kept = [c for c in docs.columns if c.lower() not in RESULT]
    temp = "_".join(["_lang", *docs.columns])  # no column has this name
    got = docs.withColumn(temp, predict(docs.sparkSession, model, F.col(text_col), max_distance))
    return got.select(*kept, *[F.col(temp)[c].alias(c) for c in RESULT])


def held_out(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id as text falls in fold 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == 0

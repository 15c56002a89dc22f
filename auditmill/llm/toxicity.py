"""Toxicity: boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize

#: Labelled rows that a fit uses at most, chosen by a hash of the id.
MAX_ROWS = 20_000
#: Terms that a lexicon holds at most, and the parts that labelled rows are divided into.
MAX_TERMS, FOLDS = 2_000, 4

#: Words that address the reader, in the languages of the corpus.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer eure tú ti tus usted ustedes vosotros vuestro".split()
)
#: Digits and signs that stand for letters in obfuscated words.
LOOKALIKE = str.maketrans("013457@$!|", "oieastasil")

FEATURES = (
    "log_words", "lexicon_density", "lexicon_words", "lexicon_kinds", "lexicon_peak", "lexicon_weight", "weight_density", "hidden_density", "near_second_person",
    "second_person_density", "capital_share", "capital_words", "exclamation_rate", "punctuation_rate", "obfuscation_rate", "stretched_rate",
)

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[^\W\d_][\d*@$!|._\-]+[^\W\d_]")
_STRETCH = re.compile(r"([^\W\d_])\1\1")
_PUNCTUATION = re.compile(r"[^\w\s]")


class _Table(dict):
    """Row numbers of words in an array of word features."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        super().__init__()
        self.lexicon, self.rows = lexicon, np.zeros((1024, 11))

    def trim(self) -> None:
        if len(self) > 300_000:
            self.clear()

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at >= len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        core = word[:-1] if word[-1] in ".," else word
        if core.islower() and core.isalpha() and not _STRETCH.search(core):  # most words: nothing odd about them
            weight, marks = self.lexicon.get(core.casefold(), 0.0), len(word) - len(core)
            self.rows[at] = (weight > 0, weight, 0, core in SECOND_PERSON, len(core), 0, 0, 0, marks, 0, 0)
            self[word] = at
            return at
        bare = _EDGE.sub("", word).casefold()
        weight = self.lexicon.get(bare, 0.0)
        inner = bool(_INNER.search(bare))
        hidden = 0.0
        if not weight:
            plain = re.sub(r"[\W_]", "", bare.translate(LOOKALIKE))
            hidden = self.lexicon.get(plain, 0.0) or self.lexicon.get(_STRETCH.sub(r"\1", plain), 0.0)
        letters, upper = sum(map(str.isalpha, word)), sum(map(str.isupper, word))
        self.rows[at] = (
            weight > 0, weight, hidden > 0, bare in SECOND_PERSON, letters, upper, letters > 1 and upper == letters,
            word.count("!") + word.count("?"), len(_PUNCTUATION.findall(word)), inner, bool(_STRETCH.search(bare)),
        )
        self[word] = at
        return at


def features_of(text: str | None, table: _Table) -> list[float]:
    """The dense features of a whole text; all zero without words."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    table.trim()
    ids = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
    rows = table.rows[ids]
    hits, peak, hidden, second, letters, upper, shouted, marks, punctuation, inner, stretched = rows.sum(axis=0)
    n = len(words)
    hit = np.flatnonzero((rows[:, 0] > 0) | (rows[:, 2] > 0))
    near = 0.0
    you = np.flatnonzero(rows[:, 3])
    if len(hit) and len(you):
        after = np.searchsorted(you, hit)
        gap = np.minimum(np.abs(you[np.minimum(after, len(you) - 1)] - hit), np.abs(hit - you[np.maximum(after - 1, 0)]))
        near = float((gap <= 5).mean())
    kinds = len(np.unique(ids[rows[:, 0] > 0]))
    chars = max(1.0, letters)
    return [
        float(np.log1p(n)), hits / n, float(hits), float(kinds), float(rows[:, 1].max()), peak, peak / n, hidden / n, near,
        second / n, upper / chars, shouted / n, marks / n, punctuation / n, inner / n, stretched / n,
    ]


def features(docs: DataFrame, lexicons: list[dict[str, float]]) -> DataFrame:
    """docs with ``features`` in place of ``text``, by the lexicon whose number is in ``fold``."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [_Table(x) for x in shared.value]
        for batch in batches:
            pairs = zip(batch.column("text"), batch.column("fold"), strict=True)
            found = pa.array([features_of(t.as_py(), tables[f.as_py()]) for t, f in pairs], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], found], [*others, "features"])

    schema = docs.select(*others).schema.add("features", T.ArrayType(T.DoubleType()))
    return docs.mapInArrow(run, schema).withColumn("features", array_to_vector("features"))


def learn_lexicons(labelled: DataFrame, most: int = MAX_TERMS) -> list[dict[str, float]]:
    """Terms and their log odds under label 1, from (text, label, fold) rows.

    The lexicon at a fold's number comes from the other folds only, so that a fold's features
    do not know its labels; the last one comes from all rows. A term must be in three rows of
    label 1, or one in 400, and four times as frequent there as in the rest.
    """
    words = F.array_distinct(F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.regexp_replace(w, r"(?U)^[\W_]+|[\W_]+$", "")))
    at = lambda k, one: F.count_if((F.col("fold") == k) & ((F.col("label") == 1) == F.lit(one)))
    both = [at(k, one).alias(f"{'a' if one else 'b'}{k}") for k in range(FOLDS) for one in (True, False)]
    sizes = labelled.agg(*both).first()
    counts = materialize(labelled.select("label", "fold", F.explode(words).alias("term")).where("term <> ''").groupBy("term").agg(*both).where(" + ".join(f"a{k}" for k in range(FOLDS)) + " >= 3"), "terms")
    out = []
    for left in range(FOLDS + 1):
        used = [k for k in range(FOLDS) if k != left]
        ones, rest = (sum(sizes[f"{x}{k}"] or 0 for k in used) for x in "ab")
        a, b = (sum((F.col(f"{x}{k}") for k in used), F.lit(0)) for x in "ab")
        weight = F.log((a + 0.5) / (ones + 1.0)) - F.log((b + 0.5) / (rest + 1.0))
        top = counts.where(a >= max(3, ones / 400)).select("term", weight.alias("w")).where(F.col("w") > float(np.log(4)))
        out.append({r["term"]: r["w"] for r in top.orderBy(F.desc("w"), "term").limit(most).collect()})
    return out


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    curve: IsotonicRegressionModel | None
    prior: float


def _margin(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    out = trees.transform(rows).withColumn("margin", vector_to_array("rawPrediction")[1])
    return out.drop("rawPrediction", "probability", "prediction", "features")


def fit(labelled: DataFrame, seed: int = 7, rounds: int = 20, depth: int = 3) -> Model:
    """A model from labelled (doc_id, text, label) rows; MAX_ROWS of them at most (see training_rows()).

    Rows fall into FOLDS folds by a hash of the id. All but the first grow the trees; the first
    fits the isotonic curve from margin to probability. Without rows of both labels every score
    is the share of label 1.
    """
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int")
    rows = materialize(labelled.select("doc_id", "text", F.col("label").cast("double").alias("label"), fold.alias("fold")), "labelled")
    lexicons = learn_lexicons(rows)
    known = materialize(features(rows, lexicons), "features")
    share = known.agg(F.avg("label")).first()[0] or 0.0
    both = lambda df: df.select("label").distinct().count() == 2
    grown, held = known.where("fold > 0"), known.where("fold = 0")
    if not both(grown):
        return Model(lexicons[-1], None, None, share)
    trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=0.3, minInstancesPerNode=3, seed=seed, checkpointInterval=-1)
    # A fixed order of rows and parts makes reruns agree.
    model = trees.fit(grown.repartitionByRange(6, "doc_id").sortWithinPartitions("doc_id"))
    # Rows of one margin count as one point with their number as its weight: the same curve.
    points = _margin(model, held if both(held) else known).groupBy("margin").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
    curve = IsotonicRegression(labelCol="label", featuresCol="margin", predictionCol="score", weightCol="weight").fit(points)
    return Model(lexicons[-1], model, curve, share)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) for every row of docs. Null and empty texts score like texts without any word."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if model.trees is None:
        return rows.select("doc_id", F.lit(float(model.prior)).alias("score"))
    scored = model.curve.transform(_margin(model.trees, features(rows.withColumn("fold", F.lit(0)), [model.lexicon])))
    return scored.select("doc_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, columns as they are, that score under the threshold. Without a shuffle."""
    if model.trees is None:
        return docs.where(F.lit(model.prior < threshold))
    rows = docs.select(F.struct("*").alias("_doc"), F.col(text_col).alias("text"), F.lit(0).alias("fold"))
    scored = model.curve.transform(_margin(model.trees, features(rows, [model.lexicon])))
    return scored.where(F.col("score") < threshold).select("_doc.*")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most: int = MAX_ROWS) -> DataFrame:
    """(doc_id, text, label) of labelled documents that are not held out, ``most`` of them at most.

    A document whose labels disagree, or whose label or id is null, is left out; so are texts
    without a label. The chosen ids are broadcast; ``most`` bounds them.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label_col).alias("label"), F.max(label_col).alias("high"))
    known = known.where((F.col("label") == F.col("high")) & ~held_out(F.col("doc_id"))).select("doc_id", "label")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")

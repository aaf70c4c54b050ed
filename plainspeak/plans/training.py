"""Three-class text classifiers as Spark ML pipelines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import IDF, CountVectorizer, Tokenizer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import VECTOR_VOCABULARY_LIMIT
from ..operators import metrics
from ..operators.vocabulary import embedding_matrix, fit_vocabulary, pool_vectors
from ..session import stored

SEED = 17
TEXT_MODELS = ("logistic_regression", "naive_bayes", "decision_tree", "random_forest")
VECTOR_MODELS = ("word_vectors",)

#: CountVectorizer's own limit on the number of words, for all models alike; a parameter of ``fit``.
VOCABULARY_SIZE = 262_144
# Tree learners hold a bin number for every feature of every row, present or not, so a row costs four bytes a
# feature. Trees see the so many words that tell the classes apart best; the rows are all labelled ones.
TREE_TERMS = 1_024
TREE_MODELS = ("decision_tree", "random_forest")


def feature_stages(text: str = "text_clean", vocabulary_size: int = VOCABULARY_SIZE) -> list:
    count = CountVectorizer(inputCol="words", outputCol="raw_features", vocabSize=vocabulary_size)
    return [
        Tokenizer(inputCol=text, outputCol="words"),
        count,
        IDF(inputCol="raw_features", outputCol="features"),
    ]


def telling_terms(docs: DataFrame, vocabulary: list[str], label: str, terms: int, words: str = "words") -> list[int]:
    """Places in ``vocabulary`` of the ``terms`` words whose presence in a document depends most on its class, by the
    chi-square statistic; ties go to the more frequent word, then to the alphabet.

    Documents with a word are counted by class in one grouped aggregation over all rows. The vocabulary is
    broadcast (CountVectorizer holds it on the driver as well: VOCABULARY_SIZE words at most).
    """
    spark = docs.sparkSession
    classes = {r[0]: r[1] for r in docs.filter(F.col(label).isNotNull()).groupBy(label).count().collect()}
    total = sum(classes.values())
    known = spark.createDataFrame(list(enumerate(vocabulary)), "place int, word string")
    hits = [F.count_if(F.col("class") == c).alias(f"n_{i}") for i, c in enumerate(classes)]
    counted = (
        docs.select(F.col(label).alias("class"), F.explode(F.array_distinct(words)).alias("word"))
        .groupBy("word")
        .agg(F.count("class").alias("n"), *hits)
        .join(F.broadcast(known), "word")
    )
    score = F.lit(0.0)
    for i, size in enumerate(classes.values()):
        for seen, rows in ((F.col(f"n_{i}"), F.col("n")), (size - F.col(f"n_{i}"), total - F.col("n"))):
            expected = rows * F.lit(size / total)
            score = score + F.when(expected > 0, (seen - expected) * (seen - expected) / expected).otherwise(0.0)
    best = counted.orderBy(F.round(score, 9).desc(), F.desc("n"), "word").limit(terms)
    return sorted(r["place"] for r in best.select("place").collect())


def classifier(name: str, label: str = "label_id", inputs: int | None = None, features: str = "features"):
    """The classifier of a model name, with the settings the moderation models use."""
    common = {"featuresCol": features, "labelCol": label}
    if name == "logistic_regression":
        return LogisticRegression(**common)
    if name == "naive_bayes":
        return NaiveBayes(smoothing=1.0, modelType="multinomial", **common)
    if name == "decision_tree":
        # More memory for the statistics of a pass, so that a pass splits several nodes.
        return DecisionTreeClassifier(seed=SEED, maxMemoryInMB=1024, **common)
    if name == "random_forest":
        return RandomForestClassifier(seed=SEED, **common)
    if name == "word_vectors":
        return MultilayerPerceptronClassifier(
            layers=[inputs, 32, 3], seed=SEED, maxIter=60, **common
        )
    raise ValueError(f"unknown model {name!r}; known: {TEXT_MODELS + VECTOR_MODELS}")


def build_model(
    name: str, text: str = "text_clean", label: str = "label_id", vocabulary_size: int = VOCABULARY_SIZE,
    inputs: int | None = None,
) -> Pipeline:
    if name in VECTOR_MODELS:
        assemble = VectorAssembler(inputCols=["pooled"], outputCol="features")
        return Pipeline(stages=[assemble, classifier(name, label, inputs)])
    return Pipeline(stages=[*feature_stages(text, vocabulary_size), classifier(name, label)])


def fit(
    name: str, train: DataFrame, text: str = "text_clean", label: str = "label_id",
    vocabulary_size: int = VOCABULARY_SIZE, rows: int | None = None, terms: int = TREE_TERMS,
) -> PipelineModel:
    """Fit on a cleaned, labelled corpus. The iterative optimisers read it many times, so
    it is written once and read back. Vocabulary and document frequencies come from all rows. Trees are grown
    on the ``terms`` words that tell the classes apart best. ``rows``: fit the classifier on at most so
    many rows, those with the smallest hash of their text (default: all)."""
    chosen = stored(train.select(text, label), "train")
    if rows is None and name not in TREE_MODELS:
        return build_model(name, text, label, vocabulary_size).fit(chosen)
    features = Pipeline(stages=feature_stages(text, vocabulary_size)).fit(chosen)
    stages, seen = list(features.stages), "features"
    if name in TREE_MODELS:
        words = features.stages[0].transform(chosen)
        places = telling_terms(words, features.stages[1].vocabulary, label, terms)
        stages.append(VectorSlicer(inputCol="features", outputCol="telling_features", indices=places))
        seen = "telling_features"
    if rows is not None:
        chosen = stored(chosen.orderBy(F.xxhash64(text), text, label).limit(rows), "train-rows")
    prepared = stored(PipelineModel(stages=stages).transform(chosen).select(seen, label), "train-features")
    return PipelineModel(stages=[*stages, classifier(name, label, features=seen).fit(prepared)])


@dataclass
class VectorFeatures:
    """What is needed to turn texts into pooled word vectors."""

    vocabulary: DataFrame
    matrix: DataFrame
    dimension: int

    @classmethod
    def fit(cls, docs: DataFrame, vectors: DataFrame, key: str, text: str, dimension: int):
        vocabulary = fit_vocabulary(docs, key, text)
        # Words beyond the limit have zero vectors; pooling does not look them up.
        with_vector = vocabulary.filter(F.col("idx") < VECTOR_VOCABULARY_LIMIT)
        matrix = stored(embedding_matrix(with_vector, vectors, dimension), "matrix")
        return cls(vocabulary, matrix, dimension)

    def transform(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """Add ``pooled``: mean and maximum side by side."""
        pooled = pool_vectors(docs, self.vocabulary, self.matrix, key, text, self.dimension)
        both = array_to_vector(F.concat("mean", "max")).alias("pooled")
        return docs.join(pooled.select(key, both), key)


def fit_vector_model(
    features: VectorFeatures, train: DataFrame, key: str, text: str = "text_clean",
    label: str = "label_id",
) -> PipelineModel:
    return fit_prepared_vectors(features, features.transform(train, key, text), text, label)


def fit_prepared_vectors(
    features: VectorFeatures, train: DataFrame, text: str = "text_clean", label: str = "label_id"
) -> PipelineModel:
    """Fit on rows that ``features`` has transformed already."""
    prepared = stored(train.select("pooled", label), "pooled")
    return build_model("word_vectors", text, label, inputs=2 * features.dimension).fit(prepared)


def validate(model: PipelineModel, data: DataFrame, label: str = "label_id") -> DataFrame:
    """loss, accuracy on a part that the fit hasn't seen. Tree models give a probability of zero at times;
    the loss counts it as a small number."""
    scored = model.transform(data).withColumn("scores", vector_to_array("probability"))
    return metrics.log_loss(scored, label)


def predictions(model: PipelineModel, data: DataFrame, label: str = "label_id") -> DataFrame:
    """Scored rows; the class as int, NaN-free."""
    return model.transform(data).withColumn("prediction", F.col("prediction").cast("int"))


def evaluate(model: PipelineModel, data: DataFrame, label: str = "label_id") -> DataFrame:
    """accuracy, f1_micro, f1_macro over all rows of a held-out part."""
    return metrics.quality(predictions(model, data, label), label)

"""Text classifiers with MLlib (2-K)."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest
from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sets import _stored


def word_features(text: str = "text", vocabulary: int = 20_000, min_df: int = 2) -> list:
    """Stages that make TF-IDF of one- and two-word grams, as `features`."""
    return [
        RegexTokenizer(inputCol=text, outputCol="words", pattern=r"\W+", minTokenLength=2), NGram(inputCol="words", outputCol="pairs", n=2),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS grams FROM __THIS__"), CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=vocabulary, minDF=min_df), IDF(inputCol="tf", outputCol="tfidf"),
        VectorAssembler(inputCols=["tfidf"], outputCol="features"),
    ]


def char_grams(text: Column, low: int = 2, high: int = 5) -> Column:
    """All runs of `low` to `high` characters."""
    return F.concat(*[_grams(text, n) for n in range(low, high + 1)])


def _grams(text: Column, n: int) -> Column:
    places = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.transform(places, lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """`weight`: rows / (classes * rows of the class)."""
    sizes = df.groupBy(label).agg(F.count("*").alias("k"))
    total = sizes.agg(F.sum("k").alias("t"), F.count("*").alias("c"))
    return df.join(F.broadcast(sizes.crossJoin(total)), label).withColumn("weight", F.col("t") / (F.col("c") * F.col("k"))).drop("k", "t", "c")  # a row for each class


def classifier(kind: str, label: str = "label"):
    return {
        "logistic": lambda: LogisticRegression(labelCol=label, weightCol="weight", maxIter=20, regParam=0.01),
        "bayes": lambda: NaiveBayes(labelCol=label, smoothing=0.5),
        "svm": lambda: OneVsRest(classifier=LinearSVC(maxIter=10, regParam=0.01), labelCol=label),
    }[kind]()


def out_of_fold(df: DataFrame, kind: str, folds: int, fold: str = "fold", keep: tuple[str, ...] = ("doc_id", "label", "fold")) -> DataFrame:
    """Each row's prediction by a model of the other folds: a loop over a few folds, the work in Spark.

    df is read and split into words once, and counted once for each fold; weights, fits and predictions read the stored counts.
    """
    tokens, *grams, counter, idf, assembler = word_features()
    columns, out = list(dict.fromkeys([*keep, "label", fold])), None
    words = _stored(tokens.transform(df).select(*columns, "words"), fold)
    told = PipelineModel(grams).transform(words)
    for k in range(folds):
        counts = _stored(counter.fit(told.filter(F.col(fold) != k)).transform(told).select(*columns, "tf"), fold, ascending=("tf.indices",))
        model = Pipeline(stages=[idf, assembler, classifier(kind)]).fit(class_weights(counts.filter(F.col(fold) != k)))
        one = model.transform(counts.filter(F.col(fold) == k)).select(*keep, F.col("prediction").cast("int").alias("y_pred"))
        out = one if out is None else out.unionByName(one)
    return out

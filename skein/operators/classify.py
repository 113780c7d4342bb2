"""Intent classifiers over vectors and texts: baselines, neighbours, centroids and linear models."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, HashingTF, IDF, NGram, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.stats import entropy
from skein.operators.retrieval import by_label_text, centroids, dense, dot
from skein.operators.sampling import stratified_folds


def majority(rows: DataFrame, y: str) -> str | None:
    """The most frequent label; ties go to the first."""
    top = rows.where(F.col(y).isNotNull()).groupBy(y).count().orderBy(F.desc("count"), y).limit(1).collect()  # one row
    return top[0][0] if top else None


def nearest_centroid_oof(vectors: DataFrame, k: int = 5) -> DataFrame:
    """(id, y, pred, score): each (id, vector, y) by the class centroid of the other folds with the greatest dot product."""
    f = stratified_folds(vectors, "y", "id", k)
    long = f.select("fold", "y", F.posexplode("vector").alias("pos", "x"))
    sums = long.groupBy("y", "fold", "pos").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("n"))
    folds = vectors.sparkSession.range(k).select(F.col("id").cast("int").alias("held"))
    cents = sums.join(F.broadcast(folds), F.col("fold") != F.col("held")).groupBy("held", "y", "pos").agg((F.sum("s") / F.sum("n")).alias("m"))
    cents = cents.groupBy("held", F.col("y").alias("label")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("c"))
    s = f.join(F.broadcast(cents), f.fold == cents.held).select("id", "y", "label", F.round(dot(F.col("vector"), F.col("c")), 6).alias("score"))  # k rows a class
    w = Window.partitionBy("id").orderBy(F.desc("score"), "label")
    return s.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("id", "y", F.col("label").alias("pred"), "score")


def knn(vectors: DataFrame, k: int = 5) -> DataFrame:
    """(id, y, pred): majority of the k nearest others by dot product; ties go to the first label."""
    hits = dense(vectors.select(F.col("id").alias("doc_id"), "vector"), vectors.select(F.col("id").alias("qid"), "vector"), k)
    votes = hits.join(vectors.select(F.col("id").alias("doc_id"), F.col("y").alias("label")), "doc_id").groupBy("qid", "label").agg(F.count("*").alias("n"))
    w = Window.partitionBy("qid").orderBy(F.desc("n"), "label")
    best = votes.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(F.col("qid").alias("id"), F.col("label").alias("pred"))
    return vectors.select("id", "y").join(best, "id")


def _features(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("features", array_to_vector(F.transform("vector", lambda x: x.cast("double"))))


def oof(vectors: DataFrame, head, k: int = 5, rep: int = 0, balanced: bool = True) -> DataFrame:
    """(id, y, pred, posterior) out of fold: each (id, vector, y) by a model of the other folds.

    head(n) makes an estimator for n training rows. posterior maps labels to probabilities, and is
    null for heads that give none.
    """
    f = _features(stratified_folds(vectors.where("y is not null"), "y", "id", k, rep))
    index = StringIndexer(inputCol="y", outputCol="label", stringOrderType="alphabetAsc").fit(f)
    f = index.transform(f).cache()
    sizes = f.groupBy("y").count()
    n, classes = f.count(), sizes.count()
    weight = F.lit(float(n)) / (classes * F.col("count")) if balanced else F.lit(1.0)
    f = f.join(sizes, "y").withColumn("weight", weight)
    names = F.array(*[F.lit(x) for x in index.labels])
    out = []
    for i in range(k):
        model = head(n).fit(f.where(F.col("fold") != i))
        p = model.transform(f.where(F.col("fold") == i))
        post = F.map_from_arrays(names, F.transform(vector_to_array("probability"), lambda x: F.round(x, 6))) if "probability" in p.columns else F.lit(None).cast("map<string,double>")
        out.append(p.select("id", "y", F.element_at(names, F.col("prediction").cast("int") + 1).alias("pred"), post.alias("posterior")))
    return reduce(DataFrame.unionAll, out)


def logistic(c: float = 4.0, weighted: bool = True, compress: int | None = None):
    """Multinomial logistic regression; the penalty is 1 / (c * total weight), the usual C on the sum of losses.

    compress projects the vectors on their first principal components, fitted on the training rows.
    """

    def make(n: int):
        lr = LogisticRegression(featuresCol="compressed" if compress else "features", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=100, family="multinomial")
        lr = lr.setWeightCol("weight") if weighted else lr
        return Pipeline(stages=[PCA(k=compress, inputCol="features", outputCol="compressed"), lr]) if compress else lr

    return make


def heads(classes: int, width: int) -> dict:
    """Challengers by name, each to be given to oof(): linear models, a support vector machine and a network."""
    return {
        "logistic_c0.5": logistic(0.5), "logistic_c1": logistic(1.0), "logistic_c4": logistic(4.0), "logistic_c16": logistic(16.0), "logistic_unweighted": logistic(4.0, False), "logistic_pca32": logistic(4.0, True, min(32, width)),
        "svm": lambda n: OneVsRest(classifier=LinearSVC(maxIter=30, regParam=1.0 / n), weightCol="weight"),
        "network": lambda n: MultilayerPerceptronClassifier(layers=[width, 64, classes], maxIter=60, seed=7),
        "trees": lambda n: RandomForestClassifier(numTrees=40, maxDepth=8, seed=7, weightCol="weight"),
    }


def logistic_oof(vectors: DataFrame, c: float = 4.0, k: int = 5, rep: int = 0) -> DataFrame:
    """(id, y, pred, confidence) out of fold by balanced multinomial logistic regression."""
    return oof(vectors, logistic(c), k, rep).select("id", "y", "pred", F.array_max(F.map_values("posterior")).alias("confidence"))


def repeated(vectors: DataFrame, predict, repeats: int = 5) -> DataFrame:
    """(rep, id, y, pred) of predict(vectors, rep) for each repeat; every repeat has folds of its own."""
    return reduce(DataFrame.unionAll, (predict(vectors, r).select(F.lit(r).alias("rep"), "id", "y", "pred") for r in range(repeats)))


def macro_f1_by(preds: DataFrame, *by: str) -> DataFrame:
    """(by, n, accuracy, macro_f1) of predictions, over the labels of each group."""
    c = preds.where("y is not null and pred is not null").groupBy(*by, "y", "pred").agg(F.count("*").alias("n"))
    same = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)
    long = c.select(*by, F.col("y").alias("label"), same.alias("tp"), F.col("n").alias("both")).unionAll(c.select(*by, "pred", F.lit(0), "n"))
    f = long.groupBy(*by, "label").agg(F.sum("tp").alias("tp"), F.sum("both").alias("both"))
    return f.groupBy(*by).agg((F.sum("both") / 2).cast("long").alias("n"), F.round(2 * F.sum("tp") / F.sum("both"), 6).alias("accuracy"), F.round(F.avg(2 * F.col("tp") / F.col("both")), 6).alias("macro_f1"))


def nested(vectors: DataFrame, candidates: dict, outer: int = 5, inner: int = 4) -> tuple[DataFrame, DataFrame]:
    """Predictions (fold, id, y, pred, chosen), and how often each candidate was chosen.

    candidates give predict(train, test, rep) -> (id, y, pred). For each outer fold the candidate with
    the best macro-F1 over inner folds of the training rows predicts the fold; ties go to the first name.
    """
    f = stratified_folds(vectors.where("y is not null"), "y", "id", outer)
    out, names = [], []
    for o in range(outer):
        train, test = f.where(F.col("fold") != o).drop("fold"), f.where(F.col("fold") == o).drop("fold")
        g = stratified_folds(train, "y", "id", inner, o + 1)
        tried = reduce(DataFrame.unionAll, (c(g.where(F.col("fold") != i).drop("fold"), g.where(F.col("fold") == i).drop("fold")).select(F.lit(name).alias("name"), "id", "y", "pred") for name, c in candidates.items() for i in range(inner)))
        best = macro_f1_by(tried, "name").orderBy(F.desc("macro_f1"), "name").first()["name"]  # a row a candidate
        names.append((best,))
        out.append(candidates[best](train, test).select(F.lit(o).alias("fold"), "id", "y", "pred", F.lit(best).alias("chosen")))
    chosen = vectors.sparkSession.createDataFrame(names, "chosen string").groupBy("chosen").agg(F.count("*").alias("n"))
    return reduce(DataFrame.unionAll, out), chosen


def by_centroid(train: DataFrame, test: DataFrame) -> DataFrame:
    """(id, y, pred): the class whose mean vector has the greatest dot product; ties go to the first label."""
    c = centroids(train, "y", "vector").groupBy(F.col("y").alias("label")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda p: p["mean"]).alias("vector"))
    return test.select("id", "y").join(by_label_text(test.select("id", "vector"), c).select("id", "pred"), "id")


def by_neighbours(k: int = 5, by_distance: bool = False):
    """A candidate for nested(): the k nearest training rows vote, each with one vote or with its similarity."""

    def predict(train: DataFrame, test: DataFrame) -> DataFrame:
        hits = dense(train.select(F.col("id").alias("doc_id"), "vector"), test.select(F.col("id").alias("qid"), "vector"), k, False)
        weight = F.round(F.sum(F.greatest(F.col("score"), F.lit(0.0))), 9) if by_distance else F.count("*").cast("double")
        v = hits.join(train.select(F.col("id").alias("doc_id"), F.col("y").alias("label")), "doc_id").groupBy("qid", "label").agg(weight.alias("w"))
        best = v.groupBy("qid").agg(F.min(F.struct((-F.col("w")).alias("w"), F.col("label").alias("label"))).alias("b")).select(F.col("qid").alias("id"), F.col("b.label").alias("pred"))
        return test.select("id", "y").join(best, "id")

    return predict


def confusable(cosines: DataFrame, n: int) -> list[str]:
    """The n most confusable classes of (a, b, cosine): the closest pair, then whichever is closest on average to those chosen.

    cosines has a row for each pair of classes; ties go to the first labels.
    """
    sim: dict = {}
    for r in cosines.collect():  # classes squared
        sim[r["a"], r["b"]] = sim[r["b"], r["a"]] = r["cosine"]
    labels = sorted({a for a, _ in sim})
    if not labels:
        return []
    chosen = list(min(((a, b) for a, b in sim if a < b), key=lambda p: (-sim[p], p)))
    while len(chosen) < min(n, len(labels)):
        chosen.append(min((x for x in labels if x not in chosen), key=lambda x: (-sum(sim[x, c] for c in chosen) / len(chosen), x)))
    return chosen[:n]


def text_pipeline(text_col: str = "text", features: int = 1 << 16) -> Pipeline:
    """Word one- and two-grams, hashed and weighed by inverse document frequency, into logistic regression."""
    words = RegexTokenizer(inputCol=text_col, outputCol="_w", pattern="[^\\p{L}\\p{N}]+", minTokenLength=2)
    pairs = NGram(n=2, inputCol="_w", outputCol="_p")
    a, b = HashingTF(inputCol="_w", outputCol="_hw", numFeatures=features), HashingTF(inputCol="_p", outputCol="_hp", numFeatures=features)
    both = VectorAssembler(inputCols=["_hw", "_hp"], outputCol="_h")
    return Pipeline(stages=[words, pairs, a, b, both, IDF(inputCol="_h", outputCol="features"), StringIndexer(inputCol="y", outputCol="label", handleInvalid="skip"), LogisticRegression(maxIter=30, regParam=0.01)])


def analysed(text: Column, kind: str = "word", stop: tuple[str, ...] = (), accents: bool = False) -> Column:
    """The terms of a text: words of two or more characters and their pairs, or, for kind `char_wb`,
    runs of three to five characters inside words padded with blanks.

    accents takes accents away; stop words are left out before pairs are made. Null gives null.
    """
    t = F.lower(text)
    if accents:
        plain = str.maketrans({chr(c): d for c in range(0xC0, 0x180) if (d := unicodedata.normalize("NFD", chr(c))[0]).isascii()})
        t = F.translate(t, "".join(map(chr, plain)), "".join(plain.values()))
    words = F.filter(F.split(t, r"(?U)[^\p{L}\p{N}_]+"), lambda w: (F.length(w) > 1) & ~w.isin(*stop) if stop else F.length(w) > 1)
    if kind == "char_wb":
        runs = lambda w: F.flatten(F.transform(F.array(F.lit(3), F.lit(4), F.lit(5)), lambda n: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substr(w, i, n))).otherwise(F.array().cast("array<string>"))))
        return F.flatten(F.transform(words, lambda w: runs(F.concat(F.lit(" "), w, F.lit(" ")))))
    pairs = F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, F.filter(pairs, lambda p: p.isNotNull()))


def vocabulary(docs: DataFrame, id_col: str, terms: Column, least: int = 1, most: float = 1.0) -> DataFrame:
    """(term, df) of the terms in `least` documents or more, and in at most the share `most` of them."""
    x = docs.select(F.col(id_col), F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = docs.where(terms.isNotNull()).agg(F.count("*").alias("n"))  # one row
    return x.join(n).where((F.col("df") >= least) & (F.col("df") <= F.lit(most) * F.col("n"))).select("term", "df")


def kmeans_sweep(vectors: DataFrame, ks: list[int], seed: int = 20250911) -> DataFrame:
    """(k, silhouette, cost, sizes) of k-means over (id, vector) for each k; sizes come largest first."""
    v = _features(vectors).select("features").cache()
    rows = []
    for k in ks:
        model = KMeans(k=k, seed=seed, maxIter=20).fit(v)
        rows.append((k, float(ClusteringEvaluator().evaluate(model.transform(v))), float(model.summary.trainingCost), sorted(map(int, model.summary.clusterSizes), reverse=True)))
    v.unpersist()
    return vectors.sparkSession.createDataFrame(rows, "k int, silhouette double, cost double, sizes array<int>")


def clusters(vectors: DataFrame, k: int, seed: int = 20250911) -> DataFrame:
    """(id, cluster) of k-means over (id, vector)."""
    v = _features(vectors)
    return KMeans(k=k, seed=seed, maxIter=20).fit(v).transform(v).select("id", F.col("prediction").alias("cluster"))


def cluster_profile(assigned: DataFrame, texts: DataFrame, terms: int = 12, examples: int = 8) -> DataFrame:
    """(cluster, n, terms, examples): the terms whose mean TF-IDF weight is greatest, and the first texts by id.

    assigned is (id, cluster), texts (id, text).
    """
    x = assigned.join(texts, "id")
    t = x.select("cluster", "id", F.explode(analysed(F.col("text"))).alias("term")).groupBy("cluster", "id", "term").agg(F.count("*").alias("tf"))
    df, n = t.groupBy("term").agg(F.count("*").alias("df")), x.agg(F.count("*").alias("all"))  # one row
    w = t.join(df, "term").join(n).groupBy("cluster", "term").agg(F.round(F.sum(F.col("tf") * (F.ln((1 + F.col("all")) / (1 + F.col("df"))) + 1)), 9).alias("w"))
    first = Window.partitionBy("cluster").orderBy(F.desc("w"), "term")
    top = w.withColumn("r", F.row_number().over(first)).where(F.col("r") <= terms).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda p: p["term"]).alias("terms"))
    shown = x.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy("id"))).where(F.col("r") <= examples)
    shown = shown.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda p: p["text"]).alias("examples"))
    return x.groupBy("cluster").agg(F.count("*").alias("n")).join(top, "cluster", "left").join(shown, "cluster", "left")


def signals(posterior: DataFrame) -> DataFrame:
    """(id, max_prob, margin, entropy, confidence_entropy) of (id, label, p); margin is 1 with fewer than two classes."""
    g = posterior.groupBy("id").agg(F.sort_array(F.collect_list("p"), asc=False).alias("ps"))
    n = F.size("ps")
    h = entropy(F.col("ps"))
    return g.select("id", F.round(F.col("ps")[0], 6).alias("max_prob"), F.round(F.when(n < 2, 1.0).otherwise(F.col("ps")[0] - F.try_element_at("ps", F.lit(2))), 6).alias("margin"), F.round(h, 6).alias("entropy"), F.round(F.when(n < 2, 1.0).otherwise(1 - h / F.ln(n.cast("double"))), 6).alias("confidence_entropy"))

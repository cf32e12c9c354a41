"""Model preparation, training and scoring with Spark ML.

Fitted statistics that Spark ML computes differently from the reference are
computed exactly as one-row aggregates: median imputation (ML ``Imputer`` is
approximate), population-std scaling (ML ``StandardScaler`` uses the sample
std), most-frequent imputation with ties to the smallest value.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import quantiles


def impute_median(df: DataFrame, fit: DataFrame, cols: list[str]) -> DataFrame:
    """Null → exact median fitted on ``fit``, of all columns in one pass; a number each is known then, so no later job
    works them out again."""
    medians = {r["column"]: r.m for r in quantiles(fit, cols, [0.5]).select("column", F.col("q")[0].alias("m")).collect()}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(medians.get(c)).cast("double")) for c in cols})


def impute_mode(df: DataFrame, fit: DataFrame, cols: list[str]) -> DataFrame:
    """Null → most frequent value in ``fit`` (ties → smallest value)."""
    if not cols:
        return df
    md = fit.agg(*[F.mode(c, deterministic=True).alias(c) for c in cols]).first()
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(md[c]).cast(fit.schema[c].dataType)) for c in cols})


def scale_pop(df: DataFrame, fit: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """z-score with the population std fitted on ``fit``; zero std → 1."""
    st = fit.agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c)
                            for c in cols])).scalar()
    out = {}
    for c in cols:
        sd = F.when(st[c]["s"] > 0, st[c]["s"]).otherwise(F.lit(1.0))
        out[c + suffix] = (F.col(c) - st[c]["m"]) / sd
    return df.withColumns(out)


def onehot_stages(cats: list[str]) -> list:
    """Alphabetical index + one-hot where unseen values map to all zeros
    (``handleInvalid='keep'`` puts them in the last slot, which
    ``dropLast`` removes).  All columns are indexed in one pass."""
    if not cats:
        return []
    idx = [f"{c}_idx" for c in cats]
    return [StringIndexer(inputCols=cats, outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=idx, outputCols=[f"{c}_oh" for c in cats], dropLast=True)]


def onehot_columns(df: DataFrame, fit: DataFrame, col: str) -> DataFrame:
    """One 0/1 column per category seen in ``fit`` (sorted), unknown → zeros."""
    model = Pipeline(stages=onehot_stages([col])).fit(fit)
    labels = model.stages[0].labelsArray[0]
    arr = vector_to_array(F.col(f"{col}_oh"))
    out = model.transform(df)
    return out.select("*", *[arr[i].cast("int").alias(f"{col}_{v}") for i, v in enumerate(labels)]).drop(
        f"{col}_idx", f"{col}_oh")


def case_vectors(df: DataFrame, fit: DataFrame, num: list[str], cats: list[str], id_col: str) -> DataFrame:
    """The id and ``vec``: imputed and scaled numbers, then 0/1 places of the categories that ``fit`` holds (sorted; a
    value it doesn't hold has none).  Needs categories of few values, as they go through the driver."""
    medians = quantiles(fit, num, [0.5]).agg(F.map_from_entries(F.collect_list(F.struct("column", F.col("q")[0])))).scalar()
    fill = lambda x: x.withColumns({c: F.coalesce(F.col(c), medians[c]) for c in num})
    d = impute_mode(scale_pop(fill(df), fill(fit), num), fit, cats)
    known = fit.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in cats]).first()  # as an encoder's labels: few values
    place = [F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0)) for c in cats for v in known[c]]
    return d.select(id_col, F.array(*num, *place).alias("vec"))


def imbalance_weight(label: Column, neg_over_pos: Column, mode: str = "ratio") -> Column:
    """Positive-class weight: neg/pos ratio, its square root, or 1."""
    w = {"ratio": neg_over_pos, "sqrt": F.sqrt(neg_over_pos), "none": F.lit(1.0)}[mode]
    return F.when(label == 1, w).otherwise(F.lit(1.0))


def assembler(num: list[str], cats: list[str]) -> list:
    return [*onehot_stages(cats),
            VectorAssembler(inputCols=[*num, *[f"{c}_oh" for c in cats]], outputCol="features",
                            handleInvalid="keep")]


def make_model(kind: str, label: str = "is_fraud", weight: str | None = None, **params):
    common = {"featuresCol": "features", "labelCol": label}
    if kind == "logreg":
        m = LogisticRegression(maxIter=params.get("maxIter", 50), regParam=params.get("regParam", 0.0), **common)
    elif kind == "rf":
        m = RandomForestClassifier(numTrees=params.get("numTrees", 50), maxDepth=params.get("maxDepth", 10),
                                   seed=params.get("seed", 42), **common)
    elif kind == "gbt":
        m = GBTClassifier(maxIter=params.get("maxIter", 100), maxDepth=params.get("maxDepth", 5),
                          stepSize=params.get("stepSize", 0.1), maxBins=params.get("maxBins", 64),
                          seed=params.get("seed", 42), **common)
    else:
        raise ValueError(kind)
    if weight:
        m.setWeightCol(weight)
    return m


def fit_pipeline(train: DataFrame, num: list[str], cats: list[str], kind: str = "gbt",
                 label: str = "is_fraud", weight: str | None = None, **params):
    pipe = Pipeline(stages=[*assembler(num, cats), make_model(kind, label, weight, **params)])
    return pipe.fit(train)


def score(model, df: DataFrame, out: str = "fraud_probability") -> DataFrame:
    return model.transform(df).withColumn(out, vector_to_array(F.col("probability"))[1])


def feature_importance(model, df: DataFrame, top: int = 20) -> DataFrame:
    """``importance_table`` of a fitted pipeline."""
    return importance_table(model.stages[-1], model.transform(df.limit(0)), top)


def importance_table(model, matrix: DataFrame, top: int = 20) -> DataFrame:
    """Top-``top`` (feature, importance) from a fitted model: tree
    importances or |coefficients|, names from the assembled vector's ML
    attribute metadata (schema only, no job), plus the feature family."""
    from ..functions.features import feature_family_expr
    imp = (model.featureImportances.toArray() if hasattr(model, "featureImportances")
           else abs(model.coefficients.toArray()))
    meta = matrix.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a["name"] for group in meta.values() for a in group}
    rows = sorted(((names.get(i, f"f{i}"), float(v)) for i, v in enumerate(imp)), key=lambda x: -x[1])[:top]
    out = matrix.sparkSession.createDataFrame(rows, "feature string, importance double")  # ≤ top rows
    return out.withColumn("family", feature_family_expr(F.col("feature")))


def stream_model(spark, sf: str):
    """A logistic regression with balanced weights on the stream's features, fitted on their batch twins,
    saved to the shared folder and loaded from there."""
    from pyspark.ml import PipelineModel

    from ..functions.features import feat_time_ext
    from ..plans.q_metrics import scored
    from ..session import scratch_path
    from ..streaming.job import MODEL_COLUMNS, VALUES
    from . import past as P
    d = scored(spark, sf)
    sender, flags = "sender_account", {f"is_new_{v}_for_sender": v for v in VALUES}
    d = P.together(d, [sender], [([sender, v], {o: ("count", None)}, "positional") for o, v in flags.items()] + [([sender], {"_last": ("max", F.col("ts"))}, "positional")])
    d = d.withColumns({o: (F.col(o) == 0).cast("int") for o in flags})
    gap = (F.unix_micros("ts") - F.unix_micros("_last")) / 1e6
    d = d.withColumn("t", F.when(F.col("_last").isNull(), F.col("time_since_last_transaction")).otherwise(gap))
    d = feat_time_ext(d, "ts").withColumns({"log_amount": F.log1p("amount"), "tslt_abs": F.coalesce(F.abs("t"), F.lit(0.0)), "tslt_is_negative": F.coalesce(F.col("t") < 0, F.lit(False)).cast("int")})
    d = d.fillna(0.0, MODEL_COLUMNS)
    rate = d.agg(F.avg("is_fraud")).first()[0] or 0.5
    d = d.withColumn("w", F.when(F.col("is_fraud") == 1, F.lit(0.5 / max(rate, 1e-9))).otherwise(F.lit(0.5 / max(1 - rate, 1e-9))))
    fit = Pipeline(stages=[VectorAssembler(inputCols=MODEL_COLUMNS, outputCol="features"),
                           LogisticRegression(labelCol="is_fraud", weightCol="w", maxIter=100)]).fit(d.select(*MODEL_COLUMNS, "is_fraud", "w"))
    path = scratch_path(spark, "stream-model")
    fit.write().save(path)
    return PipelineModel.load(path)

"""Registered model queries; each model is fitted once per warehouse."""

from __future__ import annotations

from pyspark.sql import functions as F

from martloom.ml import churn, clusters
from martloom.plans.advanced import mart_propensity_scores

MODELS = {}


def model_query(name):
    def register(fn):
        MODELS[name] = fn
        return fn

    return register


def _population(w, max_orders=None):
    return churn.churn_customers(w.mart("customer_ltv"), w.cfg.as_of, max_orders, w.cfg.churn_days)


def _features(w):
    return w.keep("churn_features", lambda: churn.churn_features(_population(w)))


def _leaking(w) -> list[str]:
    """Lineage of the feature plan before it is stored: the columns made from the label's inputs."""
    return w.remember("churn_leaking", lambda: churn.leaking_columns(churn.churn_features(_population(w))))


def _data(w) -> churn.ChurnData:
    return w.remember("churn_data", lambda: churn.training_data(_features(w), _leaking(w)))


def _models(w) -> churn.ChurnModels:
    return w.remember("churn_models", lambda: churn.train_models(_data(w)))


def _best(w) -> str:
    return w.remember("churn_best", lambda: churn.best_model(_models(w)))


def _vectors(w):
    return w.remember("cluster_vectors", lambda: clusters.cluster_input(
        w.mart("customer_base"), w.mart("customer_rfm"), w.mart("customer_ltv")))


def _profiles(w):
    def build():
        vectors = _vectors(w)
        return clusters.profiles(clusters.kmeans_assign(vectors)[0])

    return w.keep("cluster_profiles", build)


@model_query("churn_reference_dates")
def reference_dates(w):
    return churn.reference_dates(w.mart("customer_ltv"), w.cfg.as_of)


@model_query("churn_single_purchase")
def single_purchase(w):
    return _population(w, max_orders=1)


@model_query("churn_features")
def features(w):
    return churn.churn_features(_population(w))


@model_query("churn_class_balance")
def class_balance(w):
    return churn.class_balance(_features(w))


@model_query("churn_recency_crosstab")
def recency_crosstab(w):
    return churn.recency_crosstab(_features(w))


@model_query("churn_selected_features")
def selected_features(w):
    """The candidates that stay, with a flag for those that give the label away."""
    leaking = set(_leaking(w))
    kept = [c for c in churn.CANDIDATES if c not in leaking]
    chosen = churn.select_features(churn.imputed(_features(w), churn.CANDIDATES), kept)
    rows = [(c, c in chosen, c in leaking) for c in churn.CANDIDATES]
    return w.spark.createDataFrame(rows, "feature string, is_selected boolean, is_leaking boolean")


@model_query("churn_split")
def split_summary(w):
    return churn.split_summary(_data(w))


@model_query("churn_encoding_slots")
def encoding_slots(w):
    """The slots of the model's input vector, in order."""
    rows = list(enumerate(_data(w).slots))
    return w.spark.createDataFrame(rows, "position int, slot string")


@model_query("churn_split_rows")
def split_rows(w):
    """Every customer of the churn population with its part."""
    return churn.split_parts(_features(w).select("customer_id", "is_churned"))


@model_query("churn_model_results")
def model_results(w):
    return churn.model_results(_models(w))


@model_query("churn_feature_importance_all")
def feature_importance_all(w):
    return churn.importance_table(_models(w), _best(w))


@model_query("churn_feature_importance")
def feature_importance(w):
    return churn.feature_importance(_models(w), _best(w))


@model_query("churn_confusion")
def confusion(w):
    return churn.confusion(_models(w), _best(w))


@model_query("churn_curve_points")
def curve_points(w):
    return churn.curve_points(_models(w), _best(w))


@model_query("churn_scores")
def scores(w):
    return churn.scores(_models(w), _best(w))


@model_query("churn_high_risk")
def high_risk(w):
    return scores(w).where("risk_level = 'High Risk'").orderBy(F.desc("churn_probability"), "customer_id")


@model_query("churn_propensity_scores")
def propensity_scores(w):
    """The propensity mart with its churn columns filled from the model."""
    return mart_propensity_scores(
        w.customers(), w.facts("orders"), w.facts("items"), w.facts("payments"), w.cfg,
        churn=scores(w))


@model_query("cluster_elbow")
def elbow(w):
    return clusters.elbow(_vectors(w))


@model_query("cluster_profiles")
def cluster_profiles(w):
    return _profiles(w)


@model_query("cluster_priorities")
def cluster_priorities(w):
    return clusters.priorities(_profiles(w))


@model_query("cluster_recommendations")
def cluster_recommendations(w):
    return clusters.recommendations(_profiles(w))

"""Preparation, training, scoring and evaluation of the prediction tasks with Spark ML."""

from .evaluate import (
    best_threshold, binary_summary, classification_report, confusion_matrix, regression_metrics, report_summary,
    roc_auc, threshold_curve,
)
from .prepare import (
    Preprocessor, add_class_weights, build_delay_dataset, build_review_dataset, class_weights, fit_preprocessor,
    split_features,
)
from .train import (
    delay_estimators, score_classes, train_binary_review_models, train_customer_value_model, train_delay_models,
    train_review_models,
)

__all__ = [
    "Preprocessor", "add_class_weights", "best_threshold", "binary_summary", "build_delay_dataset",
    "build_review_dataset", "class_weights", "classification_report", "confusion_matrix", "delay_estimators",
    "fit_preprocessor", "regression_metrics", "report_summary", "roc_auc", "score_classes", "split_features",
    "threshold_curve", "train_binary_review_models", "train_customer_value_model", "train_delay_models",
    "train_review_models",
]

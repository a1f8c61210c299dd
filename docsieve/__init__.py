"""A PySpark-native engine for finding documents and preparing text collections. What users need most, loaded on first use."""

from importlib import import_module

_HOME = {
    "ActiveLearner": "plans.session", "Settings": "plans.session", "Run": "plans.session", "DatasetBuilder": "plans.dataset",
    "Index": "sources.index", "HttpIndex": "sources.http_index", "newest": "sources.index", "search": "operators.search", "search_text": "operators.search", "top_k": "operators.search",
    "stratified_diverse": "operators.sampling", "BalancedLogisticRegression": "operators.classifier", "Classifier": "operators.classifier",
    "create": "providers", "register": "providers", "embed": "providers", "generate_documents": "providers", "evaluate_documents": "providers",
}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(name)
    return getattr(import_module(f"{__name__}.{_HOME[name]}"), name)

"""notelake: typed, linked Markdown collections and large tables as Spark DataFrames."""

from importlib import import_module

__version__ = "0.1.0"

#: What the package offers at its top, loaded when it is first asked for: executors import the package for a function or two.
_PLACES = {
    "Collection": "collection", "DanglingError": "collection", "FieldType": "model", "FieldSchema": "model", "TypeSchema": "model", "Schema": "model", "RULES": "operators.lint", "Tables": "operators.views", "Receipt": "operators.write",
    "Env": "plans.expr", "translate": "plans.expr", "Untranslatable": "plans.expr", "infer": "functions.infer", "of_values": "functions.infer",
}
__all__ = sorted(_PLACES)


def __getattr__(name: str):
    if name in _PLACES:
        return getattr(import_module(f".{_PLACES[name]}", __name__), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")

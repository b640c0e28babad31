"""Ranked prefix suggestion over arbitrary tables, on Spark DataFrames."""

from importlib import import_module

#: Loaded on first use, so that Python workers import only what a task needs.
_HOME = {
    "EditBoundError": "schema",
    "IndexFormatError": "schema",
    "IndexBuilder": "plans.index",
    "SuggestIndex": "plans.index",
    "geo_unpack": "adapters.geo",
    "normalize": "functions.fold",
}

__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name in _HOME:
        return getattr(import_module(f"{__name__}.{_HOME[name]}"), name)
    raise AttributeError(name)

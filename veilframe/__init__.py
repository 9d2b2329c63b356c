"""Field encryption and blind-index search on Spark DataFrames."""

from importlib import import_module

#: Public names and their modules; loaded on first use, since Python workers import this package too.
_WHERE = {
    "Catalogue": "plans.spec",
    "Engine": "engine",
    "EntitySpec": "plans.spec",
    "FieldSpec": "plans.spec",
    "LocalKeyProvider": "sources.keys",
    "Normalizer": "functions.normalize",
    "Options": "engine",
    "RegistryKeyProvider": "sources.keys",
    "email": "plans.spec",
    "encrypted": "plans.spec",
    "plaintext": "plans.spec",
    "searchable": "plans.spec",
    "spark_errors": "errors",
}
__all__ = list(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module 'veilframe' has no attribute {name!r}")
    return getattr(import_module(f"veilframe.{_WHERE[name]}"), name)

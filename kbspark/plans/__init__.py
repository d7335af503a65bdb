"""The registered queries of the library's operators, by module, each with SQL where SQL can say it."""

from importlib import import_module

MODULES = ("analytics", "log", "text", "content", "stores", "language", "compiler")


def _all(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"kbspark.plans.{module}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracles() -> dict:
    return _all("ORACLES")

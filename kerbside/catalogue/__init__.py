"""Queries over the driver's tables, one per operator or report."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["batch", "spatial", "traffic", "models"]


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in _MODULES:
        merged |= getattr(import_module(f"kerbside.catalogue.{name}"), attribute)
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict[str, str]:
    return _merged("ORACLES")

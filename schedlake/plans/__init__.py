"""Queries over the rendered inputs, grouped like the operators they run."""

from importlib import import_module

AREAS = ("intakes", "layout", "tokens", "resolution", "tables", "review", "calendars", "stores", "audits", "streams", "pipeline")


def load_all() -> None:
    for area in AREAS:
        import_module(f"schedlake.plans.{area}")

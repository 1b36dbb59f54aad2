"""Named queries over the landed tables."""

from importlib import import_module

FAMILIES = ("swaps", "pricing", "registry_joins", "graphs", "series", "capitals", "stored", "expressions", "streams", "report_queries")


def load() -> None:
    for family in FAMILIES:
        import_module(f"{__name__}.{family}")

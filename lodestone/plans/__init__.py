"""Registered queries over the driver tables."""

import importlib

MODULES = (
    "text_queries",
    "search_queries",
    "scoring_queries",
    "report_queries",
    "slot_queries",
    "extraction_queries",
    "session_queries",
    "serving_queries",
    "function_queries",
)


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"lodestone.plans.{module}")

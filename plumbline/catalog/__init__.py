"""The registered queries: each operator on whole tables, with its SQL twin."""

from plumbline.catalog import combining, modelling, preparing, profiling, scoring, splitting  # noqa: F401
from plumbline.catalog.registry import ORACLE, QUERIES  # noqa: F401

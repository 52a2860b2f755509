"""All queries of the library."""

from . import canonical, corpus, covers, cycles, dedup, extras, match, reports, runs, storage, streams, substrate, text
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "canonical", "corpus", "covers", "cycles", "dedup", "extras", "match", "reports", "runs", "storage", "streams", "substrate", "text"]

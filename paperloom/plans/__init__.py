"""Queries over the driver's tables with the SQL that gives the same rows."""

from . import decks, documents, edits, files, illustrated, macros, pdfs, profiles, regions, scalars, stores, streams, tables, workbooks
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "decks", "documents", "edits", "files", "illustrated", "macros", "pdfs", "profiles", "regions", "scalars", "stores", "streams", "tables", "workbooks"]

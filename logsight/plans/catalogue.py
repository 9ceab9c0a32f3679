"""All registered queries with their SQL; importing the modules registers them."""

from logsight.plans import detection, parsing, surface
from logsight.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "detection", "parsing", "surface"]

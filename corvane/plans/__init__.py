"""Registered queries: the operators applied to the test tables, and the SQL they are compared with.

Names begin with the operator ids of the survey. Results hold no nested values; fractions are rounded to six places.
"""

from . import answers, audits, core, gates, geometry, index, items, labels, logs, media, pictures, questions, reports  # noqa: F401  importing registers the queries
from .core import flagship  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

from .catalog import OPERATORS, ORACLE, QUERIES  # noqa: F401
from . import panel, bars, profiles, baskets, matching, evaluation, documents, flows  # noqa: F401

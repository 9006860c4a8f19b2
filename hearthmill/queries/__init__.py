"""All named queries of the core, with the SQL they are checked against."""

from hearthmill.queries import data_problems, expressions, inputs, maintenance, relations

_MODULES = (relations, expressions, maintenance, inputs, data_problems)

ALL_QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ALL_SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}

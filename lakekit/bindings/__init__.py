"""Named queries over the test tables, each with its SQL counterpart where SQL can express it.

Every module has `QUERIES`, name to function of (session, data folder), and `SQL`, name to text.
"""

from . import entities, lifecycle, observing, reporting, streams

MODULES = (reporting, lifecycle, observing, streams, entities)


def all_queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}

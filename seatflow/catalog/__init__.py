"""Named queries over the given tables, each with its independent SQL twin.

A module holds ``QUERIES`` (name to function of session and folder) and ``SQL``
(name to text for the other engine); a name without text has no SQL form.
"""

from seatflow.catalog import (
    columns,
    groups,
    learning,
    rules,
    schools,
    storage,
    streams,
    texts,
    vectors,
    years,
)

MODULES = (columns, years, groups, schools, rules, storage, texts, vectors, learning, streams)


def all_queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}

"""Where catalogue modules put their queries."""

from __future__ import annotations

from collections.abc import Callable

from spindrift.plans.views import duck

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def put(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = duck(oracle)
        return f

    return put


# Pieces of DuckDB SQL that several oracles share.


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tri(x: str) -> str:
    """Distinct trigrams of a text."""
    words = rf"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform(list_transform({words}, lambda w: '  ' || w || ' '), lambda p: list_transform(range(1, length(p) - 1), lambda i: substr(p, cast(i as integer), 3)))))"


def likeness(a: str, b: str) -> str:
    """Shared over all members of two list expressions without repeats."""
    both = f"len(list_intersect({a}, {b}))"
    return f"coalesce({both}::double / nullif(len({a}) + len({b}) - {both}, 0), 0)"


def sim(x: str, term: str) -> str:
    return likeness(tri(x), tri(q(term)))


def normal(x: str) -> str:
    lines = rf"string_split(regexp_replace({x}, '\r\n?', chr(10), 'g'), chr(10))"
    return rf"array_to_string(list_filter(list_transform({lines}, lambda l: trim(regexp_replace(l, '[ \t\x0B\f　]+', ' ', 'g'))), lambda l: l <> ''), chr(10))"

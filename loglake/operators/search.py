"""Full-text search over message, category and tag values."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.operators.filters import result_limit, time_range

# Words are runs of letters, digits and underscores; everything else separates them.
_WORD = r"[\p{L}\p{N}_]"
# Searched fields are put into one text, divided by a character that no phrase matches across.
_BETWEEN_FIELDS = "\\u0001"
_SEPARATOR = r"[^\p{L}\p{N}_\x01]+"
_PIECES = re.compile(r'\(|\)|[^\s():"]+:"[^"]*"|"[^"]*"|[^\s()"]+')
_FIELDS = {
    "message": "message",
    "category": "category",
    "level": "level",
    "logtype": "log_type",
    "log_type": "log_type",
    "environment": "environment",
    "service": "source_id",
    "sourceid": "source_id",
    "source_id": "source_id",
    "traceid": "trace_id",
    "trace_id": "trace_id",
}


def _split(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w*?]+", text.lower()) if w]


def word_pattern(text: str) -> str:
    """Regular expression for a term, wildcard or phrase on lower-cased text.

    A first word without wildcards comes first as it is and its left edge is checked behind it: the
    matcher can then skip ahead to the letters instead of testing an edge at every position.
    """
    words = _split(text)
    parts = [w.replace("*", f"{_WORD}*").replace("?", _WORD) for w in words]
    if re.search(r"[*?]", words[0]):
        parts[0] = f"(?<!{_WORD}){parts[0]}"
    else:
        parts[0] = f"{parts[0]}(?<!{_WORD}{words[0]})"
    return _SEPARATOR.join(parts) + f"(?!{_WORD})"


def _may_match(haystack: str, text: str) -> str:
    """Plain substring test for the longest literal part of a term; most rows fail it cheaply."""
    literal = max(re.split(r"[^\w]+", " ".join(_split(text))), key=len)
    return f"contains({haystack}, '{literal}')" if literal else "true"


def _matches(haystack: str, text: str) -> str:
    return f"({_may_match(haystack, text)} AND rlike({haystack}, r'{word_pattern(text)}'))"


def _haystack(fields: list[str], tags: str | None) -> str:
    parts = fields + ([f"map_values({tags})"] if tags else [])
    return f"lower(concat_ws('{_BETWEEN_FIELDS}', {', '.join(parts)}))"


def split_field(piece: str) -> tuple[str | None, str]:
    """(field name or None, the rest) of a term: ``field:value`` names a field, anything else does not."""
    field, _, rest = piece.partition(":")
    if re.search(r"[\w*?]", rest) and re.fullmatch(r"[\w.]+", field):
        return field, rest
    return None, piece


def _leaf(piece: str, fields: list[str], tags: str | None) -> str:
    field, rest = split_field(piece)
    if field is None:
        return _matches(_haystack(fields, tags), piece)
    column = _FIELDS.get(field.lower())
    if column:
        return _matches(_haystack([column], None), rest)
    key = field.removeprefix("tags.")
    return _matches(_haystack([f"try_element_at({tags}, '{key}')"], None), rest) if tags else "false"


def boolean_expression(query: str, leaf: Callable[[str], str]) -> str:
    """A query string as an SQL expression over what ``leaf`` gives for its terms, phrases and ``field:value`` pieces."""
    # Of each open parenthesis: its text so far, and what is excluded from it.
    groups: list[tuple[list[str], list[str]]] = [([], [])]
    excluding = [False]

    def close() -> str:
        kept, excluded = groups.pop()
        return f"(({' '.join(kept) or 'true'}){''.join(f' AND NOT {x}' for x in excluded)})"

    def operand(text: str) -> None:
        kept, excluded = groups[-1]
        if excluding[-1]:
            excluded.append(text)
            excluding[-1] = False
            return
        if kept and kept[-1] not in ("AND", "OR", "NOT"):
            kept.append("OR")
        kept.append(text)

    for piece in _PIECES.findall(query):
        kept = groups[-1][0]
        if piece == "(":
            groups.append(([], []))
            excluding.append(False)
        elif piece == ")" and len(groups) > 1:
            text = close()
            excluding.pop()
            operand(text)
        elif piece == "NOT" and (not kept or kept[-1] not in ("AND", "OR", "NOT")):
            excluding[-1] = True
        elif piece in ("AND", "OR", "NOT"):
            # After an exclusion the operator joins what follows to the kept part.
            if kept or piece == "NOT":
                kept.append(piece)
        elif piece != ")":
            operand(leaf(piece) if re.search(r"[\w*?]", piece) else "true")
    while len(groups) > 1:
        text = close()
        excluding.pop()
        operand(text)
    return close()


def search_predicate(
    query: str | None,
    fields: tuple[str, ...] = ("message", "category"),
    tags: str | None = "tags",
) -> Column:
    """One boolean column for a query string.

    Terms, ``"phrases"``, ``field:value`` and ``wild*`` become predicates; AND, OR, NOT and parentheses
    are left to Spark's own expression language, whose precedence they share. Terms that stand next to
    each other are alternatives. A NOT that no AND or OR precedes excludes from its whole group:
    ``a b NOT c`` is ``(a OR b) AND NOT c``. Unsupported: fuzzy matching, boosts and ranges.
    """
    if query is None or not query.strip():
        return F.lit(True)
    return F.expr(boolean_expression(query, lambda piece: _leaf(piece, list(fields), tags)))


def search(
    df: DataFrame,
    query: str | None,
    limit: int | None = None,
    t_from: dt.datetime | str | None = None,
    t_to: dt.datetime | str | None = None,
    order_by: tuple[str, ...] = ("timestamp", "id"),
) -> DataFrame:
    """Entries that match, newest first; pass a frame that is already scoped to one tenant."""
    hits = time_range(df, t_from, t_to, closed=True).filter(search_predicate(query))
    keys = [F.col(order_by[0]).desc(), *order_by[1:]]
    return hits.orderBy(*keys).limit(result_limit(limit))


def relevance(
    df: DataFrame, terms: list[str], text: str = "message", k1: float = 1.2, b: float = 0.75
) -> DataFrame:
    """All rows holding at least one of the terms, with their BM25 `score`.

    The length of a text is its number of characters. Term counts are taken row by row; the corpus
    statistics are one partial aggregation whose single row comes back as a scalar subquery. No row is
    exploded and nothing but that row is shuffled.
    """
    haystack = _haystack([text], None)
    names = [f"__tf{i}" for i in range(len(terms))]
    counts = {
        n: F.when(F.expr(_may_match(haystack, t)), F.regexp_count(F.expr(haystack), F.lit(word_pattern(t)))).otherwise(0)
        for n, t in zip(names, terms)
    }
    counted = df.withColumns(counts | {"__len": F.length(text)})
    stats = counted.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            F.avg("__len").alias("avg_len"),
            *[F.count_if(F.col(n) > 0).alias(f"df{n}") for n in names],
        ).alias("s")
    )
    parts = []
    for n in names:
        freq = F.col(n).cast("double")
        idf = F.log(1 + (F.col("__s.n") - F.col(f"__s.df{n}") + 0.5) / (F.col(f"__s.df{n}") + 0.5))
        norm = k1 * (1 - b + b * F.col("__len") / F.col("__s.avg_len"))
        parts.append(idf * freq * (k1 + 1) / (freq + norm))
    score = sum(parts[1:], parts[0])
    wanted = " OR ".join(_matches(haystack, t) for t in terms)
    hits = counted.filter(F.expr(wanted))
    return hits.withColumn("__s", stats.scalar()).withColumn("score", score).drop("__s", "__len", *names)


def search_ranked(
    df: DataFrame,
    terms: list[str],
    k: int | None = None,
    text: str = "message",
    tie_break: str = "id",
    digits: int = 9,
) -> DataFrame:
    """The `k` most relevant rows. Scores are rounded so that ties break the same way everywhere."""
    scored = relevance(df, terms, text).withColumn("score", F.round("score", digits))
    return scored.orderBy(F.col("score").desc(), tie_break).limit(result_limit(k))

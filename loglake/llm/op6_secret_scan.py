"""Secret scans with linking of credentials that are split into parts.

Strong patterns are reported wherever they match. Weak ones - something that looks like an access identifier, a secret
or an endpoint - are candidates only: each is reported if complementary parts, weak or strong, lie within the same
scope, 200 code points around it. Parts and candidates are met by an interval join on scope buckets of 256 code points,
so a candidate meets the few parts that fit there, whatever the length of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.llm.common import stored

SCOPE = 200
BUCKET = 256
CHUNK = 256

# The strong patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
STRONG = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
MIN_ASSIGNED = 12

WEAK = {
    "login": r"""(?i:user(?:name)?|login|client_?id|account(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""",
    "key": r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])",
    "endpoint": r"""(?i:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s"'<>|]+""",
}
KINDS = [*STRONG, *WEAK]
ROLES = {"assign": "secret", "access": "name", "hex": "secret", "login": "name", "key": "secret", "endpoint": "place"}
# A candidate needs one of these sets of roles around it.
NEEDS = {"login": "secret", "key": "name OR place", "endpoint": "name AND secret"}

SPAN = "array<struct<start: int, n: int, stop: int>>"


def spans(text: Column, pattern: str, accept) -> Column:
    """(start, kind number, stop) of the matches that ``accept`` takes, by position in code points.

    Matches and the text between them are bound to a variable, so that the pattern runs twice a text at most and not once a
    match, and spans are gathered ``CHUNK`` at a time, so that a text with very many of them is not copied over and over.
    """
    n = KINDS.index(next(k for k, p in (STRONG | WEAK).items() if p == pattern))
    none = F.array().cast(SPAN)

    def gathered(found: Column, gaps: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(gaps, i))
            stop = start + F.length(F.get(found, i))
            span = F.struct(start.alias("start"), F.lit(n).alias("n"), stop.alias("stop"))
            taken = F.when(accept(F.get(found, i)), F.array(span)).otherwise(none)
            return F.struct(stop.alias("at"), F.concat(acc["out"], taken).alias("out"))

        def chunk(acc: Column, c: Column) -> Column:
            places = F.sequence(c * CHUNK, F.least(c * CHUNK + CHUNK, F.size(found)) - 1)
            start = F.struct(acc["at"].alias("at"), none.alias("out"))
            return F.aggregate(
                places, start, step, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out"))
            )

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        chunks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int"))
        return F.flatten(F.aggregate(chunks, start, chunk)["out"])

    def bound(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def every(found: Column) -> Column:
        return F.when(F.size(found) > 0, bound(F.split(text, pattern, -1), lambda gaps: gathered(found, gaps))).otherwise(none)

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), every)


def _accept(kind: str):
    if kind == "assign":
        return lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= MIN_ASSIGNED
    if kind == "key":
        return lambda m: m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")
    return lambda m: F.lit(True)


def _listed(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    one = F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.get(names, s["n"]), s["start"], s["stop"]))
    return F.array_join(one, ",")


def _linked(scanned: DataFrame) -> DataFrame:
    """k1, k2, linked: the weak spans of a row that complementary parts surround."""
    roles = F.array(*(F.lit(ROLES[k]) for k in KINDS))
    parts = (
        scanned.select("k1", "k2", F.explode(F.concat("base", "weak")).alias("s"))
        .select("k1", "k2", "s.start", "s.n", "s.stop", F.get(roles, F.col("s.n")).alias("role"))
        .distinct()
    )
    first_weak = len(STRONG)
    reach = F.sequence(
        F.floor(F.greatest(F.col("start") - SCOPE, F.lit(0)) / BUCKET), F.floor((F.col("stop") + SCOPE) / BUCKET)
    )
    around = parts.select(
        "k1", "k2", F.col("start").alias("p_start"), F.col("stop").alias("p_stop"), "role", F.explode(reach).alias("bucket")
    )
    own = F.sequence(F.floor(F.col("start") / BUCKET), F.floor(F.col("stop") / BUCKET))
    candidates = parts.where(f"n >= {first_weak}").select("k1", "k2", "start", "n", "stop", F.explode(own).alias("bucket"))
    met = (
        candidates.join(around, ["k1", "k2", "bucket"])
        .where(f"p_start <= stop + {SCOPE} AND p_stop >= start - {SCOPE}")
        .groupBy("k1", "k2", "start", "n", "stop")
        .agg(*(F.bool_or(F.col("role") == r).alias(r) for r in ("name", "secret", "place")))
    )
    complete = " OR ".join(f"(n = {KINDS.index(k)} AND ({need}))" for k, need in NEEDS.items())
    return met.where(complete).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "n", "stop")).alias("linked"))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of ``docs`` (doc_id, text; others ignored).

    Spans are kind:start:end in code points, end exclusive, by start and then kind in the order of ``KINDS``;
    base_sha256 covers the strong kinds only. A null text is scanned as an empty one: no spans, the digest of the
    empty string. Each row is scanned on its own, whatever its doc_id, and equal rows give equal results.
    """
    text = F.coalesce("text", F.lit(""))
    base = F.concat(*(spans(text, p, _accept(k)) for k, p in STRONG.items()))
    weak = F.concat(*(spans(text, p, _accept(k)) for k, p in WEAK.items()))
    scanned = stored(
        docs.select(
            "doc_id", F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(text, "doc_id", F.lit(1)).alias("k2"),
            base.alias("base"), weak.alias("weak"),
        ),
        "scanned",
    )

    def count(kind: str) -> Column:
        n = KINDS.index(kind)
        return F.size(F.filter("base", lambda s: s["n"] == n)).cast("long").alias(f"n_{kind}")

    # Only rows that have a weak span wait for the answer.
    open_rows = scanned.where("size(weak) > 0")
    answered = open_rows.join(_linked(open_rows), ["k1", "k2"], "left").withColumn(
        "every", F.concat("base", F.coalesce("linked", F.array().cast(SPAN)))
    )
    closed = scanned.where("size(weak) = 0").withColumn("every", F.col("base"))
    columns = ["doc_id", "base", "every"]
    return closed.select(columns).unionByName(answered.select(columns)).select(
        "doc_id", *(count(k) for k in STRONG), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("every")).alias("spans"),
    )


def _either_case(pattern: str) -> str:
    """The pattern with its (?i:...) groups spelled out for A-Z and a-z; RE2 would fold other letters as well."""
    out, depth, at, in_class = [], 0, 0, False
    while at < len(pattern):
        if pattern.startswith("(?i:", at):
            out.append("(?:")
            depth, at = 1, at + 4
            continue
        c = pattern[at]
        if depth:
            depth += (c == "(") - (c == ")")
            in_class = c == "[" or (in_class and c != "]")
        plain = depth and c.isalpha() and not in_class
        out.append(f"[{c.lower()}{c.upper()}]" if plain else "a-zA-Z" if depth and pattern.startswith("a-z", at) else c)
        at += 3 if depth and in_class and pattern.startswith("a-z", at) else 1
    return "".join(out)


def _sql() -> str:
    """The same spans for DuckDB, whose patterns know no look-around: a key is a whole run of 40 characters."""
    patterns = STRONG | WEAK | {"key": "[A-Za-z0-9+/]+"}
    quoted = {k: _either_case(p).replace("'", "''") for k, p in patterns.items()}
    matches = " UNION ALL ".join(
        f"SELECT doc_id, row, {n} AS n, regexp_extract_all(text, '{quoted[k]}') AS f, string_split_regex(text, '{quoted[k]}') AS g FROM d"
        for n, k in enumerate(KINDS)
    )
    role = " ".join(f"WHEN {n} THEN '{ROLES[k]}'" for n, k in enumerate(KINDS))
    kind = " ".join(f"WHEN {n} THEN '{k}'" for n, k in enumerate(KINDS))
    needs = " OR ".join(f"(n = {KINDS.index(k)} AND ({need}))" for k, need in NEEDS.items())
    listed = "string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, n, stop)"
    return f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents),
    m AS ({matches}),
    p AS (SELECT row, n, f, g, unnest(list_filter(range(1, len(f) + 1), lambda j: n <> {KINDS.index("key")} OR length(f[j]) = 40)) AS i FROM m),
    q AS (SELECT row, n, f[i] AS x, list_sum(list_transform(g[1:i], lambda y: length(y)))
        + coalesce(list_sum(list_transform(f[1:i - 1], lambda y: length(y))), 0) AS start FROM p),
    s AS (SELECT row, n, start::BIGINT AS start, (start + length(x))::BIGINT AS stop, CASE n {role} END AS role, CASE n {kind} END AS kind FROM q
      WHERE CASE n WHEN 0 THEN length(regexp_extract(x, '{quoted["assign"]}', 2)) >= {MIN_ASSIGNED}
        WHEN {KINDS.index("key")} THEN length(x) = 40 AND regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[a-z]') AND regexp_matches(x, '[0-9]')
        ELSE true END),
    near AS (SELECT c.row, c.n, c.kind, c.start, c.stop, bool_or(p.role = 'name') AS name, bool_or(p.role = 'secret') AS secret, bool_or(p.role = 'place') AS place
      FROM s c JOIN s p ON p.row = c.row AND p.start <= c.stop + {SCOPE} AND p.stop >= c.start - {SCOPE} WHERE c.n >= {len(STRONG)} GROUP BY ALL),
    every AS (SELECT row, n, kind, start, stop FROM s WHERE n < {len(STRONG)} UNION ALL SELECT row, n, kind, start, stop FROM near WHERE {needs}),
    t AS (SELECT row, count(*) FILTER (n = 0) AS a, count(*) FILTER (n = 1) AS b, count(*) FILTER (n = 2) AS c,
      {listed} FILTER (n < {len(STRONG)}) AS base, {listed} AS spans FROM every GROUP BY row)
    SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN t USING (row)"""


OP6_SQL = _sql()

"""Users' SQL: one read-only query over given frames, and nothing else.

The text is parsed by Spark and the parsed tree is walked before anything is analysed: every plan node, relation, function
and special name must be of an allowed kind. What is not listed is refused, so a new kind of node is refused as well.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


MAX_DEPTH = 200


class UnsafeSql(ValueError):
    pass


# Spark's plan nodes that a query over tables is made of.
PLAN_NODES = set(
    """Aggregate Distinct Except Filter GlobalLimit Intersect Join LateralJoin LocalLimit Offset OneRowRelation Pivot Project
    Sort SubqueryAlias Union UnresolvedHaving UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases
    UnresolvedWith Unpivot WithWindowDefinition Generate Sample LocalRelation UnresolvedHint""".split()
)
# Spark's own groups of functions whose members see nothing but their arguments. Reflection, the session, its
# user, files and errors are in `misc_funcs`, of which a few are harmless.
FUNCTION_GROUPS = set(
    """agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs datetime_funcs
    generator_funcs hash_funcs json_funcs lambda_funcs map_funcs math_funcs predicate_funcs string_funcs struct_funcs url_funcs
    variant_funcs window_funcs""".split()
)
HARMLESS = {"typeof", "equal_null", "bitmap_bit_position", "bitmap_bucket_number", "bitmap_count"}
# Names that Spark resolves to something outside the tables where no column has them.
SPECIAL_NAMES = {"current_user", "session_user", "user", "current_catalog", "current_database", "current_schema", "_metadata"}


def _sequence(items) -> list:
    return [items.apply(i) for i in range(items.size())]


class _Tree:
    """The plans and expressions of a parsed query, those of WITH and of subqueries too."""

    def __init__(self, spark: SparkSession):
        named = spark._jvm.java.lang.Class.forName
        package = "org.apache.spark.sql.catalyst"
        self.plan = named(f"{package}.plans.logical.LogicalPlan")
        self.expression = named(f"{package}.expressions.Expression")
        self.subquery = named(f"{package}.expressions.PlanExpression")

    def nodes(self, node, depth: int = 0) -> Iterator[tuple[str, bool, object]]:
        """(class name, whether a plan, node) of ``node`` and all below it."""
        if depth > MAX_DEPTH:
            raise UnsafeSql("nested too deeply")
        is_plan = self.plan.isInstance(node)
        if not is_plan and not self.expression.isInstance(node):
            return
        yield node.getClass().getSimpleName(), is_plan, node
        parts = _sequence(node.children()) + _sequence(node.innerChildren())
        if is_plan:
            parts += _sequence(node.expressions())
        elif self.subquery.isInstance(node):
            parts.append(node.plan())
        for part in parts:
            yield from self.nodes(part, depth + 1)


def _function_group(spark: SparkSession, name: str) -> str | None:
    """The group Spark's registry has the function in; None for unknown and for users' own ones."""
    session = spark._jsparkSession.sessionState()
    identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)
    for registry in (session.functionRegistry(), session.tableFunctionRegistry()):
        found = registry.lookupFunction(identifier)
        if found.isDefined() and found.get().getSource() == "built-in":
            return found.get().getGroup()
    return None


def check_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> None:
    """Raise unless the text is one query over ``tables`` and the query's own WITH names, by allowed functions only.

    Commands, scripts, paths, other views and tables, table functions, names made up at run time, reflection, and what shows
    the session, its user or file names are refused.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parseQuery(sql)
    except Exception as failure:
        raise UnsafeSql("not a query") from failure
    nodes = list(_Tree(spark).nodes(plan))
    own = {c._1().lower() for kind, _, node in nodes if kind == "UnresolvedWith" for c in _sequence(node.cteRelations())}
    known = {t.lower() for t in tables} | own
    columns = {c.lower() for t in tables.values() for c in t.columns}
    for kind, is_plan, node in nodes:
        if is_plan:
            if kind not in PLAN_NODES:
                raise UnsafeSql(f"not allowed in a query: {kind}")
            if kind == "UnresolvedRelation":
                name = _sequence(node.multipartIdentifier())
                if len(name) > 1 or name[0].lower() not in known:
                    raise UnsafeSql(f"not a given table: {'.'.join(name)}")
        elif kind in ("UnresolvedFunction", "UnresolvedGenerator"):
            name = _sequence(node.nameParts()) if kind == "UnresolvedFunction" else [node.name().funcName()]
            group = _function_group(spark, name[0].lower()) if len(name) == 1 else None
            if group not in FUNCTION_GROUPS and name[0].lower() not in HARMLESS:
                raise UnsafeSql(f"not an allowed function: {'.'.join(name)}")
        elif kind == "UnresolvedAttribute":
            outside = {p.lower() for p in _sequence(node.nameParts())} & SPECIAL_NAMES - columns
            if outside:
                raise UnsafeSql(f"not a column: {', '.join(sorted(outside))}")
        elif kind.startswith("Current") and kind not in ("CurrentDate", "CurrentTimestamp", "CurrentTime", "CurrentRow$"):
            raise UnsafeSql(f"not allowed in a query: {kind}")
        elif "Identifier" in kind or "Parameter" in kind and kind not in ("NamedParameter", "PosParameter"):
            raise UnsafeSql(f"not allowed in a query: {kind}")


def run_query(spark: SparkSession, sql: str, tables: dict[str, DataFrame], args: dict | None = None) -> DataFrame:
    """The result of a user's query over ``tables`` by their names; placeholders (``:name``) are bound as values.

    The frames are put under names of this call only, which live until the query is analysed: calls at the same time do not
    see each other's rows, and nothing is left behind.
    """
    sql = sql.strip().rstrip(";")
    check_sql(spark, sql, tables)
    names = {name: f"given_{uuid.uuid4().hex}" for name in tables}
    given = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in names.items())
    try:
        for name, view in names.items():
            tables[name].createOrReplaceTempView(view)
        return spark.sql(f"WITH {given} (\n{sql}\n)" if names else sql, args=args or {})
    finally:
        for view in names.values():
            spark.catalog.dropTempView(view)

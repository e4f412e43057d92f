"""What a query or a condition may hold, judged on the tree that Spark's parser makes of it, before anything is resolved or read."""

from __future__ import annotations

from collections.abc import Iterator

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.errors import ParseException
from pyspark.sql import SparkSession

# Parts of a plan that read and compute, and built-in functions that reach beyond the rows.
PLAN_PARTS = frozenset({
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Deduplicate", "Join", "LateralJoin", "Union", "Except", "Intersect", "SubqueryAlias", "OneRowRelation",
    "Generate", "Pivot", "Unpivot", "UnresolvedPivot", "Window", "WithWindowDefinition", "UnresolvedWith", "UnresolvedHaving", "UnresolvedRelation", "UnresolvedInlineTable", "UnresolvedSubqueryColumnAliases",
})
REACHING = frozenset({"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "current_database", "current_schema", "current_catalog", "current_user", "session_user", "user", "version"})


class UnsafeQueryError(ValueError):
    """Not a single read-only query."""


def _all(seq: JavaObject) -> Iterator[JavaObject]:
    for i in range(seq.size()):
        yield seq.apply(i)


def _nodes(spark: SparkSession, tree: JavaObject) -> Iterator[tuple[JavaObject, str, bool]]:
    """Every node of a plan or an expression, its class, and whether it is a plan; subqueries and named queries included."""
    plans = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")
    left = [tree]
    while left:
        node = left.pop()
        is_plan = plans.isInstance(node)
        yield node, node.getClass().getSimpleName(), is_plan
        left += [*_all(node.children()), *_all(node.innerChildren()), *(_all(node.expressions()) if is_plan else ())]


def _system_functions(spark: SparkSession) -> frozenset:
    return frozenset(r[0].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect())


def _parsed(spark: SparkSession, text: str, whole: bool) -> JavaObject:
    parser = spark._jsparkSession.sessionState().sqlParser()
    try:
        return parser.parsePlan(text) if whole else parser.parseExpression(text)
    except (Py4JJavaError, ParseException) as e:
        raise UnsafeQueryError(f"no valid SQL: {str(e).splitlines()[0]}") from None


def check_tree(spark: SparkSession, text: str, views: tuple[str, ...], whole: bool = True) -> None:
    """Raise UnsafeQueryError unless the query (or, with whole=False, the expression) reads the named views and its own named queries alone and calls
    built-in functions that compute from their arguments."""
    tree = _parsed(spark, text, whole)
    nodes = list(_nodes(spark, tree))
    own = {cte.productElement(0).lower() for node, kind, _ in nodes if kind == "UnresolvedWith" for cte in _all(node.cteRelations())}
    known = _system_functions(spark)
    for node, kind, is_plan in nodes:
        if kind == "UnresolvedRelation":
            name = [str(p) for p in _all(node.multipartIdentifier())]
            if len(name) != 1 or name[0].lower() not in own | {v.lower() for v in views}:
                raise UnsafeQueryError(f"{'.'.join(name)} can't be read here")
        elif kind == "UnresolvedFunction":
            name = [str(p) for p in _all(node.nameParts())]
            if len(name) != 1 or name[0].lower() in REACHING or name[0].lower() not in known:
                raise UnsafeQueryError(f"{'.'.join(name)}() is not allowed")
        elif is_plan and kind not in PLAN_PARTS:
            raise UnsafeQueryError(f"{kind} is not allowed")

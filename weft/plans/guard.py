"""Ad-hoc SQL over the graph's views, read-only: the text is parsed, not searched for words."""

from __future__ import annotations

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession

from weft.operators.graph import Graph

VIEWS = ("file", "class", "method", "calls", "imports", "endpoint", "route_call", "routes_to")
_PLANS, _EXPRESSIONS = "org.apache.spark.sql.catalyst.plans.logical.", "org.apache.spark.sql.catalyst.expressions."
#: Parsed forms that change something or run outside a query.
_CHANGES = (_PLANS + "Command", _PLANS + "ParsedStatement")
#: Built-in functions that call code by name or tell about the machine's files.
_BARRED = frozenset(("reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "current_catalog", "current_database", "current_schema", "current_user", "session_user", "user", "version"))


class NotReadOnly(ValueError):
    """The statement is no query over the graph's views."""


def _all(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def check_read_only(spark: SparkSession, sql: str, views: tuple[str, ...] = VIEWS) -> None:
    """Raises unless sql is a query that reads views, and its own common tables, with functions that Spark has and that are not barred.

    Plans, the common tables of WITH, expressions and the subqueries in them are all walked.
    """
    gateway = spark.sparkContext._gateway
    is_a = lambda x, name: is_instance_of(gateway, x, name)
    functions = {r.function for r in spark.sql("show system functions").collect()}
    todo, named, relations = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)], set(), []
    while todo:
        node = todo.pop()
        if any(is_a(node, c) for c in _CHANGES):
            raise NotReadOnly("only queries may run here; use the store for changes")
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            relations.append([str(p).lower() for p in _all(node.multipartIdentifier())])
        elif kind in ("UnresolvedTableValuedFunction", "UnresolvedTableFunction", "UnresolvedFunction"):
            name = [str(p).lower() for p in _all(node.name() if kind == "UnresolvedTableValuedFunction" else node.nameParts())]
            if name[-1] in _BARRED or len(name) > 1 or name[0] not in functions:
                raise NotReadOnly(f"{'.'.join(name)}() may not be called here")
        elif kind == "UnresolvedWith":
            for pair in _all(node.cteRelations()):
                named.add(str(pair._1()).lower())
                todo.append(pair._2())
        if is_a(node, _PLANS + "LogicalPlan"):
            todo += _all(node.expressions())
        elif is_a(node, _EXPRESSIONS + "PlanExpression"):
            todo.append(node.plan())
        todo += _all(node.children())
    for r in relations:
        if len(r) > 1 or r[0] not in {*views, *named}:
            raise NotReadOnly(f"{'.'.join(r)} is no view of the graph; there are {', '.join(views)}")


def query(spark: SparkSession, g: Graph, sql: str, most: int = 100) -> DataFrame:
    """The first rows of a query over file, class, method, calls, imports, endpoint, route_call and routes_to."""
    check_read_only(spark, sql)
    for name in VIEWS:
        getattr(g, "class_" if name == "class" else name).createOrReplaceTempView(name)
    return spark.sql(sql).limit(most)

"""SELECT statements of users over one relation `t`, checked on the parsed plan before they run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Words that may not occur.
FORBIDDEN = ("attach", "install", "load", "pragma", "copy", "insert", "update", "delete", "create", "drop", "alter", "grant", "revoke", "call", "execute")
_FORBIDDEN = re.compile(r"\b(" + "|".join(FORBIDDEN) + r")\b", re.IGNORECASE)
#: Functions that reach beyond the data.
UNSAFE_FUNCTIONS = frozenset({"reflect", "java_method", "try_reflect", "input_file_name", "read_files", "version", "current_user", "user", "session_user"})


class Refused(ValueError):
    """The statement may not run; the text says why."""


def _seq(x) -> list:
    return [x.apply(i) for i in range(x.size())]


def _walk(plan, allowed: frozenset[str]) -> None:
    kind = plan.getClass().getSimpleName()
    ctes = set(allowed)
    if kind == "UnresolvedWith":
        for pair in _seq(plan.cteRelations()):
            ctes.add(pair._1().lower())
            _walk(pair._2().child(), frozenset(ctes))
    elif kind in ("UnresolvedRelation", "RelationTimeTravel"):
        name = [str(p).lower() for p in _seq(plan.multipartIdentifier())] if kind == "UnresolvedRelation" else []
        if len(name) != 1 or name[0] not in allowed:
            raise Refused(f"Only the relation t may be read, not {'.'.join(name) or kind}")
    elif kind == "UnresolvedTableValuedFunction" or "TableValued" in kind:
        raise Refused("Table functions are not allowed")
    elif kind.endswith(("Command", "Statement")) or kind.startswith(("Insert", "Create", "Drop", "Set", "Cache", "Refresh", "Describe", "Show")):
        raise Refused("Only SELECT queries are allowed")
    for e in _seq(plan.expressions().toSeq() if hasattr(plan.expressions(), "toSeq") else plan.expressions()):
        _walk_expression(e, frozenset(ctes))
    for c in _seq(plan.children()):
        _walk(c, frozenset(ctes))


def _walk_expression(e, allowed: frozenset[str]) -> None:
    kind = e.getClass().getSimpleName()
    if kind == "UnresolvedFunction":
        name = [str(p).lower() for p in _seq(e.nameParts())]
        if len(name) > 1 or name[0] in UNSAFE_FUNCTIONS:
            raise Refused(f"Function {'.'.join(name)} is not allowed")
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "InSubquery", "LateralSubquery"):
        inner = e.query() if kind == "InSubquery" else e
        _walk(inner.plan(), allowed)
    for c in _seq(e.children()):
        _walk_expression(c, allowed)


def check(spark: SparkSession, sql: str) -> None:
    """Raise Refused unless sql is one SELECT over t and its own CTEs."""
    if not re.match(r"\s*select\b", sql or "", re.IGNORECASE):
        raise Refused("Only SELECT queries are allowed")
    if m := _FORBIDDEN.search(sql):
        raise Refused(f"Forbidden keyword: {m[1].lower()}")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise Refused(f"Syntax error: {str(e).strip().splitlines()[0][:200]}") from None
    _walk(plan, frozenset({"t"}))


def run_select(df: DataFrame, sql: str) -> DataFrame:
    """The statement over df as `t`, in a session of its own, so no other relation can be seen."""
    spark = df.sparkSession
    check(spark, sql)
    alone = spark.newSession()
    plan = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(alone._jsparkSession, df._jdf.logicalPlan())
    DataFrame(plan, alone).createOrReplaceTempView("t")
    return alone.sql(sql)

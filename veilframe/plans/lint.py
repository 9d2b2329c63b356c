"""Checks of a DataFrame's analysed plan for two misuses of stored columns.

P001: a projection returns an encrypted column as it is, which is ciphertext.
P002: an encrypted column is compared with = or <>, which never means the
plaintext, since nonces are random. A third number is reserved.

Columns are recognised by the metadata that EntitySpec.stored_schema puts on
them, which Spark keeps through projections, renames and Parquet.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from veilframe.plans.spec import METADATA

DIRECT_PROJECTION, EQUALITY, RESERVED = "P001", "P002", "P003"
MESSAGES = {
    DIRECT_PROJECTION: "the projection returns ciphertext; decrypt first",
    EQUALITY: "equality on an encrypted column never holds; search by the blind index",
}


@dataclass(frozen=True, order=True)
class Finding:
    """One misuse."""

    rule: str
    column: str

    @property
    def message(self) -> str:
        return MESSAGES[self.rule]


def _seq(items) -> list:
    return [items.apply(i) for i in range(items.size())]


def _is_marked(expression) -> bool:
    return expression.getClass().getSimpleName() == "AttributeReference" and expression.metadata().contains(METADATA)


def _comparisons(expression, out: set[Finding]) -> None:
    kind = expression.getClass().getSimpleName()
    children = _seq(expression.children())
    if kind in ("EqualTo", "EqualNullSafe"):
        out.update(Finding(EQUALITY, c.name()) for c in children if _is_marked(c))
    for c in children:
        _comparisons(c, out)


def _walk(plan, out: set[Finding]) -> None:
    kind = plan.getClass().getSimpleName()
    children = _seq(plan.children())
    if kind == "Project":
        below = {str(a.exprId().id()) for c in children for a in _seq(c.output())}
        kept = _seq(plan.projectList())
        if len(kept) < len(below) or any(e.getClass().getSimpleName() != "AttributeReference" for e in kept):  # a choice of columns, not all of them
            for e in kept:
                inner = e.child() if e.getClass().getSimpleName() == "Alias" else e
                if _is_marked(inner):
                    out.add(Finding(DIRECT_PROJECTION, inner.name()))
    for e in _seq(plan.expressions()):
        _comparisons(e, out)
    for c in children:
        _walk(c, out)


def lint(df: DataFrame) -> list[Finding]:
    """The misuses in a DataFrame's analysed plan, in order."""
    out: set[Finding] = set()
    _walk(df._jdf.queryExecution().analyzed(), out)
    return sorted(out)


def lint_frame(spark: SparkSession, df: DataFrame) -> DataFrame:
    return spark.createDataFrame([(f.rule, f.column, f.message) for f in lint(df)], "rule string, column string, message string")

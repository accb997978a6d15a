"""Recurrences filled down: a row's cell refers to the row above in the same table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.functions.core import num
from quillgrid.functions.scalar_finance import PMT


def geometric(start: Column, factor: Column, by: list[str], order: list[Column]) -> Column:
    """x[k] = factor[k] x[k-1] with x[0] = start and positive factors: a running product in one window."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return start * F.exp(F.sum(F.ln(factor)).over(w))


def amortization(loans: DataFrame, rate: str = "rate", nper: str = "nper", pv: str = "pv") -> DataFrame:
    """Schedule of level-payment loans: (loan columns, month, begin, payment, interest, principal, end).

    A loan's months are an array folded in the JVM and exploded, so loans spread over tasks and no window is needed.
    """
    r, payment = num(F.col(rate)), -PMT(F.col(rate), F.col(nper), F.col(pv))
    row = lambda k, begin, p: F.struct(k.cast("int").alias("month"), begin.alias("begin"), p.alias("payment"), (begin * r).alias("interest"), (p - begin * r).alias("principal"), (begin - (p - begin * r)).alias("end"))
    with_payment = loans.withColumn("__p", payment)
    p = F.col("__p")
    first = F.array(row(F.lit(1), num(F.col(pv)), p))
    months = F.aggregate(F.sequence(F.lit(2), F.greatest(F.col(nper).cast("int"), F.lit(2))), first, lambda rows, k: F.when(k <= F.col(nper), F.concat(rows, F.array(row(k, F.element_at(rows, -1)["end"], p)))).otherwise(rows))
    return with_payment.select(*loans.columns, F.explode(months).alias("m")).select(*loans.columns, "m.*")

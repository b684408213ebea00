"""op2: mixing to target weights."""

from corpusgraph.llm import mixing
from corpusgraph.llm.queries import query, table


@query("op2_soft_mixing")
def op2(spark, folder):
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "labels"))

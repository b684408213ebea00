"""op3: benchmark decontamination."""

from corpusgraph.llm import decontaminate
from corpusgraph.llm.queries import query, table


@query("op3_decontaminate")
def op3(spark, folder):
    return decontaminate.contaminations(table(spark, folder, "documents"), table(spark, folder, "benchmark"))

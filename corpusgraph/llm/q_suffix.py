"""op7: repeated passages."""

from corpusgraph.llm import suffix
from corpusgraph.llm.queries import query, table


@query("op7_suffix_dedup")
def op7(spark, folder):
    return suffix.report(table(spark, folder, "documents"))

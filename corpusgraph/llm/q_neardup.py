"""op6: near-duplicate classes."""

from corpusgraph.llm import neardup
from corpusgraph.llm.queries import query, table


@query("op6_minhash_neardup")
def op6(spark, folder):
    return neardup.classes(table(spark, folder, "documents"))

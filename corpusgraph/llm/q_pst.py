"""op10: language-model scores."""

from corpusgraph.llm import pst
from corpusgraph.llm.queries import query, table


@query("op10_pst_scores")
def op10(spark, folder):
    return pst.score(table(spark, folder, "documents"))

"""op4: language identification."""

from corpusgraph.llm import language
from corpusgraph.llm.queries import query, table


@query("op4_language_id")
def op4(spark, folder):
    docs = table(spark, folder, "documents")
    filters = language.fit(docs.filter(~language.held_out()))
    found = language.predict(docs, filters)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")

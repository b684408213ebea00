"""op8: license scan."""

from corpusgraph.llm import licenses
from corpusgraph.llm.queries import query, table


@query("op8_license_scan")
def op8(spark, folder):
    return licenses.scan(table(spark, folder, "documents"))

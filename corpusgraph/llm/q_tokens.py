"""op1: token counts."""

import public_tokenizers
from pyspark.sql import functions as F

from corpusgraph.llm import tokens
from corpusgraph.llm.queries import query, table

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048


@query("op1_token_counts")
def op1(spark, folder):
    counted = tokens.count_tokens(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)

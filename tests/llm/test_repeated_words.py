"""Items that repeat their words."""

from codeloom.llm import decontaminate
from test_pipeline_rows import text


def test_item_of_one_repeated_word(spark):
    """Each item is one distinct shingle; each document holds it once, in other text."""
    items = spark.createDataFrame([(k, " ".join([f"ab{k}"] * 100)) for k in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join([text(k, 300), *[f"ab{k}"] * 5, text(k + 100, 300)])) for k in range(40)], "doc_id long, text string")
    found = decontaminate.contaminated(docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.item_shingles) for r in found) == [(k, k, 1) for k in range(40)]

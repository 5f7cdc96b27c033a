"""Chunkers as SQL table functions."""

import pytest

from docloom.functions.udtfs import register_table_functions


def test_fixed_tokens_and_lines_in_sql(spark):
    register_table_functions(spark)
    spark.createDataFrame([(1, "a b  c\td e"), (2, None), (3, " "), (4, "x\n\ny z")], "doc_id long, text string").createOrReplaceTempView("some_docs")
    got = spark.sql("select doc_id, c.* from some_docs, lateral fixed_tokens(text, 3, 1) c order by doc_id, chunk_id").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 3, "a b c"), (1, 1, 2, 5, "c d e"), (4, 0, 0, 3, "x y z")]
    lines = spark.sql("select doc_id, c.* from some_docs, lateral word_lines(text) c where doc_id = 4 order by chunk_id").collect()
    assert [tuple(r) for r in lines] == [(4, 0, 0, 1, "x"), (4, 1, 1, 3, "y z")]
    with pytest.raises(Exception, match="overlap"):
        spark.sql("select * from some_docs, lateral fixed_tokens(text, 3, 3)").collect()
    assert register_table_functions(spark, "my_") == ["my_fixed_tokens", "my_word_lines"]

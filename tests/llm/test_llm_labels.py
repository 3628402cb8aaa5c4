"""Labels of the quality classifier that repeat or contradict each other."""

from tidemark.llm import classifier


def test_contradicting_labels_are_left_out_and_order_does_not_matter(spark):
    docs = spark.createDataFrame([(i, ("good plain words here " if i % 2 else "BUY NOW $$$ ") * 5 + str(i)) for i in range(60)], "doc_id long, text string")
    rows = [(i, i % 2) for i in range(60)]
    both = [(i, 1 - i % 2) for i in range(0, 60, 7)]
    left = [r for r in rows if r[0] % 7]
    schema = "doc_id long, quality int"
    fits = [classifier.fit(docs, spark.createDataFrame(x, schema)) for x in (left, rows + both, [*both, *rows[::-1], *rows])]
    texts = ["good plain words", "BUY NOW", ""]
    assert len({tuple(m.score(texts).tolist()) for m in fits}) == 1

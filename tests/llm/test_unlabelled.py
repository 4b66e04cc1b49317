"""The language stage where there is nothing to learn from."""

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_documents_with_a_letter_stay_without_labels(spark):
    texts = ["the cat sat", "12 ...", "", None, "\u65e5\u672c\u8a9e", "x"]
    for lang in (None, "en"):
        rows = [(i, t, None, "s", 1) for i, t in enumerate(texts)] + [(9, "123", lang, "s", 3)]
        out = P.known_language(spark, spark.createDataFrame(rows, SCHEMA), "")
        assert out.columns == P.COLUMNS and sorted(r.doc_id for r in out.collect()) == [0, 4, 5]

"""The pipeline's language stage where no row has a lang."""

import corpus_pipeline

from .test_pipeline import frame


def test_without_labels_only_texts_without_letters_go(spark):
    texts = ["the house and the garden", "été", "Ж", None, "", " \n", "123 !?", "1\na"]
    found = corpus_pipeline.identify_language(spark, frame(spark, [(i, t, None, "a") for i, t in enumerate(texts)]), "")
    assert found.columns == list(corpus_pipeline.COLUMNS)
    assert sorted((r.doc_id, r.text, r.lang) for r in found.collect()) == [(i, texts[i], None) for i in (0, 1, 2, 7)]

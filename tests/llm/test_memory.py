"""What the operators hold on the driver."""

import tracemalloc

import numpy as np

from nearfield.llm import langid


def test_a_language_model_is_built_in_little_memory(spark):
    rows = [(k, text * 20, lang) for k in range(4) for lang, text in (("en", "the owl and the hen "), ("de", "der Uhu und die Henne "))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langid.fit(docs)  # imports
    tracemalloc.start()
    model = langid.fit(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.languages == ["de", "en"] and peak < 2 * model.costs.nbytes
    counts = np.zeros((langid.CODES,) * 4)
    counts[0, 4, 5, 6] = 3
    counts[9, 4, 5, 7] = 1
    assert np.allclose(langid.distribution(counts).sum(-1), 1)

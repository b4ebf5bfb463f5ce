"""N-gram counts and sizes come from all documents."""
import collections

import numpy as np

from vigil.llm import ngram_jaccard as J


def test_every_document_is_counted(spark):
    texts = [f"the same five words here w{i} x{i}" for i in range(23)] + [f"a{i} b{i} c{i} d{i} e{i % 20} f{i}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [J.element_hashes(t) for t in texts]
    exact = collections.Counter(int(k) for e in sets for k in J.count_keys(e))
    frequent, histogram, lengths = J.ngram_counts(docs, J.N)
    often = {k: c for k, c in exact.items() if c >= J.FREQUENT_AT}
    assert often and sorted(frequent.tolist()) == sorted(often)
    assert [often[k] for k in frequent.tolist()] == sorted(often.values())
    assert histogram == collections.Counter(len(e) for e in sets)
    assert set(lengths.values()) == {sum(c * c for c in often.values()) / sum(often.values())}


def test_order_is_one_for_all_sets():
    """N-grams of one count key stand in the order of their hashes, whatever set they are in."""
    shared = (np.uint64(7) << np.uint64(40)) + np.arange(40, dtype=np.uint64)
    order = J.Order(np.unique(J.count_keys(shared)))
    other = np.arange(100, 110, dtype=np.uint64) << np.uint64(50)
    whole = order.prefix(np.sort(np.concatenate([shared, other])), 50).tolist()
    assert whole == [*other.tolist(), *shared.tolist()]
    some = order.prefix(np.sort(np.concatenate([shared[::3], other[::2]])), 50).tolist()
    assert some == sorted(some, key=whole.index)

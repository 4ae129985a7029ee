"""mentionkit: pronoun-resolution analytics as Spark DataFrame / SQL / ML jobs.

Long-form tables are canonical:

* ``mentions(id, doc_id, text, pronoun, pronoun_offset, a, a_offset, a_coref,
  b, b_offset, b_coref)`` -- one row per labelled mention;
* ``words(doc_id, wi, sent, idx, o, lo, nb, pb, word, lemma, upos, xpos,
  governor, deprel)`` -- one row per annotated word of a passage;
* ``targets(id, doc_id, role, off, target, target_len, wi, n_words)`` -- the
  pronoun, A and B of each mention aligned to a word;
* ``features(id, role, family, feature, cnt)`` -- sparse feature counts;
* ``predictions(id, p_a, p_b, p_neither)``.
"""

__all__ = ["schema", "session"]

# Functions of this package that run inside Python workers (plug-in wrappers,
# the stand-in models) are shipped by value, so executors need no installed copy.
try:
    import sys as _sys

    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

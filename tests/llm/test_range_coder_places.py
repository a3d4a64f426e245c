"""The coder's places are what numpy indexes by, so that no step converts them."""

import numpy as np

from folioframe.llm.range_coder import Counts, _Coder, _Model, decode_ids, encode_ids


def test_places_are_of_the_index_type_and_learned_values_stay_small():
    model = _Model(4, Counts(np.array([5, 3, 1])))
    model.step(_Coder(4, 64), np.array([0, 1, 2, 0], np.int32))
    assert {a.dtype for a in (model.at, model.base, model.by8, model.by64)} == {np.dtype(np.intp)}
    assert {a.dtype for a in (model.cells, model.own, model.both, model.weight)} == {np.dtype(np.int32)}


def test_round_trip():
    ids = (np.arange(5000) ** 2 % 613).astype(np.uint32)
    assert (decode_ids(encode_ids(ids)) == ids).all()

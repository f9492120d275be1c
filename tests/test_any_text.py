"""No text makes a per-row helper of the core fail."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from tracefold.operators import segment, shred
from tracefold.sources import replies

JSON = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.floats(), st.text(max_size=5)), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.sampled_from(["message", "items", "a", ""]), x, max_size=3)), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(JSON)
def test_nodes_are_a_tree(value):
    rows = shred.nodes_of(json.dumps(value))
    assert [r[0] for r in rows] == list(range(len(rows)))
    for node, parent, label, ordinal, kind, scalar in rows:
        assert (parent is None) == (node == 0) and (parent is None or parent < node)
        assert (scalar is not None) == (kind == "scalar")
        if ordinal is not None:  # an element has its list's label
            assert rows[parent][4] == "array" and label == rows[parent][2]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="[]1234.) ab-\n", max_size=60))
def test_entries_keep_their_words(text):
    style, found = segment.split_entries(text)
    assert style in ("bracketed", "numbered", "blank-line") and all(found)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='{}"status:a,[] 1\\', max_size=60))
def test_replies(text):
    got = replies._status_object(text)
    assert got is None or isinstance(json.loads(got), dict)

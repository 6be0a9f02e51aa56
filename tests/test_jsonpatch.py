import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltwork.functions.jsonpatch import apply, apply_composed, compose, dump_composed, reduce_patches, reduce_stretches, load_composed, patch, to_json

values = st.recursive(
    st.none() | st.booleans() | st.integers(-5, 5) | st.text("ab", max_size=2),
    lambda inner: st.dictionaries(st.sampled_from("abc"), inner, max_size=3) | st.lists(inner, max_size=2),
    max_leaves=8,
)
objects = st.dictionaries(st.sampled_from("abc"), values, max_size=3)


def published_rule(target, change):
    if not isinstance(change, dict):
        return change
    target = dict(target) if isinstance(target, dict) else {}
    for k, v in change.items():
        if v is None:
            target.pop(k, None)
        else:
            target[k] = published_rule(target.get(k), v)
    return target


@given(objects, objects)
def test_object_targets_follow_the_published_rule(t, s):
    assert patch(t, s) == published_rule(t, s)


@given(values, values)
def test_strict_follows_it_for_all_targets(t, s):
    assert patch(t, s, strict=True) == published_rule(t, s)


keyed = st.dictionaries(st.sampled_from(["a", "b", "\x00", "\x00a"]), values, max_size=3)


@given(keyed, st.lists(values | keyed, min_size=1, max_size=4))
def test_composed_patches_do_what_all_do(t, patches):
    want, change = t, None
    for k, p in enumerate(patches):
        want, change = patch(want, p), p if k == 0 else compose(change, p)
    assert apply_composed(t, load_composed(dump_composed(change))) == want


@settings(max_examples=300)
@given(st.lists(values | keyed, min_size=1, max_size=7), st.lists(st.integers(1, 3), min_size=7, max_size=7))
def test_any_cut_of_a_fold_gives_the_same(patches, cuts):
    parts, rest = [], list(patches)
    for n in cuts:
        now, rest = rest[:n], rest[n:]
        if not now:
            break
        applied = composed = now[0]
        for p in now[1:]:
            applied, composed = patch(applied, p), compose(composed, p)
        parts.append((json.dumps(applied), dump_composed(composed)))
    assert json.loads(reduce_stretches(parts)) == json.loads(reduce_patches([json.dumps(p) for p in patches]))


def test_single_patch_stays_verbatim():
    assert reduce_patches(['{ "k" : null }']) == '{ "k" : null }'
    assert reduce_patches([]) is None


def test_delete_within_a_batch_leaves_the_target():
    assert json.loads(apply('{"k":"kept"}', reduce_patches(['{"k":"x"}', '{"k":null}']))) == {"k": "kept"}
    assert json.loads(apply('{"k":"gone","l":1}', reduce_patches(['{"k":null}']))) == {"l": 1}


def test_nulls_and_errors():
    assert apply(None, None) is None and apply("1", None) == "1" and apply(None, "2") == "2"
    for bad in ("{", "NaN", ""):
        with pytest.raises(ValueError):
            reduce_patches([bad, "{}"])


def test_helper_sorts_keys():
    assert to_json({"b": 1, "a": "ü"}) == '{"a":"ü","b":1}' and to_json("x") == "x" and to_json(b"y") == "y"

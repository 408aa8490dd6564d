import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlog.jmes.evaluate import evaluate, text
from strandlog.jmes.lower import is_jmes, native, rendered
from strandlog.jmes.parse import JmesError, parse

DOC = {"a": {"b": [{"c": 1, "s": "x"}, {"c": 3, "s": "y"}, {"c": 2}]}, "l": [[1, 2], [3]], "o": {"p": {"q": 1}, "r": {"q": 2}}, "n": None, "e": [], "t": "text", "f": 2.5}
CASES = {
    "a.b[0].c": 1, "a.b[-1].c": 2, "a.b[9]": None, "a.b[*].c": [1, 3, 2], "a.b[?c>`1`].c": [3, 2], "a.b[?s=='x'] | [0].c": 1, "l[]": [1, 2, 3], "o.*.q": [1, 2], "a.b[::2].c": [1, 2],
    "a.b[::-1].c": [2, 3, 1], "a.b[0:2].s": ["x", "y"], "[t,f]": ["text", 2.5], "{x:t,y:n}": {"x": "text", "y": None}, "sort_by(a.b,&c)[*].c": [1, 2, 3], "max_by(a.b,&c).c": 3, "min_by(a.b,&c).c": 1,
    "length(a.b)": 3, "length(t)": 4, "not_null(n,'d')": "d", "join(',',keys(o))": "p,r", "!e": True, "e || t": "text", "t && f": 2.5, "a.b[?s&&c>`1`].s": ["y"], "@.o.p.q": 1, "l[*][0]": [1, 3],
    "o.* | [0]": {"q": 1}, "abs(`-2`)": 2, "ceil(f)": 3, "floor(f)": 2, "avg(l[0])": 1.5, "sum(l[0])": 3, "contains(t,'ex')": True, "contains(l[0],`2`)": True, "ends_with(t,'xt')": True,
    "starts_with(t,'te')": True, "map(&c,a.b)": [1, 3, 2], "max(l[0])": 2, "min(l[0])": 1, "merge(o.p,o.r)": {"q": 2}, "reverse(l[0])": [2, 1], "reverse(t)": "txet", "sort(l[0])": [1, 2],
    "to_array(f)": [2.5], "to_number('12')": 12, "to_number('x')": None, "to_string(l[0])": "[1,2]", "type(n)": "null", "type(f)": "number", "values(o.p)": [1], "f<`3`": True, "t<`3`": None, "t=='text'": True,
    "l[0]==`[1,2]`": True, "missing.x": None, '"t"': "text", "`\"s\"`": "s",
}


@pytest.mark.parametrize("expression", CASES)
def test_evaluation(expression):
    assert evaluate(parse(expression), DOC) == CASES[expression]


@pytest.mark.parametrize("bad", ["a.", "a[", "a b", "[::0]", "a..b", "&", "{a:}", "'x", "foo(a"])
def test_syntax_errors(bad):
    with pytest.raises(JmesError):
        parse(bad)


@pytest.mark.parametrize("bad", ["length(f)", "nope(t)", "abs(t)", "abs()", "sort(`[1,\"a\"]`)"])
def test_call_errors(bad):
    with pytest.raises(JmesError):
        evaluate(parse(bad), DOC)


def test_modes():
    assert is_jmes("a[0]") and is_jmes("a | b") and is_jmes("@") and not is_jmes("a.b")


values = st.recursive(st.none() | st.booleans() | st.integers(-99, 99) | st.text("xyz", max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from("abc"), x, max_size=3), max_leaves=8)


@given(values, st.lists(st.sampled_from("abc"), min_size=1, max_size=3))
def test_paths_agree(doc, path):
    want = doc
    for p in path:
        want = want.get(p) if isinstance(want, dict) else None
    assert evaluate(parse(".".join(path)), doc) == want


def test_lowered_equals_evaluated(spark):
    docs = [DOC, {"a": 1}, {"a": {"b": "é"}}, {"t": True}, {}, {"o": {"p": None}}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, raw string")
    for expression in ("t", "o.p.q", "a.b", "o.p | q"):
        fast = native(parse(expression), F.col("raw"))
        assert fast is not None
        rows = df.select("i", fast.alias("x"), rendered(expression)(F.col("raw")).alias("y")).collect()
        for r in rows:
            want = evaluate(parse(expression), docs[r.i])
            assert r.y == (None if want is None else text(want))
            assert r.x == r.y or json.loads(r.x) == json.loads(r.y)


LOWERED = [
    "a.b[0].c", "a.b[-1].c", "a.b[9]", "a.b[*].c", "a.b[?c>`1`].c", "a.b[?s=='x'] | [0].c", "l[]", "o.*.q", "a.b[0:2].s", "a.b[1:].c", "[t,f]", "[t,n,missing]", "{x:t,y:n}", "{y:t,x:o.p}", "length(a.b)", "length(t)", "length(o)",
    "not_null(n,'d')", "join(',',keys(o))", "!e", "e || t", "t && f", "e && t", "a.b[?s&&c>`1`].s", "@.o.p.q", "l[*][0]", "o.* | [0]", "contains(t,'ex')", "contains(l[0],`2`)", "contains(l[0],'2')", "ends_with(t,'xt')", "starts_with(t,'te')",
    "to_array(f)", "to_array(l)", "to_string(l[0])", "to_string(t)", "type(n)", "type(f)", "type(o)", "type(l)", "type(t)", "type(t=='x' || `true`)", "values(o.p)", "f<`3`", "t<`3`", "t=='text'", "t!='text'", "f==`2.5`", "n==`null`",
    "missing.x | [0]", '"t" | [0]', "`\"s\"`", "ceil(f)", "floor(f)", "l[][]", "a.b[].c", "a.b[?!s].c", "[?a]", "@", "l | [1][0]", "a.b[?contains(to_string(c),'3')].c", "a.b[*].{n:c,m:s}", "a.b[*].[c,s]", "o.*.q | [1]",
]


def test_lowered_forms_equal_the_evaluator(spark):
    docs = [DOC, {"t": "text", "f": 3, "l": [], "o": {}, "a": {"b": []}, "e": {}}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(9, "no json")], "i int, raw string")
    made = [native(parse(x), F.col("raw")) for x in LOWERED]
    assert all(x is not None for x in made), [e for e, x in zip(LOWERED, made) if x is None]
    for i, doc in enumerate(docs):
        good, fails = [], []
        for k, expression in enumerate(LOWERED):
            try:
                want = evaluate(parse(expression), doc)
                good.append((k, expression, None if want is None else text(want)))
            except JmesError:
                fails.append(k)
        got = df.where(f"i = {i}").select(*[made[k].alias(f"x{k}") for k, _, _ in good]).first()
        wrong = [(expression, got[f"x{k}"], want) for k, expression, want in good if got[f"x{k}"] != want]
        assert not wrong
        for k in fails[:3]:
            with pytest.raises(Exception, match="argument"):
                df.where(f"i = {i}").select(made[k]).collect()
    bad = df.where("i = 9").select(*[m.alias(f"x{k}") for k, m in enumerate(made) if not LOWERED[k].startswith("`")][:12]).first()
    assert all(x is None for x in bad)


@pytest.mark.parametrize("expression", ["sort_by(a.b,&c)", "a.b[::-1]", "sum(l[0])", "a.b[?c==s]", "map(&c,a.b)"])
def test_other_forms_go_to_the_evaluator(spark, expression):
    assert native(parse(expression), F.col("raw")) is None

"""The evaluator's compiled form, and which queries go to it."""

from strandlog import catalog
from strandlog.jmes import lower
from strandlog.jmes.evaluate import compiled, evaluate
from strandlog.jmes.parse import JmesError, parse

from test_jmes import CASES, DOC, LOWERED


def test_compiled_equals_evaluated():
    def result(f):
        try:
            return f()
        except JmesError as e:
            return str(e)

    for x in (*CASES, *LOWERED, 'sort(`[1,"a"]`)', "nope(t)", "abs()", "abs(t)", "missing | [`1`]", "missing | sort(`[2,1]`)", "not_null(n)", "merge({a: t}, {a: f})"):
        node = parse(x)
        for doc in (DOC, {}, None, [1], "x", {"t": "text", "f": 3, "l": [], "o": {}, "a": {"b": []}, "e": {}}):
            assert result(lambda: compiled(node)(doc)) == result(lambda: evaluate(node, doc)), (x, doc)


def test_calls_go_to_the_evaluator(spark, sf):
    assert lower._calls(parse("a[?length(b) > `1`].c")) and lower._calls(parse("{x: [keys(a)]}")) and not lower._calls(parse("call.b[0] || `[\"call\"]`"))
    for name in ("query_jmes_arrays", "query_jmes_order"):
        assert "ArrowEvalPython" in catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()

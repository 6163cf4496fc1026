import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlspike.errors import FilterError, QueryError, ValueRefused
from marlspike.functions import jsonops
from marlspike.operators.select import Select, expr
from marlspike.plans.fields import Field, parse_field, parse_path, print_path
from marlspike.plans.filters import Filters, Group, Leaf, MultiScope, TableScope
from marlspike.plans.parser import Parser, tokenize
from tests.bank import bank


@pytest.fixture(scope="module")
def c(spark):
    return bank(spark)


def ids(c, f, table="clients"):
    q = Select(c).from_(table, "t")
    name = c.table(table).column("id").full_name
    return sorted(r[name] for r in q.where(f).to_df().collect())


def truth(node, values):
    """A group by brute force over leaves named v0, v1, ... that are True, False or None."""
    if isinstance(node, Leaf):
        return values[int(node.left[1:])]
    out = None
    for i, x in enumerate(node.items):
        v = truth(x, values)
        out = v if i == 0 else _and(out, v) if node.cond == "and" else _or(out, v)
    return out


def _and(a, b):
    return False if a is False or b is False else None if a is None or b is None else True


def _or(a, b):
    return True if a is True or b is True else None if a is None or b is None else False


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=5), st.data())
def test_left_associative(conds, data):
    text, values = "v0 is_true", data.draw(st.lists(st.sampled_from([True, False, None]), min_size=len(conds) + 1, max_size=len(conds) + 1))
    want = values[0]
    for i, is_and in enumerate(conds, 1):
        text += f" {'and' if is_and else 'or'} v{i} is_true"
        want = (_and if is_and else _or)(want, values[i])
    assert truth(Filters.from_text(text).root, values) is want


def test_regrouping_and_flattening():
    f = Filters().eq("a", 1).eq("b", 2).or_().eq("c", 3)
    assert f.root == Group("or", [Group("and", [Leaf("a", "eq", 1), Leaf("b", "eq", 2)]), Leaf("c", "eq", 3)])
    f = Filters().eq("a", 1).and_(lambda g: g.eq("b", 2).eq("c", 3))
    assert len(f.root.items) == 3
    f = Filters().eq("a", 1).or_(lambda g: g.eq("b", 2).eq("c", 3))
    assert f.root.cond == "or" and f.root.items[1].cond == "and"
    assert Filters().where(Filters()).is_empty()
    with pytest.raises(FilterError):
        Filters().where(lambda g: None)


def test_tokens_and_grammar():
    assert [t.kind for t in tokenize("a eq :b AND (c IS_NULL)")] == ["word", "op", "binding", "cond", "open", "word", "op", "close"]
    assert Parser("a eq x").parse() == [["a", "eq", "x"]]
    assert Parser("a#b['x y'].c gt -3.5 or d eq 'it\\'s'", strict=False).parse() == [["a#b['x y'].c", "gt", -3.5], "or", ["d", "eq", "it's"]]
    assert Parser("").parse() == []
    for bad in ("a", "a eq", "a eq :x", "(a is_null", "a is_null)", "a is_null and", "and a is_null", "a :x", "a eq :", "a is_null b is_null", "()"):
        with pytest.raises(FilterError):
            Parser(bad).parse()
    with pytest.raises(FilterError):
        tokenize("a eq 'x", strict=False)


@pytest.mark.parametrize("bad", [["a"], ["a", "eq"], ["a", "what", 1], ["a", "eq", 1, "and"], ["a", "eq", 1, "b", "eq", 2], [[], "and", ["a", "eq", 1]], {"_$filter": "a eq 1", "x": 1}, {"a": [["eq"]]}, {"a": [["eq", 1, "xor"]]}, ["a", "in", 3], ["a", "has_key", ""]])
def test_malformed(bad):
    with pytest.raises(FilterError):
        Filters.from_any(bad)


def test_paths():
    for text, want in {"a.b": ["a", "b"], "a['x.y'].c": ["a", "x.y", "c"], "['k'][0]": ["k", "0"], "a[\"q'\\\"\"]": ["a", "q'\""]}.items():
        assert parse_path(text) == want and parse_path(print_path(want)) == want
    assert parse_field("t.c#a.b") == Field("c", "t", ("a", "b")) and str(parse_field("t.c#a['b.c']")) == "t.c#a['b.c']"
    for bad in ("", "a..b", "a.", ".a", "a['x", "a[x]", "a[0", "a['x']b"):
        with pytest.raises(FilterError):
            parse_path(bad)
    for bad in ("#a", "c#", ".c"):
        with pytest.raises(FilterError):
            parse_field(bad)


def test_operators_on_rows(c):
    acc = lambda f: ids(c, f, "accounts")
    assert acc(Filters().eq("balance", "10.5")) == [1] and acc(Filters().neq("label", "main")) == [2]
    assert acc(Filters().lt("balance", 7)) == [3] and acc(Filters().lte("balance", 7)) == [2, 3] and acc(Filters().gt("balance", 7)) == [1] and acc(Filters().gte("balance", 7)) == [1, 2]
    assert acc(Filters().like("label", "m%")) == [1, 3] and acc(Filters().like("label", "M%")) == [] and acc(Filters().not_like("label", "m%")) == [2]
    assert acc(Filters().in_("id", [1, 2, 2])) == [1, 2] and acc(Filters().in_("id", [])) == [] and acc(Filters().not_in("id", [])) == [1, 2, 3]
    assert acc(Filters().not_in("id", [1])) == [2, 3] and acc(Filters().not_in("id", [1, None])) == [] and acc(Filters().in_("id", [1, None])) == [1]
    assert acc(Filters().is_true("valid")) == [1, 2, 3] and acc(Filters().is_false("valid")) == [] and acc(Filters().eq("valid", 1)) == [1, 2, 3]
    assert ids(c, Filters().eq("pin", None)) == [1, 2, 3] and ids(c, Filters().neq("pin", None)) == [] and ids(c, Filters().neq("pin", "x")) == []
    assert acc("account_id = 2") == [2] and acc(expr("account_balance > 8")) == [1] and acc(F.col("t.account_id") == 3) == [3]
    assert acc(Filters().eq("client_id", Field("id", "t"))) == [1]
    sub = Select(c).from_("accounts", "x").select(None, ["max(x.account_balance) AS m"])
    assert acc(Filters().eq("balance", sub)) == [1]
    vip = Select(c).from_("clients", "k").select("k", ["id"]).where(["first_name", "eq", "Bob"])
    assert acc(Filters().in_("client_id", vip)) == [3] and acc(Filters().not_in("client_id", vip)) == [1, 2]
    assert acc(Filters().eq("currency_code", "t.currency_code")) == []  # texts on the right are never columns
    with pytest.raises(ValueRefused):
        acc(Filters().eq("id", "abc"))


def test_json_filters(c):
    assert ids(c, Filters().eq("data#user.role", "admin")) == [1] and ids(c, Filters().eq("data#['meta.key']", "dotted")) == [1]
    assert ids(c, Filters().gt("data#user.level", 2)) == [1] and ids(c, Filters().eq("data#user.level", 3)) == [1] and ids(c, Filters().like("data#tag", "v%")) == [1]
    assert ids(c, Filters().is_null("data#tag")) == [2, 3] and ids(c, Filters().is_not_null("data#tag")) == [1]
    assert ids(c, Filters().has_key("data", "tag")) == [1, 2] and ids(c, Filters().has_key("data", "user.role")) == [1] and ids(c, Filters().has_key("data#user", "role")) == [1]
    assert ids(c, Filters().contains("data", {"user": {"role": "admin"}})) == [1] and ids(c, Filters().contains("data", '{"tag": null}')) == [2]
    assert ids(c, Filters().contains_at_path("data", "list", [2])) == [2] and ids(c, Filters().contains_at_path("data", "list", [{"a": 1}, 1])) == [2] and ids(c, Filters().contains("data", {})) == [1, 2, 3]
    with pytest.raises(FilterError):
        ids(c, Filters().eq("first_name#a", 1))
    with pytest.raises(FilterError):
        ids(c, Filters().has_key("first_name", "a"))


def test_containment_equals_rule(spark):
    import json

    r = random.Random(5)
    values = [None, True, 1, 1.0, "1", "a", [], {}, [1, [2]], {"a": 1}, {"a": {"b": [1, 2]}}, [{"a": 1, "b": 2}], {"a": None}, {"0": 1}, {"it's": 1}, {"'\"": 1}, [None], [[1]], 1.5]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(99, None), (98, "{bad")], "i int, j string")
    parts = r.sample(values, len(values))
    got = {row.i: row for row in df.select("i", *[jsonops.contains(F.col("j"), p).alias(f"c{k}") for k, p in enumerate(map(json.dumps, parts))]).collect()}
    for (i, v), (k, p) in itertools.product(enumerate(values), enumerate(parts)):
        assert got[i][f"c{k}"] == jsonops.contains_value(v, p), (v, p)
    assert got[99]["c0"] is None and got[98]["c0"] is False
    both = df.where("i < 90").crossJoin(df.where("i < 90").select(F.col("i").alias("k"), F.col("j").alias("p")))
    for row in both.select("i", "k", jsonops.contains(F.col("j"), F.col("p")).alias("x")).collect():
        assert row.x == jsonops.contains_value(values[row.i], values[row.k])
    plan = df.where(jsonops.contains(F.col("j"), {"a": 1}))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_json_patch(spark):
    p = jsonops.JsonPatch({"a": {"b": 1}, "c": 2}).set("a.d", [1]).set("c.x", 3).remove("a.b").remove("no.such").set("['k.k']", None)
    assert p.apply() == {"a": {"d": [1]}, "c": {"x": 3}, "k.k": None}
    out = spark.createDataFrame([('{"a": 1}',), (None,)], "j string").select(jsonops.JsonPatch().set("a.b", 1).apply_to(F.col("j")).alias("j")).collect()
    assert [r.j for r in out] == ['{"a":{"b":1}}', '{"a":{"b":1}}']


def test_scopes(c):
    scope = TableScope(c.table("clients"), "t")
    assert ids(c, Filters(scope).eq("first_name", "Ann")) == [1] and ids(c, Filters.from_any({"clients.first_name": "Bob"}, scope)) == [2]
    for bad in ("pin", "email", "no_such", "count(*)", "accounts.label"):
        with pytest.raises(FilterError):
            Filters(scope).eq(bad, "x")
    with pytest.raises(FilterError):
        Filters(scope).where("1 = 1")
    assert ids(c, Filters(TableScope(c.table("clients"), "t", True, True)).eq("email", "Ann@x")) == [1]
    multi = MultiScope(scope, TableScope(c.table("accounts"), "a"))
    assert Filters(multi).eq("label", "x").root.items[0].left == Field("account_label", "a")
    assert Filters(multi).eq("a.id", 1).root.items[0].left.table == "a" and Filters(multi).eq("id", 1).root.items[0].left.table == "t"


def test_pushdown(spark, tmp_path):
    from marlspike.schema import catalog_of

    spark.range(100).selectExpr("id AS o_orderkey", "id AS o_custkey", "'F' AS o_orderstatus", "double(id) AS o_totalprice", "current_timestamp() AS o_orderdate", "'x' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    q = Select(catalog_of(spark, str(tmp_path))).from_("orders", "o").select("o", ["orderkey"]).where(Filters().gt("orderkey", "10").eq("orderstatus", "F"))
    plan = q.to_df()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_orderkey,10)" in plan and "EqualTo(o_orderstatus,F)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan
    with pytest.raises(QueryError):
        Select(q.catalog).from_("orders", "o").where(Filters().eq("o.nope", 1)).to_df()

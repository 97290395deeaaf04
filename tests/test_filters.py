import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillfire.operators.filters import FilterError, compile_filter, parse

TYPES = {"brand": "string", "price": "number", "size": "number"}
ROWS = [("a", "Aurora", 90.0, 1), ("b", "Aurora", 110.0, 2), ("c", "Nim bus", 150.0, None), ("d", None, None, 4), ("e", "", float("nan"), 5)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "id string, brand string, price double, size int").cache()


def found(docs, text):
    return sorted(r.id for r in docs.where(compile_filter(docs, text, TYPES)).collect())


@pytest.mark.parametrize(
    "text,ids",
    [
        ("brand:Aurora", "ab"), ('brand:"Nim bus"', "c"), ('brand:[Aurora, "Nim bus"]', "abc"), ("price:>100", "bc"), ("price:>=110", "bc"),
        ("price:<100", "a"), ("price:[90..110]", "ab"), ("price:110", "b"), ("size:[1,4]", "ad"), ("size:<=2", "ab"), ("size:2.5", ""),
        ("brand:Aurora && price:>100 || size:4", "bd"), ("brand:Aurora && (price:>100 || size:1)", "ab"), ("price:>-1", "abc"), ('brand:""', "e"),
    ],
)
def test_found(docs, text, ids):
    assert found(docs, text) == list(ids)


@pytest.mark.parametrize(
    "text",
    ['brand:"x', "colour:red", "brand:>3", "brand:[a..b]", "price:abc", "price:[1..x]", "price:[1,x]", "brand:a b", "brand", "brand:", "(brand:a", ":", "price:!=3", ""],
)
def test_errors(text):
    with pytest.raises(FilterError):
        parse(text, TYPES)


def test_precedence():
    assert parse("size:1 || size:2 && size:3", TYPES)[0] == "or"


def evaluate(node, row):
    if node[0] in ("and", "or"):
        a, b = evaluate(node[1], row), evaluate(node[2], row)
        return a and b if node[0] == "and" else a or b
    v = row[{"brand": 1, "price": 2, "size": 3}[node[1]]]
    if v is None or v != v:
        return False
    if node[0] == "in":
        return v in node[3]
    if node[0] == "range":
        return node[2] <= v <= node[3]
    return {">": v > node[3], ">=": v >= node[3], "<": v < node[3], "<=": v <= node[3]}[node[2]]


clause = st.one_of(
    st.sampled_from(["brand:Aurora", 'brand:["Nim bus",x]', "brand:x"]),
    st.builds(lambda f, o, n: f"{f}:{o}{n}", st.sampled_from(["price", "size"]), st.sampled_from(["", ">", ">=", "<", "<="]), st.integers(0, 160)),
    st.builds(lambda f, a, b: f"{f}:[{a}..{b}]", st.sampled_from(["price", "size"]), st.integers(0, 5), st.integers(0, 160)),
)
exprs = st.recursive(clause, lambda s: st.builds(lambda a, o, b: f"({a} {o} {b})", s, st.sampled_from(["&&", "||"]), s), max_leaves=6)


@settings(max_examples=40, deadline=None)
@given(exprs)
def test_against_an_evaluator(docs, text):
    assert found(docs, text) == [r[0] for r in ROWS if evaluate(parse(text, TYPES), r)]


def test_pushdown(spark, tmp_path, docs, capsys):
    docs.write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    df.where(compile_filter(df, "price:>=100 && brand:Aurora && size:[1..3]", TYPES)).explain("formatted")
    pushed = next(x for x in capsys.readouterr().out.splitlines() if "PushedFilters" in x)
    assert all(x in pushed for x in ("GreaterThanOrEqual(price", "EqualTo(brand", "LessThanOrEqual(size"))

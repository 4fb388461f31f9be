import pytest

from skarn.operators import profiling, tabular
from skarn.operators.tabular import Filter

USERS = [(1, "Alice", 30, "admin"), (2, "Bob", 25, "user"), (3, "Charlie", 35, "admin"), (4, "Dana", 28, "user"), (5, "Eve", 32, "moderator")]
ORDERS = [("o1", 1, "120.50", "EU"), ("o2", 1, "75.00", "US"), ("o3", 2, "200.25", "EU"), ("o4", 3, "320.00", "US"), ("o5", 4, "45.75", "APAC"), ("o6", 3, "60.00", "EU")]


@pytest.fixture
def users(spark):
    return spark.createDataFrame(USERS, "id int, name string, age int, role string")


@pytest.fixture
def orders(spark):
    return spark.createDataFrame(ORDERS, "order_id string, user_id int, amount string, region string")


def names(df):
    return sorted(r["name"] for r in df.collect())


def test_filters(users):
    q = lambda *f: names(tabular.query_rows(users, [Filter(*x) for x in f]))
    assert q(("role", "eq", "admin")) == ["Alice", "Charlie"]
    assert q(("age", "gt", 28)) == ["Alice", "Charlie", "Eve"]
    assert q(("name", "contains", "AR")) == ["Charlie"]
    assert q(("id", "in", [])) == [] and q(("id", "in", [1, 5])) == ["Alice", "Eve"]
    assert q(("age", "between", (28, 30)), ("role", "neq", "admin")) == ["Dana"]
    assert q(("role", "is_null", True)) == []
    with pytest.raises(ValueError, match="available"):
        q(("nope", "eq", 1))
    with pytest.raises(ValueError):
        q(("age", "between", [1]))
    assert tabular.parse_filter("a:eq:b:c") == Filter("a", "eq", "b:c")


def test_numbers_compare_as_numbers(spark):
    df = spark.createDataFrame([(30,), (5,), (100,)], "v int")
    assert sorted(r.v for r in tabular.where(df, [Filter("v", "gt", 18)]).collect()) == [30, 100]
    assert tabular.aggregate(df, [], [("min", "v"), ("max", "v")]).first().asDict() == {"min_v": 5, "max_v": 100}


def test_aggregate_and_join(users, orders):
    g = {r.region: round(r.sum_amount, 2) for r in tabular.aggregate(orders, ["region"], [("sum", "amount")]).collect()}
    assert g == {"EU": 380.75, "US": 395.0, "APAC": 45.75}
    assert tabular.aggregate(orders, [], [("count_distinct", "user_id", "n"), ("avg", "amount", "m")]).first().n == 4
    assert tabular.join(users, orders, "id", "user_id").count() == 6
    assert tabular.join(users, orders, "id", "user_id", "left").count() == 7
    assert tabular.join(users, orders, "id", "user_id", "right", ["name", "amount"], "u", "o").columns == ["u.name", "o.amount"]
    with pytest.raises(ValueError):
        tabular.aggregate(orders, [], [("sum", "*")])


def test_correlation_gini_profile(spark, users):
    m = spark.createDataFrame([(i, 2 * i + (i % 3), None) for i in range(1, 20)], "a int, b int, c int")
    r = tabular.correlations(m, ["a", "b", "c"]).collect()
    assert [(x.column_a, x.column_b, x.strength) for x in r] == [("a", "b", "strong")]
    for v, want in (([1, 2, 3, 4, 5], 0.266667), ([0, 0, 0, 10], 0.75), ([0, 0], 0.0), ([3], None), ([], None)):
        g = tabular.gini(spark.createDataFrame([(x,) for x in v], "x int"), "x").first().gini
        assert g is None and want is None or abs(g - want) < 1e-6
    p = {r.column_name: r for r in profiling.profile(users, samples=True).collect()}
    assert (p["age"].min_number, p["age"].max_number, p["age"].mean_value, p["age"].cardinality, p["age"].null_count) == (25, 35, 30, 5, 0)
    assert p["role"].inferred_type == "string" and p["id"].inferred_type == "integer"
    assert len(p["name"].sample_values) == 5

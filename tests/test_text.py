"""XPR-1 / FLT-4..8: string rules against Python's own behaviour."""

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from wayfare import contracts as C
from wayfare.functions import text as X

SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0        　"


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet=SPACES + "ab 城市", max_size=12), min_size=1, max_size=10))
def test_strip_like_python(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r.i: r.s for r in df.select("i", X.blank_to_null("v").alias("s")).collect()}
    for i, v in enumerate(values):
        expect = v.strip() or None
        assert got[i] == expect, repr(v)


def test_valid_and_truthy(spark):
    vals = [None, "", " ", "未知", " Unknown ", "NULL", "东京", "none", "0"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    got = {r.i: (r.valid, r.truthy) for r in df.select("i", X.valid_slot("v").alias("valid"),
                                                           X.truthy("v").alias("truthy")).collect()}
    for i, v in enumerate(vals):
        py_valid = v is not None and str(v).strip().lower() not in C.INVALID_SLOT_VALUES
        py_truthy = bool(v)
        assert got[i] == (py_valid, py_truthy), repr(v)


def test_members_keep_order_and_repeats(spark):
    df = spark.createDataFrame([(["ticket_agent", "x", "weather_agent", "ticket_agent"],)], "a array<string>")
    r = df.select(X.keep_members("a", C.SUPPORTED_AGENTS).alias("k"), X.drop_member("a", "ticket_agent").alias("d")).first()
    assert r.k == ["ticket_agent", "weather_agent", "ticket_agent"]
    assert r.d == ["x", "weather_agent"]


def test_same_multiset(spark):
    df = spark.createDataFrame([(["a", "b", "a"], ["a", "a", "b"]), (["a", "b"], ["a", "b", "b"]), (None, [])],
                               "l array<string>, r array<string>")
    assert [r.s for r in df.select(X.same_multiset("l", "r").alias("s")).collect()] == [True, False, True]


def test_collated_canonical_keys(spark):
    left = spark.createDataFrame([("Café  ", 1), ("CAFE", 2), ("Tokyo", 3)], "city string, v int")
    right = spark.createDataFrame([("cafe", "x"), ("tokyo ", "y"), ("Osaka", "z")], "city string, w string")
    mapping = X.canonical_map(left.select("city").unionByName(right.select("city")), "city")
    got = dict((r.raw, r.canonical) for r in mapping.collect())
    assert got["Café  "] == got["CAFE"] == got["cafe"]
    assert got["Tokyo"] == got["tokyo "]
    assert got["Osaka"] == "Osaka"
    joined = X.canonicalize(left, "city", mapping, "k").join(
        X.canonicalize(right, "city", mapping, "k").select("k", "w"), "k")
    assert sorted((r.v, r.w) for r in joined.collect()) == [(1, "x"), (2, "x"), (3, "y")]


def test_placeholders_inside_values_stay(spark):
    from pyspark.sql import functions as F
    from wayfare.functions import text as X
    row = spark.range(1).select(
        X.render("{original}|{reply}{other}", original=F.lit("我问{reply}"), reply=F.lit("R")).alias("a"),
        X.render_template_col(F.lit("{city} {date}{dep}{x}"), F.lit("{date}"), F.lit("d"), F.lit(None).cast("string"), F.lit("z")).alias("b")).first()
    assert (row.a, row.b) == ("我问{reply}|R{other}", "{date} d{x}")

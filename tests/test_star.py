"""A star of bookings gives what the flat bookings give, aggregated before the names are looked up."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from burnline.operators import dashboard as D
from burnline.operators import filters as B
from burnline.plans import catalog
from burnline.sources import derived
from burnline.sources.star import BookingStar, Lookup

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pair(spark):
    """The same bookings flat and as a star; names repeat, keys are missing or have no row."""
    rng = random.Random(3)
    facts = [(rng.choice([None, *range(8)]), rng.choice([None, *range(6)]), rng.choice([None, *range(9)]), rng.choice([None, 1.5, 2.0, 8.25]),
              rng.choice([None, dt.date(2024, 1, 1) + dt.timedelta(rng.randint(0, 500))]), rng.choice(["A", "R", None]), rng.choice(["x1", "y2", None]))
             for _ in range(600)]
    fact = spark.createDataFrame(facts, "pk long, ak long, ek long, hours_billed double, entry_date date, status string, comment string") \
        .withColumns({"year": F.year("entry_date"), "month": F.month("entry_date")})
    projects = spark.createDataFrame([(k, ["Alpha", "Beta", None][k % 3], ["K1", "K2", None, "K2"][k % 4]) for k in range(7)], "id long, name string, cust string")
    activities = spark.createDataFrame([(k, ["Dev", "Test", None][k % 3]) for k in range(5)], "id long, name string")
    people = spark.createDataFrame([(k, ["Ann", "Bob", None][k % 3]) for k in range(8)], "id long, name string")
    nr = F.concat(F.lit("P"), (F.col("pk") % 5).cast("string"))
    star = BookingStar(fact, [
        Lookup("pk", projects, "id", {"project": F.col("name"), "customer": F.col("cust")}, {"project_nr": nr}),
        Lookup("ak", activities, "id", {"activity": F.col("name")}), Lookup("ek", people, "id", {"employee": F.col("name")})])
    flat = fact.withColumn("project_nr", nr)
    for key, frame, names in (("pk", projects, {"project": "name", "customer": "cust"}), ("ak", activities, {"activity": "name"}),
                              ("ek", people, {"employee": "name"})):
        flat = flat.join(frame.select(F.col("id").alias("_on"), *(F.col(c).alias(n) for n, c in names.items())), F.col(key) == F.col("_on"), "left").drop("_on")
    return flat, star


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


FILTERS = [B.BookingFilters(), B.BookingFilters(year=2024, status="R"), B.BookingFilters(activities=["Dev"], employees=["Ann", "Bob"]),
           B.BookingFilters(activity="Test", month=3), B.BookingFilters(search_term="^dev$|k2"), B.BookingFilters(projects=["P1", " P2 ", None]),
           B.BookingFilters(projects=[]), B.BookingFilters(search_term="x|bet", search_columns=["comment", "project"], statuses=["A"]),
           B.BookingFilters(start_date=dt.date(2024, 2, 1), end_date=dt.date(2024, 9, 30))]


@pytest.mark.parametrize("k", range(len(FILTERS)))
def test_aggregates_equal_those_of_flat_bookings(pair, k):
    flat, star = (B.apply_filters(x, FILTERS[k]) for x in pair)
    assert rows(D.aggregate_bookings(star)) == rows(D.aggregate_bookings(flat))
    assert rows(D.aggregate_bookings_compact(star)) == rows(D.aggregate_bookings_compact(flat))


def test_codes_and_entitlements(spark, pair):
    codes = spark.createDataFrame([(" P1",), ("P3",), (None,), ("",)], "project_nr string")
    flat, star = (B.apply_filters(x, B.BookingFilters(projects=codes)) for x in pair)
    assert rows(D.aggregate_bookings(star)) == rows(D.aggregate_bookings(flat)) and flat.count() > 0
    grants = spark.sql("SELECT map('a@b', named_struct('projects', array('P2', ' P4 '), 'permissions', cast(null AS array<string>))) AS users")
    flat, star = (B.restrict_to_user(x, grants, "a@b") for x in pair)
    assert rows(D.aggregate_bookings(star)) == rows(D.aggregate_bookings(flat)) and flat.count() > 0


def test_header_takes_the_customer_from_the_activity_rows(spark, pair):
    agg = D.aggregate_bookings(pair[0])
    targets = spark.createDataFrame([("P1", "Dev", 10.0), ("P2", "Test", 5.0)], "project_nr string, activity string, budget_hours double")
    joined = D.project_header(D.activity_dashboard(agg, targets), agg)
    carried = D.project_header(D.activity_dashboard(agg, targets, with_top=True))
    assert rows(joined) == rows(carried)
    with pytest.raises(ValueError):
        D.project_header(D.activity_dashboard(agg, targets))


def test_bookings_meet_names_only_after_the_first_aggregate(spark):
    plan = catalog.QUERIES["d1_booking_aggregate"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    depth = {name: [len(x) - len(x.lstrip(" :+-")) for x in lines if name in x] for name in ("Aggregate", "s_name", "p_type", "c_name", "l_quantity")}
    inner = max(depth["Aggregate"])  # the aggregate by keys
    assert min(d for x, d in ((x, len(x) - len(x.lstrip(" :+-"))) for x in lines) if "Relation" in x and "l_quantity" in x) > inner
    for name in ("s_name", "p_type", "c_name"):
        assert not any(name in x for x in lines if len(x) - len(x.lstrip(" :+-")) > inner and "l_quantity" in x)


def test_derived_star_is_the_derived_bookings(spark):
    flat, star = derived.bookings(spark, SMALL), derived.booking_star(spark, SMALL)
    assert rows(D.aggregate_bookings(star)) == rows(D.aggregate_bookings(flat))

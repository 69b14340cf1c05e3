import datetime as dt

import pytest
from conftest import rows

from readtrail.operators import campaigns
from readtrail.operators.cohorts import LearnerTables
from readtrail.sources import spend

D = dt.date
DAILY = (
    "campaign_id string, segment_date date, campaign_name string, cost double, "
    "campaign_start_date date, campaign_end_date date, source string"
)


@pytest.fixture(scope="module")
def daily(spark):
    def build(*items):
        out = []
        for item in items:
            r = {"id": "1", "day": D(2024, 6, 1), "name": "A: Zulu - Kenya", "cost": 1.0,
                 "start": D(2024, 5, 1), "end": None, "source": "Google", **item}
            out.append((r["id"], r["day"], r["name"], r["cost"], r["start"], r["end"], r["source"]))
        return campaigns.add_country_and_language(spark.createDataFrame(out, DAILY))

    return build


def test_names(spark):
    names = ["FB: Zulu - South Africa Campaign 2", "X - Campaign", "plain", "a: b", "A:  Hausa  -\tNigeria \t",
             "G: en-US - Kenya", "A: x - Campaign Campaign end", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, campaign_name string")
    got = campaigns.add_country_and_language(df).orderBy("i").collect()
    assert [(r.country, r.app_language) for r in got] == [
        ("South Africa", "zulu"), ("", None), (None, None), (None, None), ("Nigeria", "hausa"),
        ("US - Kenya", "en"), ("Campaign", "x"), (None, None),
    ]


def test_rollup(daily):
    df = daily(
        {"day": D(2024, 6, 1), "cost": 2.0, "start": D(2024, 1, 1), "end": D(2024, 7, 1)},
        {"day": D(2024, 6, 3), "cost": 3.0, "name": "A: Hausa - Ghana", "start": None},
        {"day": D(2024, 6, 4), "cost": None, "name": None, "start": None},
        {"id": "single", "cost": None},
        {"id": "no-cost", "cost": None}, {"id": "no-cost", "cost": None},
        {"id": "no-day", "day": None, "name": "old"}, {"id": "no-day", "name": "new"},
    )
    got = {r.campaign_id: r for r in campaigns.rollup_campaigns(df).collect()}
    r = got["1"]
    assert (r.cost, r.campaign_name, r.country, r.app_language) == (5.0, "A: Hausa - Ghana", "Ghana", "hausa")
    assert (r.campaign_start_date, r.campaign_end_date) == (D(2024, 1, 1), D(2024, 7, 1))
    assert got["single"].cost is None
    assert got["no-cost"].cost == 0.0
    assert got["no-day"].campaign_name == "new"
    assert "segment_date" not in r.asDict()


def test_rows_without_id(daily):
    assert rows(campaigns.rollup_campaigns(daily({"id": None})), "campaign_id", "cost") == [(None, 1.0)]
    assert campaigns.rollup_campaigns(daily({"id": None}, {"id": None})).count() == 0


def test_by_date_is_inclusive(daily):
    df = daily(*[{"day": D(2024, 6, n), "cost": float(n)} for n in (1, 2, 3, 4)])
    assert rows(campaigns.campaigns_by_date(df, (D(2024, 6, 2), D(2024, 6, 3))), "cost") == [(5.0,)]


def test_costs(spark, daily):
    launches = spark.createDataFrame(
        [("a", "Kenya", "zulu", D(2024, 6, 1)), ("b", "Kenya", "zulu", D(2024, 6, 2)), ("c", "Kenya", "zulu", D(2024, 6, 2)),
         ("d", "Kenya", "zulu", D(2024, 9, 1))],
        "cr_user_id string, country string, app_language string, first_open date")
    progress = spark.createDataFrame(
        [("a", "Kenya", "zulu", "CR", D(2024, 6, 1), "level_completed", 26, 10.0),
         ("b", "Kenya", "zulu", "CR", D(2024, 6, 1), "level_completed", 2, 10.0),
         ("x", "Kenya", "zulu", "x-standalone", D(2024, 6, 1), "level_completed", 2, 10.0),
         ("e", "Ghana", "zulu", "CR", D(2024, 6, 1), "puzzle_completed", 0, 0.0)],
        "cr_user_id string, country string, app_language string, app string, first_open date, "
        "furthest_event string, max_user_level long, gpc double")
    tables = LearnerTables(progress, progress, launches)
    df = daily({"id": "1", "cost": 10.004}, {"id": "2", "cost": 0.004}, {"id": "3", "name": "A: Zulu - Ghana", "cost": 4.0},
               {"id": "4", "name": "A: Twi - Togo", "cost": None}, {"id": "5", "name": "plain"})
    got = {r.country: r for r in campaigns.campaign_table(df, tables, (D(2024, 6, 1), D(2024, 6, 30))).collect()}
    assert sorted(got) == ["Ghana", "Kenya", "Togo"]
    k, g, t = got["Kenya"], got["Ghana"], got["Togo"]
    assert (k.cost, k.LR, k.LRC, k.PC, k.PCC, k.LA, k.LAC, k.RA, k.RAC) == (10.01, 3, 3.34, 2, 5.0, 2, 5.0, 1, 10.01)
    assert (k["PC_LR %"], k["LA_LR %"], k["RA_LR %"]) == (67.0, 67.0, 33.0)
    assert (g.LR, g.LRC, g.PC, g.PCC, g["PC_LR %"]) == (0, 0.0, 1, 4.0, 0.0)
    assert (t.cost, t.LR, t.RAC) == (0.0, 0, 0.0)


def test_google_spend(spark):
    stats = spark.createDataFrame(
        [("1,234", D(2024, 5, 1), 1_234_567), ("1,234", D(2024, 5, 1), 1_234_567), ("1,234", D(2024, 4, 30), 9),
         ("unknown", D(2024, 5, 2), 5)],
        "campaign_id string, segments_date date, metrics_cost_micros long")
    named = spark.createDataFrame([("1,234", "A", D(2024, 1, 1), None)],
                                  "campaign_id string, campaign_name string, campaign_start_date date, campaign_end_date date")
    got = rows(spend.google_spend(stats, named), "campaign_id", "segment_date", "campaign_name", "cost", "source")
    assert got == [("1234", D(2024, 5, 1), "A", 1.23, "Google")]


def test_facebook_spend(spark):
    ads = spark.createDataFrame(
        [(7, D(2024, 4, 30), "A", 1.0, None, None), (7, D(2024, 5, 1), "A", 2.0, None, None), (7, D(2024, 6, 1), "A", 2.0, None, None),
         (7, D(2024, 6, 1), "A", 2.0, None, None)],
        "campaign_id long, data_date_start date, campaign_name string, spend double, start_time date, end_time date")
    got = [(r.campaign_id, r.segment_date) for r in spend.facebook_spend(ads, newest_first=True).collect()]
    assert got == [("7", D(2024, 6, 1)), ("7", D(2024, 6, 1)), ("7", D(2024, 5, 1))]

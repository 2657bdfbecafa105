from pyspark.sql import functions as F

from gustline.functions import text as X
from gustline.functions import units as U


def test_compass(values):
    assert values(U.compass_degrees, "n", "NorthEast", "NORTHEAST", "W", "bat", None) == [0, 45, 45, 270, -1, -1]
    assert values(U.compass_text, "se", "South", "bat", None) == ["SouthEast", "South", None, None]


def test_wind_parts(values):
    got = values(lambda c: U.wind_parts(c), "NW 8", "NW 8 G 25", "Calm", "Vrbl 5", "NE 10", " N  3 ", None)
    assert [(r.mph_text, r.gust_text) for r in got[1:3]] == [("8", "25"), ("0", None)]
    assert [tuple(r)[:4] for r in got[:6]] == [
        ("NorthWest", 315, 8.0, None),
        ("NorthWest", 315, 8.0, 25.0),
        ("North", 0, 0.0, None),
        ("Variable", -1, 5.0, None),
        ("NorthEast", 45, 10.0, None),
        ("North", 0, 3.0, None),
    ]
    assert got[2].calm and got[3].variable and got[6].mph is None


def test_conversions(spark):
    row = spark.range(1).select(U.knots(F.lit(10.0)), U.celsius(F.lit(212.0)), U.celsius(F.lit(None).cast("double")))
    knots, celsius, nothing = row.first()
    assert round(knots, 5) == 8.68976 and round(celsius, 3) == 100.008 and nothing is None


def test_number(values):
    assert values(U.number, "8.1", " 7 ", "NA", "<no_value_provided>", "", None) == [8.1, 7.0, None, None, None, None]


def test_display(spark):
    none = F.lit(None).cast("double")
    row = spark.range(1).select(
        U.wind_display(F.lit("North"), F.lit(0.0), none),
        U.wind_display(F.lit("South"), F.lit(10.0), F.lit(20.0)),
        U.temperature_display(F.lit(32.0)),
        U.temperature_display(F.lit(32.0), gap=""),
        U.temperature_display(none),
        U.pressure_display(F.lit(1026.8)),
    )
    assert tuple(row.first()) == (
        "North at 0.0 MPH (0.0 KT)",
        "from the South at 10.0 gusting to 20.0 MPH (8.68976 KT gusting to 17.37952 KT)",
        "32.0 F (0.0 C)",
        "32.0 F (0.0C)",
        None,
        "1026.8 mb",
    )


def test_text(values):
    assert values(X.station_of_url, "https://x/xml/current_obs/KDCA.xml", "https://x/KDCA.html", None) == ["KDCA", None, None]
    assert values(X.strip_update_prefix, "Last Updated on Jan 29 2021, 8:52 am EST") == ["Jan 29 2021, 8:52 am EST"]
    assert values(X.without_token, "<no_value_provided>", " ", "5") == [None, None, "5"]
    assert values(lambda c: X.html_row(c), "a<b&c", None) == [
        "<tr><td>a&lt;b&amp;c</td></tr>",
        "<tr><td>&lt;no_value_provided&gt;</td></tr>",
    ]
    assert X.column_name(' "collection time" ') == "collection_time"

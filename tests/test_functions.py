import pandas as pd
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sluice.functions import dates, geo, links, similarity, text


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("name, want", [("The New Tower - Phase Two", "tower 2"), ("Re-Bid: Library of Art", "re library art"), (None, ""), ("", "")])
def test_normal_names(spark, name, want):
    assert one(spark, text.normalize_name(F.lit(name).cast("string"))) == want


def test_names_and_domains(spark):
    assert one(spark, text.name_tokens(F.lit("Riverside medical tower med"))) == ["riverside", "medical", "tower"]
    assert one(spark, text.normalize_domain(F.lit("Bids@WWW.Acme.com "))) == "acme.com"
    assert one(spark, text.organisation_core(F.lit("Acme Builders, Inc."))) == "acme"


def test_messages(spark):
    assert one(spark, text.trim_quoted(F.lit("yes\nOn Monday Bob wrote:\n> hi"))) == "yes"
    assert one(spark, text.excerpt(F.lit("a " * 200))).endswith("…")
    assert one(spark, text.content_hash(F.lit("Fwd: Hello"), F.lit("A  b"))) == one(spark, text.content_hash(F.lit("hello"), F.lit("a b")))
    assert one(spark, text.html_to_text(F.lit('<p>a <a href="http://x.y">b</a></p><script>z</script>'))) == "a b (http://x.y)"
    assert one(spark, text.stated_range(F.lit("cost $1.2 - 1.5 million now"))) == "$1.2 - 1.5 million"
    assert one(spark, text.location_label(F.lit("attachment:Specs: A.pdf:p03"))) == "attachment:Specs: A.pdf:p3"
    assert one(spark, text.location_label(F.lit("Specs.pdf page 3"))) is None and one(spark, text.location_label(F.lit(" Body "))) == "body"


def test_removals_and_awards(spark):
    items = F.array(F.lit("lighting"), F.lit("site_lighting"), F.lit("fire_alarm"))
    assert one(spark, text.removed_items(F.lit("Site lighting is deleted. Fire alarm stays."), items)) == ["site_lighting"]
    assert one(spark, text.award_outcome(F.lit("The project is cancelled, congratulations"))) == "cancelled"
    assert one(spark, text.award_outcome(F.lit("We are pleased to award you the contract"))) == "won"
    assert one(spark, text.award_outcome(F.lit("We regret to inform you"))) == "lost"
    assert one(spark, text.award_outcome(F.lit("You have been selected"))) is None
    assert one(spark, text.award_outcome(F.lit("Pleased to inform you that it was awarded to another"))) is None


def test_zones_beyond_home(spark):
    anchor = F.lit("2026-09-30 10:30:00").cast("timestamp")
    assert one(spark, dates.parse_local(F.lit("2026-01-05T09:00"), F.lit("Europe/London"), anchor)["ts"]) == datetime(2026, 1, 5, 9)


@pytest.mark.parametrize("line", ["short", "x" * 75, "x" * 76, "é" * 200, "SUMMARY:" + "日本" * 60])
def test_folded_lines(spark, line):
    got = one(spark, text.ics_fold(F.lit(line)))
    assert got.replace("\r\n ", "") == line and all(len(x.encode()) <= 75 for x in got.split("\r\n"))


def test_noise(spark):
    noise = lambda subject, body: one(spark, text.bid_noise(F.lit(subject), F.lit(body), F.lit(0), F.lit(0)))
    assert noise("Member newsletter", "Fees are due on Friday, please send them in by then, thanks.") and not noise("Newsletter", "You are invited to bid on the tower")
    assert noise("hi", "short") and not noise("hi", "a body that is long enough to be worth a look at")


@pytest.mark.parametrize("value, want", [
    ("weekday:fri@12:00", datetime(2026, 10, 2, 12)), ("2026-10-05", datetime(2026, 10, 5)), ("2026-10-05T14:30", datetime(2026, 10, 5, 14, 30)),
    ("01-05", datetime(2027, 1, 5)), ("9/29", datetime(2026, 9, 29)), ("2026-02-29", None), ("soon", None),
])
def test_date_grammars(spark, value, want):
    anchor = F.lit("2026-09-30 10:30:00").cast("timestamp")
    assert one(spark, dates.parse_local(F.lit(value), F.lit("UTC"), anchor)["ts"]) == want


def test_zones_and_phrases(spark):
    anchor = F.lit("2026-09-30 10:30:00").cast("timestamp")
    assert one(spark, dates.parse_local(F.lit("2026-01-05T09:00"), F.lit("Mars/Base"), anchor)["ts"]) == datetime(2026, 1, 5, 14)
    assert one(spark, dates.due_phrase(F.lit(1.5))) == "due in 1 day"
    assert one(spark, dates.trigger_text(F.lit(26))) == "-P1DT2H"


def test_links(spark):
    assert one(spark, links.harvest(F.lit("see https://a.b/c. and https://a.b/c, http://d.e/f"))) == ["https://a.b/c", "http://d.e/f"]
    assert one(spark, links.unwrap(F.lit("https://x.safelinks.protection.outlook.com/?url=https%3A%2F%2Fa.b%2Fc&d=1"))) == "https://a.b/c"
    assert one(spark, links.host_class(F.lit("files.box.com"))) == "box"
    assert one(spark, links.platform_id(F.lit("https://app.procore.com/1/projects/77"))) == "procore:77"


def bisected(lat, lon, length=6):
    bounds, out = [[-180.0, 180.0], [-90.0, 90.0]], ""
    for i in range(length):
        n = 0
        for j in range(5):
            k = (5 * i + j) % 2
            v, (low, high) = (lon, lat)[k], bounds[k]
            up = v > (low + high) / 2
            bounds[k] = [(low + high) / 2, high] if up else [low, (low + high) / 2]
            n = 2 * n + up
        out += "0123456789bcdefghjkmnpqrstuvwxyz"[n]
    return out


@pytest.mark.parametrize("lat, lon", [(40.3462, -79.9482), (0.0, 0.0), (90.0, 180.0), (-90.0, -180.0), (45.0, -90.0), (-33.9, 151.2)])
def test_geohash(spark, lat, lon):
    assert one(spark, geo.geohash(F.lit(lat), F.lit(lon))) == bisected(lat, lon)


def test_geohash_without_a_point(spark):
    assert one(spark, geo.geohash(F.lit(None).cast("double"), F.lit(1.0))) == ""


def test_ratios():
    assert similarity.indel_ratio("abc", "abd") == pytest.approx(2 * 2 / 6)
    assert similarity.token_set_ratio("tower north", "north tower annex") == 1.0
    assert similarity.token_set_ratio("alpha", "omega") < 0.6


def test_lcs_by_brute_force():
    import random

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rnd = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 12))) for _ in "xy")
        if a or b:
            assert similarity.indel_ratio(a, b) == pytest.approx(2 * lcs(a, b) / (len(a) + len(b)))


def test_ratios_of_many_pairs():
    """Many pairs at once have the ratios that each has alone."""
    rnd = random.Random(3)
    text = lambda: " ".join("".join(rnd.choice("abcé1") for _ in range(rnd.choice([0, 1, 3, 9, 40]))) for _ in range(rnd.randint(1, 3)))
    a, b = [text() for _ in range(600)], [text() for _ in range(600)]
    b[:50], a[50:60] = a[:50], ["x" * 64, "y" * 65, "\0", "\0a", "", " ", "ab" * 32, "ab" * 33, "é" * 64, "z"]
    b[50:60] = ["x" * 64, "y" * 65, "\0", "a", "", "a", "ba" * 32, "ba" * 33, "é" * 63, "z" * 64]
    assert similarity.indel_ratios(a, b, rows=100).tolist() == [similarity.indel_ratio(x, y) for x, y in zip(a, b)]
    want = [max(similarity.token_set_ratio(x, y), similarity.indel_ratio(x, y)) if x and y else 0.0 for x, y in zip(a, b)]
    assert similarity._of_known(pd.Series(a), pd.Series(b), similarity._name_ratios).tolist() == pytest.approx(want)


@pytest.mark.parametrize("html, want", [
    ("a &amp; b", "a & b"), ("&#65;&#x42;&#X1F642;", "AB\U0001F642"), ("&amp;#39;", "&#39;"), ("&#38;lt;", "&lt;"), ("&#0;&#xD800;&#1114112; & &unknown; &", "&#0;&#xD800;&#1114112; & &unknown; &"), ("", ""), ("&lt;&gt;&quot;&apos;&nbsp;x", "<>\"' x"),
])
def test_entities_in_one_pass(spark, html, want):
    assert one(spark, text.unescape(F.lit(html))) == want

import ipaddress
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from iocweave.functions import base, feedmap, ip, norm
from iocweave.operators import score

NOW = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


def values(spark, rows, fn, schema="v string"):
    df = spark.createDataFrame([(i, *((r,) if not isinstance(r, tuple) else r)) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[1] for r in sorted(df.select("i", fn).collect())]


NORMALISE = [
    ("192.168.1.1", "ip-dst", None), ("127.0.0.1", "ip-dst", None), ("169.254.1.1", "ip-dst", None), ("224.0.0.1", "ip-dst", None),
    ("8.8.8.8", "ip-dst", "8.8.8.8"), ("100.64.0.1", "ip-dst", "100.64.0.1"), ("192.0.0.9", "ip-dst", "192.0.0.9"),
    ("192.0.0.8", "ip-dst", None), ("198.18.0.1", "ip-dst", None), ("01.2.3.4", "ip-dst", None), ("240.0.0.1", "ip-dst", None),
    ("2001:4860:4860:0:0:0:0:8888", "ip-dst", "2001:4860:4860::8888"), ("::1", "ip-dst", None),
    ("a" * 31, "md5", None), ("d" * 32, "md5", "d" * 32), ("z" * 32, "md5", None), ("d41d8cd98f00b204e9800998ecf8427e", "md5", None),
    ("e" * 64, "sha256", "e" * 64), ("A" * 64, "sha256", "a" * 64), ("f" * 39, "sha1", None), ("f" * 40, "sha1", "f" * 40),
    ("EVIL.COM", "domain", "evil.com"), ("www.evil.com", "domain", "evil.com"), ("localhost", "domain", None),
    ("server.local", "domain", None), ("example.com", "domain", None), ("a.example.com", "domain", "a.example.com"),
    ("evil.com.", "domain", "evil.com"), ("a.b", "domain", None), ("a" * 250 + ".com", "domain", None),
    ("ftp://evil.com/bad", "url", None), ("https://evil.com/bad", "url", "https://evil.com/bad"),
    (" http://evil.com/payload.exe ", "url", "http://evil.com/payload.exe"), ("http:///x", "url", None), ("HTTP://evil.com", "url", None),
    ("Bad@evil.com", "email-src", "bad@evil.com"), ("notanemail", "email-src", None), ("a@b.c", "email-src", None),
    (" x.exe ", "filename", " x.exe "), (" x ", "filename", None), ("", "url", None), ("   ", "domain", None), ("x", "cidr", None),
]


def test_normalise(spark):
    got = values(spark, [(v, t) for v, t, _ in NORMALISE], norm.normalise(F.col("v"), F.col("t")), "v string, t string")
    assert got == [e for *_, e in NORMALISE]


def test_ip_against_standard_library(spark):
    rnd = random.Random(5)
    texts = ["::", "::ffff:1.2.3.4", "64:ff9b::1.2.3.4", "fe80::1%eth0", "2620::1%z", "2620::1%", "1:2:3:4:5:6:7::", ":1:2:3:4:5:6:7",
             "1:::2", "::1.2.3.256", "2620:0:0:1:0:0:0:1", "2620:0:0:1:1:0:0:1", "1.2.3", "1.2.3.4\n", "", "2001:20::5", "2001:1::1"]
    for _ in range(600):
        texts.append(":".join(rnd.choice(["0", "0", "1", "ab", "ffff", "00ab", "2001", "12345", "g", "", "2620"]) for _ in range(rnd.choice([3, 7, 8, 8, 9]))))
        texts.append(str(ipaddress.IPv6Address((0x2001 << 112) | rnd.getrandbits(rnd.choice([20, 60, 112])))))
        texts.append(str(ipaddress.IPv4Address(rnd.getrandbits(32))))

    def expected(t):
        try:
            a = ipaddress.ip_address(t)
        except ValueError:
            return None, False
        bad = a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_reserved or a.is_unspecified
        return None if bad else str(a), bad

    assert values(spark, texts, ip.normalise_ip(F.col("v"))) == [expected(t)[0] for t in texts]
    assert values(spark, texts, ip.is_private_ip(F.col("v"))) == [expected(t)[1] for t in texts]


def test_candidate_rule_differs_from_indicator_rule(spark):
    texts = ["198.18.0.1", "10.0.0.1", "172.16.0.5", "300.1.1.1", "0.0.0.0", "0.0.0.1", "localhost", "abc", "240.0.0.1", "x.com"]
    got = values(spark, texts, ip.valid_candidate(F.col("v")))
    assert got == [True, False, False, True, False, True, False, False, False, True]


def test_hosts_and_types(spark):
    urls = ["http://evil.com/path", "not-a-url", "https://u:p@Evil.com:8443/x", "http://[2620::1]/", "http://localhost/a"]
    assert values(spark, urls, norm.host_from_url(F.col("v"))) == ["evil.com", None, "evil.com", None, None]
    texts = ["1.2.3.4", "2620::1", "a" * 64, "b" * 32, "https://x", "evil.com", "two words.com", "f" * 40]
    assert values(spark, texts, norm.infer_ioc_type(F.col("v"))) == ["ip-dst", "ip-dst", "sha256", "md5", "url", "domain", None, None]


def test_feed_times(spark):
    texts = ["2024-01-15 10:00:00", "2024-01-15T10:00:00", "2024-1-5", "2024-01-15 10:00:00 UTC", "", "2024-13-01"]
    now = datetime(2024, 1, 31)
    assert values(spark, texts, feedmap.parse_feed_datetime(F.col("v"), NOW)) == [
        datetime(2024, 1, 15, 10), datetime(2024, 1, 15, 10), datetime(2024, 1, 5), now, now, now]
    texts = ["2024-01-15T10:00:00+02:00", "2024-01-15T10:00:00Z", "2024-01-15", "15/01/2024", "2024-01"]
    assert values(spark, texts, feedmap.parse_iso_drop_tz(F.col("v"))) == [
        datetime(2024, 1, 15, 10), datetime(2024, 1, 15, 10), datetime(2024, 1, 15), None, None]


def test_pulse_confidence(spark):
    texts = [None, '"feed"', '{"indicator_count":250}', '{"x":1}', '{"indicator_count":-3}']
    got = values(spark, texts, feedmap.otx_confidence(F.parse_json(F.col("v"))))
    assert got == [50, 70, 100, 50, 0]


@pytest.mark.parametrize("digits", [1, 2])
def test_rounding_is_that_of_the_binary_value(spark, digits):
    rnd = random.Random(2)
    numbers = [15.075, 2.675, 0.125, 0.375, 38.5, 99.995, 0.0, 100.0] + [round(rnd.uniform(0, 100), 3) for _ in range(400)]
    got = values(spark, numbers, base.round_exact(F.col("v"), digits), "v double")
    assert got == [round(x, digits) for x in numbers]


def test_recency_bounds(spark):
    hours = [0, 24, 24.001, 72, 72.001, 168, 444, 720, 721]
    last = F.expr("timestamp_ntz'2024-01-31 00:00:00' - make_dt_interval(0, 0, 0, v * 3600)")
    got = values(spark, [float(h) for h in hours], F.round(score.recency_score(last, NOW), 4), "v double")
    assert got == [100.0, 100.0, 90.0, 90.0, 75.0, 75.0, 37.5, 0.0, 0.0]


def test_score_and_signal(spark):
    row = spark.createDataFrame([(["apt28", "Emotet", "conti", "fin7"], [])], "a array<string>, b array<string>")
    assert row.select(score.tag_signal(F.col("a")), score.tag_signal(F.col("b"))).first() == (20.0, 0.0)
    s = score.threat_score(F.lit("otx"), F.lit("ip-dst"), F.lit("unknown"), F.lit(75), NOW, F.col("b"), NOW)
    assert row.select(s).first()[0] == 38.16

"""Text functions by hand."""

import pytest

from tidemark.functions import parameters, text

DAY = 86_400_000_000


@pytest.mark.parametrize(
    ("said", "micros"),
    [
        ("1970-01-02", DAY), (" 1970-01-02T00:01 \n", DAY + 60_000_000), ("1970-01-02 00:00:00.5Z", DAY + 500_000), ("1970-01-02 00:00:00 UTC", DAY), ("1970-01-02 00:00:00+0130", DAY - 5_400_000_000), ("1970-01-02 00:00-01:30", DAY + 5_400_000_000),
        ("1970-01-02 00:00:00+99", DAY - 99 * 3_600_000_000), ("1970-02-30", None), ("1970-01-01 24:00", None), ("1970-01-01 00:00:60", None), ("1970-01-01 00", None), ("0000-01-01", None), ("", None), (None, None), ("1970-01-01 00:00:00 CET", None),
    ],
)
def test_event_micros(spark, said, micros):
    df = spark.createDataFrame([(said,)], "s string")
    assert df.select(text.event_micros(df.s)).first()[0] == micros


def test_slug(spark):
    df = spark.createDataFrame([("Prod DB #1!",), ("--a_b--",), ("é",), ("",), (None,), ("x" * 70,)], "s string")
    assert [r[0] for r in df.select(text.slug(df.s)).collect()] == ["prod-db-1", "a_b", "cluster", "cluster", "cluster", "x" * 60]


def test_parameters(spark):
    said = [
        ('{"source": "agent", "hosts": ["a", {"path": "b"}, ["c"], 1], "x": "/kept"}', '{"source":"agent","hosts":["(hidden)",{"path":"(hidden)"},["c"],1],"x":"/kept"}'), ('{"source": ["agent"]}', '{"source":["(hidden)"]}'),
        ('{"offsite": {"access_key": "", "secret_key": "s"}, "steps": {"into": {"password": "kept"}}, "into": "p"}', '{"offsite":{"access_key":"","secret_key":"•••"},"steps":{"into":{"password":"kept"}},"into":"p"}'), ("[null, 1.5, \"é\"]", '[null,1.5,"é"]'), ("{", None), (None, None),
    ]
    df = spark.createDataFrame(said, "said string, want string").coalesce(1)
    assert all(r.shown == r.want for r in df.select("want", parameters.shown(df.said).alias("shown")).collect())
    two = spark.createDataFrame([('{"b": [2, 1], "a": {"d": 1, "c": null}}',), ('{"a":{"c":null,"d":1},"b":[2,1]}',)], "s string")
    assert {r[0] for r in two.select(parameters.stable(two.s)).collect()} == {'{"a":{"c":null,"d":1},"b":[2,1]}'}

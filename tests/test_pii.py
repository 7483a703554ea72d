import re

import pytest
from conftest import by, rows

from tabassay.operators import pii

TEXTS = [
    (1, "mail A.B@x.org or c@d.net, call +1 (415) 555-0100"),
    (2, "ssn 123-45-6789 and card 4111 1111 1111 1111"),
    (3, "host 10.0.0.1 at HTTPS://Example.com/a?b=1#c"),
    (4, None),
    (5, "éa@b.com pays $5 \\ nothing"),
    (6, "card 4111111111111111"),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "id int, t string").repartition(3)


def test_scan_matches_python(texts):
    got = by(pii.scan(texts), "pattern")
    for name, pattern in pii.PATTERNS.items():
        found = [len(list(re.finditer(pattern, t, re.I))) for _, t in TEXTS if t]
        if sum(found):
            assert got[name]["n_matches"] == sum(found), name
            assert got[name]["n_rows"] == sum(f > 0 for f in found), name
        else:
            assert name not in got


def test_patterns_can_be_chosen(texts):
    assert [r["pattern"] for r in rows(pii.scan(texts, ["email", "unknown"]))] == ["email"]
    assert rows(pii.scan(texts, ["unknown"])) == []
    assert rows(pii.summarize(texts, ["unknown"]))[0]["risk_level"] == "none"


def test_redaction_order_and_null(texts):
    expected = {}
    for i, t in TEXTS:
        if t is not None:
            for pattern in pii.PATTERNS.values():
                t = re.sub(pattern, "[REDACTED]", t, flags=re.I)
        expected[i] = t
    assert {r["id"]: r["t"] for r in rows(pii.redact(texts))} == expected
    assert expected[6] == "card [REDACTED]111111"  # the phone pattern comes first


def test_nothing_is_left_after_redaction(texts):
    assert rows(pii.scan(pii.redact(texts))) == []


@pytest.mark.parametrize("replacement", ["$1", "\\", "a$b\\c", ""])
def test_replacement_is_literal(texts, replacement):
    got = {r["id"]: r["t"] for r in rows(pii.redact(texts, ["ssn"], replacement))}
    assert got[2].startswith(f"ssn {replacement} and card")


def test_log_counts_each_step_on_what_is_left(texts):
    log = by(pii.redaction_log(texts), "pattern")
    text = {i: t for i, t in TEXTS if t}
    for name, pattern in pii.PATTERNS.items():
        n = 0
        for i in text:
            text[i], k = re.subn(pattern, "[REDACTED]", text[i], flags=re.I)
            n += k
        assert (log[name]["n_redactions"] if name in log else 0) == n


def test_samples_keep_the_first_five(spark):
    data = [(i, f"a{i}@x.org b{i}@x.org " + "z" * 60) for i in range(20)]
    df = spark.createDataFrame(data, "id int, t string").repartition(6)
    got = rows(pii.samples(df, "id").orderBy("sample"))
    assert [(r["key"], r["position"], r["value"]) for r in got] == [
        (0, 0, "a0@x.org"), (0, 1, "b0@x.org"), (1, 0, "a1@x.org"), (1, 1, "b1@x.org"), (2, 0, "a2@x.org"),
    ]
    assert got[0]["context"].endswith("...") and len(got[0]["context"]) == 53


@pytest.mark.parametrize("n, level", [(0, "none"), (9, "low"), (10, "medium"), (99, "medium"), (100, "high")])
def test_risk_levels(spark, n, level):
    df = spark.createDataFrame([("10.0.0.1 " * n, "plain")], "t string, u string")
    got = rows(pii.summarize(df))[0]
    assert (got["risk_level"], got["total_matches"]) == (level, n)
    assert got["columns_affected"] == got["patterns_found"] == got["rows_affected"] == min(n, 1)


def test_gate(spark):
    risky = spark.createDataFrame([("10.0.0.1 " * 20,)], "t string")
    calm = spark.createDataFrame([("10.0.0.1",)], "t string")
    assert "10.0" not in rows(pii.gate(risky))[0]["t"]
    assert rows(pii.gate(calm))[0]["t"] == "10.0.0.1"
    assert "10.0" in rows(pii.gate(risky, "none"))[0]["t"]
    with pytest.raises(ValueError):
        pii.gate(risky, "block")
    with pytest.raises(ValueError):
        pii.gate(risky, "burn")


def test_column_names(spark):
    df = spark.createDataFrame([(1, 1, 1, 1)], "user_SSN int, lastname int, page int, n int")
    got = by(pii.personal_names(df), "column")
    assert {c: (r["keyword"], r["risk_level"]) for c, r in got.items()} == {
        "user_SSN": ("ssn", "high"),
        "lastname": ("name", "medium"),
        "page": ("age", "medium"),
    }


def test_redaction_runs_on_a_stream(spark, texts, tmp_path):
    texts.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(texts.schema).parquet(str(tmp_path / "in"))
    job = pii.redact(stream).writeStream.format("memory").queryName("redacted_texts").start()
    try:
        job.processAllAvailable()
    finally:
        job.stop()
    got = sorted(map(str, rows(spark.table("redacted_texts"))))
    assert got == sorted(map(str, rows(pii.redact(texts))))

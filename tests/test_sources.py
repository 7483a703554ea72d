import pytest
from conftest import rows

from tabassay import sources


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_types_and_missing_tokens(spark, tmp_path):
    path = write(
        tmp_path / "a.csv",
        "id,x,flag,when,mixed,empty\n1,1.5,True,2024-01-02,7,\n2,NA,False,2024-01-03,n/a,\n3,nan,True,null,x,\n",
    )
    df = sources.read_csv(spark, [path])
    assert [f.dataType.simpleString() for f in df.schema.fields] == [
        "bigint", "double", "boolean", "string", "string", "double",
    ]
    got = rows(df.orderBy("id"))
    assert got[1]["x"] is None and got[2]["x"] is None and got[0]["x"] == 1.5
    assert [r["when"] for r in got] == ["2024-01-02", "2024-01-03", None]
    assert [r["mixed"] for r in got] == ["7", None, "x"]


def test_csv_cells_may_span_lines(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id,text\n1,"two\nlines"\n2,"say ""hi"""\n')
    got = rows(sources.read_csv(spark, [path], multi_line=True).orderBy("id"))
    assert [r["text"] for r in got] == ["two\nlines", 'say "hi"']


def test_csv_files_are_matched_by_name(spark, tmp_path):
    a = write(tmp_path / "a.csv", "id,x\n1,10\n")
    b = write(tmp_path / "b.csv", "y,id\nq,2\n")
    got = rows(sources.read_csv(spark, [a, b]).orderBy("id"))
    assert got == [{"id": 1, "x": 10, "y": None}, {"id": 2, "x": None, "y": "q"}]


def test_bad_sources_raise(spark, tmp_path):
    with pytest.raises(ValueError):
        sources.read_csv(spark, [])
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sources.read_csv(spark, [str(tmp_path / "none.csv")])
    with pytest.raises(ValueError, match="Unknown table"):
        sources.read_table(spark, "/tmp", "nothing")
    with pytest.raises(ValueError):
        sources.concat_tables([])


def test_catalog_names_real_columns(spark, sf):
    for name, info in sources.CATALOG.items():
        columns = sources.read_table(spark, sf, name).columns
        assert set(info.keys) <= set(columns)
        assert info.target is None or info.target in columns


def test_fingerprint_ignores_order_and_sees_content(spark):
    data = [(i, f"t{i}", None if i % 3 else float(i)) for i in range(500)]
    make = lambda d: spark.createDataFrame(d, "a int, b string, c double")
    base = sources.fingerprint(make(data), "t").first()
    assert sources.fingerprint(make(data[::-1]).repartition(7), "t").first() == base
    assert sources.fingerprint(make([*data, data[0]]), "t").first()["fingerprint"] != base["fingerprint"]
    changed = [*data[:250], (250, "other", 1.0), *data[251:]]
    assert sources.fingerprint(make(changed), "t").first()["fingerprint"] != base["fingerprint"]
    assert sources.fingerprint(make(data), "u").first()["fingerprint"] != base["fingerprint"]
    assert sources.fingerprint(make([]), "t").first()["n_rows"] == 0


def test_sinks_round_trip_and_prune(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "val"), (3, "test")], "id int, split string")
    path = sources.write_splits(df, str(tmp_path / "s"))
    back = sources.load_table(spark, path).where("split = 'val'")
    assert "PartitionFilters: [isnotnull(split" in back._jdf.queryExecution().toString()
    assert [r["id"] for r in back.collect()] == [2]
    for fmt in ("parquet", "json", "csv", "orc"):
        out = sources.write_table(df, str(tmp_path / fmt), fmt)
        assert spark.read.format(fmt).load(out).count() >= 3

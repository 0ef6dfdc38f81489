"""The CSV scan against pandas on the same files."""

import io

import numpy as np
import pandas as pd
import pytest

from conftest import rows
from reviewmill.sources import csv_records
from reviewmill.sources.csv_files import FILE, drop_empty_columns, scan_csv

DIRTY = ('id,Review Text,stars,blank\n1,"nice, really",5,\n2,short\n3,long,1,,more\n4,long,2,,\n'
         '5,"two ""quotes""",3,\n\n6,"line\nbreak",4,\n7,n/a,NA,\n   \n8,ok,2,\n')


def pandas_rows(raw: str, sep: str):
    skipped = []
    table = pd.read_csv(io.StringIO(raw), sep=sep, engine="python", dtype=str,
                        on_bad_lines=lambda line: skipped.append(line))
    table = table.dropna(axis=1, how="all")
    values = [tuple(None if pd.isna(v) else v for v in row) for row in table.itertuples(index=False)]
    return list(table.columns), values, len(skipped)


@pytest.fixture
def folder(tmp_path):
    return tmp_path


@pytest.mark.parametrize("sep,name", [(",", "comma"), (";", "semicolon"), ("\t", "tab"), ("|", "pipe")])
def test_dirty_file_reads_like_pandas(spark, folder, sep, name):
    raw = DIRTY.replace("nice, really", "nice really").replace(",", sep)
    (folder / "a.csv").write_text(raw, encoding="utf-8")
    scan = scan_csv(spark, str(folder))
    names, values, skipped = pandas_rows(raw, sep)
    info = scan.info.first()
    assert (info["encoding"], info["delimiter"], info["rows"], info["rows_skipped"], info["error"]) == (
        "utf-8-sig", name, len(values), skipped, None)
    assert scan.rows.columns == [FILE, *names]
    assert sorted(rows(scan.rows.drop(FILE)), key=str) == sorted(values, key=str)


def test_quoted_delimiters(spark, folder):
    (folder / "a.csv").write_text(DIRTY, encoding="utf-8")
    scan = scan_csv(spark, str(folder))
    names, values, skipped = pandas_rows(DIRTY, ",")
    assert scan.info.first()["rows_skipped"] == skipped == 2
    assert sorted(rows(scan.rows.drop(FILE)), key=str) == sorted(values, key=str)


def test_encodings(spark, folder):
    body = "id;review\n1;“smart” café – €5\n2;plain\n"
    (folder / "utf8.csv").write_bytes(body.encode("utf-8"))
    (folder / "bom.csv").write_bytes(body.encode("utf-8-sig"))
    (folder / "cp1252.csv").write_bytes(body.encode("cp1252"))
    (folder / "latin.csv").write_bytes("id;review\n1;caf\xe9 \x81\n2;plain\n".encode("latin-1"))
    scan = scan_csv(spark, str(folder))
    info = {r[FILE].rsplit("/", 1)[1]: r for r in scan.info.collect()}
    assert {k: v["encoding"] for k, v in info.items()} == {
        "utf8.csv": "utf-8-sig", "bom.csv": "utf-8-sig", "cp1252.csv": "cp1252", "latin.csv": "latin-1"}
    assert {v["delimiter"] for v in info.values()} == {"semicolon"}
    got = {(r[FILE].rsplit("/", 1)[1], r["id"]): r["review"] for r in scan.rows.collect()}
    for name in ("utf8.csv", "bom.csv", "cp1252.csv"):
        assert got[(name, "1")] == "“smart” café – €5"
    assert got[("latin.csv", "1")] == "caf\xe9 \x81"
    assert len(got) == 8


def test_empty_and_header_only_files(spark, folder):
    (folder / "blank.csv").write_text("\n  \n")
    (folder / "header.csv").write_text("id,review\n")
    (folder / "good.csv").write_text("id,review\n1,fine\n")
    info = {r[FILE].rsplit("/", 1)[1]: r["error"] for r in scan_csv(spark, str(folder)).info.collect()}
    assert info == {"blank.csv": "The file holds no text.", "good.csv": None,
                    "header.csv": "No row of the file could be used."}


def test_only_blank_files(spark, folder):
    (folder / "blank.csv").write_text("\n")
    scan = scan_csv(spark, str(folder))
    assert scan.rows is None
    assert scan.info.first()["error"] == "The file holds no text."


def test_headers_united_by_name_and_repeats_told_apart(spark, folder):
    (folder / "a.csv").write_text("id,text,text\n1,x,y\n")
    (folder / "b.csv").write_text("text,id,more\nz,2,m\n")
    scan = scan_csv(spark, str(folder))
    got = {r["id"]: (r["text"], r["text.1"], r["more"]) for r in scan.rows.select(
        "id", "text", "`text.1`", "more").collect()}
    assert got == {"1": ("x", "y", None), "2": ("z", None, "m")}


def test_drop_empty_columns(spark):
    df = spark.createDataFrame([(1, None, None), (None, "a", None)], "a int, b string, c string")
    assert drop_empty_columns(df).columns == ["a", "b"]


def big_rows(n, seed=7):
    import random
    rng = random.Random(seed)
    words = ["plain", 'with ""two"" quotes', "a,b", "line\nbreak", "two\n\nbreaks", "crlf\r\nin it", '""', "", "  x ", 'say ""hi""\n,"']
    out = []
    for i in range(n):
        cell = rng.choice(words)
        quoted = any(c in cell for c in ',"\n\r')
        body = cell[:-1] + '""' if cell.endswith(',"') else cell
        fields = [str(i), f'"{body}"' if quoted else body, str(i % 5)]
        if i % 41 == 0:
            fields = fields[:1]
        if i % 53 == 0:
            fields += ["more"]
        out.append(",".join(fields))
        if i % 97 == 0:
            out.append("")
    return out


@pytest.mark.parametrize("split,ending", [("200", "\n"), ("1000", "\r\n"), ("1m", "\n")])
def test_quoted_line_breaks_are_read_by_many_tasks(spark, folder, split, ending):
    raw = "id,text,stars\n".replace("\n", ending) + ending.join(big_rows(700)) + ending
    (folder / "a.csv").write_bytes(raw.encode())
    (folder / "b.csv").write_bytes(raw.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1m" if split == "1m" else "1")
    try:
        scan = scan_csv(spark, str(folder))
        got = sorted((tuple(r) for r in scan.rows.drop(FILE).collect()), key=str)
        lines = csv_records._lines(spark, [str(folder / "a.csv"), str(folder / "b.csv")], ",", False)
        tasks = csv_records.split_maps(lines).count()
    finally:
        for name, value in zip(("maxPartitionBytes", "openCostInBytes"), before):
            spark.conf.set(f"spark.sql.files.{name}", value)
    skipped = []
    table = pd.read_csv(io.StringIO(raw, newline=""), engine="python", dtype=str, lineterminator=None,
                        on_bad_lines=lambda line: skipped.append(line))
    want = sorted([tuple(None if pd.isna(v) else v for v in row) for row in table.itertuples(index=False)] * 2, key=str)
    assert got == want
    assert {r["rows_skipped"] for r in scan.info.collect()} == {len(skipped)}
    assert tasks == 2 if split == "1m" else tasks > 10


def test_line_states_compose():
    import random
    rng = random.Random(1)
    kinds = [(0, 1), (1, 0), (0, 0), (1, 1)]
    for _ in range(200):
        lines = [rng.choice(kinds) for _ in range(rng.randint(1, 9))]
        a, b = np.array([x for x, _ in lines]), np.array([x for _, x in lines])
        for start in (0, 1):
            want = [start]
            for line in lines:
                want.append(line[want[-1]])
            assert csv_records.states(a, b, start).tolist() == want


def test_a_split_is_read_in_pieces():
    import pyarrow as pa
    n = 5000
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["a"] * (n - 10) + ["b"] * 10), pa.array([0] * n, pa.int64()), pa.array([str(i) for i in range(n)])],
        names=[FILE, "_block", "_text"])
    parts = list(csv_records._pieces(iter([batch, batch])))
    assert max(p.num_rows for _, p in parts) <= csv_records.LINES < n
    assert [t for _, p in parts for t in p.column("_text").to_pylist()] == [str(i) for i in range(n)] * 2
    assert {k for k, _ in parts} == {("a", 0), ("b", 0)}


def test_files_with_a_header_are_written_without_python(spark, folder, monkeypatch):
    from pyspark.sql import DataFrame
    from reviewmill.plans import catalog
    monkeypatch.setattr(DataFrame, "mapInPandas", None, raising=False)
    lines = spark.range(0, 40, 1, 4).selectExpr("'h1,h2' as header", "concat(id, ',x') as value").where("value < '3'")
    catalog._headed(lines, str(folder / "out"))
    files = [p.read_text().splitlines() for p in (folder / "out").glob("part-*")]
    files = [f for f in files if f]
    assert all(f[0] == "h1,h2" and "h1,h2" not in f[1:] for f in files)
    assert sorted(x for f in files for x in f[1:]) == sorted(f"{i},x" for i in range(40) if f"{i},x" < "3")

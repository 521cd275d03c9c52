"""CSV records over many splits against Python's csv module."""

import csv
import random

import pytest

from triagelens.sources import tickets
from triagelens.sources.records import csv_records, read_csv_records
from triagelens.sources.tickets import CSV_OPTIONS


def table(n=400, seed=4):
    draw = random.Random(seed)
    pieces = ["plain", "two\nlines", 'a "quoted" word', "comma, here", "\u00e9\u4e2d", '"', "\n\n", "x" * 30, '",\n"', " "]
    rows = [[str(i), "".join(draw.choices(pieces, k=draw.randint(1, 6))), draw.choice(["Low", "High"])] for i in range(n)]
    rows[7][1] = "long\n" * 900  # crosses several splits
    return rows


def written(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as out:
        made = csv.writer(out, lineterminator=end, quoting=csv.QUOTE_ALL)
        made.writerow(["id", "a, \"b\"", "p"])
        made.writerows(rows)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("split", [257, 1024, 1 << 20])
def test_records_do_not_depend_on_splits(spark, tmp_path, end, split):
    rows = table()
    (tmp_path / "t").mkdir()
    written(tmp_path / "t" / "one.csv", rows[:300], end)
    written(tmp_path / "t" / "two.csv", rows[300:], end)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = read_csv_records(spark, str(tmp_path / "t"), CSV_OPTIONS)
        assert got.columns == ["id", 'a, "b"', "p"]
        assert sorted([list(r) for r in got.collect()]) == sorted(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_blank_lines_open_quotes_and_short_rows(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('h,i\n\n1,\n   \n"2","x\ny"\n3\n4,"open\nend')
    got = {r["record"] for r in csv_records(spark, str(path)).filter("not header").collect()}
    assert got == {"1,", '"2","x\ny"', "3", '4,"open\nend'}
    rows = {r["h"]: r["i"] for r in read_csv_records(spark, str(path), CSV_OPTIONS).filter("h < 4").collect()}
    assert rows == {"1": None, "2": "x\ny", "3": None}


def test_labelled_csv_is_compressed_in_files_of_bounded_length(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tickets, "CSV_RECORDS_PER_FILE", 100)
    texts = [f"line {i}\n" + " ".join(str(i * j) for j in range(200)) for i in range(450)]
    df = spark.createDataFrame([(i, t, "s. " + t, [t[:6], '"']) for i, t in enumerate(texts)],
                               "id int, d string, full_text string, k array<string>").coalesce(1)
    tickets.write_labeled(df, str(tmp_path / "t"), "csv")
    files = list((tmp_path / "t").glob("part-*"))
    assert len(files) == 5 and all(f.name.endswith(".csv.gz") for f in files)
    assert sum(f.stat().st_size for f in files) < sum(map(len, texts))  # of twice that many characters
    back = tickets.read_labeled(spark, str(tmp_path / "t"), df.schema, "csv")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))

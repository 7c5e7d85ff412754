"""Files whose records are not their lines, read by many tasks, against the readers that take a file whole."""

import csv
import io
import json
import random

import pytest
from tillview.sources import files, records


def place(tmp_path, name, *texts):
    """A folder with a file for each text; line ends stay as they are."""
    folder = tmp_path / name
    folder.mkdir()
    for i, text in enumerate(texts):
        (folder / f"part-{i}.txt").write_bytes(text.encode())
    return str(folder)


@pytest.fixture
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def cells(rng):
    parts = ["a", '"', "\n", ",", "é", " ", '""', "\n\n", "word", ";"]
    return "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 3, 8, 200])))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_with_line_breaks(spark, tmp_path, small_ranges, end):
    rng = random.Random(4)
    texts, want = [], []
    for k in range(3):
        rows = [(f"{k}-{i}", cells(rng), cells(rng)) for i in range(60)]
        rows.append((f"{k}-long", "line\n" * 400, '"'))  # over several ranges
        rows += [(f"{k}+{i}", "plain", "x") for i in range(20)]
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=end, quoting=csv.QUOTE_ALL)
        writer.writerow(["id", "one", "two"])
        writer.writerows(rows)
        texts.append(out.getvalue())
        want += rows
    path = place(tmp_path, "csv", *texts)
    df, bad = files.read_csv(spark, path)
    assert bad == 0 and df.columns == ["id", "one", "two"]
    assert sorted((r.id, r.one or "", r.two or "") for r in df.collect()) == sorted(want)
    assert spark.read.text(path).rdd.getNumPartitions() > 6
    whole = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    assert sorted(map(tuple, whole.fillna("").collect())) == sorted(map(tuple, df.fillna("").collect()))


def test_csv_quotes_inside_cells_and_open_ends(spark, tmp_path, small_ranges):
    body = "a,b\n" + '5" pipe,x\n' + 'y,"two\nlines"\n' + "\n  \n" + "".join(f'{i},"z\n{i}"\n' for i in range(50))
    df, bad = files.read_csv(spark, place(tmp_path, "q", body))
    assert bad == 0 and df.count() == 52 and df.where("a = '5\" pipe'").first()["b"] == "x"
    header = '"a\nb",c\n' + "".join(f'{i},"v\n{i}"\n' for i in range(30))
    df, _ = files.read_csv(spark, place(tmp_path, "h", header))
    assert df.columns == ["a\nb", "c"] and df.count() == 30
    df, _ = files.read_csv(spark, place(tmp_path, "open", 'a,b\n1,"x\ny"\n2,"never closed\n'), tolerance=1.0)
    assert df.count() == 2


def objects(rng, n):
    text = lambda: "".join(rng.choice(['"', "}", "{", "]", "[", "\\", "\n", "é", "x", ",", " "]) for _ in range(rng.randrange(12)))
    out = []
    for i in range(n):
        one = {"id": str(i), "t": text(), "in": {"deep": {"v": text()}, "list": [text(), text()]}}
        if i % 7 == 0:
            one["long"] = text() * 60
        out.append(one)
    return out


def key(df):
    return sorted(tuple((c, r[c]) for c in sorted(df.columns) if r[c] is not None) for r in df.collect())


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("wrapped", [False, True])
def test_json_arrays(spark, tmp_path, small_ranges, indent, wrapped):
    rows = objects(random.Random(7), 80)
    shape = lambda x: json.dumps({"the \"data": x} if wrapped else x, indent=indent, ensure_ascii=False)
    path = place(tmp_path, "json", shape(rows), shape(objects(random.Random(8), 3)) + "\n")
    got = files.read_json(spark, path)
    lines = place(tmp_path, "lines", "\n".join(json.dumps(r) for r in rows + objects(random.Random(8), 3)))
    assert key(got) == key(files.read_json(spark, lines)) and got.count() == 83
    assert files._elements(spark, path, 2 if wrapped else 1) is not None


def test_json_that_is_no_plain_array(spark, tmp_path):
    one = place(tmp_path, "beside", '{\n"rows": [{"a": 1}, {"a": 2}],\n"count": 2}')
    assert files.read_json(spark, one).columns == ["count", "rows"]
    pretty = place(tmp_path, "pretty", '{\n"a": 1,\n"b": {"c": 2}\n}')
    assert files.read_json(spark, pretty).first().asDict() == {"a": "1", "b__c": "2"}
    with pytest.raises(files.InvalidStructure):
        files.read_json(spark, place(tmp_path, "mixed", '[{"a": 1}, 7, {"a": 2}]'))
    several = place(tmp_path, "several", '{"x": [{"a": 1}]}\n{"x": [{"a": 2}]}')
    assert sorted(r.a for r in files.read_json(spark, several).collect()) == ["1", "2"]


def test_scans():
    scan = records.csv_framing(";").scan
    assert scan('a;"b', False) == (True, 0) and scan('b";c', True) == (False, 0) and scan('b"";c', True) == (True, 0) and scan('a"b;c', False) == (False, 0)
    scan = records.json_framing(1).scan
    assert scan('[{"a": "x', False) == (True, 2) and scan('y"', True) == (False, -1) and scan('\\"', True) == (True, 0) and scan("]", False) == (False, -2)

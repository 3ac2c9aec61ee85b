"""Readers over byte ranges: quoted breaks and arrays cut at any place."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from assaylake.sources import readers as RD
from assaylake.sources.ranges import Brackets, Delimited, begins, _parts


@pytest.fixture
def small_ranges(spark):
    """Files are cut every few hundred bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in zip(names, ("300", "0", "1")):
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def texts(rng, n):
    parts = ['"', '""', ",", "\n", "\r\n", "a", "word ", "é", "中", "}", "{", "[", "]", "\\", '\\"', ":", "  "]
    return ["".join(rng.choice(parts) for _ in range(rng.choice([0, 3, 10, 40, 1500 if rng.random() < 0.1 else 5]))) for _ in range(n)]


def test_csv_with_quoted_breaks_in_many_ranges(spark, tmp_path, small_ranges):
    rng = random.Random(1)
    rows = [(k, t) for k, t in enumerate(texts(rng, 300))]
    for f in range(2):
        with open(tmp_path / f"f{f}.csv", "w", newline="", encoding="utf-8") as out:
            w = csv.writer(out, lineterminator="\r\n" if f else "\n")
            w.writerow(["id", "the\ntext"])
            w.writerows(rows[f::2])
    parts = _parts(spark, str(tmp_path), "\n")
    assert parts.rdd.getNumPartitions() > 20 and begins(parts, Delimited())  # some ranges begin inside a field
    got = {r["id"]: r["t"] for r in RD.read_csv(spark, str(tmp_path), "id long, t string").collect()}
    missing = {"NA", "NaN", "null"}
    assert got == {k: (t if t and t not in missing else None) for k, t in rows}
    inferred = RD.read_csv(spark, str(tmp_path))
    assert inferred.columns == ["id", "the\ntext"] and dict(inferred.dtypes)["id"] == "int" and inferred.count() == 300


def test_csv_edges(spark, tmp_path):
    cases = {
        "empty": (b"", []), "header": (b"a,b\n", []), "no break at the end": (b"a,b\n1,x", [(1, "x")]), "blank lines": (b"a,b\n\n1,x\n\n\n2,y\n", [(1, "x"), (2, "y")]),
        "one field over lines": (b'a,b\n1,"x\n\n\ny"\n', [(1, "x\n\n\ny")]), "mark of order": (b"\xef\xbb\xbfa,b\n3,z\n", [(3, "z")]), "short row": (b"a,b\n4\n", [(4, None)]),
    }
    for name, (data, want) in cases.items():
        path = tmp_path / f"{name}.csv"
        path.write_bytes(data)
        assert [tuple(r) for r in RD.read_csv(spark, str(path), "a int, b string").collect()] == want, name
    latin = tmp_path / "latin.csv"
    latin.write_bytes("a,b\n1,\"é\nü\"\n".encode("latin1"))
    assert RD.read_csv(spark, str(latin), "a int, b string", encoding="ISO-8859-1").collect()[0]["b"] == "é\nü"


@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays_in_many_ranges(spark, tmp_path, small_ranges, indent):
    rng = random.Random(2)
    rows = [{"id": k, "t": t, "deep": {"list": [{"x": k, "s": t[:5]}], "y": {"z": k}}} for k, t in enumerate(texts(rng, 150))]
    for f in range(2):
        (tmp_path / f"f{f}.json").write_text(json.dumps(rows[f::2], indent=indent, ensure_ascii=bool(f)), encoding="utf-8")
    parts = _parts(spark, str(tmp_path), "}")
    assert parts.rdd.getNumPartitions() > 20 and begins(parts, Brackets())
    got = RD.read_json(spark, str(tmp_path), lines=False)
    assert set(got.columns) == {"id", "t", "deep.list", "deep.y.z"}
    assert sorted((r["id"], r["t"], r["deep.y.z"], r["deep.list"][0]["s"]) for r in got.collect()) == [(r["id"], r["t"], r["id"], r["t"][:5]) for r in rows]
    given = RD.read_json(spark, str(tmp_path), "id long, t string", lines=False)
    assert given.count() == 150 and given.agg(F.sum("id")).first()[0] == sum(range(150))


def test_json_edges(spark, tmp_path):
    cases = {
        "empty": ("", []), "no rows": ("[]", []), "one object": ('{"a": 1}', [1]), "objects over lines": ('{"a":\n 1}\n{"a": 2}\n', [1, 2]),
        "space": (' \n[ {"a":1} ,\n\n {"a":2}\n ]\n\n', [1, 2]), "braces in strings": ('[{"s":"}{]\\"}","a":1},{"s":"\\\\","a":2}]', [1, 2]),
    }
    for name, (data, want) in cases.items():
        path = tmp_path / f"{name}.json"
        path.write_text(data)
        assert sorted(r["a"] for r in RD.read_json(spark, str(path), "a int, s string", lines=False).collect()) == want, name

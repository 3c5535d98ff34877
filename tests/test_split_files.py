import json

from quillon.sources import split_files as rows


def test_lines_of_json(spark, tmp_path):
    good = [{"content": f"text {i}", "n": i} for i in range(400)]
    lines = [json.dumps(x) for x in good]
    lines[7:7] = ["", "{broken" + "x" * 200]
    lines += ['{"text": "other"}', '{"content": 5, "text": "no"}', '{"content": " "}', "[1, 2]", '"words"', "null"]
    (tmp_path / "a.jsonl").write_bytes(("\r\n".join(lines) + "\r\n").encode())
    (tmp_path / "b.jsonl").write_text('{"content": "b"}\n\n{\n')
    (tmp_path / "c.txt").write_text("not read")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        read = rows.json_lines(spark, str(tmp_path), "*.jsonl")
        assert read.select("path", "split").distinct().count() > 3
        found = {(r.path[-7], r.line): r for r in rows.numbered(read, spark, str(tmp_path), "*.jsonl").select("path", "line", "text", "error", "start").collect()}
        assert {k for k in found if k[0] == "a"} == {("a", i) for i, x in enumerate(lines, 1) if x}
        for i, x in enumerate(lines, 1):
            if x.startswith('{"content": "text'):
                assert found["a", i].text == json.loads(x)["content"]
        n = len(lines)
        assert [found["a", i].text for i in range(n - 5, n + 1)] == ["other", None, None, None, None, None]
        bad = sorted((r.path[-7:], r.line, r.start) for r in rows.errors(spark, str(tmp_path), "*.jsonl").collect())
        assert bad == [("a.jsonl", 9, ("{broken" + "x" * 200)[:100]), ("b.jsonl", 3, "{")]
        profile = {r.path[-7]: r for r in rows.json_profile(read).collect()}
        a, b = profile["a"], profile["b"]
        assert (a.rows, a.errors, a.texts, a.shapes, a.consistent) == (406, 1, 401, 4, False)
        assert (b.rows, b.errors, b.texts, b.shapes, b.consistent) == (1, 1, 1, 1, True)
        first = [json.loads(r.value) for r in rows.first_rows(read).where("path like '%a.jsonl'").orderBy("place").collect()]
        assert first == good[:10]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_no_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n \n")
    read = rows.json_lines(spark, str(tmp_path))
    assert read.count() == 0 and rows.json_profile(read).count() == 0 and rows.errors(spark, str(tmp_path)).count() == 0


def test_delimiter():
    assert rows.delimiter(['a;b;"x,y,z"', "1;2,5;3"]) == ";"
    assert rows.delimiter(["a\tb", "1\t2"]) == "\t"
    assert rows.delimiter(["one", "1,2"]) == "," and rows.delimiter([]) == ","


def test_tables(spark, tmp_path):
    body = 'id|name|score|when|empty|a`b\n1|"x | ""y"""|1.5|2024-01-02||true\n2|z|2|2024-01-03||false\n2|z|2|2024-01-03||false\n3|w|||\n4|v|7|2024-02-01||true|more\n'
    (tmp_path / "t.csv").write_text(body)
    read = rows.table_rows(spark, str(tmp_path))
    got = read.collect()
    assert read.columns == ["id", "name", "score", "when", "empty", "a`b", "_faulty"]
    assert got[0].name == 'x | "y"' and [r.id for r in got if r._faulty] == ["3", "4"]
    assert rows.repeated_rows(read).first().duplicates == 1


def test_profile(spark):
    made = spark.createDataFrame(
        [("1", "x", "1.5", "2024-01-02", None, "true"), ("2", "y", "2", "2024-01-03", None, "false"), ("2", None, None, "2024-01-03", None, "true")], "id string, name string, score string, when string, empty string, flag string"
    )
    got = {r.column: (r.dtype, r.nulls, r.distinct_values, r.samples) for r in rows.table_profile(made, 1).collect()}
    assert got == {
        "id": ("bigint", 0, 2, ["1"]), "name": ("string", 1, 2, ["x"]), "score": ("double", 1, 2, ["1.5"]), "when": ("date", 0, 2, ["2024-01-02"]),
        "empty": ("string", 3, 0, []), "flag": ("boolean", 0, 2, ["false"]),
    }

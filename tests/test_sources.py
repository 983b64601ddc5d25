import os

import pytest

from quarry.sources import readers as R


def _write(d, name, data: bytes):
    p = os.path.join(d, name)
    with open(p, "wb") as f:
        f.write(data)
    return p


def test_csv_na_tokens_inference_and_dup_headers(spark, tmpdir_path):
    p = _write(tmpdir_path, "a.csv", b"a,b,a,flag,s\n1,2.5,x,True,hello\nNA,n/a,y,False,#N/A\n3,,z,True,ok\n")
    df = R.load(spark, p)
    assert df.columns == ["a", "b", "a.1", "flag", "s"]
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "a.1": "string", "flag": "boolean", "s": "string"}
    rows = df.collect()
    assert rows[1]["a"] is None and rows[1]["b"] is None and rows[1]["s"] is None and rows[2]["b"] is None


def test_csv_header_only_and_zero_byte(spark, tmpdir_path):
    h = R.load(spark, _write(tmpdir_path, "h.csv", b"x,y\n"))
    assert h.columns == ["x", "y"] and h.count() == 0
    z = R.load(spark, _write(tmpdir_path, "z.csv", b""))
    assert z.columns == [] and z.count() == 0


def test_encoding_sniff(spark, tmpdir_path):
    p = _write(tmpdir_path, "l.csv", "name,v\ncafé,1\n".encode("cp1252"))
    assert R.sniff_encoding(spark, p) == "ISO-8859-1"
    assert R.load(spark, p).first()["name"] == "café"
    u = _write(tmpdir_path, "u.csv", "name,v\ncafé,1\n".encode("utf-8"))
    assert R.sniff_encoding(spark, u) == "UTF-8"


def test_json_shapes(spark, tmpdir_path):
    lines = _write(tmpdir_path, "l.json", b'{"a": 1, "b": "x"}\n{"a": 2, "b": "y"}\n')
    arr = _write(tmpdir_path, "a.json", b'[\n {"a": 1, "b": "x"},\n {"a": 2, "b": "y"}\n]\n')
    one = _write(tmpdir_path, "o.json", b'[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]')
    cols = _write(tmpdir_path, "c.json", b'{\n "a": {"0": 1, "1": 2},\n "b": {"0": "x", "1": "y"}\n}\n')
    for p in (lines, arr, one, cols):
        df = R.load(spark, p)
        assert df.count() == 2 and "_corrupt_record" not in df.columns, p
        assert sorted(r["a"] for r in df.collect()) == [1, 2]


def _xlsx(path, sheets):
    """Write a minimal .xlsx: sheets = list of row lists (first sheet first)."""
    import zipfile

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shared, idx = [], {}

    def cell(ref, v):
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v}</v></c>'
        if isinstance(v, tuple):  # inline string
            return f'<c r="{ref}" t="inlineStr"><is><t>{v[0]}</t></is></c>'
        if v not in idx:
            idx[v] = len(shared)
            shared.append(v)
        return f'<c r="{ref}" t="s"><v>{idx[v]}</v></c>'

    with zipfile.ZipFile(path, "w") as z:
        sheet_xml = []
        for rows in sheets:
            body = "".join(
                f'<row r="{r + 1}">' + "".join(cell(f"{chr(65 + c)}{r + 1}", v) for c, v in enumerate(row) if v is not None)
                + "</row>" for r, row in enumerate(rows))
            sheet_xml.append(f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
        for i, x in enumerate(sheet_xml):
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", x)
        z.writestr("xl/sharedStrings.xml",
                   f'<sst xmlns="{main}">' + "".join(f"<si><t>{t}</t></si>" for t in shared) + "</sst>")
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(
            f'<sheet name="S{i + 1}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i in range(len(sheets))) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(
                       f'<Relationship Id="rId{i + 1}" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets)))
                   + "</Relationships>")
    return path


def test_excel_first_sheet_types(spark, tmpdir_path):
    p = _xlsx(os.path.join(tmpdir_path, "book.xlsx"), [
        [["name", "age", "score", "flag", "note"],
         ["alice", 31, 2.5, True, ("x",)],
         ["bob", "NA", 3.0, False, None],
         [None, 40, None, True, ("z",)]],
        [["other"], ["ignored"]],
    ])
    df = R.load(spark, p)
    assert df.columns == ["name", "age", "score", "flag", "note"]
    assert dict(df.dtypes) == {"name": "string", "age": "bigint", "score": "double", "flag": "boolean", "note": "string"}
    rows = df.collect()
    assert [r["name"] for r in rows] == ["alice", "bob", None]
    assert rows[1]["age"] is None and rows[2]["score"] is None and rows[2]["note"] == "z"
    typed = R.read_excel(spark, p, schema="name string, age int")
    assert typed.first()["age"] == 31


def test_dispatch_errors(spark, tmpdir_path):
    with pytest.raises(ValueError):
        R.load(spark, _write(tmpdir_path, "x.txt2", b"1"))
    with pytest.raises(FileNotFoundError):
        R.load(spark, os.path.join(tmpdir_path, "missing.csv"))
    with pytest.raises(ValueError):
        R.load(spark, _write(tmpdir_path, "old.xls", b"\xd0\xcf\x11\xe0"))


def test_csv_folder_of_files(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "parts")
    os.makedirs(d)
    _write(d, "p1.csv", b"k,v\n1,2.5\n2,NA\n")
    _write(d, "p2.csv", b"k,v\n3,4.0\n")
    df = R.read_csv(spark, d)
    assert dict(df.dtypes) == {"k": "bigint", "v": "double"}
    assert sorted(r["k"] for r in df.collect()) == [1, 2, 3]


def test_csv_with_schema_normalises_na(spark, tmpdir_path):
    p = _write(tmpdir_path, "s.csv", b"a,b\n1,x\nNA,y\n3,#N/A\n")
    df = R.read_csv(spark, p, schema="a int, b string")
    assert [(r["a"], r["b"]) for r in df.collect()] == [(1, "x"), (None, "y"), (3, None)]


def test_json_lines_with_nested_values(spark, tmpdir_path):
    p = _write(tmpdir_path, "n.json", b'{"a": [1, 2], "b": {"c": 1}, "d": "x"}\n{"a": [3], "b": {"c": 2}, "d": "y"}\n')
    assert R.json_shape(spark, p) == "lines"
    df = R.load(spark, p)
    assert df.count() == 2 and sorted(df.columns) == ["a", "b", "d"]


def test_csv_quotes_line_breaks_and_wide_numbers(spark, tmpdir_path):
    p = _write(tmpdir_path, "q.csv", b',t,k,d\n0,"x\ny",99999999999999999999,30d\n1,"say ""hi"", ok",1,60d\n')
    df = R.load(spark, p)
    assert df.columns == ["Unnamed: 0", "t", "k", "d"]
    assert [t for _, t in df.dtypes] == ["bigint", "string", "double", "string"]
    assert [r["t"] for r in df.orderBy("k").collect()] == ['say "hi", ok', "x\ny"]


def test_csv_encoding_per_file_over_all_bytes(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "two files")
    os.makedirs(d)
    _write(d, "a.csv", b"n,v\n" + b"x,1\n" * 3000 + "caf\u00e9 \u201cq\u201d \u20ac5,2\n".encode("cp1252"))
    _write(d, "b.csv", "n,v\nna\u00efve,3\n".encode())
    df = R.load(spark, d, format="csv")
    assert {r["n"] for r in df.where("v > 1").collect()} == {"caf\u00e9 \u201cq\u201d \u20ac5", "na\u00efve"}
    assert df.count() == 3002 and R.sniff_encoding(spark, d) == "windows-1252"


def test_csv_write_and_read_back(spark, tmpdir_path):
    rows = [(1, 'a "quoted", b', " lead"), (2, "line\nbreak\\", "x"), (3, None, "tail ")]
    p = os.path.join(tmpdir_path, "back.csv")
    R.write_table(spark.createDataFrame(rows, "k long, t string, s string"), p)
    assert sorted(tuple(r) for r in R.load(spark, p).collect()) == rows


def test_json_one_line_columns_with_text_labels(spark, tmpdir_path):
    p = _write(tmpdir_path, "c1.json", b'{"a": {"r2": 1, "r1": 2}, "b": {"r2": "x", "r1": "y"}}')
    assert [(r["a"], r["b"]) for r in R.load(spark, p).collect()] == [(1, "x"), (2, "y")]


def test_json_folder_of_mixed_shapes(spark, tmpdir_path):
    """Each file is read by its own shape, whichever comes first."""
    for order in ("abcd", "badc", "cdba"):
        d = os.path.join(tmpdir_path, order)
        os.makedirs(d)
        _write(d, f"{order[0]} 1.json", b'\n[\n {"a": 1, "b": "x"},\n {"a": 2, "b": "y"}\n]\n')
        _write(d, f"{order[1]}.json", b'{"a": 3, "b": "x"}\n{"a": 4, "b": "y", "c": 0.5}\n{"a": 5, "b": "z"}\n')
        _write(d, f"{order[2]}.json", b'{"a": {"0": 6, "1": 7}, "b": {"0": "p", "1": "q"}}')
        _write(d, f"{order[3]}.json", b'{\n "a": {"0": 8.5, "1": 9},\n "b": {"0": "r", "1": "s"}\n}\n')
        _write(d, "zz.json", b"  \n\n")
        got = R.read_json(spark, d)
        want = list(zip([1, 2, 3, 4, 5, 6, 7, 8.5, 9], "xyxyzpqrs", [None] * 3 + [0.5] + [None] * 5))
        assert sorted((r.a, r.b, r.c) for r in got.collect()) == want
        typed = R.read_json(spark, d, "b string, c double")
        assert typed.columns == ["b", "c"] and sorted(r.b for r in typed.collect()) == sorted("xyxyzpqrs")
        assert R.json_shape(spark, d) == "mixed"


def test_json_shapes_of_two_types(spark, tmpdir_path):
    _write(tmpdir_path, "a.json", b'[{"a": 1}]')
    _write(tmpdir_path, "b.json", b'{"a": "one"}\n{"a": "two"}\n')
    assert sorted(r.a for r in R.read_json(spark, tmpdir_path).collect()) == ["1", "one", "two"]


def test_csv_folder_by_each_header(spark, tmpdir_path):
    _write(tmpdir_path, "1.csv", b"a,b\n1,2\n")
    _write(tmpdir_path, "2.csv", b"b,a\n5,6\n")
    _write(tmpdir_path, "3.csv", b'"c, d",a\n"x\ny",7\n')
    _write(tmpdir_path, "4.csv", "b,a\n8,9\n".encode("utf-16"))
    _write(tmpdir_path, "5.csv", "\ufeffa,b\r\n10,\r\n".encode())
    _write(tmpdir_path, "6.csv", b"")
    df = R.read_csv(spark, tmpdir_path)
    assert df.columns == ["a", "b", "c, d"]
    assert sorted(map(tuple, df.collect()), key=lambda r: r[0]) == [(1, 2, None), (6, 5, None), (7, None, "x\ny"), (9, 8, None), (10, None, None)]


def test_csv_refuses_extra_cells(spark, tmpdir_path):
    for name, text in (("plain", b"a,b\n1,2\n3,4,5\n"), ("whole", b'a,b\n1,"x\ny"\n3,4,5\n')):
        p = _write(tmpdir_path, f"{name}.csv", text)
        with pytest.raises(ValueError, match="3 cells, the header 2"):
            R.read_csv(spark, p)
    p = _write(tmpdir_path, "short.csv", b'a,b,c\n1,2\n3,"4,5",6\n\n')
    assert sorted(map(tuple, R.read_csv(spark, p).collect())) == [(1, "2", None), (3, "4,5", 6)]


def test_csv_names_that_differ_in_case(spark, tmpdir_path):
    p = _write(tmpdir_path, "c.csv", b"a,A,a,b.c,\n1,2,3,4,5\n")
    df = R.read_csv(spark, p)
    assert df.columns == ["a", "A.1", "a.2", "b.c", "Unnamed: 4"] and tuple(df.first()) == (1, 2, 3, 4, 5)
    assert R.dedupe_names(["a", "A", "a"]) == ["a", "A", "a.1"]


@pytest.mark.parametrize("codec", ["utf-16", "utf-16-be", "utf-16-le"])
def test_utf16(spark, tmpdir_path, codec):
    text = "näme,v\r\n\u0a0a\u0d0a,1\r\n数字,2\r\n"
    bom = {"utf-16-be": b"\xfe\xff", "utf-16-le": b"\xff\xfe"}.get(codec, b"")
    p = _write(tmpdir_path, "u.csv", bom + text.encode(codec))
    assert R.sniff_encoding(spark, p) == "UTF-16"
    df = R.read_csv(spark, p)
    assert sorted(map(tuple, df.collect())) == sorted([("\u0a0a\u0d0a", 1), ("数字", 2)]) and df.columns == ["näme", "v"]


def test_json_refuses_what_is_not_json(spark, tmpdir_path):
    p = _write(tmpdir_path, "bad.json", b'{"a": 1}\n{"a": \n')
    with pytest.raises(ValueError, match="not JSON"):
        R.read_json(spark, p)

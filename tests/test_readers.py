import json
import zipfile

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltwork.functions import coerce, jsonquery
from siltwork.ingest import normalise
from siltwork.schema import table_schema
from siltwork.sources import cellformat
from siltwork.sources.excel import ExcelError, column_number, read_excel, sheet_rows
from siltwork.sources.jsonl import json_path, read_jsonl
from siltwork.sources.records import ReadOptions, Record, match_column

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, sheets):
    """A workbook of {name: rows}; a row is {cell reference: xml of the cell}."""
    with zipfile.ZipFile(path, "w") as z:
        names = list(sheets)
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(names))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}"><si><t>shared </t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>')
        for i, n in enumerate(names):
            rows = "".join(f'<row r="{r}">' + "".join(cells) + "</row>" for r, cells in sheets[n])
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>')
    return str(path)


def text(ref, v):
    return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'


def sheet(header_row=1):
    # The golden records of FIXTURES.md, section 5.
    names = ["id", " name ", "phone_a", "phone_b", "address_a", "address_b"]
    grid = [names, ["r1", "alpha", "111,222", "333", "", "west"], ["r2", "beta", "N/A", "444", "east", "west"]]
    return [(header_row + k, [text("ABCDEF"[i] + str(header_row + k), v) for i, v in enumerate(g) if v]) for k, g in enumerate(grid)]


OPTIONS = dict(
    fields={"id": "id", "name": "name", "phones": "phone_a & phone_b", "address": "address_a | address_b"},
    null=("N/A",), split={"phones": ","}, transform={"name": F.upper},
)


@pytest.mark.parametrize("header", [1, 3])
def test_excel(spark, tmp_path, header):
    p = workbook(tmp_path / "b.xlsx", {"first": sheet(header), "other": []})
    got = {r.id: r for r in read_excel(spark, p, ReadOptions(header=header, **OPTIONS)).collect()}
    assert got["r1"].name == "ALPHA" and got["r1"].phones == ["111", "222", "333"] and got["r1"].address == "west"
    assert got["r2"].phones == ["444"] and got["r2"].address == "east" and len(got) == 2


def test_excel_cells_and_errors(spark, tmp_path):
    cells = ['<c r="A1" t="s"><v>0</v></c>', '<c r="C1" t="s"><v>1</v></c>', '<c r="D1"><v>12.0</v></c>', '<c r="E1" t="b"><v>1</v></c>', '<c r="F1" t="str"><v>f</v></c>', '<c r="G1"><v>1.5</v></c>']
    p = workbook(tmp_path / "b.xlsx", {"s": [(1, cells), (4, [text("B4", "late")])]})
    data = (tmp_path / "b.xlsx").read_bytes()
    assert sheet_rows(data) == [["shared ", "", "rich", "12", "TRUE", "f", "1.5"], [], [], ["", "late"]]
    assert column_number("AB3") == 27
    for bad in (ReadOptions(), ReadOptions(header=0)):
        with pytest.raises(ExcelError):
            read_excel(spark, p, bad)
    with pytest.raises(Exception, match="out of range"):
        read_excel(spark, p, ReadOptions(header=9, fields={"a": "x"})).collect()
    with pytest.raises(ExcelError):
        sheet_rows(data, "nowhere")
    with pytest.raises(ExcelError):
        sheet_rows(b"no zip")


def test_jsonl(spark, tmp_path):
    # The golden lines of FIXTURES.md, section 5.
    lines = [
        {"items": [{"profile": {"name": "alpha"}, "alias": "", "contact": {"email": "a@example.com", "alt": "b@example.com"}}]},
        {"items": [{"profile": {"name": ""}, "alias": "beta", "contact": {"email": "N/A", "alt": "c@example.com"}}]},
        {"other": 1},
    ]
    p = tmp_path / "f.jsonl"
    p.write_text("\n".join(map(json.dumps, lines)) + "\n\n  \nnot json\n")
    o = ReadOptions(root="items", null=("N/A",), fields={"name": "profile.name | alias", "email": "contact.email & contact.alt"})
    got = [tuple(r) for r in read_jsonl(spark, str(p), o).collect()]
    assert got == [("alpha", ["a@example.com", "b@example.com"]), ("beta", ["c@example.com"])]


def test_jsonl_values_and_paths(spark, tmp_path):
    p = tmp_path / "f.jsonl"
    p.write_text('{"a.b": 1, "n": null, "t": true, "o": {"x": [1, {"y": "z"}]}, "0": "zero"}\n{"q": 1}\n')
    fields = {"dotted": r"a\.b", "null": "n", "yes": "t", "obj": "o.x", "deep": "o.x.1.y", "zero": "0", "all": "o.x.#.y"}
    (r,) = read_jsonl(spark, str(p), ReadOptions(fields=fields)).collect()
    assert (r.dotted, r.null, r.yes, r.deep, r.zero) == ("1", None, "true", "z", "zero") and json.loads(r.obj) == [1, {"y": "z"}]
    assert json_path(r"a\.b.c.0") == "$['a.b']['c'][0]"


def test_jsonl_line_limit(spark, tmp_path, monkeypatch):
    from siltwork.sources import jsonl

    monkeypatch.setattr(jsonl, "MAX_LINE", 20)
    p = tmp_path / "f.jsonl"
    p.write_text('{"a": "' + "x" * 30 + '"}\n')
    with pytest.raises(Exception, match="longer than"):
        read_jsonl(spark, str(p), ReadOptions(fields={"a": "a"})).collect()


def test_record_accessors():
    r = Record(i=5, f=7.0, s="8", bad="not-a-number", none=None, b=True, l=["x", None, 3], e=[])
    assert [r.int64(k) for k in ("i", "f", "s", "bad", "none", "missing", "b")] == [5, 7, 8, 0, 0, 0, 0]
    assert r.text("l") == "x" and r.text("e") == "" and r.text("b") == "true" and r.text("f") == "7"
    assert r.texts("l") == ["x", "3"] and r.texts("s") == ["8"] and r.texts("i") == ["5"]
    assert r.match("s", "^8$") and not r.match("s", "(") and not r.match("none", ".*")


def test_match_column(spark):
    df = spark.createDataFrame([("abc",), ("",), (None,)], "v string")
    assert [r[0] for r in df.select(match_column(F.col("v"), "b")).collect()] == [True, False, False]
    assert [r[0] for r in df.select(match_column(F.col("v"), "(")).collect()] == [False] * 3


@given(st.one_of(st.text(), st.integers(), st.floats(), st.none(), st.booleans(), st.lists(st.text())))
def test_coercions_never_raise(v):
    assert -(2**63) <= coerce.to_int64(v) <= 2**63 - 1
    assert isinstance(coerce.to_str(v), str) and isinstance(coerce.to_str_list(v), list)


def test_int64_column_agrees(spark):
    texts = ["5", "+5", "-5", " 5", "5.0", "", "x", "9223372036854775807", "9223372036854775808", "-9223372036854775809", "007", "5\n"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    assert [r[0] for r in df.select(coerce.int64_column(F.col("v"))).collect()] == [coerce.to_int64(t) for t in texts]


def test_normalise(spark):
    s = table_schema("t", {"id": (str, "pk"), "n": int, "tags": list[str], "meta": (dict, "json_merge")})
    df = spark.createDataFrame(
        [("a", "7", ["x", None], {"k": 1}), ("", "1", [], None), (None, "1", None, None), ("b", "0", [None], {})],
        T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("meta", T.MapType(T.StringType(), T.IntegerType()))]),
    )
    assert [tuple(r) for r in normalise(s, df).collect()] == [("a", 7, ["x"], '{"k":1}'), ("b", None, None, "{}")]
    with pytest.raises(ValueError):
        normalise(s, df.drop("id"))


FORMATTED = [
    ("45000", "mm-dd-yy", "03-15-23"), ("45000.5", "m/d/yy h:mm", "3/15/23 12:00"), ("0.256", "0.00%", "25.60%"), ("0.255", "0%", "26%"), ("1234567.891", "#,##0.00", "1,234,567.89"),
    ("-1234.5", "#,##0.00;(#,##0.00)", "(1,234.50)"), ("1234.5", "0.00E+00", "1.23E+03"), ("9.999", "0.00E+00", "1.00E+01"), ("0.75", "h:mm AM/PM", "6:00 PM"), ("1.5", "[h]:mm:ss", "36:00:00"),
    ("45000", "yyyy-mm-dd", "2023-03-15"), ("45000.123456", 'yyyy"-"mm\\-dd hh:mm:ss', "2023-03-15 02:57:47"), ("45000", "dddd, mmmm d", "Wednesday, March 15"), ("45000", "[$-409]d/m/yyyy;@", "15/3/2023"),
    ("0.0005", "mm:ss.0", "00:43.2"), ("3", '0" pcs"', "3 pcs"), ("5", "000", "005"), ("-5", "0.0", "-5.0"), ("0", '0;-0;"zero"', "zero"), ("12.5", '"$"#,##0.00', "$12.50"), ("0.5", "#.##", ".5"),
    ("1234567", "#,##0,", "1,235"), ("3", "General", "3"), ("12", "@", "12"), ("x", "0.00", "x"), ("1e400", "yyyy", "1e400"),
]


@pytest.mark.parametrize("text, code, want", FORMATTED)
def test_cell_formats(text, code, want):
    assert cellformat.shown(text, code) == want


def test_dates_since_1904():
    assert cellformat.shown("0", "yyyy-mm-dd", True) == "1904-01-01"


def test_formatted_cells_of_a_workbook(spark, tmp_path):
    rows = [(1, [text("A1", "day"), text("B1", "share"), text("C1", "plain")]), (2, ['<c r="A2" s="1"><v>45000</v></c>', '<c r="B2" s="2"><v>0.5</v></c>', '<c r="C2"><v>7.0</v></c>'])]
    path = workbook(tmp_path / "b.xlsx", {"s": rows})
    with zipfile.ZipFile(path, "a") as z:
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs><xf/><xf numFmtId="164"/><xf numFmtId="9"/></cellXfs></styleSheet>')
    got = read_excel(spark, path, ReadOptions(fields={"d": "day", "s": "share", "p": "plain"}, header=1)).first()
    assert tuple(got) == ("2023-03-15", "50%", "7")


SHELF = '{"shop": {"books": [{"t": "Ash", "p": 5, "tags": ["a", "b"]}, {"t": "Birch", "p": 12.5, "in": true}, {"t": "Cedar", "p": 12, "tags": []}], "open": null}, "a.b": {"k*": 1}, "raw": "{\\"x\\": [1]}"}'
PATHS = [
    ("shop.books.#", "3"), ("shop.books.#.t", '["Ash","Birch","Cedar"]'), ("shop.books.#.in", "[true]"), ("shop.b*.0.t", "Ash"), ("sh?p.books.2.p", "12"), ("sh?.books", None),
    ('shop.books.#(t=="Birch").p', "12.5"), ("shop.books.#(p>5)#.t", '["Birch","Cedar"]'), ('shop.books.#(t%"*e*")#.t', '["Cedar"]'), ('shop.books.#(t!%"*e*").t', "Ash"), ("shop.books.#(in).t", "Birch"),
    ("shop.books.#(p>99).t", None), ("shop.books.#(p>99)#.t", "[]"), ("shop.books.0.tags.#(==b)", "b"), ("shop.books.@reverse.0.t", "Cedar"), ("shop.@keys", '["books","open"]'),
    ("shop.books.#.tags.@flatten", '[["a","b"],[]]'), ("raw.@fromstr.x.0", "1"), ("shop.open.@this", None), (r"a\.b.k\*", "1"), ("shop.books.9.@this", None), ("shop.books.#(p!=5)#.p", "[12.5,12]"), ("@this.shop.books.#(p<=5)#", '[{"t":"Ash","p":5,"tags":["a","b"]}]'),
    ("shop.books.@nothing", None),
]


@pytest.mark.parametrize("path, want", PATHS)
def test_paths_with_wildcards_queries_and_modifiers(path, want):
    assert jsonquery.text_at(SHELF, path) == want
    assert jsonquery.text_at(None, path) is None and jsonquery.text_at("{bad", path) is None


def test_queries_in_fields_of_lines(spark, tmp_path):
    p = tmp_path / "f.jsonl"
    p.write_text(SHELF + "\n{}\n")
    fields = {"n": "shop.books.#", "cheap": "shop.books.#(p<6).t", "wild": "sh*.books.1.t", "plain": "shop.books.0.t"}
    assert [tuple(r) for r in read_jsonl(spark, str(p), ReadOptions(fields=fields)).collect()] == [("3", "Ash", "Birch", "Ash")]
    assert [r.t for r in read_jsonl(spark, str(p), ReadOptions(fields={"t": "t"}, root="shop.books.#(p>5)#")).collect()] == ["Birch", "Cedar"]

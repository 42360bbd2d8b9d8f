import zipfile

from pyspark.sql import functions as F

from pitchside.sources import scan as S


def sheet(path, rows):
    cell = lambda v, i, n: f'<c r="{chr(65 + i)}{n}" t="inlineStr"><is><t>{v}</t></is></c>'
    body = "".join(f"<row>{''.join(cell(v, i, n) for i, v in enumerate(r))}</row>" for n, r in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')


def test_a_folder_of_both_kinds(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_bytes("Home,Away,\nArsenal,Chelsea,x\n\nMálaga,,y\nA,B,c,d\n".encode("utf-8-sig"))
    (tmp_path / "sub" / "b.CSV").write_bytes('Home,Away\nM\xe1laga,"Real, Madrid"\n'.encode("cp1252"))
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "notes.txt").write_bytes(b"Home\nno\n")
    sheet(tmp_path / "c.xlsx", [["Home", "Away"], ["Lyon", "Nice"], ["Lille", ""]])
    (tmp_path / "d.xlsx").write_bytes(b"no sheet")
    rows, seen = S.scan(spark, tmp_path.as_uri(), needs=("Home", "Away"))
    got = rows.withColumn("f", F.element_at(F.split("source_file", "/"), -1)).collect()
    cells = {(r["f"], r["row"]): r["cells"] for r in got}
    assert cells == {
        ("a.csv", 0): {"Home": "Arsenal", "Away": "Chelsea", "col_2": "x"}, ("a.csv", 1): {"Home": "Málaga", "Away": "", "col_2": "y"}, ("a.csv", 2): {"Home": "A", "Away": "B", "col_2": "c"},
        ("b.CSV", 0): {"Home": "Málaga", "Away": "Real, Madrid"}, ("c.xlsx", 0): {"Home": "Lyon", "Away": "Nice"}, ("c.xlsx", 1): {"Home": "Lille", "Away": ""}, ("d.xlsx", -1): None,
    }
    assert seen.get == {"rows": 7, "rejected": 4, "bad_bytes": 1}
    counts = {r["f"]: (r["format"], r["encoding"], r["rows"], r["rejected"], r["bad_bytes"]) for r in S.file_counts(rows).withColumn("f", F.element_at(F.split("source_file", "/"), -1)).collect()}
    assert counts == {"a.csv": ("csv", "utf-8-sig", 3, 2, 0), "b.CSV": ("csv", "cp1252", 1, 0, 1), "c.xlsx": ("xlsx", None, 2, 1, 0), "d.xlsx": ("xlsx", None, 0, 1, 0)}


def test_no_files(spark, tmp_path):
    (tmp_path / "notes.txt").write_bytes(b"x")
    rows, seen = S.scan(spark, tmp_path.as_uri())
    assert rows.collect() == [] and seen.get == {"rows": 0, "rejected": 0, "bad_bytes": 0}

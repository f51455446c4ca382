"""Row counts by format against serial readers."""

import csv
import io
import random
import zipfile

import pytest

from voltaic.sources import counts


def serial(text):
    """As a serial reader counts: records with content, less the header and a shorter first line."""
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if any(c.strip() for c in r)]
    return max(0, len(rows) - (len(rows) > 1 and len(rows[0]) < len(rows[1])) - 1)


@pytest.mark.parametrize("seed", range(4))
def test_csv_records_over_many_splits(spark, tmp_path, seed):
    """Quoted line ends, doubled quotes, blank records, quotes within fields, cut anywhere."""
    r = random.Random(seed)
    fields = ["1", "", "abc", '"x"', '"a\nb"', '"a\n\n,""c"\n"', '""', '" \n "', " ", 'd"e', '""""', '"\r\n"']
    fields = [f for f in fields if f != '"a\n\n,""c"\n"'] + ['"a\n\n,""c""\n"']
    want = {}
    for k in range(6):
        lines = ["CREATED AT 2026"] if k % 2 else []
        lines += ["a,b,c", *[",".join(r.choices(fields, k=3)) if r.random() < 0.9 else r.choice(["", ",,", '"",""," \n"']) for _ in range(r.choice([0, 3, 400]))]]
        text = r.choice(["\n", "\r\n"]).join(lines) + r.choice(["", "\n", '\n"never closed', '\n"'])
        (tmp_path / f"f{k}.csv").write_bytes((b"\xef\xbb\xbf" if k == 3 else b"") + text.encode())
        want[f"f{k}.csv"] = serial(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("300b", "64m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert {x.name: x.n_rows for x in counts.csv_records(spark, str(tmp_path)).collect()} == want
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def workbook(sheets):
    out, ns = io.BytesIO(), 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            cells = "".join("<row>" + "".join(f"<c><v>{v}</v></c>" if v is not None else "<c/>" for v in row) + "</row>" for row in rows)
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


def test_counts_by_format(spark, tmp_path):
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "t.csv").write_text("a,b\n1,2\n3,4\n")
    (tmp_path / "body.xml").write_text('<D xmlns="http://example.org/s"><H/><DocBody><DeliveryDate>x</DeliveryDate><P><Q/></P><P/></DocBody></D>')
    (tmp_path / "flat.XML").write_text("<dataroot><t><a/></t><t/><t/></dataroot>")
    (tmp_path / "bad.xml").write_text("<dataroot><t>")
    (tmp_path / "named.xlsx").write_bytes(workbook({"Note": [[1]] * 9, "Contract Data": [["a", "b"], [None, None], ["x", None]]}))
    (tmp_path / "large.xlsx").write_bytes(workbook({"One": [[1]], "Two": [[1], [2], [3]]}))
    (tmp_path / "bad.xlsx").write_bytes(b"no archive")
    (tmp_path / "other.txt").write_text("x")
    got = {r.name: r.n_rows for r in counts.row_counts(spark, str(tmp_path)).collect()}
    assert got == {"t.csv": 2, "body.xml": 2, "flat.XML": 3, "bad.xml": None, "named.xlsx": 2, "large.xlsx": 3, "bad.xlsx": None}

"""PDF files made by hand, and read back."""

import zlib

from claimloom.functions import pdf
from claimloom.sources import readers


def made(contents, packed=True, fonts=b"/F1 3 0 R", more=b""):
    """A file with a page for each content stream."""
    n = len(contents)
    kids = b" ".join(b"%d 0 R" % (10 + i) for i in range(n))
    out = b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n"
    out += b"2 0 obj\n<< /Type /Pages /Kids [" + kids + b"] /Count %d /Resources << /Font << " % n + fonts + b" >> >> >>\nendobj\n3 0 obj\n<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>\nendobj\n"
    for i, c in enumerate(contents):
        raw, name = (zlib.compress(c), b"/Filter /FlateDecode ") if packed else (c, b"")
        out += b"%d 0 obj\n<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>\nendobj\n" % (10 + i, 50 + i)
        out += b"%d 0 obj\n<< %s/Length %d >>\nstream\n" % (50 + i, name, len(raw)) + raw + b"\nendstream\nendobj\n"
    return out + more + b"trailer\n<< /Root 1 0 R >>\n%%EOF\n"


PAGE = rb"BT /F1 12 Tf 72 720 Td (Rain \(heavy\) leads to ) Tj (floods.) Tj 0 -14 Td [(Soil) -300 (er) 20 (odes)] TJ T* <41626364> Tj ET"


def test_pages_in_order():
    for packed in (True, False):
        assert pdf.pages(made([PAGE, b"BT (Second\\040page) Tj ET"], packed)) == ["Rain (heavy) leads to floods.\nSoil erodes\nAbcd", "Second page"]
    assert pdf.pages(made([b""])) == [""]


def test_fonts_with_a_map():
    cmap = b"1 beginbfchar\n<0001> <00E9>\nendbfchar\n1 beginbfrange\n<0010> <0012> <0061>\nendbfrange\n1 beginbfrange\n<0020> <0021> [<0078> <0079007A>]\nendbfrange"
    more = b"4 0 obj\n<< /Type /Font /Subtype /Type0 /ToUnicode 5 0 R >>\nendobj\n5 0 obj\n<< /Length %d >>\nstream\n" % len(cmap) + cmap + b"\nendstream\nendobj\n"
    got = pdf.pages(made([b"BT /F2 9 Tf <00010010001100120020 0021> Tj ET"], fonts=b"/F1 3 0 R /F2 4 0 R", more=more))
    assert got == ["éabcxyz"]


def test_objects_in_a_stream():
    inner = b"10 0 11 40 << /Type /Page /Contents 50 0 R >>          << /Type /Page /Contents 51 0 R >>"
    first = len(b"10 0 11 40 ")
    raw = zlib.compress(inner)
    data = b"%PDF-1.5\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [10 0 R 11 0 R] >>\nendobj\n"
    data += b"7 0 obj\n<< /Type /ObjStm /N 2 /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (first, len(raw)) + raw + b"\nendstream\nendobj\n"
    for n, text in ((50, b"one"), (51, b"two")):
        data += b"%d 0 obj\n<< /Length 99 >>\nstream\nBT (%s) Tj ET\nendstream\nendobj\n" % (n, text)
    assert pdf.pages(data) == ["one", "two"]


def test_a_folder_of_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(made([PAGE] * 7))
    (tmp_path / "b.pdf").write_bytes(b"no such format")
    got = {r["name"]: r["text"] for r in readers.documents(spark, str(tmp_path), pages=5).collect()}
    assert got["b.pdf"] == "" and got["a.pdf"].count("floods") == 5
    assert len(readers.documents(spark, str(tmp_path), most=12).filter("name = 'a.pdf'").first()["text"]) == 12

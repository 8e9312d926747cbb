"""A real PDF, where a reader of them is installed."""

import pytest

from quarry.sources import pdf


def small_pdf(*lines: str) -> bytes:
    """One page with a line of text each 20 points, as the format's own objects."""
    shown = "BT /F1 12 Tf 75 800 Td " + " ".join(f"({x}) Tj 0 -20 Td" for x in lines) + " ET"
    parts = [
        "<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", "<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>",
        f"<< /Length {len(shown)} >>\nstream\n{shown}\nendstream", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
    ]
    out, places = b"%PDF-1.4\n", []
    for i, part in enumerate(parts, 1):
        places.append(len(out))
        out += f"{i} 0 obj\n{part}\nendobj\n".encode()
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    return out + f"xref\n0 {len(parts) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(parts) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()


def test_spans_of_a_real_file(spark, tmp_path):
    pytest.importorskip("pypdf")
    (tmp_path / "a.pdf").write_bytes(small_pdf("First line", "Second line"))
    found, rejects = pdf.split_parsed(pdf.read_spans(pdf.read_pdfs(spark, str(tmp_path)), pdf.pypdf_pages))
    assert [r.text for r in found.orderBy(found.y.desc()).collect()] == ["First line", "Second line"] and rejects.count() == 0


def test_the_file_is_read_by_the_binary_source(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(small_pdf("x"))
    row = pdf.read_pdfs(spark, str(tmp_path)).first()
    assert bytes(row.content) == small_pdf("x") and row.file_size == len(row.content) and row.filename == "a.pdf"

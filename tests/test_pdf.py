"""The PDF reader on files put together here, and the table of files around it."""

import base64
import zlib

import pytest

from cardwright.sources import ingest
from cardwright.sources.pdf import PdfError, document, glyph, page_texts

CATALOG, FONT = b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>"


def built(objects: dict[int, bytes], trailer: bytes = b"/Root 1 0 R") -> bytes:
    out, places = bytearray(b"%PDF-1.4\n%\xe2\xe3\n"), {}
    for number, body in objects.items():
        places[number] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    start, n = len(out), max(objects) + 1
    rows = b"".join(b"%010d 00000 n \n" % places[k] if k in places else b"0000000000 65535 f \n" for k in range(n))
    return bytes(out + b"xref\n0 %d\n%strailer <</Size %d%s>>\nstartxref\n%d\n%%%%EOF" % (n, rows, n, trailer, start))


def stream(data: bytes, more: bytes = b"") -> bytes:
    return b"<</Length %d%s>>stream\n%s\nendstream" % (len(data), more, data)


def one_page(content: bytes, font: bytes = FONT, more: bytes = b"", resources: bytes = b"", extra: dict[int, bytes] | None = None) -> bytes:
    page = b"<</Type/Page/Parent 2 0 R/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>%s>>>>" % resources
    return built({1: CATALOG, 2: b"<</Type/Pages/Kids[3 0 R]/Count 1>>", 3: page, 4: stream(content, more), 5: font} | (extra or {}))


SHOWN = [
    (b"BT /F1 12 Tf 72 700 Td (Hello) Tj ( World) Tj ET", "Hello World"),
    (b"BT /F1 12 Tf 14 TL 72 700 Td (one) Tj T* (two) Tj (three) ' 1 2 (four) \" ET", "one\ntwo\nthree\nfour"),
    (b"BT /F1 12 Tf 72 700 Td (a) Tj 0 -14 Td (b) Tj 0 -14 TD (c) Tj T* (d) Tj ET", "a\nb\nc\nd"),
    (b"BT /F1 10 Tf 1 0 0 1 50 700 Tm (left) Tj 1 0 0 1 200 700 Tm (right) Tj ET", "left right"),
    (b"BT /F1 10 Tf 0 0 Td [(Mo) 20 (nod) -600 (growth)] TJ ET", "Monod growth"),
    (rb"BT /F1 10 Tf (\(a\\b\)\101\12612\n(nested (twice))) Tj ET", "(a\\b)AV12(nested (twice))"),
    (b"BT /F1 10 Tf <48656C6C 6F2> Tj ET", "Hello "),
    (b"BT /F1 10 Tf (\xb5 \xb0 caf\xe9) Tj ET % (not shown) Tj\n", "µ ° café"),
    (b"q 1 0 0 1 0 500 cm BT /F1 10 Tf (high) Tj ET Q BT /F1 10 Tf (low) Tj ET", "high\nlow"),
    (b"BT /F1 10 Tf (before) Tj ET BI /W 4 /H 4 /BPC 8 ID \x00(EI)\xff Tj \nEI BT /F1 10 Tf ( after) Tj ET", "before after"),
    (b"BT (no font) Tj ET", ""), (b"", ""), (b"BT /F1 10 Tf (open", ""), (b"Q Q ] >> BT /F1 10 Tf (x) Tj ET", "x"),
]


@pytest.mark.parametrize("content,text", SHOWN)
def test_content_streams(content, text):
    assert page_texts(one_page(content)) == [text]


@pytest.mark.parametrize("encode,name", [
    (lambda d: zlib.compress(d), b"/FlateDecode"), (lambda d: d.hex().encode() + b">", b"/ASCIIHexDecode"), (lambda d: base64.a85encode(d) + b"~>", b"/ASCII85Decode"),
    (lambda d: base64.a85encode(zlib.compress(d)) + b"~>", b"[/ASCII85Decode /FlateDecode]"),
])
def test_filters(encode, name):
    assert page_texts(one_page(encode(b"BT /F1 10 Tf (packed) Tj ET"), more=b"/Filter " + name)) == ["packed"]


def test_fonts():
    differences = b"<</Type/Font/Subtype/Type1/Encoding<</BaseEncoding/WinAnsiEncoding/Differences[65/mu/alpha 67/Lambda/eacute/uni2206/quoteright/fi]>>>>"
    assert page_texts(one_page(b"BT /F1 9 Tf (ABCDEFGx) Tj ET", differences)) == ["μαΛé∆’fix"]
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <03BC> <0002> <00660069> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<0078> <D83DDE00>] endbfrange"
    wide = b"<</Type/Font/Subtype/Type0/Encoding/Identity-H/ToUnicode 6 0 R/DescendantFonts[<</DW 600/W[1[500 700] 16 18 400]>>]>>"
    assert page_texts(one_page(b"BT /F1 9 Tf <000100020010001100120020002100FF> Tj ET", wide, extra={6: stream(cmap)})) == ["μfiABCx😀"]
    assert [glyph(n) for n in ("Omega", "adieresis", "u1F600", "period", "nothing", "a.alt")] == ["Ω", "ä", "😀", ".", "", "a"]


def test_forms_and_inherited_resources():
    form = stream(b"BT /G 10 Tf (in a form) Tj ET /X Do", b"/Type/XObject/Subtype/Form/Matrix[1 0 0 1 0 -40]/Resources<</Font<</G 5 0 R>>/XObject<</X 6 0 R>>>>")
    assert page_texts(one_page(b"BT /F1 10 Tf (page) Tj ET /X Do /Y Do", resources=b"/XObject<</X 6 0 R>>", extra={6: form}))[0].startswith("page\nin a form")
    pages = b"<</Type/Pages/Kids[3 0 R 6 0 R]/Count 3/Resources<</Font<</F1 5 0 R>>>>>>"
    text = lambda t: stream(b"BT /F1 10 Tf (%s) Tj ET" % t)
    objects = {1: CATALOG, 2: pages, 3: b"<</Type/Page/Contents[7 0 R 8 0 R]>>", 5: FONT, 6: b"<</Type/Pages/Kids[9 0 R 10 0 R]>>", 7: text(b"first"), 8: text(b" part"), 9: b"<</Type/Page/Contents 7 0 R>>", 10: b"<</Type/Page>>"}
    assert page_texts(built(objects)) == ["first part", "first", ""]


def packed_file(predictor: bool) -> bytes:
    """A file whose objects stand in an object stream and whose references are a stream too."""
    inner = {1: CATALOG, 2: b"<</Type/Pages/Kids[3 0 R]/Count 1>>", 3: b"<</Type/Page/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>>>>>", 5: FONT}
    bodies, head, at = b"", [], 0
    for number, body in inner.items():
        head.append(b"%d %d" % (number, len(bodies)))
        bodies += body + b" "
    first = b" ".join(head) + b" "
    out, places = bytearray(b"%PDF-1.5\n"), {}
    for number, body in ((4, stream(b"BT /F1 10 Tf (from packed objects) Tj ET")), (6, stream(zlib.compress(first + bodies), b"/Type/ObjStm/N 4/First %d/Filter/FlateDecode" % len(first)))):
        places[number] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    start, order = len(out), list(inner)
    places[7] = start
    rows = [bytes([0, 0, 0, 0])] + [bytes([2, 0, 6, order.index(n)]) if n in inner else bytes([1, *places[n].to_bytes(2, "big"), 0]) for n in range(1, 8)]
    if predictor:
        rows = [bytes([2, *((a - b) % 256 for a, b in zip(row, before, strict=True))]) for row, before in zip(rows, [bytes(4), *rows], strict=False)]
    parms = b"/DecodeParms<</Predictor 12/Columns 4>>" if predictor else b""
    out += b"7 0 obj\n" + stream(zlib.compress(b"".join(rows)), b"/Type/XRef/Size 8/W[1 2 1]/Root 1 0 R/Filter/FlateDecode" + parms) + b"\nendobj\n"
    return bytes(out + b"startxref\n%d\n%%%%EOF" % start)


@pytest.mark.parametrize("predictor", [False, True])
def test_packed_objects(predictor):
    data = packed_file(predictor)
    assert page_texts(data) == ["from packed objects"]
    assert page_texts(data[: data.rindex(b"startxref")] + b"startxref\n3\n%%EOF") == ["from packed objects"]


def test_updates_and_broken_references():
    old = one_page(b"BT /F1 10 Tf (old) Tj ET")
    at = len(old) + 1
    new = old + b"\n4 0 obj\n%s\nendobj\n" % stream(b"BT /F1 10 Tf (new) Tj ET")
    new += b"xref\n4 1\n%010d 00000 n \ntrailer <</Size 6/Root 1 0 R/Prev %d>>\nstartxref\n%d\n%%%%EOF" % (at, old.rindex(b"xref\n0"), len(new))
    assert page_texts(new) == ["new"]
    assert page_texts(old[: old.rindex(b"xref\n0")]) == ["old"] and page_texts(b"junk" * 9 + old) == ["old"]


@pytest.mark.parametrize("data,why", [
    (b"hello", "no PDF header"), (b"%PDF-1.4\nnothing", "no catalogue"), (one_page(b"x", more=b"/Filter/LZWDecode"), "LZWDecode"), (one_page(b"x", more=b"/Filter/FlateDecode"), "damaged"),
    (built({1: CATALOG, 2: b"<</Type/Pages/Kids[2 0 R]>>"}), "circle"), (built({1: CATALOG, 2: b"<</Kids[]>>"}, b"/Root 1 0 R/Encrypt<<>>"), "encrypted"),
])
def test_unreadable_files(data, why):
    with pytest.raises(PdfError, match=why):
        page_texts(data)


def test_damaged_files_end():
    whole = packed_file(True) + one_page(SHOWN[1][0])
    for k in range(0, len(whole), 37):
        for data in (whole[:k], whole[:k] + b"\xff(<<[" + whole[k + 3 :]):
            try:
                page_texts(data)
            except PdfError:
                pass


def test_written_documents_come_back():
    pages = [["Growth μmax = 0.5", "über 😀 中文"], ["second page", "x" * 3000], []]
    assert page_texts(document(pages)) == ["\n".join(p) for p in pages]


def test_table_of_files(spark, tmp_path):
    long = [["A line of text that is long enough to count as one."] * 3, ["The second page."] * 4]
    short, tiny, many = [["Thirty characters and some more."]], [["tiny"]], [["page"]] * 201
    rows = [(k, document(p)) for k, p in enumerate((long, short, tiny, many))] + [(4, b"%PDF-1.4 junk"), (5, b""), (6, None)]
    files = spark.createDataFrame([(k, None if d is None else base64.b64encode(d).decode()) for k, d in rows], "id long, data string")
    asked = lambda raw: ("retried: " + ingest.read_pdf(raw)[0], 1)
    good, bad = ingest.pdf_texts(files, retry=asked)
    got = {r["id"]: r for r in good.collect()}
    assert set(got) == {0, 1} and got[0]["text"] == "\n\n".join("\n".join(p) for p in long) and got[0]["pages"] == 2 and got[0]["extraction_mode"] == "default" and got[0]["warnings"] == []
    n = len(got[0]["text"])
    assert got[0]["page_chars"] == [n // 2, n - n // 2] and got[0]["chars"] == n and got[0]["words"] == len(got[0]["text"].split())
    assert got[1]["text"] == "retried: " + short[0][0] and got[1]["extraction_mode"] == "normalized_whitespace" and len(got[1]["warnings"]) == 1
    why = {r["id"]: (r["reason"], r["status_code"]) for r in bad.collect()}
    assert why[2] == ("too little text", 422) and why[3] == ("too many pages", 422) and why[4][1] == 422 and why[5] == why[6] == ("no PDF data", 400)
    for k, data in rows[:2]:
        (tmp_path / f"{k}.pdf").write_bytes(data)
    (tmp_path / "other.txt").write_text("no")
    good, bad = ingest.pdf_texts(ingest.pdf_files(spark, str(tmp_path)))
    assert sorted(r["id"].rsplit("/")[-1] for r in good.collect()) == ["0.pdf", "1.pdf"] and bad.count() == 0


def test_characters_by_page(spark):
    rows = spark.createDataFrame([(" a\fbb\f\nccc", 2), ("a\n \n\nbb", 2), ("abcdefg", 3), ("abc", 1), ("abc", 0), ("", 2)], "t string, n int")
    assert [r[0] for r in rows.select(ingest.page_char_counts("t", rows["n"])).collect()] == [[1, 2], [1, 2], [2, 2, 3], [3], [3], [0, 0]]


def test_files_are_made_and_read_once(spark, tmp_path):
    from cardwright.plans.files import pdf_round_trip

    spark.createDataFrame([(1, "A line of text that is long enough to count.\n\nMore."), (2, "tiny"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = pdf_round_trip(spark, str(tmp_path))
    assert {r["id"]: (r["reason"], r["chars"]) for r in out.collect()} == {1: (None, 50), 2: ("too little text", None)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2  # one makes the files, one reads them; five before


def test_codes_taken_together_are_those_taken_one_by_one():
    from cardwright.sources.pdf import File, Font, Lexer

    file = File(document([["Growth μmax 😀"]]))
    info = file.get(Lexer(b"4 0 R").value())
    fast, slow = Font(file, info), Font(file, info)
    slow.widths = {70_000: 1}  # a width of its own sends each code the long way
    for raw in ("Growth μmax 😀 中".encode("utf-16-be"), b"", b"\0G\0"):
        assert fast.shown(raw) == slow.shown(raw)
    assert fast.units and not slow.units  # taken together here, one by one there

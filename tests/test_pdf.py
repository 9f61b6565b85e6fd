import struct
import zlib

import pytest

from quire.operators import memory
from quire.plans import pipeline
from quire.plans.options import Options
from quire.sources import files, pdf
from quire.sources.pdf import Document, Name, Ref, Stream


def sample(pages=("BT /F1 12 Tf 100 700 Td (Hello) Tj 0 -14 Td [(wor) -500 (ld)] TJ ET 0 0 0 RG 0.5 w 100 650 m 200 650 l S",), rotate=0, packed=False, form=None):
    """A small file, made by hand."""
    objects = {1: {"Type": Name("Catalog"), "Pages": Ref(2)}, 3: {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Times-Roman")}}
    resources = {"Font": {"F1": Ref(3)}}
    if form:
        objects[4] = Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, 100, 100], "Matrix": [1, 0, 0, 1, 10, 20], "Filter": Name("FlateDecode")}, zlib.compress(form.encode()))
        resources["XObject"] = {"X1": Ref(4)}
    kids = []
    for k, content in enumerate(pages):
        objects[10 + 2 * k] = Stream({"Filter": Name("FlateDecode")} if k % 2 else {}, zlib.compress(content.encode()) if k % 2 else content.encode())
        objects[11 + 2 * k] = {"Type": Name("Page"), "Parent": Ref(2), "Contents": Ref(10 + 2 * k)}
        kids.append(Ref(11 + 2 * k))
    objects[2] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids), "MediaBox": [0, 0, 612, 792], "Resources": resources, "Rotate": rotate}
    doc = Document.__new__(Document)
    doc.objects, doc.trailer = objects, {"Root": Ref(1)}
    if not packed:
        return doc.bytes()
    inside = {n: v for n, v in objects.items() if not isinstance(v, Stream)}
    parts = {n: pdf.serialized(v) for n, v in inside.items()}
    head, at = "", 0
    for n, p in parts.items():
        head += f"{n} {at} "
        at += len(p) + 1
    body = head.encode() + b"\n".join(parts.values())
    width = 7
    rows = b"".join(b"\x02" + bytes((c - (body[k - width + j] if k >= width else 0)) & 255 for j, c in enumerate(body[k : k + width].ljust(width, b" "))) for k in range(0, len(body), width))
    doc.objects = {n: v for n, v in objects.items() if isinstance(v, Stream)}
    out = doc.bytes().split(b"xref\n")[0]
    info = {"Type": Name("ObjStm"), "N": len(inside), "First": len(head), "Filter": Name("FlateDecode"), "DecodeParms": {"Predictor": 12, "Columns": width}}
    out += b"90 0 obj\n" + pdf.serialized(Stream(info, zlib.compress(rows))) + b"\nendobj\n"
    return out + b"91 0 obj\n" + pdf.serialized(Stream({"Type": Name("XRef"), "Root": Ref(1), "Size": 92, "W": [1, 1, 1]}, b"")) + b"\nendobj\n%%EOF"


@pytest.mark.parametrize("v", [None, True, 5, -2.5, b"a(b)\\\xff", Name("A B#"), [1, [Ref(7)]], {"K": {"L": [Name("x")]}}])
def test_objects_round_trip(v):
    assert pdf.value(pdf.serialized(v))[0] == v


def test_strings():
    assert pdf.value(rb"(a\(b\)\n\101(c)\\)")[0] == b"a(b)\nA(c)\\"
    assert pdf.value(b"<4 1 4>")[0] == b"A@"


@pytest.mark.parametrize("packed", [False, True])
def test_glyphs_of_a_page(packed):
    items = list(pdf.page_items(sample(packed=packed)))
    text = [i for i in items if i["ch"]]
    assert "".join(i["ch"] for i in text) == "Helloworld"
    h, e = text[0], text[1]
    assert (h["x0"], h["y0"], h["y1"], h["size"]) == (100.0, 700.0, 712.0, 12.0)
    assert e["x0"] == pytest.approx(100 + 0.722 * 12)
    assert text[8]["x0"] - text[7]["x0"] == pytest.approx((0.333 + 0.5) * 12)
    line = items[-1]
    assert line["ch"] is None and (line["x0"], line["x1"], line["y0"], line["linewidth"]) == (100.0, 200.0, 650.0, 0.5)
    assert text[0]["font"] == "F1+Times-Roman"


def test_rotated_page():
    items = [i for i in pdf.page_items(sample(rotate=90)) if i["ch"]]
    assert (items[0]["page_w"], items[0]["page_h"]) == (792.0, 612.0)
    assert items[0]["x0"] == pytest.approx(700.0) and items[0]["y1"] == pytest.approx(512.0)


def test_forms_are_containers_of_their_own():
    items = list(pdf.page_items(sample(pages=("q 2 0 0 2 0 0 cm /X1 Do Q",), form="BT /F1 10 Tf 5 5 Td (in) Tj ET")))
    assert {i["container"] for i in items} == {"page/4"} and items[0]["x0"] == 2 * (10 + 5) and items[0]["size"] == 20.0


def test_patched_and_interleaved():
    original = sample(pages=("q 1 0 0 rg 5 5 10 10 re f Q BT /F1 12 Tf 10 700 Td (old) Tj ET", "BT /F1 12 Tf 10 700 Td (two) Tj ET"))
    mono = pdf.patched(original, {(0, "page"): "BT /tiro 12 Tf 1 0 0 1 10 700 Tm [<6e6577>] TJ ET "})
    doc = Document(mono)
    said = doc.contents(doc.pages[0])
    assert b"re f" in said and b"(old)" not in said and b"6e6577" in said
    text = ["".join(i["ch"] for i in pdf.page_items(mono) if i["ch"] and i["pageno"] == p) for p in (0, 1)]
    assert text == ["new", "two"]
    dual = Document(pdf.interleaved(original, mono))
    assert len(dual.pages) == 4
    both = list(pdf.page_items(dual.bytes()))
    assert ["".join(i["ch"] for i in both if i["ch"] and i["pageno"] == p) for p in range(4)] == ["old", "new", "two", "two"]


def test_patched_form_undoes_its_place():
    original = sample(pages=("q 2 0 0 2 0 0 cm /X1 Do Q",), form="BT /F1 10 Tf 5 5 Td (in) Tj ET")
    mono = pdf.patched(original, {(0, "page/4"): "BT /tiro 10 Tf 1 0 0 1 30 50 Tm [<6f7574>] TJ ET "})
    got = [i for i in pdf.page_items(mono) if i["ch"]]
    assert "".join(i["ch"] for i in got) == "out" and (got[0]["x0"], got[0]["y0"]) == pytest.approx((30.0, 50.0))


def test_refused_files():
    with pytest.raises(pdf.PdfError):
        Document(b"no file at all")
    with pytest.raises(pdf.PdfError, match="encrypted"):
        Document(sample().replace(b"trailer\n<<", b"trailer\n<</Encrypt 9 0 R "))


def test_unicode_tables():
    got = pdf._unicode_map(b"1 beginbfchar <01> <0041> endbfchar 2 beginbfrange <02> <04> <0061> <05> <06> [<0078> <00790079>] endbfrange")
    assert got == {1: "A", 2: "a", 3: "b", 4: "c", 5: "x", 6: "yy"}


def small_font():
    """A TrueType file with just the tables that are read: A at glyph 1, B at glyph 2."""
    cmap = struct.pack(">HHHHL", 0, 1, 3, 1, 12) + struct.pack(">HHHHHHH", 4, 32, 0, 4, 0, 0, 0) + struct.pack(">HH", 66, 0xFFFF) + b"\0\0" + struct.pack(">HH", 65, 0xFFFF) + struct.pack(">HH", (1 - 65) & 0xFFFF, 1) + struct.pack(">HH", 0, 0)
    tables = {b"cmap": cmap, b"head": b"\0" * 18 + struct.pack(">H", 1000) + b"\0" * 34, b"hhea": b"\0" * 34 + struct.pack(">H", 3), b"hmtx": struct.pack(">HhHhHh", 500, 0, 600, 0, 700, 0)}
    out, at, body = struct.pack(">LHHHH", 0x10000, len(tables), 0, 0, 0), 12 + 16 * len(tables), b""
    for tag, t in tables.items():
        out += struct.pack(">4sLLL", tag, 0, at + len(body), len(t))
        body += t
    return pdf.WideFont(out + body, "Small")


def test_wide_font():
    font = small_font()
    m = font.metrics()
    assert font.cmap()[65] == 1 and font.cmap()[66] == 2 and m.wide[66] == 0.7 and m.codes("noto", "AB") == "00010002"
    mono = pdf.patched(sample(), {(0, "page"): "BT /noto 10 Tf 1 0 0 1 0 0 Tm [<00010002>] TJ ET "}, font)
    got = [i for i in pdf.page_items(mono) if i["ch"]]
    assert [i["cid"] for i in got] == [1, 2] and got[1]["x0"] == pytest.approx(6.0)


def test_files_to_files(spark, tmp_path):
    good = sample(pages=("BT /F1 12 Tf 100 700 Td (Hello) Tj 0 -14 Td (world 5) Tj ET", "BT /F1 12 Tf 100 700 Td (Next) Tj ET"))
    docs = files.from_bytes(spark, [good, b"broken"])
    e = memory.Engine("pseudo", "en", "zh", "", memory.pseudo("zh"))
    got = {r.doc_id: r for r in pipeline.translate_files(docs, None, None, e, Options(service="pseudo", pages=(0,))).collect()}
    assert got[1].error and got[1].mono_content is None
    mono, dual = bytes(got[0].mono_content), bytes(got[0].dual_content)
    assert ["".join(i["ch"] for i in pdf.page_items(mono) if i["ch"] and i["pageno"] == p) for p in (0, 1)] == ["[zh] Hello world 5", "Next"]
    assert len(Document(dual).pages) == 4


def test_command_line(spark, tmp_path, capsys):
    from quire.plans.cli import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(sample())
    (tmp_path / "in/b.PDF").write_bytes(b"broken")
    engine = lambda spec, lang_in, lang_out, *_: memory.Engine("pseudo", lang_in, lang_out, "", memory.pseudo(lang_out))
    assert main([str(tmp_path / "in/a.pdf"), "-lo", "fr", "-o", str(tmp_path / "out"), "--cache", str(tmp_path / "memory")], engine) == 0
    mono = (tmp_path / "out/a-mono.pdf").read_bytes()
    assert "".join(i["ch"] for i in pdf.page_items(mono) if i["ch"]).replace(" ", "") == "[fr]Helloworld"  # blanks go where lines wrap
    assert len(Document((tmp_path / "out/a-dual.pdf").read_bytes()).pages) == 2
    assert main([str(tmp_path / "in"), "--dir"], engine) == 1  # one file is broken
    assert (tmp_path / "in/a-mono.pdf").exists() and "b.PDF" in capsys.readouterr().err


def test_service(spark):
    import json
    import threading
    import time
    import urllib.error
    import urllib.request

    from quire.plans import service

    engine = lambda spec, lang_in, lang_out: memory.Engine(spec, lang_in, lang_out, "", memory.pseudo(lang_out))
    web = service.server(spark, ("127.0.0.1", 0), engine)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{web.server_port}/v1/translate"

    def ask(path="", data=None, kind="text/plain", method=None):
        request = urllib.request.Request(root + path, data=data, headers={"Content-Type": kind}, method=method)
        try:
            with urllib.request.urlopen(request, timeout=60) as answer:
                return answer.status, answer.read()
        except urllib.error.HTTPError as failure:
            return failure.code, failure.read()

    options = json.dumps({"service": "pseudo", "lang_out": "fr", "pages": "1"}).encode()
    form = b'--x\r\nContent-Disposition: form-data; name="data"\r\n\r\n' + options + b'\r\n--x\r\nContent-Disposition: form-data; name="file"; filename="a.pdf"\r\nContent-Type: application/pdf\r\nContent-Transfer-Encoding: binary\r\n\r\n' + sample() + b"\r\n--x--\r\n"
    status, said = ask(data=form, kind="multipart/form-data; boundary=x")
    job = json.loads(said)["id"]
    assert status == 200 and ask("/none")[0] == 404 and ask(data=b"", kind="multipart/form-data; boundary=x")[0] == 400
    states = []
    for _ in range(120):
        early = ask(f"/{job}/mono")[0]
        states.append(json.loads(ask(f"/{job}")[1])["state"])
        if states[-1] == "SUCCESS":
            break
        assert early == 400 and states[-1] in ("PENDING", "PROGRESS")
        time.sleep(0.2)
    mono, dual = (ask(f"/{job}/{k}")[1] for k in ("mono", "both"))
    assert "".join(i["ch"] for i in pdf.page_items(mono) if i["ch"]).startswith("[fr] Hello") and len(Document(dual).pages) == 2
    assert json.loads(ask(f"/{job}", method="DELETE")[1])["state"] == "SUCCESS"
    web.shutdown()


def test_layout_through_the_command_line(spark, tmp_path):
    from quire.plans.cli import main

    path = tmp_path / "a.pdf"
    path.write_bytes(sample(pages=("BT /F1 12 Tf 100 700 Td (Text) Tj ET BT /F1 12 Tf 100 400 Td (Cells) Tj ET",)))
    boxes = tmp_path / "boxes"
    spark.createDataFrame([(f"file:{path}", 0, 0, 90.0, 360.0, 300.0, 420.0, 0.9, "table", 612.0, 792.0)], "path string, pageno int, det_idx int, x0 double, y0 double, x1 double, y1 double, conf double, name string, page_w double, page_h double").write.parquet(str(boxes))
    engine = lambda spec, lang_in, lang_out, *_: memory.Engine("pseudo", lang_in, lang_out, "", memory.pseudo(lang_out))

    def said(*more):
        assert main([str(path), "-lo", "fr", "-o", str(tmp_path / "out"), *more], engine) == 0
        return "".join(i["ch"] for i in pdf.page_items((tmp_path / "out/a-mono.pdf").read_bytes()) if i["ch"])

    assert said("--boxes", str(boxes)) == "[fr] TextCells"
    assert said() == "[fr] Text Cells"
    with pytest.raises(ValueError, match="images"):
        main([str(path), "--onnx", "model.onnx"], engine)


def outline_font():
    """Four glyphs with outlines: 3 is composed of 1."""
    simple = struct.pack(">hhhhh", 1, 0, 0, 10, 10) + b"\x01" * 14
    composite = struct.pack(">hhhhh", -1, 0, 0, 10, 10) + struct.pack(">HHbb", 0x02, 1, 0, 0)
    glyf, at = b"", [0]
    for outline in (simple, simple, simple, composite):
        glyf += outline
        at.append(len(glyf))
    tables = {b"glyf": glyf, b"loca": struct.pack(">5H", *(x // 2 for x in at)), b"head": b"\0" * 18 + struct.pack(">H", 1000) + b"\0" * 30 + struct.pack(">hh", 0, 0), b"hhea": b"\0" * 34 + struct.pack(">H", 4), b"hmtx": struct.pack(">HhHhHhHh", 500, 0, 600, 0, 700, 0, 800, 0), b"maxp": b"\0" * 6}
    out, start, body = struct.pack(">LHHHH", 0x10000, len(tables), 0, 0, 0), 12 + 16 * len(tables), b""
    for tag, t in tables.items():
        out += struct.pack(">4sLLL", tag, 0, start + len(body), len(t))
        body += t
    return pdf.WideFont(out + body)


def test_font_subset():
    font = outline_font()
    for used, kept in (({3}, {0, 1, 3}), ({2}, {0, 2}), (set(), {0})):
        small = pdf.WideFont(font.only(used))
        at = struct.unpack(">5L", small._table(b"loca"))
        assert {g for g in range(4) if at[g] < at[g + 1]} == kept and small.advances() == font.advances()
    mono = pdf.patched(sample(), {(0, "page"): "BT /noto 10.0 Tf 1 0 0 1 0 0 Tm [<00020002>] TJ ET "}, font)
    whole = pdf.patched(sample(), {(0, "page"): "BT /noto 10.0 Tf 1 0 0 1 0 0 Tm [<00020002>] TJ ET "}, pdf.WideFont(font.data, subset=False))
    sizes = [next(v.info["Length1"] for v in Document(c).objects.values() if isinstance(v, Stream) and "Length1" in v.info) for c in (mono, whole)]
    assert sizes[0] != sizes[1] == len(font.data)
    assert [i["x0"] for i in pdf.page_items(mono) if i["ch"]] == pytest.approx([0.0, 7.0])


def test_deep_nesting_is_the_files_error(spark):
    deep = sample().replace(b"/Rotate 0", b"/Rotate " + b"[" * 5000 + b"]" * 5000)
    e = memory.Engine("pseudo", "en", "zh", "", memory.pseudo("zh"))
    got = {r.doc_id: r for r in pipeline.translate_files(files.from_bytes(spark, [deep, sample()]), None, None, e, Options(service="pseudo")).collect()}
    assert "Recursion" in got[0].error and got[1].mono_content

import io
import zipfile

from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import chunking
from quillgraph.schemas import Settings, load_settings
from quillgraph.sources import files, remote


def one(spark, column, **values):
    row = [tuple(values.values())]
    return spark.createDataFrame(row, list(values)).select(column.alias("v")).first().v


def test_text_functions(spark):
    assert one(spark, T.tokenize("t"), t="RK3588 npu_x 3abc 知识 A") == ["知", "识", "rk3588", "npu_x", "abc"]
    sim = lambda a, b: one(spark, T.name_similarity("a", "b"), a=a, b=b)
    assert sim("Foo-Bar!", "foobar") == 1.0 and abs(sim("abcdefg", "abcdefx") - 6 / 7) < 1e-9 and sim("--", "!!") == 1.0
    assert one(spark, T.normalize_name("t"), t="Grüße, Welt_1") == "grüßewelt_1"
    assert one(spark, T.safe_filename("t"), t=" a/b  c:d ") == "ab_cd" and one(spark, T.safe_filename("t"), t="//") == "unknown_entity"
    assert one(spark, T.source_of_chunk("t"), t="a_chunk_b_chunk_3") == "a_chunk_b" and one(spark, T.source_of_chunk("t"), t="x.csv_row_2") == "x.csv"
    assert one(spark, T.source_of_chunk("t"), t="plain") is None
    got = one(spark, T.parse_triples("t"), t='Sure: [{"subject": "a", "object": "b", "confidence": 0.9}] done')
    assert got[0].subject == "a" and got[0].relation is None
    assert one(spark, T.parse_triples("t"), t="no array") is None
    assert one(spark, T.cypher_quote("t"), t="O'Neil") == "O\\'Neil"
    assert one(spark, T.word_count("t"), t="a b c") == 3
    assert T.parse_path_query("a > b") == ("a", "b") and T.parse_path_query("a") is None and T.parse_path_query("A -> B") == ("A -", "B")
    assert [one(spark, T.two_places(F.lit(x)), t="") for x in (0.945, 0.125, 1.0, 0.5)] == ["0.94", "0.12", "1.00", "0.50"]


def chunks(df):
    return [(r.id, r.text) for r in df.orderBy("index").collect()]


def test_fixed(spark):
    df = lambda t: spark.createDataFrame([("d", t)], "source string, text string")
    p = ["a1 a2 a3", "b1 b2 b3", "c1 c2 c3"]
    assert chunks(chunking.fixed_chunks(df("\n\n".join(p)), size=6)) == [("d_chunk_0", "a1 a2 a3 b1 b2 b3"), ("d_chunk_1", "b1 b2 b3 c1 c2 c3")]
    assert chunks(chunking.fixed_chunks(df("w1 w2 w3 w4\n\nx"), size=3)) == [("d_chunk_0", "w1 w2 w3 w4"), ("d_chunk_1", "x")]
    assert chunks(chunking.fixed_chunks(df("\n\na b c"), size=2)) == [("d_chunk_1", "a b c")]
    assert chunks(chunking.fixed_chunks(df(None))) == []


def test_sliding(spark):
    df = spark.createDataFrame([("d", " ".join(map(str, range(10))))], "source string, text string")
    got = chunks(chunking.sliding_chunks(df, 4, 1))
    assert [t.split()[0] for _, t in got] == ["0", "3", "6", "9"] and got[-1][1] == "9"
    assert chunks(chunking.sliding_chunks(df, 2, 3)) == []


def package(parts):
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    return f.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
R = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'


def test_directory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("hello world\n\nsecond part")
    (tmp_path / "sub" / "a.md").write_text("other")
    (tmp_path / "t.csv").write_text("n,v,w,x\nfoo,1,,2\nbar,2,3,4\n")
    (tmp_path / "short.csv").write_text("n,v\nfoo,1\nbar\nbaz,3\n")
    (tmp_path / "p.png").write_bytes(b"\x89PNG")
    (tmp_path / "skip.exe").write_bytes(b"x")
    (tmp_path / "d.docx").write_bytes(package({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>one </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>"}))
    (tmp_path / "x.xlsx").write_bytes(package({
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="S1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships {R}><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>name</t></si><si><t>size</t></si><si><t>bolt</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>1.5</v></c></row><row r="4"><c r="B4"><v>7</v></c></row></sheetData></worksheet>',
    }))
    slide = lambda t: f"<p:sld {P}><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:sld>"
    (tmp_path / "s.pptx").write_bytes(package({
        "ppt/presentation.xml": f'<p:presentation {P}><p:sldIdLst><p:sldId id="1" r:id="r2"/><p:sldId id="2" r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": f'<Relationships {R}><Relationship Id="r1" Target="slides/slide1.xml"/><Relationship Id="r2" Target="slides/slide2.xml"/></Relationships>',
        "ppt/slides/slide1.xml": slide("last"), "ppt/slides/slide2.xml": slide(" first "),
    }))
    found = files.discover(spark, str(tmp_path))
    assert found.count() == 8
    got = {(r.path.rsplit("/", 1)[-1], r.id): (r.text, r.word_count) for r in files.chunk_files(found, Settings()).collect() if "/sub/" not in r.path}
    assert got["a.md", "a.md_chunk_0"] == ("hello world second part", 4)
    assert got["t.csv", "t.csv_row_0"][0] == "行 1:, n=foo, v=1, x=2" and ("t.csv", "t.csv_row_1") in got
    assert [k for k in got if k[0] == "short.csv"] == [("short.csv", "short.csv_row_0")]
    assert got["p.png", "p.png_image_0"] == ("[Image file: p.png]", 4)
    assert got["d.docx", "d.docx_chunk_0"][0] == "one two three"
    assert got["x.xlsx", "x.xlsx_S1_row_2"][0] == "Sheet=S1, 行 2:, name=bolt, size=1.5" and got["x.xlsx", "x.xlsx_S1_row_3"][0] == "Sheet=S1, 行 3:"
    assert got["x.xlsx", "x.xlsx_S1_row_4"][0] == "Sheet=S1, 行 4:, size=7"
    assert got["s.pptx", "s.pptx_slide_1"][0] == "first" and got["s.pptx", "s.pptx_slide_2"][0] == "last"
    assert files.pptx_slides(package({"ppt/presentation.xml": f"<p:presentation {P}/>", "ppt/_rels/presentation.xml.rels": f"<Relationships {R}/>"}), "e") == [("e_empty", 0, "")]


TREE = {None: ["n1", "n2"], "n1": ["n3"], "n2": [], "n3": []}


def stub(options):
    def get(path, params):
        if path.endswith("/nodes"):
            names = TREE[params["parent_node_token"]]
            start = int(params["page_token"] or 0)
            items = [{"node_token": n, "obj_token": n, "obj_type": "sheet" if n == "n2" else "docx", "title": n, "has_child": bool(TREE[n])} for n in names[start : start + 1]]
            return {"items": items, "has_more": start + 1 < len(names), "page_token": str(start + 1)}
        kinds = [(1, "line"), (2, " two "), (3, "head"), (4, ""), (10, "item"), (99, "gone")]
        return {"items": [{"block_type": k, "style": 2, "text": [{"content": t}]} for k, t in kinds] + [{"block_type": 7, "image": {"token": "tok"}}], "has_more": False}

    return get


def test_remote(spark):
    remote.register(spark, "stub_wiki", stub)
    got = {r.title: r.text for r in remote.documents(spark.read.format("stub_wiki").option("space", "s").load()).collect()}
    assert set(got) == {"n1", "n3"}
    assert got["n1"] == "# n1\n\nline\ntwo\n## head\n[table]\n- item\n![image](img_tok.bin)"


def test_settings(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text('{"chunking": {"strategy": "sliding_window", "chunk_size": 7, "unknown": 1}}')
    assert load_settings(str(p)).chunk_size == 7 and load_settings().overlap == 250

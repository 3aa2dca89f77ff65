import io
import zipfile

import pytest

from millrace.operators.chunking import ChunkSizes, chunk, pack, sections
from millrace.plans.ingest import ingest
from millrace.sources import files, records

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(*paragraphs: tuple[str, str | None], drawing: bool = False) -> bytes:
    body = "".join(f"<w:p>{f'<w:pPr><w:pStyle w:val="{s}"/></w:pPr>' if s else ''}<w:r><w:t>{t}</w:t></w:r></w:p>" for t, s in paragraphs)
    body += "<w:p><w:r><w:drawing/></w:r></w:p>" * drawing
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


@pytest.fixture(scope="module")
def ingested(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    put = lambda name, data: ((root / name).parent.mkdir(parents=True, exist_ok=True), (root / name).write_bytes(data))
    put("fujian/a b.docx", docx(("本办法适用于各类主体。", None), ("申请指南", "Heading1"), ("最高50万元。", None)))
    put("北京农户/empty.docx", docx(drawing=True))
    put("x/bad.docx", b"not-a-zip")
    put("x/t.txt", "题目\n\n第一行\n第二行\n\n末段".encode())
    put("x/blank.txt", b"")
    put("x/m.md", "# 题目\n\n正文。\n\n## 节\n\n内容。".encode())
    put("x/sparse.pdf", b"(Hi) (OK) (Hi)")
    put("x/none.pdf", b"<<>>")
    put("x/p.png", b"\x89PNG")
    put("x/s.xls", b"x")
    put("x/skip.tmp", b"x")
    return ingest(spark, str(root), str(tmp_path_factory.mktemp("out")))


def test_files_become_documents_and_no_file_ends_the_run(ingested):
    docs = {r.file_name: r for r in ingested.documents.collect()}
    assert "skip.tmp" not in docs and len(docs) == 10
    a = docs["a b.docx"]
    assert (a.region, a.title, a.parse_status) == ("fj", "申请指南", "success") and a.doc_id.startswith("fj:a_b:")
    assert (docs["empty.docx"].region, docs["empty.docx"].parse_status, docs["empty.docx"].ocr_needed, docs["empty.docx"].title) == ("北京", "partial", True, "empty")
    assert docs["bad.docx"].parse_status == "failed" and docs["bad.docx"].parse_error.startswith("The docx file cannot be read")
    assert docs["t.txt"].paragraphs == ["题目", "第一行\n第二行", "末段"] and docs["t.txt"].source_format_confidence == 0.92
    assert (docs["blank.txt"].parse_status, docs["blank.txt"].text_quality_flag, docs["blank.txt"].title) == ("partial", "empty", "blank")
    assert docs["m.md"].title == "题目" and docs["m.md"].paragraphs == ["# 题目", "正文。", "## 节", "内容。"]
    assert docs["sparse.pdf"].paragraphs == ["Hi", "OK"] and docs["sparse.pdf"].parse_status == "partial"
    assert docs["none.pdf"].parse_status == "failed" and docs["none.pdf"].ocr_needed
    assert docs["p.png"].parse_status == "skipped" and docs["s.xls"].parse_error == "Files of type xls have no parser."


def test_report_and_manifest(ingested):
    r = ingested.report.first()
    assert (r.total_files, r.parsed_successfully, r.parsed_partially, r.parse_failed) == (10, 3, 3, 4)
    assert r.chunks_created == ingested.chunks.count() > 0
    assert ingested.manifest.where("parse_status is null").count() == 0
    errors = files.report_errors(ingested.documents).collect()
    assert sum(r.source_path.endswith("bad.docx") for r in errors) == 2 and not any(r.source_path.endswith("t.txt") for r in errors)
    assert ingested.manifest.where("length(checksum) = 64").count() == 10


def test_outputs_are_replaced_as_a_whole(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("题目\n\n正文一。", encoding="utf-8")
    out = str(tmp_path / "out")
    ingest(spark, str(tmp_path / "in"), out)
    (tmp_path / "in" / "b.txt").write_text("题目\n\n正文二。", encoding="utf-8")
    again = ingest(spark, str(tmp_path / "in"), out)
    assert again.documents.count() == 2 and not (tmp_path / "out" / "_staged").exists()
    assert records.read_chunks(spark, records.resolve(out, "kb_chunks.jsonl")).count() == again.chunks.count() == 2


def test_a_parser_may_be_added(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s.xls").write_bytes(b"cell")

    def parse_xls(content, stem):
        return stem, content.decode(), [content.decode()], files._told("success", "clean", 1.0)

    docs = files.parse(files.manifest(files.scan(spark, str(tmp_path / "in"))), files.PARSERS | {"xls": parse_xls}).collect()
    assert docs[0].paragraphs == ["cell"] and docs[0].parse_status == "success"


SCHEMA = "doc_id string, region string, title string, file_name string, source_path string, raw_text string, paragraphs array<string>, parse_status string"


def test_sections_and_chunks(spark):
    paragraphs = ["前言说明这里是一段没有标题的正文内容而且比较长一些。", "一、申请条件", "满足条件甲。", " ", "满足条件乙。", "## 材料", "身份证。"]
    df = spark.createDataFrame([("d", "r", "", "f.txt", "/p", "", paragraphs, "success"), ("n", "r", None, None, None, None, None, None), ("x", "r", "t", "f", "/p", "甲。\n\n乙。", [], "success"), ("f", "r", "t", "f", "/p", "甲。", ["甲。"], "failed")], SCHEMA)
    found = [tuple(r)[2:] for r in sections(df).where("doc_id = 'd'").orderBy("section_no").collect()]
    assert found == [(None, 0, 0, None), ("一、申请条件", 1, 3, 1), ("材料", 4, 5, 4)]
    got = chunk(df, ChunkSizes(5, 20, 60)).orderBy("doc_id", "chunk_index").collect()
    assert [(r.section_title, r.chunk_text, r.paragraph_range.start, r.paragraph_range.end) for r in got if r.doc_id == "d"] == [
        (None, paragraphs[0], 0, 0),
        ("一、申请条件", "满足条件甲。\n\n满足条件乙。", 2, 4),
        ("材料", "## 材料\n\n身份证。", 5, 6),
    ]
    assert got[0].source_title == "f.txt" and got[0].chunk_id.startswith("d:chunk:0:")
    assert [r.chunk_text for r in got if r.doc_id == "x"] == ["甲。\n\n乙。"]
    assert not [r for r in got if r.doc_id in "fn"]


def test_long_paragraphs_are_cut_at_sentences():
    items = [{"at": 1, "text": "这是第一句话内容。" * 8, "no": 0, "section": 0, "title": None, "heading": -1}]
    out = pack(items, ChunkSizes(20, 40, 45))
    assert len(out) >= 2 and all(len(s[0]) <= 45 and s[1:3] == (1, 1) for s in out)


def test_sizes():
    assert ChunkSizes.of() == ChunkSizes(233, 700, 800)
    with pytest.raises(ValueError):
        ChunkSizes.of(100, 100)


def test_chunk_records_with_other_names(spark, tmp_path):
    (tmp_path / "chunks").mkdir()
    (tmp_path / "chunks" / "kb_chunks.jsonl").write_text('{"chunk_id": "a", "content": "正文", "title": "题", "index": 3, "section": "节", "paragraph_range": [1, 2], "source_path": "/x", "metadata": {"region": "fj"}}\n\n{"chunk_id": "b", "chunk_text": "", "text": "乙", "doc_id": ""}\n', encoding="utf-8")
    a, b = records.read_chunks(spark, records.resolve(str(tmp_path))).orderBy("chunk_id").collect()
    assert (a.chunk_text, a.source_title, a.chunk_index, a.section_title, a.region, a.doc_id) == ("正文", "题", 3, "节", "fj", "a")
    assert a.metadata["source_path"] == "/x" and (a.paragraph_range.start, a.paragraph_range.end) == (1, 2)
    assert (b.chunk_text, b.doc_id, b.paragraph_range) == ("乙", "b", None)
    with pytest.raises(FileNotFoundError):
        records.resolve(str(tmp_path / "nowhere"))

"""Pages in and out: PDF reader and writer, assembly, pictures, recognition by option, services."""

import json
import threading
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from quire.operators import draw, services, translate
from quire.plans import stages
from quire.sources import config, ocr, pdf

BASE = "/root/testdata/sf0.001"
COMMANDS = [
    {"layer": 1, "item_idx": 0, "op": "text", "line_no": 0, "x": 50.0, "y": 100.0, "x1": None, "y1": None, "font": 12, "text": "水门检查 A-1"},
    {"layer": 1, "item_idx": 0, "op": "ground", "line_no": -1, "x": 45.0, "y": 85.0, "x1": 200.0, "y1": 120.0, "font": 0, "text": None},
    {"layer": 0, "item_idx": 0, "op": "frame", "line_no": -1, "x": 45.0, "y": 85.0, "x1": 200.0, "y1": 120.0, "font": 0, "text": None},
]
IMAGE = {"layer": -1, "item_idx": 0, "op": "image", "line_no": -1, "x": 0.0, "y": 0.0, "x1": 595.0, "y1": 842.0, "font": 0, "text": None}
PICTURE = (2).to_bytes(4, "big") + (3).to_bytes(4, "big") + zlib.compress(b"\x00\xff" * 3)


def test_reader_reads_what_the_writer_writes():
    pages = pdf.read_plain(pdf.write_pdf([(595.0, 842.0, COMMANDS, None), (200.5, 100.0, [], None), (595.0, 842.0, [IMAGE, *COMMANDS], PICTURE)]))
    assert [(p["width"], p["height"], len(p["spans"]), len(p["images"])) for p in pages] == [(595.0, 842.0, 1, 0), (200.5, 100.0, 0, 0), (595.0, 842.0, 1, 1)]
    span = pages[0]["spans"][0]
    assert (span["text"], span["size"], span["x0"], span["y0"], span["y1"]) == ("水门检查 A-1", 12.0, 50.0, 88.0, 100.0)
    assert pages[2]["images"] == [{"x0": 0.0, "y0": 0.0, "x1": 595.0, "y1": 842.0}]
    assert pdf.read_plain(b"") == [] and pdf.read_plain(b"%PDF-1.4 nothing") == []


def test_hand_written_file():
    data = b"1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj 2 0 obj <</Kids [3 0 R] /MediaBox [0 0 300 200]>> endobj 3 0 obj <</Type /Page /Contents [4 0 R]>> endobj\n4 0 obj <</Length 9>>\nstream\nBT /F1 10 Tf 20 150 Td (a\\(b\\)) Tj 0 -20 Td (c) Tj ET\nendstream endobj"
    (page,) = pdf.read_plain(data)
    assert [(s["text"], s["x0"], s["y1"]) for s in page["spans"]] == [("a(b)", 20.0, 50.0), ("c", 20.0, 70.0)] and page["height"] == 200.0


def test_pages_from_files(spark, tmp_path):
    good = pdf.write_pdf([(595.0, 842.0, [c | {"text": "長い本文がここに印刷されている。次の行もある。"} if c["op"] == "text" else c for c in COMMANDS], None), (595.0, 842.0, [IMAGE], PICTURE)])
    (tmp_path / "a.pdf").write_bytes(good)
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    files = pdf.read_pdfs(spark, str(tmp_path)).select(F.when(F.col("path").endswith("a.pdf"), 1).otherwise(2).cast("bigint").alias("doc_id"), "content")
    pages = pdf.read_pages(files)
    sizes, blocks, images = pdf.assemble_pages(pages, 72)
    assert [(r.doc_id, r.page_num, r.needs_ocr) for r in sizes.orderBy("page_num").collect()] == [(1, 1, False), (1, 2, True)]
    assert [(r.page_num, r.text, r.source) for r in blocks.collect()] == [(1, "長い本文がここに印刷されている。次の行もある。", "native")]
    assert [(r.page_num, r.x1, r.y1) for r in images.collect()] == [(2, 595.0, 842.0)]
    pictures = pdf.rasterise(pages, 72)
    wanted = pdf.pages_for_ocr(sizes, pictures).collect()
    assert [r.page_num for r in wanted] == [2] and wanted[0].image[:8] == b"\x89PNG\r\n\x1a\n"
    assert pdf.pages_for_ocr(sizes, pictures, no_ocr=True).count() == 0 and pdf.pages_for_ocr(sizes, pictures.limit(0)).count() == 0
    assert pdf.read_pages(files, page_start=2).count() == 1 and pdf.read_pages(files.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pdf.read_pages(files, "nothing")


def test_drawn_pages_as_files(spark):
    pages, paras = (spark.read.parquet(f"{BASE}/{t}.parquet") for t in ("ocr_pages", "ocr_paragraphs"))
    points = stages.page_points(pages)
    commands = stages.drawing(paras.select("doc_id", "page_num", "para_idx", F.col("translated_text").alias("translation")).dropDuplicates(["doc_id", "page_num", "para_idx"]), paras, pages)
    commands = commands.unionByName(pdf.image_commands(draw.page_modes(points, stages.stored_line_rows(paras)), points))
    files = pdf.pdf_files(commands, points, 2).collect()
    read = [p for f in files for p in pdf.read_plain(bytes(f.content))]
    assert len(read) == points.count() and sum(len(p["spans"]) for p in read) == commands.where("op = 'text'").count()


def test_recognition_by_option(spark):
    boxes_ = lambda text, at: lambda lang: lambda image: [([(at, 0), (at + 9, 8)], text, 0.9)]
    ocr.register_engine("easyocr", boxes_("a", 0), 0.1)
    ocr.register_engine("paddle", boxes_("bb", 1), 0.1)
    pages = spark.createDataFrame([(1, 1, bytearray(b"p"))], "doc_id bigint, page_num bigint, image binary")
    assert {k: [r.text for r in ocr.recognise_as(pages, k).collect()] for k in ("both", "paddle", "easyocr", "other")} == {"both": ["bb"], "paddle": ["bb"], "easyocr": ["a"], "other": ["a"]}


class Chat(BaseHTTPRequestHandler):
    seen: list = []

    def do_POST(self):  # noqa: N802
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Chat.seen.append((self.path, self.headers.get("Authorization"), body))
        user = body["messages"][1]["content"]
        if "破損" in user:
            self.send_response(500)
            self.end_headers()
            return
        text = json.dumps({"items": [{"id": i["id"], "text": "译" + i["text"][0]} for i in json.loads(user)["items"]]}) if user.startswith("{") else " 自由译文 "
        reply = {"message": {"content": text}} if self.path == "/api/chat" else {"choices": [{"message": {"content": text}}]}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(reply).encode())

    def log_message(self, *args):
        pass


def test_services(spark):
    server = HTTPServer(("127.0.0.1", 0), Chat)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    texts = spark.createDataFrame([("日本語",), ("破損した文",)], "text string")
    memory = spark.createDataFrame([], "source_hash string, source_text string, translated_text string")
    try:
        for backend in (translate.create_backend("local", url=url), translate.create_backend("hosted", url=url, key="k"), translate.create_backend("client", start=lambda: lambda system, user, as_json: '{"items":[{"id":0,"text":"译日"}]}' if "日本" in user else "")):
            done, new = translate.translate_texts(texts, memory, backend)
            assert [(r.source_text, r.translation) for r in done.collect()] == [("日本語", "译日")] and new.count() == 1
        free = services.LocalService(url).translate_text(spark.createDataFrame([("文",)], "source_text string")).collect()
        assert [(r.source_text, r.reply) for r in free] == [("文", "自由译文")]
    finally:
        server.shutdown()
    assert {p for p, _, _ in Chat.seen} == {"/api/chat", "/chat/completions"} and {a for p, a, _ in Chat.seen if p != "/api/chat"} == {"Bearer k"}
    assert config.Options(engine="hosted", hosted_url="u").backend() == ("hosted", {"url": "u", "key": "", "model": "openai/gpt-4o-mini"}) and config.Options().backend()[0] == "local"

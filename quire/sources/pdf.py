"""PDF files as pages and back: an own reader for plain files, an own writer for drawn pages, and registered readers for all others.

The reader takes objects, page tree, page size, text spans and image places from files with classic or compressed
(Flate) content streams and one-byte or UTF-16 text; it reads what ``write_pdf`` writes. It does not decrypt, and it knows
no embedded font encodings: register a reader for such files (``register_reader``). A reader runs once for each file in a
task, so a damaged file gives no pages and loses no other.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boxes

PAGE = ["doc_id", "page_num"]
SPAN = "struct<block_idx:int,block_kind:int,span_idx:int,text:string,size:double,x0:double,y0:double,x1:double,y1:double>"
PAGE_SCHEMA = f"doc_id bigint, page_num bigint, width double, height double, spans array<{SPAN}>, images array<struct<x0:double,y0:double,x1:double,y1:double>>"
Page = dict
Reader = Callable[[bytes], list[Page]]
READERS: dict[str, Reader] = {}
#: Fonts for the translated text, in order of preference; the first that exists on the executors is used.
FONT_FILES = ("/usr/share/fonts/opentype/noto/NotoSansCJK-Regular.ttc", "/usr/share/fonts/truetype/noto/NotoSansCJK-Regular.ttc")
#: A predefined CJK font of all PDF viewers, for when no font file is found.
BUILT_IN_FONT = "STSong-Light"


def register_reader(name: str, reader: Reader) -> None:
    """``reader``: the bytes of a file to its pages, dicts with width, height, spans and images (points, counted from the top)."""
    READERS[name] = reader


def find_font(paths: tuple[str, ...] = FONT_FILES) -> str | None:
    """The first font file that exists; None if text is measured and drawn without one."""
    import os

    return next((p for p in paths if os.path.exists(p)), None)


_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_NUMBERS = re.compile(rb"-?\d*\.?\d+")
_SHOW = re.compile(rb"/\w+\s+(-?[\d.]+)\s+Tf|([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+Tm|([-\d.]+)\s+([-\d.]+)\s+Td|<([0-9A-Fa-f\s]*)>\s*Tj|\(((?:\\.|[^\\)])*)\)\s*Tj|([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+cm\s*/\w+\s+Do|\bBT\b")


def _reference(body: bytes, name: bytes) -> int | None:
    m = re.search(rb"/" + name + rb"\s+(\d+)\s+\d+\s+R", body)
    return int(m.group(1)) if m else None


def read_plain(data: bytes) -> list[Page]:
    """Pages of a PDF file in order of its page tree."""
    objects = {int(m.group(1)): m.group(2) for m in _OBJECT.finditer(data)}
    root = next((n for n, b in objects.items() if re.search(rb"/Type\s*/Catalog", b)), None)
    pages: list[Page] = []

    def content(n: int) -> bytes:
        body = objects.get(n, b"")
        m = _STREAM.search(body)
        raw = m.group(1) if m else b""
        return zlib.decompress(raw) if b"/FlateDecode" in body and raw else raw

    def visit(n: int, box: bytes | None, seen: frozenset[int]) -> None:
        body = objects.get(n, b"")
        if n in seen or not body:
            return
        m = re.search(rb"/MediaBox\s*\[([^\]]*)\]", body)
        box = m.group(1) if m else box
        kids = re.search(rb"/Kids\s*\[([^\]]*)\]", body)
        if kids:
            for k in re.findall(rb"(\d+)\s+\d+\s+R", kids.group(1)):
                visit(int(k), box, seen | {n})
            return
        x0, y0, x1, y1 = (float(v) for v in _NUMBERS.findall(box or b"0 0 612 792")[:4])
        listed = re.search(rb"/Contents\s*\[([^\]]*)\]", body)
        parts = [int(k) for k in re.findall(rb"(\d+)\s+\d+\s+R", listed.group(1))] if listed else [_reference(body, b"Contents") or -1]
        spans, images = _marks(b"\n".join(content(k) for k in parts), y1 - y0)
        pages.append({"width": x1 - x0, "height": y1 - y0, "spans": spans, "images": images})

    if root is not None:
        visit(_reference(objects[root], b"Pages") or -1, None, frozenset())
    return pages


def _marks(stream: bytes, height: float) -> tuple[list[dict], list[dict]]:
    """Text spans and image boxes of a content stream; y is counted from the top."""
    size, x, y, spans, images = 12.0, 0.0, 0.0, [], []
    for m in _SHOW.finditer(stream):
        g = m.groups()
        if g[0] is not None:
            size = float(g[0])
        elif g[1] is not None:
            x, y = float(g[5]), float(g[6])
        elif g[7] is not None:
            x, y = x + float(g[7]), y + float(g[8])
        elif g[9] is not None or g[10] is not None:
            text = bytes.fromhex(re.sub(rb"\s", b"", g[9]).decode()).decode("utf-16-be", "replace") if g[9] is not None else re.sub(rb"\\(.)", rb"\1", g[10]).decode("latin-1")
            wide = sum(size if "⺀" <= c else size / 2 for c in text)
            spans.append({"block_idx": len(spans), "block_kind": 0, "span_idx": 0, "text": text, "size": size, "x0": x, "y0": height - y - size, "x1": x + wide, "y1": height - y})
        elif g[11] is not None:
            a, _, _, d, left, low = (float(v) for v in g[11:17])
            images.append({"x0": left, "y0": height - low - d, "x1": left + a, "y1": height - low})
        else:
            x = y = 0.0
    return spans, images


register_reader("plain", read_plain)


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """PDF files as binary rows: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)


def read_pages(files: DataFrame, reader: str = "plain", page_start: int | None = None, page_end: int | None = None) -> DataFrame:
    """Pages of files (doc_id, content): size in points, text spans and image boxes. Files that cannot be read give no rows."""
    if reader not in READERS:
        raise ValueError(f"unknown reader {reader!r}; there are {', '.join(sorted(READERS))}")
    read, first, last = READERS[reader], page_start or 1, page_end or 1 << 31

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, content in zip(batch["doc_id"], batch["content"]):
                try:
                    pages = read(bytes(content)) if content is not None else []
                except Exception:  # noqa: BLE001  a damaged file must not lose the others
                    pages = []
                rows += [(doc_id, n, p["width"], p["height"], p["spans"], p["images"]) for n, p in enumerate(pages, 1) if first <= n <= last]
            yield pd.DataFrame(rows, columns=[*PAGE, "width", "height", "spans", "images"])

    return files.select("doc_id", "content").mapInPandas(run, PAGE_SCHEMA)


def assemble_pages(pages: DataFrame, dpi: int = 300, char_threshold: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages (with needs_ocr), native blocks and image boxes (at least 24 points, doubles dropped) from ``read_pages``."""
    spans = pages.select(*PAGE, F.explode("spans").alias("s")).select(*PAGE, "s.*")
    blocks = boxes.merge_horizontally(boxes.read_spans(spans))
    images = pages.select(*PAGE, F.col("width").alias("page_width"), F.col("height").alias("page_height"), F.posexplode("images").alias("image_idx", "i")).select(*PAGE, "image_idx", "i.*", "page_width", "page_height", F.lit(dpi).alias("dpi"))
    sizes = pages.select(*PAGE, "width", "height", F.lit(dpi).alias("dpi"))
    few = boxes.pages_needing_ocr(sizes, blocks, char_threshold).select(*PAGE, F.lit(True).alias("needs_ocr"))
    return sizes.join(few, PAGE, "left").withColumn("needs_ocr", F.coalesce("needs_ocr", F.lit(False))), blocks, boxes.dedup_image_boxes(images)


def pages_for_ocr(pages: DataFrame, images: DataFrame, no_ocr: bool = False) -> DataFrame:
    """Pages that go to recognition: they need it, it is not switched off, and there is a picture of them (doc_id, page_num, image)."""
    wanted = pages.where(F.col("needs_ocr") & ~F.lit(no_ocr)).select(*PAGE)
    return wanted.join(images.where(F.col("image").isNotNull()), PAGE)


def png(width: int, height: int, rows: list[bytes]) -> bytes:
    """A grey picture as PNG."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\x00" + r for r in rows))) + chunk(b"IEND", b"")


def draw_picture(width: float, height: float, dark: list[tuple[float, float, float, float]], dpi: int) -> bytes:
    """A white page of ``width`` by ``height`` points with dark boxes, at ``dpi``."""
    import numpy as np

    s = dpi / 72
    page = np.full((max(1, round(height * s)), max(1, round(width * s))), 255, np.uint8)
    for x0, y0, x1, y1 in dark:
        page[max(0, int(y0 * s)) : max(0, int(y1 * s)), max(0, int(x0 * s)) : max(0, int(x1 * s))] = 0
    return png(page.shape[1], page.shape[0], [r.tobytes() for r in page])


def rasterise(pages: DataFrame, dpi: int = 300, render: Callable[[float, float, list[tuple[float, float, float, float]], int], bytes] = draw_picture) -> DataFrame:
    """Pages as PNG pictures (doc_id, page_num, image) of the marks of ``read_pages``: text and images as boxes, unless ``render`` does better."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):  # one picture at a time: they are large
                marks = [(m["x0"], m["y0"], m["x1"], m["y1"]) for m in [*row.spans, *row.images]]
                yield pd.DataFrame({"doc_id": [row.doc_id], "page_num": [row.page_num], "image": [render(row.width, row.height, marks, dpi)]})

    return pages.select(*PAGE, "width", "height", "spans", "images").mapInPandas(run, "doc_id bigint, page_num bigint, image binary")


def image_commands(modes: DataFrame, pages: DataFrame) -> DataFrame:
    """The page itself as the lowest layer of its commands: 'image' (a picture of the page), 'inpainted' or 'copy', over the whole page."""
    op = F.when(F.col("page_mode") == "raster", "image").when(F.col("page_mode") == "inpaint", "inpainted").otherwise("copy")
    none = F.lit(0.0)
    return modes.join(pages.select(*PAGE, "width", "height"), PAGE).select(*PAGE, F.lit(0).alias("item_idx"), op.alias("op"), F.lit(-1).alias("layer"), F.lit(-1).alias("line_no"), none.alias("x"), none.alias("y"), F.col("width").alias("x1"), F.col("height").alias("y1"), F.lit(0).alias("font"), F.lit(None).cast("string").alias("text"))


def page_stream(commands: list[dict], height: float, picture: bool = False) -> bytes:
    """Content stream of a page from its draw commands, in order of layer, item and line."""
    out = ["q"]
    for c in sorted(commands, key=lambda c: (c["layer"], c["item_idx"], c["op"] == "text", c["line_no"])):
        if c["op"] == "image" and picture:
            out.append(f"q {c['x1']:.2f} 0 0 {c['y1']:.2f} 0 0 cm /Im Do Q")
        elif c["op"] in ("ground", "frame", "line"):
            paint = {"ground": "1 1 1 rg 1 1 1 RG 1 w", "frame": "0 0 1 RG 2 w", "line": "1 0 0 RG 0.5 w"}[c["op"]]
            out.append(f"{paint} {c['x']:.2f} {height - c['y1']:.2f} {c['x1'] - c['x']:.2f} {c['y1'] - c['y']:.2f} re {'B' if c['op'] == 'ground' else 'S'}")
        elif c["op"] == "text":
            out.append(f"0 g BT /F {c['font']} Tf 1 0 0 1 {c['x']:.2f} {height - c['y']:.2f} Tm <{c['text'].encode('utf-16-be', 'replace').hex()}> Tj ET")
    return "\n".join([*out, "Q"]).encode()


def write_pdf(pages: list[tuple[float, float, list[dict], bytes | None]]) -> bytes:
    """A PDF file of pages (width, height, commands, grey picture as deflated rows with its size or None)."""
    bodies: list[bytes] = []

    def add(body: bytes) -> int:
        bodies.append(body)
        return len(bodies)

    def stream(head: str, data: bytes) -> int:
        packed = zlib.compress(data)
        return add(f"<< {head} /Filter /FlateDecode /Length {len(packed)} >>\nstream\n".encode() + packed + b"\nendstream")

    catalog, tree = add(b""), add(b"")
    descendant = add(f"<< /Type /Font /Subtype /CIDFontType0 /BaseFont /{BUILT_IN_FONT} /CIDSystemInfo << /Registry (Adobe) /Ordering (GB1) /Supplement 2 >> /DW 1000 >>".encode())
    font = add(f"<< /Type /Font /Subtype /Type0 /BaseFont /{BUILT_IN_FONT} /Encoding /UniGB-UTF16-H /DescendantFonts [{descendant} 0 R] >>".encode())
    kids = []
    for width, height, commands, picture in pages:
        image = ""
        if picture is not None:
            w, h = struct.unpack(">II", picture[:8])
            image = f" /XObject << /Im {stream(f'/Type /XObject /Subtype /Image /Width {w} /Height {h} /ColorSpace /DeviceGray /BitsPerComponent 8', zlib.decompress(picture[8:]))} 0 R >>"
        content = stream("", page_stream(commands, height, picture is not None))
        kids.append(add(f"<< /Type /Page /Parent {tree} 0 R /MediaBox [0 0 {width:g} {height:g}] /Contents {content} 0 R /Resources << /Font << /F {font} 0 R >>{image} >> >>".encode()))
    bodies[catalog - 1] = f"<< /Type /Catalog /Pages {tree} 0 R >>".encode()
    bodies[tree - 1] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] >>".encode()
    out, places = bytearray(b"%PDF-1.5\n"), []
    for n, body in enumerate(bodies, 1):
        places.append(len(out))
        out += f"{n} 0 obj\n".encode() + body + b"\nendobj\n"
    start = len(out)
    out += f"xref\n0 {len(bodies) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places)
    out += f"trailer\n<< /Size {len(bodies) + 1} /Root {catalog} 0 R >>\nstartxref\n{start}\n%%EOF\n".encode()
    return bytes(out)


def pdf_files(commands: DataFrame, pages: DataFrame, pages_per_file: int = 100) -> DataFrame:
    """PDF files of drawn pages: doc_id, part_no, content. A file holds ``pages_per_file`` pages, so no task holds a whole long document.

    ``pages``: doc_id, page_num, width, height (points); ``commands``: columns of ``draw.text_commands``.
    """
    fields = ["item_idx", "op", "layer", "line_no", "x", "y", "x1", "y1", "font", "text"]
    drawn = commands.groupBy(*PAGE).agg(F.collect_list(F.struct(*fields)).alias("commands"))
    rows = pages.select(*PAGE, "width", "height").join(drawn, PAGE, "left").withColumn("part_no", F.floor((F.col("page_num") - 1) / pages_per_file).cast("bigint"))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("page_num")
        found = [(w or 595.0, h or 842.0, [dict(c) for c in cs] if cs is not None else [], None) for w, h, cs in zip(part["width"].fillna(595.0), part["height"].fillna(842.0), part["commands"])]
        return pd.DataFrame({"doc_id": [key[0]], "part_no": [key[1]], "content": [write_pdf(found)]})

    return rows.groupBy("doc_id", "part_no").applyInPandas(run, "doc_id bigint, part_no bigint, content binary")

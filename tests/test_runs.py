import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.operators import translate
from quire.plans import catalog
from quire.sources import config, store

BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(BASE):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{BASE}/{f}')")
    return c


def rows_of(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if x is None or x != x else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, sql, name):
    got, expected = catalog.QUERIES[name](spark, BASE).toPandas(), sql.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    if name == "event_sessions":
        for c in ("started", "ended"):
            got[c], expected[c] = got[c].astype("datetime64[us]"), expected[c].astype("datetime64[us]")
    for c in got.columns:
        if got[c].dtype != expected[c].dtype and "int" in str(expected[c].dtype).lower():
            got[c], expected[c] = got[c].astype("Int64"), expected[c].astype("Int64")
    assert rows_of(got) == rows_of(expected)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


class Counting(translate.DictionaryBackend):
    """Answers from a table and notes what it was asked."""

    def __init__(self, table, free=None):
        super().__init__(table)
        self.json, self.texts, self.free = [], [], free or {}

    def translate_json(self, requests):
        self.json.append(sorted(i["text"] for r in requests.collect() for i in json.loads(r.request)["items"]))
        return super().translate_json(requests)

    def translate_text(self, texts):
        self.texts += [r.source_text for r in texts.collect()]
        rows = [(k, v) for k, v in self.free.items() if k in self.texts]
        return texts.sparkSession.createDataFrame(rows, "source_text string, reply string")


MEMORY = "source_text string, translated_text string"
LINES = "doc_id bigint, page_num bigint, para_idx int, line_idx int, text string"


def memory(spark, rows):
    return spark.createDataFrame(rows, MEMORY).withColumn("source_hash", F.sha2("source_text", 256))


def test_retry_asks_failed_lines_again(spark):
    lines = spark.createDataFrame([(1, 1, 0, i, f"日本語{i}") for i in range(51)] + [(1, 1, 1, 0, "　"), (1, 1, 1, 1, "日本語x"), (1, 4, 0, 0, "既知"), (1, 4, 0, 1, "無答")], LINES)
    backend = Counting(spark.createDataFrame([(f"日本語{i}", f" 中文{i} ") for i in range(51)] + [("日本語x", "日本語x")], MEMORY))
    done, new = translate.translate_lines(lines, memory(spark, [("既知", "已知"), ("日本語0", "日本語0")]), backend)
    out = {(r.page_num, r.para_idx, r.line_idx): r.translated for r in done.collect()}
    assert out[1, 0, 50] == "中文50" and out[1, 1, 0] == "" and out[1, 1, 1] == "日本語x" and out[4, 0, 0] == "已知" and out[4, 0, 1] == "" and len(out) == 55
    # one request for all but the known line, then one for the failed lines, which brings nothing new
    assert len(backend.json) == 2 and len(backend.json[0]) == 53 and backend.json[1] == ["日本語x", "無答"]
    assert {r.source_text for r in new.collect()} == {f"日本語{i}" for i in range(51)}


class OneByOne(translate.DictionaryBackend):
    """Answers the first item of a request alone, if ``any``."""

    def __init__(self, any_=True):
        self.any, self.asked = any_, 0

    def translate_json(self, requests):
        self.asked += 1
        items = requests.select("chunk_id", F.explode(F.from_json("request", "items array<struct<id:int,text:string>>")["items"]).alias("i"))
        reply = F.when((F.col("i.id") == 0) & F.lit(self.any), F.lit("中文")).otherwise(F.lit(""))
        rows = items.groupBy("chunk_id").agg(F.collect_list(F.struct(F.col("i.id").alias("id"), reply.alias("text"))).alias("items"))
        return rows.select("chunk_id", F.to_json(F.struct("items")).alias("reply"))


def test_one_request_and_three_retries(spark):
    line = spark.createDataFrame([(1, 1, 0, i, f"日本語{i}") for i in range(6)], LINES)
    backend = OneByOne()
    done, _ = translate.translate_lines(line, memory(spark, []), backend)
    assert [r.translated for r in done.orderBy("line_idx").collect()] == ["中文"] * 4 + ["", ""] and backend.asked == 4
    never = OneByOne(False)
    done, _ = translate.translate_lines(line, memory(spark, []), never)
    assert {r.translated for r in done.collect()} == {""} and never.asked == 2


def test_paragraphs_are_asked_in_json_first(spark):
    backend = Counting(spark.createDataFrame([("日本語の段落", "中文翻译")], MEMORY), {"別の段落": "Translate the following", "三つ目": " 第三段 "})
    texts = spark.createDataFrame([("日本語の段落",), ("日本語の段落",), ("別の段落",), ("三つ目",), ("原文",), ("同じ",), (None,), ("　",)], "text string")
    done, new = translate.translate_texts(texts, memory(spark, [("原文", "译文"), ("同じ", "同じ")]), backend)
    assert {(r.source_text, r.translation, r.from_cache) for r in done.collect()} == {("日本語の段落", "中文翻译", False), ("三つ目", "第三段", False), ("原文", "译文", True), ("別の段落", "Translate the following", False)}
    assert {(r.source_text, r.translated_text) for r in new.collect()} == {("日本語の段落", "中文翻译"), ("三つ目", "第三段")}
    assert "日本語の段落" not in backend.texts and set(backend.texts) == {"別の段落", "三つ目", "同じ"} and backend.json == [["三つ目", "別の段落", "同じ", "日本語の段落"]]


def test_unknown_names_are_errors(spark):
    from quire.operators import layout

    with pytest.raises(ValueError):
        translate.create_backend("nothing")
    with pytest.raises(ValueError):
        layout.cluster(None, None, "nothing")
    assert isinstance(translate.create_backend("dictionary", spark.createDataFrame([], MEMORY)), translate.DictionaryBackend)


def test_stage_saves_into_the_stores(spark, tmp_path):
    from quire.plans import stages

    root = str(tmp_path / "run")
    pages, paras, cache = (spark.read.parquet(f"{BASE}/{t}.parquet") for t in ("ocr_pages", "ocr_paragraphs", "translation_cache"))
    store.save_pages(store.latest_pages(pages), f"{root}/pages")
    store.save_pages(store.latest_paragraphs(paras), f"{root}/paragraphs")
    before = spark.read.parquet(f"{root}/paragraphs").count()
    done = stages.translate_render_stage(pages, paras, cache, translate.DictionaryBackend(translate.latest_entries(cache)))
    stages.save_stage(done, root)
    assert spark.read.parquet(f"{root}/paragraphs").count() == before and spark.read.parquet(f"{root}/pages").where("status != 'translated'").count() == 0
    assert spark.read.json(f"{root}/debug").count() == spark.read.parquet(f"{root}/pages").count()
    assert store.clean_up(spark, root) == 4 and store.clean_up(spark, root) == 0


def test_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "store")
    first = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "doc_id bigint, page_num bigint, status string")
    store.save_pages(first, path)
    store.save_pages(spark.createDataFrame([(2, 7, "c")], first.schema), path)
    store.save_pages(spark.createDataFrame([(2, 7, "d"), (3, 1, "e")], first.schema), path)
    assert {(r.doc_id, r.page_num, r.status) for r in spark.read.parquet(path).collect()} == {(1, 1, "a"), (2, 1, "b"), (2, 7, "d"), (3, 1, "e")}
    store.reset(spark, path, 2)
    store.reset(spark, path, 3)
    assert [r.doc_id for r in spark.read.parquet(path).collect()] == [1]
    marked = store.mark_translated(first, first.where("doc_id = 1"))
    assert {r.doc_id: r.status for r in marked.collect()} == {1: "translated", 2: "b"}


def test_saved_again_with_fewer_paragraphs(spark):
    rows = [(1, 1, 1, 0, "a", 1), (2, 1, 1, 1, "b", 1), (3, 1, 1, 2, "c", 1), (4, 1, 1, 0, "A", 2), (5, 1, 1, 1, "B", 2), (6, 1, 2, 0, "x", 1), (7, 1, 2, 0, "y", 1), (8, 2, 1, 0, None, None)]
    df = spark.createDataFrame(rows, "id bigint, doc_id bigint, page_num bigint, para_idx int, text string, saved_at int")
    assert sorted(r.id for r in store.latest_paragraphs(df).collect()) == [4, 5, 7, 8]
    assert [r.text for r in store.load_page(store.latest_paragraphs(df), 1, 1).collect()] == ["A", "B"]


def test_checkpoint_folder_on_a_cluster(monkeypatch):
    from quire import session

    class Fake:
        master = "spark://host:7077"

        def __getattr__(self, name):
            return self

        def __call__(self, *args):
            return "" if args and args[0] == "spark.checkpoint.dir" else self

        def isDefined(self):  # noqa: N802
            return False

    fake = Fake()
    fake.sparkContext = fake
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(fake)


def test_proportional_split_equals_plain_function(spark):
    from quire.functions import fit

    rows = [("一二三四五六七", [3, 3, 1]), ("abc", [0, 0]), ("", [1, 2]), ("abcdef", [5]), ("ab", []), ("abcdefghij", [1, None, 7, 2]), (None, [2, 1])]
    df = spark.createDataFrame(rows, "t string, n array<int>").select("t", "n", fit.split_proportionally(F.col("t"), F.col("n")).alias("p"))
    for r in df.collect():
        assert r.p == (fit.proportional_parts(r.t, [x or 0 for x in r.n]) if r.n else [])


def test_stream_of_pages(spark, tmp_path):
    from quire.operators.simple import simple_paragraphs
    from quire.streaming.pages import process_pages

    rows = spark.read.parquet(f"{BASE}/blocks.parquet")
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows.repartition(1).write.parquet(source)
    process_pages(spark, source, rows.schema, target, str(tmp_path / "cp"), simple_paragraphs).awaitTermination()
    assert spark.read.parquet(f"{target}/*").count() == simple_paragraphs(rows).count()


def test_options(tmp_path):
    assert config.load_options(None) == config.Options() == config.load_options(str(tmp_path / "none"))
    f = tmp_path / "c.yaml"
    f.write_text("extract_dpi: 600\nunknown: 1\nno_ocr: true\n")
    o = config.load_options(str(f))
    assert o.extract_dpi == 600 and o.no_ocr is True and o.merged({"no_ocr": None, "extract_dpi": 72}).extract_dpi == 72
    assert config.output_path("/a/b.pdf") == "/a/b_translated.pdf"


def test_ocr_backend(spark):
    from quire.sources import ocr

    ocr.register_engine("fake", lambda lang: lambda image: [([(1.7, 2.2), (9.9, 2.0), (9.0, 8.8)], "x", 0.5), ([(0, 0), (1, 1)], "y", 0.1)], 0.3)
    pages = spark.createDataFrame([(1, 1, bytearray(b"p")), (1, 2, None)], "doc_id bigint, page_num bigint, image binary")
    rows = ocr.recognise_with(pages, ["fake"]).collect()
    assert [(r.page_num, r.x0, r.y0, r.x1, r.y1, r.text) for r in rows] == [(1, 1.0, 2.0, 9.0, 8.0, "x")]

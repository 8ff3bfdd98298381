"""Markup, e-books, exchange files, model stand-ins and streams."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from folioscope.operators import context
from folioscope.sources import epub, exchange, markup, models
from folioscope.streaming import live

SF = "/root/testdata/sf0.001"


def book():
    files = {
        "mimetype": b"application/epub+zip",
        "META-INF/container.xml": b'<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>',
        "OEBPS/content.opf": b'<package xmlns:dc="d"><metadata><dc:title>A Book</dc:title><dc:language>en</dc:language></metadata><manifest><item id="a" href="ch%201.xhtml"/><item id="b" href="ch2.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="zz"/><itemref idref="b"/></spine></package>',
        "OEBPS/ch 1.xhtml": b"<html><head><title>T</title></head><body><h1>One</h1><p>First <b>bold</b>.</p><p>Second&nbsp;one.</p></body></html>",
        "OEBPS/ch2.xhtml": b"<html><body><p>Third.</p></body></html>",
    }
    return files, epub.write(files)


def test_epub_round_trip(spark, tmp_path):
    files, data = book()
    b = epub.load(data)
    assert (b["title"], b["language"], [c["title"] for c in b["chapters"]]) == ("A Book", "en", ["One", None])
    assert epub.entries(data) == files
    with zipfile.ZipFile(__import__("io").BytesIO(data)) as z:
        assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    (tmp_path / "a.epub").write_bytes(data)
    rows = epub.read_books(spark, str(tmp_path)).orderBy("spine_idx").collect()
    assert [r["href"] for r in rows] == ["OEBPS/ch 1.xhtml", "OEBPS/ch2.xhtml"]
    new = epub.load(epub.translated(data, {"OEBPS/ch2.xhtml": "<p>Drittens.</p>"}, "de"))
    assert new["language"] == "de" and new["chapters"][1]["xhtml"] == "<p>Drittens.</p>"
    for gone in ("META-INF/container.xml", "OEBPS/content.opf", "OEBPS/ch2.xhtml"):
        with pytest.raises(epub.BookError):
            epub.load(epub.write({k: v for k, v in files.items() if k != gone}))


def tree(rng, depth=0):
    out = ""
    for _ in range(rng.randint(1, 3)):
        out += rng.choice(["text ", "a &lt; b ", "ünï "])
        if depth < 3 and rng.random() < 0.6:
            tag = rng.choice(["em", "strong", "span", "a", "i", "b"])
            out += f'<{tag} class="x">{tree(rng, depth + 1)}</{tag}>' if rng.random() < 0.8 else "<br/>"
    return out


def test_placeholders_invert():
    rng = random.Random(1)
    for _ in range(80):
        host = markup.parse(tree(rng))
        text, skeleton = markup.placeholders(host)
        assert markup.to_markup(markup.rebuild(text, skeleton)) == markup.to_markup(host)
        parts = markup.split_sentences(text, skeleton, 3)
        assert "".join(markup.plain(p) for p, _ in parts).replace(" ", "") == markup.plain(text).replace(" ", "")
    for bad in ("[[T9]]", "[[/T0]]", "[[T0]]x"):
        with pytest.raises(ValueError):
            markup.rebuild(bad, [{"tag": "b", "kind": "pair", "attrs": {}}])


def test_segments(spark):
    page = "<body><div>loose <i>text</i><p>One. Two.</p><script>var x='</p>'</script></div><p>  <br></p><ul><li>item</ul><p lang='de'>Deutsch</p></body>"
    got = list(markup.segment(page, target="de-DE"))
    assert [markup.plain(s["source_text"]) for s in got] == ["loose text", "One. Two.", "item"]
    root = markup.parse(page)
    markup.wrap_loose(root)
    assert all(markup.find(root, s["host_path"]) is not None for s in got)
    assert markup.find(root, "/body[1]/p[9]") is None
    with pytest.raises(ValueError):
        markup.find(root, "/body")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = markup.segments(pages, "page_id", "html", budget=40)
    assert rows.select("page_id").distinct().count() == pages.count()
    assert rows.groupBy("page_id", "idx").count().where("count > 1").count() == 0
    assert markup.reassemble(rows, "page_id", "source_text").count() == rows.select("page_id", "host_path").distinct().count()
    assert markup.expand_entities("&eacute;&amp;&nope;") == "é&amp;&nope;"


def entries(spark):
    return spark.createDataFrame([("House, of Commons", "Câmara", "place", "confirmed", True, None, None, ["Commons"], ["Câmara dos Comuns"]), (None, "Yennefer", "term", "locked", False, "f", 'a "b"', [], [])], exchange.ENTRY)


def test_exchange(spark, tmp_path):
    e = entries(spark)
    exchange.write_csv(e.coalesce(1), str(tmp_path / "csv"))
    want = sorted(map(str, e.collect()))
    assert sorted(map(str, exchange.read_csv(spark, str(tmp_path / "csv")).collect())) == want
    exchange.to_json(e).write.text(str(tmp_path / "json"))
    assert sorted(map(str, exchange.read_json(spark, str(tmp_path / "json")).collect())) == want
    (tmp_path / "bad.json").write_text('{"version": 9, "entries": []}')
    with pytest.raises(Exception, match="unsupported snapshot"):
        exchange.read_json(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "bad2.json").write_text('{"version": 1, "entries": [{"target_term": "x"}]}')
    with pytest.raises(Exception, match="source_known"):
        exchange.read_json(spark, str(tmp_path / "bad2.json")).collect()


def test_bundle(spark, tmp_path):
    v = spark.createDataFrame([("s1", "old", [0.5, -1.25])], "ref_id string, project_id string, vector array<float>")
    ev = spark.createDataFrame([(1, "old", "k")], "event_id bigint, project_id string, kind string")
    exchange.export_bundle({"embeddings": v, "events": ev}, str(tmp_path / "b"), "old")
    got = exchange.import_bundle(spark, str(tmp_path / "b"), {"embeddings": "ref_id string, project_id string, vector array<float>", "events": "event_id bigint, project_id string, kind string", "chapters": "id string"}, "new")
    assert got["embeddings"].collect()[0]["vector"] == [0.5, -1.25] and got["embeddings"].collect()[0]["project_id"] == "new"
    assert got["events"].columns == ["project_id", "kind"] and got["chapters"].count() == 0


def test_models(spark):
    v = models.mock_vector("hello")
    assert len(v) == 32 and abs(float((v.astype(float) ** 2).sum()) - 1) < 1e-5 and (v == models.mock_vector("hello")).all()
    df = spark.createDataFrame([(1, "a"), (2, None)], "id bigint, t string")
    assert models.embed(df, "id", "t").count() == 2


def test_streams_match_batch(spark, tmp_path):
    log = spark.read.parquet(f"{SF}/events.parquet")
    log.repartition(4).write.parquet(str(tmp_path / "log"))
    s = live.events(spark, str(tmp_path / "log"), log.schema)
    for name, df, mode in (("t_totals", live.kind_totals(s), "complete"), ("t_break", live.breaker(s.withColumn("g", F.col("user_id") % 2), "g", "event_id", F.col("event_type") == "error"), "update"), ("t_once", live.once(s.select("user_id", "ts"), ["user_id"], within="60 days"), "append")):
        q = live.to_memory(df, name, mode, str(tmp_path / name))
        q.processAllAvailable()
        q.stop()
    a = {r["event_type"]: (r["n"], round(r["value"], 6)) for r in spark.table("t_totals").collect()}
    assert a == {r["event_type"]: (r["n"], round(r["value"], 6)) for r in live.kind_totals(log).collect()}
    b = context.sliding_failures(log.withColumn("g", F.col("user_id") % 2), "g", "event_id", F.col("event_type") == "error")
    want = {r["g"]: (r["n"], r["last"], r["t"]) for r in b.groupBy("g").agg(F.count("*").alias("n"), F.max_by("fails", "event_id").alias("last"), F.max("tripped").alias("t")).collect()}
    assert {r["g"]: (r["seen"], r["fails"], r["tripped"]) for r in spark.table("t_break").collect()} == want
    assert spark.table("t_once").count() == log.select("user_id").distinct().count()


def test_json_snapshots_of_bounded_size(spark, tmp_path):
    rows = [(f"t{k % 700:03}", f"z{k}", "term", "locked", True, None, 'say "x"\n' if k % 3 else None, ["a"], []) for k in range(1000)]
    e = spark.createDataFrame(rows, exchange.ENTRY)
    exchange.write_json(e, str(tmp_path / "j"), most=20_000)
    files = sorted((tmp_path / "j").glob("part-*"))
    assert len(files) > 5 and max(f.stat().st_size for f in files) < 21_000 and all(len(f.read_text().splitlines()) <= 1 for f in files)
    assert sorted(map(str, exchange.read_json(spark, str(tmp_path / "j")).collect())) == sorted(map(str, exchange.normalised(e).collect()))
    exchange.write_json(e.limit(0), str(tmp_path / "none"))
    assert exchange.read_json(spark, str(tmp_path / "none")).count() == 0

"""Score files and page listings."""

from neumatic.sources import files

SCORE = """<score-partwise xmlns="x"><part id="P1"><measure number="1" width="120"><attributes><divisions>2</divisions><key><fifths>-1</fifths></key><time><beats>3</beats><beat-type>4</beat-type></time></attributes>
<note><!-- imgpos: 10.5, 20 --><pitch><step>B</step><alter>-1</alter><octave>4</octave></pitch><duration>4</duration><tie type="start"/><lyric number="2"><syllabic>begin</syllabic><text>a</text></lyric></note>
<backup><duration>4</duration></backup><harmony><root><root-step>F</root-step></root><kind>major</kind></harmony><note><rest/><duration>6</duration><voice>2</voice></note></measure></part></score-partwise>"""


def test_score_events_keep_document_order(spark, tmp_path):
    (tmp_path / "a.musicxml").write_text(SCORE)
    (tmp_path / "b.xml").write_text("<html/>")
    (tmp_path / "c.xml").write_text("<broken")
    events = files.score_events(spark, str(tmp_path)).cache()
    assert files.rejects(events).count() == 2
    rows = files.accepted(events).orderBy("seq").collect()
    assert [r["kind"] for r in rows] == ["attributes", "note", "backup", "harmony", "note"]
    assert (rows[0]["divisions"], rows[0]["beats"], rows[0]["fifths"], rows[0]["width"]) == (2, "3", -1, 120.0)
    assert rows[1]["alter_by"] == -1 and rows[1]["tie_start"] and rows[1]["lyrics"][0]["verse"] == "2"
    assert rows[4]["is_rest"] and rows[4]["note_index"] == 2 and rows[4]["voice"] == "2"
    assert [(r["image_x"], r["image_y"]) for r in files.note_places(files.accepted(events)).collect()] == [(10.5, 20.0)]


def test_pages(spark, tmp_path):
    for n in ("page-1.png", "page-2.png", "page-10.png"):
        (tmp_path / n).write_bytes(n.encode())
    (tmp_path / "notes.txt").write_text("x")
    pages = files.page_files(spark, str(tmp_path))
    assert [r["number"] for r in pages.orderBy("sort_key").collect()] == [1, 2, 10]
    assert not files.complete_pages(pages).first()["complete"]
    assert files.admission(pages, max_pages=2).first()["reason"] == "too many pages"


def test_regions_crops_lexicon(spark, tmp_path):
    (tmp_path / "r.txt").write_text("0 0.5 0.5 2 0.5\n")
    r = files.regions(spark, str(tmp_path / "r.txt"), 100.0, 200.0).first()
    assert (r["x1"], r["y1"], r["x2"], r["y2"]) == (0.0, 50.0, 100.0, 150.0)
    (tmp_path / "c.json").write_text('{"id":"a","bbox":{"x1":1,"y1":2,"x2":3,"y2":4}}\n{"id":"b","bbox":{"x1":1}}\n')
    assert files.crops(spark, str(tmp_path / "c.json")).count() == 1
    (tmp_path / "w.txt").write_text("Xin chào,\nchào bạn\n")
    assert {x["word"] for x in files.lexicon(spark, str(tmp_path / "w.txt"), ["ê"]).collect()} == {"xin", "chào", "bạn", "ê"}


def test_review_log_as_a_stream(spark, tmp_path):
    from neumatic.plans import core
    from neumatic.streaming import review

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = tmp_path / "events"
    events.write.parquet(str(source))
    stream = core.log_of(spark.readStream.schema(events.schema).parquet(str(source)))
    q = review.folded(stream).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    from neumatic.operators import review as batch

    got = {(r["score_id"], r["measure_no"]): r["status"] for r in spark.table("folded").collect()}
    expected = {(r["score_id"], r["measure_no"]): r["status"] for r in batch.folded(core.log_of(events)).collect()}
    assert {k: v for k, v in got.items() if v != "open"} == {k: v for k, v in expected.items() if v != "open"}

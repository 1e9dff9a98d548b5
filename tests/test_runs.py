"""Search, navigation and indexing as whole runs, with odd rows."""

import json

import pytest

from quern.operators import indexing, integrity, navigation, search, store, vector
from quern.operators.embed import HashingEmbedder, embed

CHUNKS = "id long, doc_id long, source string, text string, chunk_idx int, chunk_of int, ocr boolean, embedding array<float>"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(i, 7, "tower.txt", f"part {i}", i, 5, i == 2, [1.0, float(i)]) for i in range(5)]
    rows += [(10, None, None, "loose", 0, 1, None, [0.5, 0.0]), (11, 8, "sea.py", "x" * 4000, 0, 1, None, [0.0, 9.0]), (12, 8, "sea.py", "again", 0, 1, None, None)]
    return spark.createDataFrame(rows, CHUNKS)


def asked(spark, *rows):
    return spark.createDataFrame([*rows], "qid int, embedding array<float>, source_filter string")


def test_search_with_context_and_filter(spark, chunks):
    vectors = chunks.select("id", "embedding")
    hits = search.search(asked(spark, (1, [0.0, 1.0], None), (2, [0.0, 1.0], "tower"), (3, [1.0, 0.0], "nothing")), chunks, vectors, 2, context=1).collect()
    got = {(r.qid, r["rank"]): (r.id, [a.id for a in r.adjacent]) for r in hits}
    assert got == {(1, 1): (11, []), (1, 2): (4, [3]), (2, 1): (4, [3]), (2, 2): (3, [2, 4])}
    body = {r.qid: r.body for r in search.render(search.search(asked(spark, (2, [0.0, 1.0], "tower")), chunks, vectors, 3, context=1)).collect()}[2]
    assert body.split("\n\n---\n\n")[1] == "[2] tower.txt | chunk 4/5 | score 3.000\n[context: chunk 3]\npart 2\n\npart 3\n\n[context: chunk 5]\npart 4"
    assert search.OCR_NOTE in body.split("\n\n---\n\n")[2]
    found = json.loads(search.as_json(search.search(asked(spark, (1, [0.0, 1.0], None)), chunks, vectors, 2)).first().json)
    assert [x["id"] for x in found] == [11, 4] and len(found[0]["text"]) == 4000
    assert search.search(asked(spark), chunks, vectors, 2).count() == 0 and search.search(asked(spark, (1, None, None)), chunks, vectors, 2).count() == 0


def test_ask_names_a_source(spark, chunks):
    words = chunks.drop("embedding").join(embed(chunks, HashingEmbedder(16), key="id", text="text"), "id")
    questions = spark.createDataFrame([(1, "which part is in the tower notes"), (2, "x")], "qid int, text string")
    sources = spark.createDataFrame([("tower notes.txt",), ("tower.txt",)], "source string")
    hits = search.ask(questions, words.withColumn("source", words.source), HashingEmbedder(16), 2, sources=sources)
    assert {r.qid for r in hits.collect()} == {2}  # the first asks for a source that no chunk has


def test_best_keeps_ties_by_column():
    import numpy as np

    row, col = vector.best(np.array([[1.0, 3.0, 3.0, 2.0], [0.0, 0.0, 0.0, 0.0]]), 2)
    assert list(zip(row, col)) == [(0, 1), (0, 2), (1, 0), (1, 1)]


def test_many_queries_and_few_vectors(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "id int, embedding array<float>")
    q = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(90)], "qid int, embedding array<float>")
    for a, b in ((q, v), (v.withColumnRenamed("id", "qid"), q.withColumnRenamed("qid", "id"))):
        got = vector.top_k(a, b, 2, block=16).collect()
        assert len(got) == 2 * a.count() and {r["rank"] for r in got} == {1, 2}


def test_nth_chunk(spark, chunks):
    want = spark.createDataFrame([(7, 1), (7, 9), (7, -1), (8, 0), (99, 0), (None, 0)], "doc_id long, n int")
    got = sorted((r.doc_id, r.n, r.pos if r.pos is not None else -1, r.total, r.is_hit) for r in navigation.nth_chunk(want, chunks, context=1).collect())
    assert got == [(7, -1, -1, 5, False), (7, 1, 0, 5, False), (7, 1, 1, 5, True), (7, 1, 2, 5, False), (7, 9, -1, 5, False), (8, 0, 0, 2, True), (8, 0, 1, 2, False)]


def test_documents_by_source(spark):
    docs = spark.createDataFrame([("a/tower.txt", "one"), ("b/tower.md", "two"), ("tower", "three"), (None, "x")], "source string, full_text string")
    want = spark.createDataFrame([("tower",), ("/tower",), ("nowhere",), (None,), ("",)], "asked string")
    got = sorted((r.asked, r.found, r.source or "", r.text or "") for r in navigation.documents_by_source(want, docs).collect())
    assert got == [("", False, "", ""), ("/tower", False, "a/tower.txt", ""), ("/tower", False, "b/tower.md", ""), ("nowhere", False, "", ""), ("tower", True, "tower", "three")]
    assert navigation.documents_by_source(want, docs.limit(0)).where("found").count() == 0


def test_ignore_known_and_removal(spark):
    new = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "source string, doc_id long")
    assert [tuple(r) for r in store.ignore_known(new, new.where("source = 'a'"), ["source"], ["doc_id"]).collect()] == [("b", 2)]
    rows = spark.createDataFrame([(1, "a"), (1, None), (2, "b"), (None, None)], "doc_id long, source string")
    gone = store.split_by_source(rows, new.where("source = 'a'"), on=[], documents=new)
    assert sorted((r.doc_id or 0, r.source or "", r.gone) for r in gone.collect()) == [(0, "", False), (1, "", True), (1, "a", True), (2, "b", False)]


def test_compare(spark):
    was = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("d", "4")], "f string, sha256 string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("e", "5")], "f string, sha256 string")
    assert {r.f: r.state for r in integrity.compare(was, now, ["f"]).collect()} == {"a": "ok", "b": "mismatch", "c": "untracked", "d": "MISSING", "e": "UNTRACKED_FILE"}


def test_index_files(spark):
    book, code = "A paragraph of words. " * 20, "import os\n\ndef f():\n    return 1\n" * 4
    rows = [(1, "ix", "a.txt", book, "book", None, None), (2, "ix", "b.txt", book, "book", None, None), (3, "ix", "m.py", code, "code", "python", None), (4, "ix", None, book, "book", None, None), (5, "ix", "n.txt", None, "book", None, None), (6, "iy", "old.txt", "other " * 30, "book", None, True)]
    files = spark.createDataFrame(rows, "doc_id long, index_name string, source string, full_text string, doc_type string, language string, ocr boolean")
    stored = spark.createDataFrame([("iy", "h", "old.txt")], "index_name string, hash string, filename string")
    out = indexing.index_files(files, stored)
    assert {r.doc_id: r.reason for r in out["reasons"].collect()} == {1: "new", 2: "batch duplicate", 3: "new", 6: "stored name"}
    assert {(r.doc_id, r.source) for r in out["chunks"].collect()} == {(1, "a.txt"), (3, "m.py"), (None, "__project_summary__")}
    meta = {r.index_name: r for r in out["meta"].collect()}
    assert (meta["ix"].n_files, meta["ix"].n_repeated, meta["ix"].n_chunks, meta["iy"].n_known, meta["iy"].n_chunks) == (2, 1, 3, 1, 0)
    assert out["hashes"].count() == 2 and out["documents"].count() == 2
    empty = indexing.index_files(files.limit(0), stored)
    assert all(df.count() == 0 for df in empty.values())


# ---- pages, models, command line ------------------------------------------------------------------------------------


def reader(page, *, language, negative):
    """Stands in for an OCR engine: names the shape of what it is given."""
    return f"{language} {len(page)} bytes" if isinstance(page, bytes) else f"{language} {page.shape[1]}x{page.shape[0]}{' negative' if negative else ''}"


def pgm(w, h):
    import numpy as np

    page = np.full((h, w), 90, np.uint8)
    page[:, w // 2] = 255
    return f"P5 {w} {h} 255\n".encode() + page.tobytes()


def test_pages_are_rendered_split_and_read(spark):
    import numpy as np

    from quern.sources import extract as e

    def frames(data, kind, *, dpi):
        assert kind in ("tiff", "pdf", "djvu") and dpi == 200
        yield from (np.zeros((10, 12), np.uint8), np.zeros((10, 40, 3), np.uint8))

    assert e.extract(b"x", "tiff", ocr=reader, render=frames, dpi=200) == ("eng 12x10\neng 40x10", True)
    assert e.extract(b"x", "tiff", ocr=reader, render=frames, dpi=200, split_spreads=True, language="deu", negative=True)[0].count("negative") == 3
    assert e.extract(pgm(40, 10), "image", ocr=reader, split_spreads=True) == ("eng 20x10\neng 20x10", True)
    assert e.extract(pgm(40, 10), "image", ocr=reader) == ("eng 413 bytes", True)
    assert e.netpbm(pgm(7, 5)).shape == (5, 7)
    with pytest.raises(e.Unavailable):
        e.extract(b"x", "tiff")
    assert e.extract(b"x", "mobi", unpack=lambda d: "<html><p>a</p></html>") == ("a", False)
    with pytest.raises(e.Unavailable):
        e.extract(b"x", "mobi")


def test_books_of_pictures():
    import base64
    import io
    import zipfile

    from quern.sources import extract as e

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("b.pgm", pgm(300, 250))
        z.writestr("a.pgm", pgm(220, 260))
        z.writestr("ornament.pgm", pgm(20, 260))
        z.writestr("c.svg", "<svg><image href='data:image/png;base64," + base64.b64encode(pgm(30, 30)).decode() + "'/></svg>")
    book = data.getvalue()
    assert e.extract(book, "epub", ocr=reader) == (f"eng {len(pgm(220, 260))} bytes\n\neng {len(pgm(300, 250))} bytes\n\neng {len(pgm(30, 30))} bytes", True)
    assert e.extract(book, "epub") == (None, False)


def test_settings_reach_the_reader():
    from quern.settings import Settings
    from quern.sources.extract import missing_languages, options_of

    s = Settings(ocr_lang="deu", render_dpi=150, disable_ocr=True)
    assert options_of(s, reader)["ocr"] is None and options_of(s, reader, use_ocr=True)["ocr"] is reader and options_of(s, reader)["dpi"] == 150
    assert missing_languages("eng+deu+fra+deu", ["eng"]) == ["deu", "fra"]
    assert s.pick("top_k", 0) == 5 and s.pick("top_k", 9) == 9 and s.pick("overlap", 0) == 0 and s.pick("code_chunk_size") == 3000


def test_models_are_found_and_kept():
    from quern.operators.embed import NoModel, Resident, best_device, embedder_of

    loads = []

    def load(name, device):
        loads.append((name, device))
        return HashingEmbedder(8)

    a, b = Resident(load, "a", 8, "cpu"), Resident(load, "b", 8, "cpu")
    a(["x"]), a(["y"]), b(["x"]), a(["x"])
    assert loads == [("a", "cpu"), ("b", "cpu"), ("a", "cpu")] and best_device("xpu") == "xpu"
    makers = {"local": lambda meta: HashingEmbedder(8)}
    assert embedder_of({"dim": 8}, makers).dim == 8
    for meta, more in (({"dim": 9}, {}), ({"embedding_backend": "none"}, {}), ({}, {"probe": lambda *x: False})):
        with pytest.raises(NoModel):
            embedder_of(meta, makers, **more)
    here = set()
    assert embedder_of({}, makers, probe=lambda *x: x in here, fetch=lambda *x: here.add(x)).dim == 8


def test_command_line(spark, tmp_path):
    from quern.__main__ import run
    from quern.operators.catalog import IndexNotFound

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "tower notes.txt").write_text("The quiet harbour keeps the old map. " * 90)
    (tmp_path / "in" / "sea.txt").write_text("One clerk studies the wooden bridge. " * 3)
    home = str(tmp_path / "home")
    assert run(spark, [home, "add", "books", str(tmp_path / "in")]) == "2 files"
    assert run(spark, [home, "list"]).startswith("books  ") and "2 files" in run(spark, [home, "list"])
    assert run(spark, [home, "sources", "books"]).startswith("2 sources") and "tower" in run(spark, [home, "sources", "books", "--filter", "TOWER"])
    assert run(spark, [home, "read", "books", "sea.txt"]).startswith("=== sea.txt ===") and "like it: tower notes.txt" in run(spark, [home, "read", "books", "tower"])
    assert run(spark, [home, "chunk", "books", "sea.txt", "0"]).startswith("chunk 1/1 <") and run(spark, [home, "chunk", "books", "sea.txt", "7"]) == "there are 1 chunks"
    assert run(spark, [home, "range", "books", "tower notes.txt"]).endswith("[0 chunks remain]")
    assert run(spark, [home, "query", "books", "which clerk studies the bridge", "--top-k", "1"]).startswith("[1] sea.txt | chunk 1/1 | score ")
    assert json.loads(run(spark, [home, "query", "books", "harbour map", "--json", "--top-k", "1"]))[0]["source"] == "tower notes.txt"
    assert "mismatch" not in run(spark, [home, "verify", "books"])
    assert run(spark, [home, "remove", "books", "sea.txt"]) == "1 chunks, 1 documents, 1 hashes"
    run(spark, [home, "unlock", "books"]), run(spark, [home, "rename", "books", "old"]), run(spark, [home, "delete", "old"])
    with pytest.raises(IndexNotFound):
        run(spark, [home, "read", "old", "x"])


def below(plan, node):
    """The lines under each line of a plan that names ``node``."""
    lines = plan.split("Initial Plan")[0].split("\n")
    deep = [len(line) - len(line.lstrip(" :+-*(0123456789)")) for line in lines]
    for i, line in enumerate(lines):
        if node in line:
            yield "\n".join(lines[i + 1 : next((j for j in range(i + 1, len(lines)) if deep[j] <= deep[i]), len(lines))])


@pytest.mark.parametrize("name", ["knn_chunks", "knn_ip", "render_results", "knn_batch", "result_sources", "search_rendered", "knn_cosine", "search_context"])
def test_blocks_of_vectors_are_not_broadcast(spark, name):
    from quern.plans.queries import QUERIES

    found = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert found.collect()
    met = [x for x in below(found._jdf.queryExecution().executedPlan().toString(), "MapInArrow") if "embedding" in x]
    assert met and not any("Broadcast" in x for x in met)


def test_every_vector_is_asked_for(spark):
    from quern.plans.queries import ORACLE, QUERIES

    usable = spark.read.parquet("/root/testdata/sf0.001/vec_index.parquet").where("size(embedding) > 0")
    asked = {r.qid for r in QUERIES["knn_ip"](spark, "/root/testdata/sf0.001").select("qid").distinct().collect()}
    assert asked == {r.rowid for r in usable.collect()} and "%" not in ORACLE["knn_ip"]


def test_best_of_many_blocks_with_ties(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (700, 3)).astype(np.float32)  # nearly all scores tie, some vectors are all zero
    x[5], x[6] = [3e20, 0, 1], [1e-30, 3e20, 2]
    v = spark.createDataFrame([(f"k{i:04}", a.tolist()) for i, a in enumerate(x)], "id string, embedding array<float>").repartition(5)
    q = v.selectExpr("cast(substring(id, 2) as int) as qid", "embedding").repartition(3)
    got = {(r.qid, r["rank"]): (r.id, r.raw) for r in vector.top_k(q, v, 7, block=64).collect()}
    s = np.round(x.astype(float) @ x.T.astype(float), 9)
    for i in range(700):
        want = np.lexsort((np.arange(700), -s[i]))[:7]
        assert [got[i, r + 1] for r in range(7)] == [(f"k{j:04}", s[i, j]) for j in want]

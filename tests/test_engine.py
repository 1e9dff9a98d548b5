import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions.text import sanitize
from quern.operators import integrity, vector
from quern.operators.catalog import Catalog, IndexNotFound
from quern.operators.embed import HashingEmbedder, embed
from quern.operators.store import Conflict, Index, Locked, Unsupported, dense_ids, verify_all
from quern.settings import Settings
from quern.sources.extract import epub_text, extract, html_text, split_spread
from quern.sources.files import code_documents, code_paths, document_paths
from quern.streaming.ingest import ingest

CHUNKS = "id long, doc_id long, source string, text string, chunk_idx int, chunk_of int, ocr boolean, embedding array<float>"


def chunk_rows(spark, sources):
    rows = [(i, None, s, f"text {s} {i}", 0, 1, False, [1.0, 0.0]) for i, s in enumerate(sources)]
    return spark.createDataFrame(rows, CHUNKS)


def hash_rows(spark, *names):
    return spark.createDataFrame([(f"h-{n}", n) for n in names], "hash string, filename string")


def doc_rows(spark, *names):
    return spark.createDataFrame([(i + 1, n, f"full {n}", False) for i, n in enumerate(names)], "doc_id long, source string, full_text string, ocr boolean")


def test_store_round_trip(spark, tmp_path):
    index = Index(spark, tmp_path / "one")
    index.save(chunk_rows(spark, ["a", "b"]), hash_rows(spark, "a", "b"), doc_rows(spark, "a", "b"))
    assert index.locked() and index.meta()["n_chunks"] == 2 and index.meta()["dim"] == 2
    with pytest.raises(Locked):
        index.save(chunk_rows(spark, ["a"]), hash_rows(spark, "a"))
    index.append(chunk_rows(spark, ["c", "b"]), hash_rows(spark, "c", "b"), doc_rows(spark, "b", "c"))
    got = {(r.id, r.source) for r in index.read("chunks").collect()}
    assert got == {(0, "a"), (1, "b"), (2, "b"), (3, "c")}
    assert index.read("documents").count() == 3 and index.read("hashes").count() == 3
    assert index.remove_source("b") == {"documents": 1, "chunks": 2, "hashes": 1}
    with pytest.raises(KeyError):
        index.remove_source("b")
    assert set(index.check(fast=False).values()) == {"ok"}


def files_under(folder):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_append_rewrites_nothing(spark, tmp_path):
    index = Index(spark, tmp_path / "big")
    index.save(chunk_rows(spark, [f"s{i}" for i in range(50)]), hash_rows(spark, *(f"s{i}" for i in range(50))), doc_rows(spark, *(f"s{i}" for i in range(50))))
    before = files_under(tmp_path / "big")
    index.append(chunk_rows(spark, ["new"]), hash_rows(spark, "new", "s1"), doc_rows(spark, "new"))
    after = files_under(tmp_path / "big")
    assert before.items() <= after.items()
    added = [p for p in after if p not in before and "record" not in str(p)]
    assert sum(spark.read.parquet(str(p)).count() for p in added) == 3  # one document, one chunk, one hash
    assert index.read("chunks").count() == 51 and index.read("hashes").count() == 51 and index.meta()["n_files"] == 51
    assert index.vacuum(keep=1) == ["manifest-1.json"] and index.read("documents").count() == 51
    index.save_hashes(hash_rows(spark, "one"))
    assert index.read("hashes").count() == 1 and index.read("chunks").count() == 51
    assert len(index.vacuum(keep=1)) == 1 and set(index.check(fast=False).values()) <= {"ok", "MISSING"}


def test_two_writers(spark, tmp_path):
    one, two = Index(spark, tmp_path / "x"), Index(spark, tmp_path / "x")
    one.save(chunk_rows(spark, ["a"]), hash_rows(spark, "a"), lock=False)
    base, manifest = two.version, two.manifest()
    one.append(chunk_rows(spark, ["b"]), hash_rows(spark, "b"), lock=False)
    with pytest.raises(Conflict):
        two._commit(base, {"chunks": chunk_rows(spark, ["c"])}, manifest["tables"], manifest["records"], {}, False)
    assert sorted(r.source for r in two.read("chunks").collect()) == ["a", "b"]


def test_lost_write_keeps_the_version_before(spark, tmp_path):
    index = Index(spark, tmp_path / "two")
    index.save(chunk_rows(spark, ["a"]), hash_rows(spark, "a"))
    bad = chunk_rows(spark, ["z"]).withColumn("text", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        index.append(bad, hash_rows(spark, "z"))
    assert [r.source for r in index.read("chunks").collect()] == ["a"]
    with pytest.raises(Unsupported):
        index.append(chunk_rows(spark, ["b"]), hash_rows(spark, "b"), doc_rows(spark, "b"))


def test_dense_ids(spark):
    items = spark.createDataFrame([(f"k{i:03}", i % 4) for i in range(100)], "k string, n int")
    got = dense_ids(items, "k", "n", 7, buckets=5).orderBy("k").collect()
    at = 7
    for r in got:
        assert r["_first"] == at
        at += r["n"]


def test_catalog(spark, tmp_path):
    c = Catalog(spark, tmp_path / "home")
    c.new("alpha").save(chunk_rows(spark, ["a"]), hash_rows(spark, "a"), lock=False)
    with pytest.raises(IndexNotFound) as e:
        c.get("beta")
    assert e.value.known == ["alpha"]
    c.rename("alpha", "beta")
    c.move("beta", tmp_path / "away")
    assert c.names() == ["beta"] and c.get("beta").read("chunks").count() == 1
    with pytest.raises(ValueError):
        c.add_external(tmp_path / "away" / "beta")
    c.delete("beta")
    assert c.names() == [] and (tmp_path / "away" / "beta").exists()
    with pytest.raises(ValueError):
        c.new("no/name")


def test_integrity(spark, tmp_path):
    index = Index(spark, tmp_path / "three")
    index.save(chunk_rows(spark, ["a"]), hash_rows(spark, "a"))
    index.gate(fast=False)
    data = next((tmp_path / "three").glob("data-*/hashes/*.parquet"))
    data.write_bytes(data.read_bytes() + b"x")
    data.with_name(f".{data.name}.crc").unlink()
    with pytest.raises(integrity.IntegrityError):
        index.gate(fast=False)
    with pytest.raises(integrity.IntegrityError):
        Index(spark, tmp_path / "three").read("chunks")
    assert set(verify_all([index])["three"].values()) == {"mismatch", "ok"}
    data.unlink()
    assert set(index.check().values()) == {"MISSING", "ok"}
    index.suppress()
    assert index.check() == {"": "suppressed"} and Index(spark, tmp_path / "three").read("chunks").count() == 1
    assert Index(spark, tmp_path / "none").check() == {}


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[7] = x[3]
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)] + [(900, None), (901, [0.0] * 8), (902, [1.0])]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = vectors.where("id < 20").select(F.col("id").alias("qid"), "embedding")
    got = {(r.qid, r["rank"]): r.id for r in vector.top_k(asked, vectors, 3, mode="cosine", block=64).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(20):
        s = np.round((1 + u[q].astype(float) @ u.T.astype(float)) / 2, 9)
        assert [got[q, r] for r in (1, 2, 3)] == list(np.lexsort((np.arange(300), -s))[:3])
    assert vector.top_k(asked.limit(0), vectors, 3).count() == 0


def test_files(spark, tmp_path):
    for name, body in {
        "pkg/__init__.py": b"x = 1\n", ".env.example": b"A=1\n", ".hid/y.py": b"y\n", "node_modules/z.js": b"z\n", "bad.py": b"\xff\xfea\r\nb\r", "empty.py": b" \n", "UP.PY": b"no\n", "n.TXT": b"t\n",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    assert code_paths(tmp_path) == [".env.example", "bad.py", "empty.py", "pkg/__init__.py"]
    assert document_paths(tmp_path) == ["n.TXT"]
    docs = {r.source: r for r in code_documents(spark, tmp_path).collect()}
    assert set(docs) == {".env.example", "bad.py", "pkg/__init__.py"} and docs["bad.py"].full_text == "��a\nb\n"
    assert docs["pkg/__init__.py"].language == "python" and docs[".env.example"].language is None


def test_text_and_formats(spark, tmp_path):
    import io
    import zipfile

    messy = "ﬁ１\r\nx \t\n" + "\n" * 5 + "\ry\x07"
    assert spark.createDataFrame([(messy,)], "t string").select(sanitize(F.col("t"))).first()[0] == "fi1\nx\n\n\ny"
    assert html_text("<p>a<script>no</script><!-- c --> b &amp; c</p>") == "a\n b & c"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("b.xhtml", "<p>two</p>")
        z.writestr("a.xhtml", "<p>one</p>")
        z.writestr("c.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="1" href="b.xhtml"/><item id="2" href="a.xhtml"/></manifest><spine><itemref idref="1"/><itemref idref="2"/></spine></package>')
    assert epub_text(data.getvalue()) == "two\n\none"
    assert extract(b"  ", "text") == (None, False)
    assert extract(b"img", "image", ocr=lambda i, language, negative: "seen") == ("seen", True)
    page = np.full((10, 40), 100)
    page[:, 20] = 255
    assert [p.shape for p in split_spread(page)] == [(10, 20), (10, 20)]


def test_embedder_is_unit_or_zero(spark):
    rows = spark.createDataFrame([(1, "a b c"), (2, ""), (3, None)], "id int, text string")
    got = {r.id: r.embedding for r in embed(rows, HashingEmbedder(8)).collect()}
    assert abs(sum(v * v for v in got[1]) - 1) < 1e-6 and not any(got[2]) and not any(got[3])


def test_settings(tmp_path):
    p = tmp_path / "s.json"
    p.write_text('{"chunk_size": 500, "unknown": 1}')
    s = Settings.load(p)
    assert s.chunk_size == 500 and s.overlap == 200 and s.ocr_enabled(False) is False


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    index = Index(spark, tmp_path / "idx")
    schema = "source string, full_text string, ocr boolean"
    spark.createDataFrame([("a", "alpha " * 20, False), ("b", "beta " * 20, None), ("c", "alpha " * 20, False)], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        q = ingest(stream, index, str(tmp_path / "check"), HashingEmbedder(8))
        q.processAllAvailable()
        q.stop()
    assert sorted(r.source for r in index.read("documents").collect()) == ["a", "b"]
    assert index.read("chunks").where("embedding is null").count() == 0

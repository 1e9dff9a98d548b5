"""Edge cases and brute-force comparisons of the operators for training text."""

import itertools
import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import codelang, handwritten, knn, markup, mixing, neardup, oversized, packing, scans, sentences

DOCS = "doc_id long, index_name string, source string, text string, full_text string, doc_type string, language string, lang string, ocr boolean, _k string, _t int"
PROSE = "The quiet harbour keeps the old map beside the river, because one clerk studies the wooden bridge. "


def docs(spark, *rows):
    """(doc_id, text, doc_type, source, language) rows with columns whose names clash with the operators' own."""
    full = [(r[0], "ix", r[3] if len(r) > 3 else "a.txt", r[1], r[1], r[2] if len(r) > 2 else "book", r[4] if len(r) > 4 else None, "en", None, "clash", 7) for r in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, very long, tied and repeated texts."""
    return docs(spark, (1, None), (2, ""), (3, PROSE * 300), (4, PROSE * 2), (5, PROSE * 2), (6, " \n\n "), (7, None, None, None), (8, "x = 'a'\n" * 5000, "code", None, "python"), (9, "", "code", "v.py", None))


def limits(spark, size=200, overlap=20):
    return spark.createDataFrame([("ix", size, overlap), ("none", None, None)], "index_name string, chunk_size int, overlap int")


# ---- 1


def test_attribute_files_decide():
    files = [("", "*.js linguist-generated\nvendor/** -linguist-vendored\ndocs/*.h linguist-vendored=true\n"), ("src", "*.js linguist-generated=false\n/a/*.py linguist-generated\n")]
    assert handwritten.declared("x/y.js", files) == {"generated": True}
    assert handwritten.declared("src/y.js", files) == {"generated": False}
    anchored = [("", "/vendor/ linguist-vendored\na/*.c linguist-generated\nb.c linguist-generated\n"), ("x", "b.c !linguist-generated\n")]
    assert handwritten.declared("vendor/a.js", anchored) == {"vendored": True} and handwritten.declared("src/vendor/a.js", anchored) == {}
    assert handwritten.declared("a/q.c", anchored) == {"generated": True} and handwritten.declared("z/a/q.c", anchored) == {}
    assert handwritten.declared("y/b.c", anchored) == {"generated": True} and handwritten.declared("x/b.c", anchored) == {}
    assert handwritten.declared("src/a/b.py", files) == {"generated": True}
    assert handwritten.declared("src/z/a/b.py", files) == {}
    assert handwritten.declared("docs/x.h", files) == {"vendored": True} and handwritten.declared("docs/d/x.h", files) == {}
    assert handwritten.declared("vendor/q/z.py", files) == {"vendored": False}


def test_statements_count_wherever_they_stand():
    licence = "".join(f"# licence line {i}\n" for i in range(40))
    assert handwritten.content_kind(licence + "# Code generated by x 1.2. DO NOT EDIT.\ndef f(): pass\n") == "generated"
    assert handwritten.content_kind("def f(): pass\n" * 30 + "# " + "-" * 500 + " Code generated by x 1.2. DO NOT EDIT.\n") == "generated"


def test_content_kinds():
    assert handwritten.content_kind("# Code generated by x 1.2. DO NOT EDIT.\ndef f(): pass") == "generated"
    assert handwritten.content_kind("# Do not edit this pilot while the loop is running.\ndef f(): pass") is None
    assert handwritten.content_kind("// third-party copy of x\nint f() { return 1; }") == "vendored"
    assert handwritten.content_kind("var a=function(b){return b.c};" * 40) == "minified"
    assert handwritten.content_kind("x = [\n" + "  0x1f, 0x2e, 0x3d,\n" * 40 + "]") == "data"
    assert handwritten.content_kind("\n".join(f"def get_{i}(a):\n    return a\n" for i in range(9))) == "generated"
    assert handwritten.content_kind("def area(w, h):\n    return w * h\n\ndef edge(w):\n    return 4 * w\n" * 3) is None


def test_not_handwritten(spark, odd):
    rows = docs(
        spark, (1, "*.py linguist-generated\n", "code", ".gitattributes"), (2, "def a(): pass", "code", "x/a.py", "python"), (3, "int b;", "code", "vendor/b.c", "c"),
        (4, "int c;", "code", "src/c.c", "c"), (5, None, "code", "third_party/d.c", "c"), (6, "# generated", "code", "__project_summary__"), (6, "int e;", "code", "Pods/e.c", "c"), (7, "int f;", "book", "vendor/f.c"),
    )
    got = {r.doc_id: (r.kind, r.evidence) for r in handwritten.not_handwritten(rows).collect()}
    assert got == {2: ("generated", "declared"), 3: ("vendored", "path"), 5: ("vendored", "path"), 6: ("vendored", "path")}
    data = "x = [\n" + "  0x1f, 0x2e, 0x3d,\n" * 40 + "]"
    spared = docs(spark, (1, "*.py -linguist-generated\n", "code", ".gitattributes"), (2, data, "code", "a.py", "python"), (3, data, "code", "b.go", "go"))
    assert [(r.doc_id, r.kind, r.evidence) for r in handwritten.not_handwritten(spared).collect()] == [(3, "data", "content")]
    ruled = docs(spark, (0, "out/** linguist-generated\n", "code", ".gitattributes"), *((i, f"int f{i};", "code", f"out/{'abcdefgh'[i]}.c") for i in range(1, 8)), *((i, "int a;", "code", f"src/{i}.c") for i in range(20, 80)))
    other = ruled.unionByName(docs(spark, (100, "int z;", "code", "lib/out/z.c")).withColumn("index_name", F.lit("other")))
    assert {r.doc_id: r.evidence for r in handwritten.not_handwritten(other).collect()} == {**{i: "declared" for i in range(1, 8)}, 100: "mined"}
    assert handwritten.not_handwritten(odd).count() == 0 and handwritten.not_handwritten(odd.limit(0)).count() == 0


# ---- 2


@settings(max_examples=80, deadline=None)
@given(st.text("ab .\n", max_size=600), st.integers(5, 60), st.integers(0, 80))
def test_pieces_restore_the_text(text, size, overlap):
    overlap = min(overlap, size - 1)
    spans = list(oversized.pieces(text, size, overlap))
    assert all(b - a <= size for a, b, _ in spans) and spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(c == b - overlap for (_, b, _), (c, _, _) in zip(spans, spans[1:]))
    for _, b, kind in spans[:-1]:
        assert text[b - 1].isspace() == (kind != "none") and ("\n" in re.search(r"\s*$", text[:b]).group() or kind in ("word", "none"))


def test_boundary_of():
    assert oversized.boundary_of("aaa\n \nbbb", 3) == "paragraph"
    assert oversized.boundary_of("aaa\nbbb", 3) == "line"
    assert oversized.boundary_of("aaa bbb", 3) == "word"
    assert oversized.boundary_of("aaaa", 3) == "none"


def test_cuts_fall_where_the_topic_changes():
    one, two = "river boat water fish sail harbour. ", "wheel engine road brake motor garage. "
    text = "\n".join([one] * 8 + [two] * 8)
    assert 8 * len(one + "\n") in [b for _, b, _ in oversized.pieces(text, int(len(text) * 0.7), 0)]
    # also between words, where there is nothing coarser
    words = text.replace("\n", "")
    assert 8 * len(one) in [b for _, b, _ in oversized.pieces(words, int(len(words) * 0.7), 0)]


def test_cuts_find_planted_changes_of_topic():
    rng, hits, n = random.Random(4), 0, 60
    for _ in range(n):
        topics = [[f"t{rng.randrange(10**6)}" for _ in range(12)] for _ in range(2)]
        lines = [" ".join(rng.choice(w) for _ in range(9)) for w in topics for _ in range(14)]
        text = "\n".join(lines)
        border = len("\n".join(lines[:14])) + 1
        hits += any(abs(b - border) <= 60 for _, b, _ in oversized.pieces(text, int(border * 1.4), 0))
    assert hits >= 0.9 * n


def test_cohesion_equals_counting():
    text = " ".join(random.Random(1).choice("aa bb cc dd ee".split()) for _ in range(90))
    words, gaps = text.split(), np.array([m.end() for m in re.finditer(" ", text)])
    for at, got in zip(range(1, 90), oversized.cohesion(text, gaps, 20)):
        a, b = Counter(words[max(0, at - 20) : at]), Counter(words[at : at + 20])
        assert abs(got - sum(a[w] * b[w] for w in a) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))) < 1e-9



def test_split_oversized(spark, odd):
    got = oversized.split_oversized(odd, limits(spark)).collect()
    assert {r.doc_id for r in got} == {3, 8} and all(len(r.text) <= 200 for r in got)
    assert oversized.split_oversized(odd, limits(spark, None)).count() == 0
    assert oversized.split_oversized(odd.limit(0), limits(spark)).count() == 0


# ---- 3


@pytest.fixture(scope="module")
def models():
    texts = {
        "de": "Der alte Mann geht durch die Stadt und sucht einen Freund, weil das Wetter nicht gut ist. Ich habe keine Zeit für das Spiel. ",
        "en": "The old man walks through the town and looks for a friend, because the weather is not good. I have no time for the game. ",
        "es": "El hombre viejo camina por la ciudad y busca un amigo, porque el tiempo no es bueno. No tengo tiempo para el juego. ",
        "fr": "Le vieil homme marche dans la ville et cherche un ami, parce que le temps n’est pas bon. Je n’ai pas le temps pour le jeu. ",
        "it": "Il vecchio cammina per la città e cerca un amico, perché il tempo non è buono. Non ho tempo per il gioco. ",
    }
    return np.stack([codelang.train([texts[k]] * 5) for k in codelang.LATIN])


def masks(text, syntax):
    raw = text.encode()
    found = codelang.runs(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), [syntax])[0]
    return [t for t, _ in codelang.passages(raw, found) if t]


def test_automaton():
    assert masks("a = 1 # one\n# two\nb = '''x\n'y' # z''' + \"q\\\"r\" + ''\n", "python") == ["one\ntwo", "x\n'y' # z", 'q"r']
    assert masks('int a; // one "two"\nb; /* three * / four */ s = "fi//ve";', "c") == ['one "two"', "three * / four ", "fi//ve"]
    assert masks("x=$a#no # yes\ny='it\\'", "shell")[0] == "yes"
    assert masks("a -- note\nselect 'it''s'", "sql")[0] == "note"
    assert masks(r's = "\u4f60\u597d\n"', "js") == ["你好\n"]
    assert masks("", "c") == []


def test_automaton_reads_what_looks_like_quotes():
    assert masks("""let c = '"'; let s: &'a str = "one"; // two's\nlet d = '\\''; let e = "three";""", "rust") == ["one", "two's", "three"]
    assert masks("""let r = /["'`]/g; let s = "one"; // two\nx = a / b; y = "c" / 2; s.replace(/[/"]\\/"/, 'q'); /* z */""", "js") == ["one", "two", "c", "q", "z "]
    assert [x.strip(" $") for x in masks('t = `a ${ f("in", `x ${ {b: "deep"}.b } y`) } b`; u = "last"', "js")] == ["a", "in", "x", "deep", "y", "b", "last"]
    assert masks('String a = """\n  one "two" three\n  """; char b = \'"\'; String c = "four"; // five', "java") == ['\n  one "two" three\n  ', "four", "five"]


def test_languages(models):
    lang = lambda t: set(codelang.languages(t, models))
    assert lang("the man looks for a friend") == {"en"} and lang("weil das Wetter nicht gut ist") == {"de"}
    assert lang("three words only") == set() and lang("while (a.b()) { c = d; }") == set() and lang("path/to/file name.py key_one") == set()
    assert lang("шла старая женщина домой") == {"ru"} and lang("静かな図書館は長い") == {"ja"} and lang("安静的图书馆") == {"zh"} and lang("图书馆") == set()
    assert lang("їхала стара жінка додому") == set()


def test_code_languages(spark, odd, models):
    rows = docs(spark, (1, "# the man looks for a friend\nx = 1\n", "code", "a.py", "python"), (2, "# the man looks for a friend", "code", "a.py", None), (3, "the man looks for a friend", "book"))
    assert [(r.doc_id, r.lang) for r in codelang.code_languages(rows, models).collect()] == [(1, "en")]
    assert codelang.code_languages(odd, models).count() == 0 and codelang.code_languages(odd.limit(0), models).count() == 0
    assert codelang.fit_models(odd.limit(0)).shape[0] == 5


# ---- 4


def test_page_lines():
    text = "OLD MAPS OF TANETH   11\nThe clerk studies a bridge in the cold\nmonths of the\n\n12\nOLD MAPS OF TANETH\n\nyear. It ends in\n1846.\n\nCHAPTER 2\n\nMore."
    assert sorted(scans.page_lines(text.split("\n"))) == [0, 4, 5]


def test_variants():
    assert "private" in scans.variants("privatc") and "modern" in scans.variants("modem") and "bridge" in scans.variants("briclge", 1)


def test_repair():
    text = "One clerk keeps the wood-\nen bridge and thi5\n\n12\n\nold map.\n\nAnother para-\ngraph ends."
    got = scans.repair(text, {4}, {1, 8}, {2: {"thi5": "this"}})
    assert got == "One clerk keeps the wooden bridge and this old map.\n\nAnother paragraph ends."


def test_scan_noise(spark, odd):
    base = [(i, PROSE * 20) for i in range(10, 20)]
    noisy = "The quiet har-\nbour keeps tbe old map. A half-\nopen gate.\n\n— 7 —\n\nThe wooden br1dge."
    compound = [(30, "A half-open gate stands here. " * 4)]
    rows = docs(spark, *base, *compound, (1, noisy))
    noise, fixes = scans.scan_noise(rows)
    assert {(r.line_no, r.kind) for r in noise.where("doc_id = 1").collect()} == {(1, "hyphen"), (2, "chars"), (5, "page"), (7, "chars")}
    assert {(r.word, r.fix) for r in fixes.collect()} == {("tbe", "the"), ("br1dge", "bridge")}
    repaired = {r.doc_id: r.text for r in scans.repair_scans(rows).collect()}
    assert repaired[1] == "The quiet harbour keeps the old map. A half-open gate.\n\nThe wooden bridge."
    assert scans.scan_noise(odd)[0].count() == 0 and scans.scan_noise(odd.limit(0))[0].count() == 0


def test_words_of_every_book_are_judged(spark):
    base = [(i, PROSE * 20 + f"Copy {i}.") for i in range(10, 20)]
    plain = spark.createDataFrame([(1, "book", False, "The quiet harbour keeps tbe old map."), (2, "book", None, "The wooden br1dge.")], "doc_id long, doc_type string, ocr boolean, full_text string")
    rows = docs(spark, *base).select("doc_id", "doc_type", "ocr", "full_text").unionByName(plain)
    noise, fixes = scans.scan_noise(rows)
    assert {tuple(r) for r in noise.collect()} == {(1, 1, "chars"), (2, 1, "chars")}
    assert {(r.word, r.fix) for r in fixes.collect()} == {("tbe", "the"), ("br1dge", "bridge")}


def test_copies_and_size_do_not_decide(spark):
    base = [(i, PROSE * 20 + f"Copy {i}.") for i in range(10, 20)]
    copies = [(i, "The quiet harbour keeps tbe old map.") for i in range(100, 140)]
    noise, fixes = scans.scan_noise(docs(spark, *base, *copies))
    assert noise.where("kind = 'chars'").count() == 40 and {r.word for r in fixes.collect()} == {"tbe"}
    counts = spark.createDataFrame([("tbe", 3000), ("the", 900000), ("0f", 2500), ("of", 800000)], "word string, n long")
    assert {(r.word, r.fix) for r in scans.misread_words(counts, counts).collect()} == {("tbe", "the"), ("0f", "of")}


def test_blanks_lost_added_and_displaced(spark):
    base = [(i, PROSE * 40 + f"Copy {i}.") for i in range(10, 30)]
    bad = [(1, "The quiet harbourkeeps the old map."), (2, "The quiet harb our keeps the old map."), (3, "The quie tharbour keeps tbe old map."), (4, "The qui-\net harb0ur keeps the old br-\nidgc."), (5, "The quie\n\n— 7 —\n\ntharbour keeps the old map.")]
    rows = docs(spark, *base, *bad)
    noise, fixes = scans.scan_noise(rows)
    got = {k: {(r.word, r.fix) for r in fixes.where(f"doc_id = {k}").collect()} for k in (1, 2, 3, 4, 5)}
    assert got.pop(5) == {("quie tharbour", "quiet harbour")}  # over a line end and a page
    assert got == {1: {("harbourkeeps", "harbour keeps")}, 2: {("harb our", "harbour")}, 3: {("quie tharbour", "quiet harbour"), ("tbe", "the")}, 4: {("harb0ur", "harbour"), ("bridgc", "bridge")}}
    assert {(r.doc_id, r.line_no, r.kind) for r in noise.collect()} == {(3, 1, "chars"), (4, 1, "hyphen"), (4, 2, "chars"), (4, 2, "hyphen"), (4, 3, "chars"), (5, 3, "page")}
    repaired = {r.doc_id: r.text for r in scans.repair_scans(rows).where("doc_id <= 5").collect()}
    assert set(repaired.values()) == {"The quiet harbour keeps the old map.", "The quiet harbour keeps the old bridge."} and repaired.keys() == {1, 2, 3, 4, 5}


def test_markup_in_a_scan_hides_only_itself(spark):
    base = [(i, PROSE * 20) for i in range(10, 20)]
    noise, _ = scans.scan_noise(docs(spark, *base, (1, "The quiet har-\nbour keeps tbe old map.\n\n— 7 —\n\n<p>tbe</p>\n```\ntbe\n```\n" + "x" * 200 + " br1dge")))
    assert {(r.line_no, r.kind) for r in noise.where("doc_id = 1").collect()} == {(1, "hyphen"), (2, "chars"), (4, "page"), (10, "chars")}


def test_words_without_end(spark):
    endless = "".join(random.Random(1).choice("cri1l0nm") for _ in range(200_000))
    noise, fixes = scans.scan_noise(docs(spark, *[(i, PROSE * 20) for i in range(10, 20)], (1, f"The quiet harbour keeps tbe old map. {endless} and {endless}")))
    assert [(r.word, r.fix) for r in fixes.collect()] == [("tbe", "the")]


def test_best_path():
    assert scans.best_path([(0, 1, 3.0, 0), (0, 2, 5.0, 1), (1, 1, 1.0, 2), (2, 1, 1.0, 3)]) == [1, 3] and scans.best_path([]) == []
    assert scans.best_path([(0, 2, 3.0, 0), (1, 1, 4.0, 1)]) == [1]


def test_wrapped_and_flagged_books_are_repaired(spark):
    wrapped = "The quiet harbour keeps the old map beside\nthe river, because one clerk studies the\nwooden bridge and the quiet clerk waits."
    rows = [(1, "book", False, wrapped), (2, "book", True, "One line."), (3, "book", False, "One line.\n\nAnother."), (4, "code", True, wrapped), (5, "book", True, None), (6, "book", True, "See this\ncode:\n```\na\n\nb\n```\nend of\nit.")]
    got = {r.doc_id: r.text for r in scans.repair_scans(spark.createDataFrame(rows, "doc_id long, doc_type string, ocr boolean, full_text string")).collect()}
    assert got == {1: wrapped.replace("\n", " "), 2: "One line.", 6: "See this code:\n\n```\na\n\nb\n```\n\nend of it."}


# ---- 5


def vectors(spark, rows):
    return spark.createDataFrame([(int(k), None if v is None else [float(x) for x in v], "clash") for k, v in rows], "rowid long, embedding array<float>, _v string")


def test_similar_pairs_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 32))
    x = np.concatenate([centres + 0.08 * rng.standard_normal(centres.shape) for _ in range(4)] + [rng.standard_normal((200, 32))])
    x = np.concatenate([x, x[:3], x[:1] * 2, x[:1] * 3])
    rows = [*enumerate(x), (900, None), (901, np.zeros(32)), (902, [1.0, 2.0])]
    got = {(r.rowid_a, r.rowid_b) for r in knn.similar_pairs(vectors(spark, rows)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    want = set()
    for i in range(len(x)):
        for j in np.lexsort((np.arange(len(x)), -s[i]))[:5]:
            if s[i, j] >= 0.9:
                want.add((min(i, int(j)), max(i, int(j))))
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    assert knn.similar_pairs(vectors(spark, [(1, None)])).count() == 0


def test_nearest_of_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 32)).astype(np.float32)
    rows = vectors(spark, enumerate(x))
    got = knn.nearest_of(rows, rows.where("rowid % 20 = 0"), k=5, block=16).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = sum(r.neighbour in [j for j in np.argsort(-(u @ u[r.query]))[:6] if j != r.query] for r in got)
    assert len(got) == 150 and hits == 150  # all far off: the exact way
    near = np.concatenate([x[:100] + 0.02 * rng.standard_normal((100, 32)) for _ in range(8)]).astype(np.float32)
    close = vectors(spark, enumerate(near))
    found = knn.nearest_of(close, close.where("rowid % 20 = 0"), k=5).collect()
    u = near / np.linalg.norm(near, axis=1, keepdims=True)
    hits = sum(r.neighbour in [j for j in np.argsort(-(u @ u[r.query]))[:6] if j != r.query] for r in found)
    assert len(found) == 200 and hits >= 0.95 * 200  # all near: by the index
    same = vectors(spark, [(i, [1.0, 2.0, 0.5]) for i in range(30)] + [(99, [0.0, 0.0, 1.0])])
    assert {(r.query, r.neighbour) for r in knn.nearest_of(same, same.where("rowid in (0, 20)"), k=3).collect()} == {(0, 1), (0, 2), (0, 3), (20, 0), (20, 1), (20, 2)}
    assert knn.nearest_of(rows.limit(0), rows).count() == 0


def test_equal_vectors_of_any_number(spark):
    rows = vectors(spark, [(i, [1.0, 2.0, 0.5, 1.5]) for i in range(40)] + [(100, [1.0, 2.0, 0.5, 1.51]), (101, [-1.0, 0.0, 2.0, 0.0])])
    got = {(r.rowid_a, r.rowid_b) for r in knn.similar_pairs(rows, k=2).collect()}
    want = {(0, i) for i in range(1, 40)} | {(1, i) for i in range(2, 40)} | {(0, 2), (0, 100), (1, 100)}
    assert got == want


def test_shape_of_codes():
    assert knn.code_shape(200_000, 0.9, 0.06)[0] == 16 and knn.code_shape(90_000_000, 0.9, 0.06)[0] == 24
    assert knn.code_shape(90_000_000, 0.9, 0.06)[1] > 2 * knn.code_shape(200_000, 0.9, 0.06)[1]
    assert knn.radius_for(64, 0.9, 6e-5) in range(18, 24)


# ---- 6


def test_near_duplicates_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(30):
        base = [rng.choice(words) for _ in range(90)]
        texts.append(" ".join(base))
        for edits in (2, 8, 14):
            other = list(base)
            for _ in range(edits):
                other[rng.randrange(len(other))] = rng.choice(words)
            texts.append(" ".join(other))
    texts += [texts[0]] * 40 + ["too few words", texts[5].upper(), texts[6]]
    rows = [(i, x) for i, x in enumerate(texts)]
    sets = {i: {tuple(x.lower().split()[j : j + 5]) for j in range(len(x.split()) - 4)} for i, x in rows if len(x.split()) >= 40}
    links, members = neardup.near_duplicates(docs(spark, *rows), threshold=0.5)
    want = {(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    pairs = lambda found: [(r.doc_id_a, r.doc_id_b) for r in neardup.all_pairs(*found).collect()]
    assert sorted(pairs((links, members))) == sorted(want)
    close = {(a, b) for a, b in want if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert sorted(pairs(neardup.near_duplicates(docs(spark, *rows), threshold=0.8))) == sorted(close)
    # small blocks, ranges and trees split everything that can be split and change nothing
    small = neardup.near_duplicates(docs(spark, *rows), threshold=0.5, block_tokens=500, range_tokens=700, dense=2, tree_sets=2)
    assert sorted(pairs(small)) == sorted(want)
    assert len({r.rep for r in members.collect()}) == len(set(texts)) - 1 and all(r.doc_id_a not in range(120, 160) for r in links.collect())
    assert members.count() == len(sets)


def test_near_duplicates_of_odd_rows(spark, odd):
    links, members = neardup.near_duplicates(odd.unionByName(odd))
    assert links.count() == 0 and {(r.doc_id, r.rep) for r in members.collect()} == {(3, 3), (8, 8)}
    links, members = neardup.near_duplicates(odd.limit(0))
    assert links.count() == 0 and members.count() == 0


def test_shingle_in_half_of_all_texts(spark):
    rng = random.Random(8)
    head = " ".join(f"h{i}" for i in range(30))
    texts = [(head + " " if i % 2 else "") + " ".join(f"u{rng.randrange(10**6)}" for _ in range(40)) for i in range(200)]
    texts += [t + " one more end" for t in texts[:6]]
    sets = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for t in texts]
    want = sorted((a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]))
    for more in ({}, {"dense": 3, "tree_sets": 8}):
        links, _ = neardup.near_duplicates(docs(spark, *enumerate(texts)), threshold=0.5, **more)
        assert sorted((r.doc_id_a, r.doc_id_b) for r in links.collect()) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.sets(st.integers(0, 12), min_size=1, max_size=9), st.integers(0, 3)), max_size=14), st.sampled_from([0.4, 0.5, 0.8]), st.sampled_from([1, 50]))
def test_trees_equal_brute_force(rows, threshold, most):
    rows = sorted((g, sorted(s), extra) for g, s, extra in rows)
    sets = neardup.Sets([r[0] for r in rows], [np.array(r[1], np.uint64) for r in rows], [len(r[1]) + r[2] for r in rows], [r[2] for r in rows])
    found = neardup.join_trees(sets, sets, np.arange(len(rows)), threshold, most)
    want = set()
    for i, j in itertools.combinations(range(len(rows)), 2):
        (g, x, a), (h, y, b) = rows[i], rows[j]
        both = len(set(x) & set(y))
        if g == h and both and (1 + threshold) * (both + min(a, b)) >= threshold * (len(x) + a + len(y) + b) - 1e-9:
            small, large = sorted((len(x) + a, len(y) + b))
            if small >= threshold * large - 1e-9:
                want.add((i, j, both))
    assert set(zip(*(x.tolist() for x in found))) == want


def test_large_trees_are_met_in_bounded_memory(spark, monkeypatch):
    """A worker that meets 3,000 sets of one home holds neither all their pairs nor lists of them."""
    rng = np.random.default_rng(1)
    ranks = [np.unique(rng.integers(0, 40, rng.integers(2, 7))).astype(np.uint64) for _ in range(3000)]
    rows = [(1, 0, 0, 0, i.to_bytes(16, "big"), i, 60, neardup._ranks_bytes(r), int(r[-1]), 50) for i, r in enumerate(ranks)]
    workers = []
    monkeypatch.setattr(neardup, "_mapped", lambda df, run, ddl: workers.append(run) or spark.createDataFrame([], ddl))
    prefixes = spark.createDataFrame([], "_home long, _k long, _digest binary, _size int, _ranks binary, _last long, _rest int")
    neardup._meet(prefixes, "bigint", 0.5, 4096)
    tracemalloc.start()
    found = sum(1 for _ in workers[0](iter(rows)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    held = np.zeros((3000, 40), np.int64)
    for i, r in enumerate(ranks):
        held[i, r.astype(np.int64)] = 1
    assert found == (np.triu(held @ held.T, 1) > 0).sum() and peak < 64e6


def test_trees_in_pieces_find_the_same(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(40):
        other = list(base)
        for _ in range(rng.choice((1, 4, 9))):
            other[rng.randrange(len(other))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(other))
    sets = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for t in texts]
    want = sorted((a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]))
    assert 0 < len(want) < 780
    for held in (neardup._HELD, 200):
        monkeypatch.setattr(neardup, "_HELD", held)
        links, _ = neardup.near_duplicates(docs(spark, *enumerate(texts)), threshold=0.5)
        assert sorted((r.doc_id_a, r.doc_id_b) for r in links.collect()) == want


def test_trees_share_paths():
    rows = [[1, 2], [1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 7], [1, 2, 3, 7, 8, 9], [4, 5, 6, 10, 11, 12]]
    sets = neardup.Sets([0] * 5, [np.array(r, np.uint64) for r in rows], [6] * 5, [0] * 5)
    forest = neardup.Forest(sets, sets.ranks.astype(np.int64))
    assert [len(x["token"]) for x in forest.levels] == [2, 2, 2, 3, 3, 4] and forest.levels[0]["hi"].tolist() == [4, 5]


# ---- 7


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("<p>One</p>", ["html"]), ("a &mdash; b", ["html"]), ("The board reads <shut> here.", []), ("It costs $5 to $9 here.", []), ("a 94'' nail", []), ("c:\\notes\\shelf", []),
        ("# One\n\ntext", ["markdown"]), ("one **two** three", ["markdown"]), ("- one\n- two\n\n1. three\n\n* * *", []), ("a_b_c and 2 * 3 * 4", []), ("see [a](b.md)", ["markdown"]),
        ("see [[One|two]]", ["wiki"]), ("== One ==\n\ntext", ["wiki"]), ("# one\n# two\n\n'''x'''", ["wiki"]), ("\\section{One}", ["latex"]), ("``one''", ["latex"]), ("so $x^2$ is", ["latex"]), ("", []),
        ("```\nx = a[[1]] ** b\n```", ["markdown"]),
    ],
)
def test_kinds(text, kinds):
    assert markup.kinds_of(text) == kinds


def test_long_and_deep_markup_is_markup():
    words = "word " * 100
    assert markup.kinds_of(f"a *{words}end* b") == ["markdown"] and markup.kinds_of(f"a ``{words}end'' b") == ["latex"]
    assert markup.clean("a " + "{{t|" * 8 + "x" + "}}" * 8 + " [[b]]") == "a x b"
    assert "\\emph" not in markup.clean("\\emph{" * 9 + "x" + "}" * 9 + " y")


def test_menus_of_fragments_go():
    menu = "<div><ul>" + "".join(f'<li><a href="/{i}">Go to {i}</a></li>' for i in range(6)) + "</ul></div>"
    text = markup.clean(menu + "<div><h2>Title</h2><p>" + PROSE * 3 + '</p><p>See <a href="x">this</a> too.</p></div>')
    assert text.startswith("## Title") and text.endswith("See this too.") and "Go to" not in text
    assert markup.clean("Plain <b>bold</b> text &amp; more.") == "Plain bold text & more."


def marked_up(rng, kind):
    """A text in one markup, and the headings, items, code blocks and formulas that it has."""
    words = "river clerk bridge harbour map stone letter garden window engine".split()
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(5, 12))).capitalize() + "."
    heads, items, code, formulas, out = [], [], [], [], []
    for _ in range(rng.randrange(2, 5)):
        head, prose = " ".join(rng.choice(words) for _ in range(3)).title(), " ".join(sentence() for _ in range(4))
        own, body, formula = [sentence() for _ in range(rng.randrange(2, 4))], f"x_{rng.randrange(99)} = f(a) * 2 # *no*\nreturn [x]", f"x^{rng.randrange(9)} + \\frac{{a}}{{b}}"
        stars = "\n".join(f"* {i}" for i in own)
        out += {
            "html": [f"<h2>{head}</h2>", f"<p>{prose} <em>very</em></p>", "<ul>" + "".join(f"<li>{i}</li>" for i in own) + "</ul>", f"<pre>{body}</pre>"],
            "markdown": [f"## {head}", f"{prose} *very*", stars, f"```\n{body}\n```"],
            "wiki": [f"== {head} ==", f"{prose} ''very''", stars, f'<syntaxhighlight lang="c">{body}</syntaxhighlight>'],
            "latex": [f"\\section{{{head}}}", f"{prose} \\emph{{very}}", "\\begin{itemize}\n" + "\n".join(f"\\item {i}" for i in own) + "\n\\end{itemize}", f"\\begin{{verbatim}}\n{body}\n\\end{{verbatim}}"],
        }[kind]
        heads, items, code = [*heads, head], items + own, [*code, body]
        if kind != "wiki":
            formulas.append(formula)
            out.append(f"It is so that ${formula}$ holds.")
    return "\n\n".join(out), heads, items, code, formulas


@pytest.mark.parametrize("kind", markup.KINDS)
def test_structure_kept_is_measured(kind):
    rng, kept, whole = random.Random(3), Counter(), Counter()
    for _ in range(40):
        text, heads, items, code, formulas = marked_up(rng, kind)
        got = markup.clean(text)
        assert kind in markup.kinds_of(text) and not re.search(r"</?\w+>|\*very\*|''very|\\emph|\\begin|\\item|==", got)
        kept["heads"] += sum(re.search(rf"(?m)^#+ {re.escape(h)}$", got) is not None for h in heads)
        kept["items"] += sum(re.search(rf"(?m)^- {re.escape(i)}$", got) is not None for i in items)
        kept["code"] += sum(f"```\n{c}\n```" in got for c in code)
        kept["formulas"] += sum(f in got for f in formulas)
        whole += Counter(heads=len(heads), items=len(items), code=len(code), formulas=len(formulas))
    assert all(kept[k] == n for k, n in whole.items())


def test_clean_keeps_structure():
    page = "<html><body><nav><a href='x'>zzz</a></nav><h2>Head</h2><p>One <b>two</b> &amp; three and a good deal more text here.</p><ul><li>a<li>b</ul><pre><code>if a &lt; b:\n    c</code></pre></body></html>"
    assert re.sub(r"\n+", "\n", markup.clean(page)) == "## Head\nOne two & three and a good deal more text here.\n- a\n- b\n```\nif a < b:\n    c\n```"
    assert "zzz" not in markup.clean(page)
    assert markup.clean("\\section{A}\n\nSo $x^2$ and \\emph{so} on ``here''.") == "# A\n\nSo x^2 and so on “here”."
    assert markup.clean("== A ==\n'''b''' [[c|d]] {{e|f}}") == "## A\nb d f"
    assert markup.clean("**a** _b_ `c`\n\n```py\n**x**\n```") == "a b c\n\n```\n**x**\n```"
    assert markup.clean("plain text stays.") == "plain text stays."


def test_markup_rows(spark, odd):
    assert [(r.doc_id, r.markup) for r in markup.markup_kinds(docs(spark, (1, "**a** b"), (2, "**a** b", "code"))).collect()] == [(1, "markdown")]
    assert markup.markup_kinds(odd).count() == 0 and markup.markup_kinds(odd.limit(0)).count() == 0


def test_pieces_find_their_kind(spark, models):
    from quern.llm import origin

    held = spark.createDataFrame([(1, "b", "a.txt", "book", None), (2, "c", "x.py", "code", "python"), (3, "c", "y", "code", None)], "doc_id long, index_name string, source string, doc_type string, language string")
    pieces = [
        (1, 1, "b", "a.txt", "**a** b"), (2, None, "b", None, "**c** d"), (3, None, "c", "x.py", "# the man looks for a friend\n"), (4, 3, "c", "y", "**a**"), (5, None, "q", None, "# file: z.py\n# the man looks for a friend\n"),
        (6, 9, "q", None, "**e** f"), (7, None, "c", "n.js", "// the man looks for a friend"), (8, None, None, None, None),
    ]
    got = origin.with_origin(spark.createDataFrame(pieces, "id long, doc_id long, index_name string, source string, text string"), held)
    want = {1: ("book", None), 2: ("book", None), 3: ("code", "python"), 4: ("code", None), 5: ("code", "python"), 6: ("book", None), 7: ("code", "javascript"), 8: ("book", None)}
    assert got.count() == 8 and {r.id: (r.doc_type, r.language) for r in got.collect()} == want
    assert {(r.id, r.text) for r in markup.markup_kinds(got, key="id", text="text").collect()} == {(1, "a b"), (2, "c d"), (6, "e f")}
    assert {(r.id, r.lang) for r in codelang.code_languages(got, models, key="id", text="text").collect()} == {(3, "en"), (5, "en"), (7, "en")}


# ---- 8


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_plan_packs_every_item_once(sizes):
    from collections import Counter

    done = packing.plan(dict(Counter(sizes)), 64)
    assert all(sum(c) <= 64 for _, c in done)
    got = Counter()
    for n, c in done:
        for s in c:
            got[s] += n
    assert got == Counter(sizes)


def test_plan_finds_exact_complements():
    assert packing.plan({50: 3, 14: 3}, 64) == [(3, (50, 14))]
    assert sorted(packing.plan({40: 2, 10: 2, 14: 2}, 64)) == [(2, (40, 14, 10))]


def test_pack(spark, odd):
    packs = spark.createDataFrame([("p", 32, "book"), ("bad", None, "book")], "pack string, capacity int, doc_type string")
    got = packing.pack(odd, packs).collect()
    assert {r.doc_id for r in got} == {2, 3, 4, 5, 6} and all(r.container is None for r in got if not r.n_tokens)
    room = {}
    for r in got:
        if r.n_tokens:
            room[r.container] = room.get(r.container, 0) + r.n_tokens
    assert max(room.values()) <= 32 and set(room) == set(range(len(room)))
    long = sorted((r.part, r.start_token, r.n_tokens) for r in got if r.doc_id == 3)
    assert all(s == p * 32 for p, s, _ in long) and len({r.part for r in got if r.doc_id == 3}) == len(long)
    assert packing.pack(odd.limit(0), packs).count() == 0


# ---- 9


def test_budgets():
    take, exponent = mixing.budgets({"a": 100, "b": 1000, "c": 0}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 2, "b": 1, "c": 5})
    assert {k: round(v) for k, v in take.items()} == {"a": 200, "b": 120} and exponent == 1
    more, exponent = mixing.budgets({"a": 100, "b": 1000}, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 2}, total=1000)
    assert abs(more["a"] - 200) < 1 and abs(sum(more.values()) - 1000) < 1e-6 and 0 < exponent < 1
    w, exponent = mixing.weights_for_entropy({"a": 1, "b": 99}, 0.5)
    assert abs(mixing.entropy(w) - 0.5) < 1e-6 and 0 < exponent < 1
    even, _ = mixing.budgets({"a": 100, "b": 300}, {"a": 0.5, "b": 0.5}, {"a": 9, "b": 9}, goal_entropy=0.65)
    assert abs(mixing.entropy({k: v / sum(even.values()) for k, v in even.items()}) - 0.65) < 1e-6


def test_mix(spark, odd):
    rows = spark.createDataFrame([(i, "big" if i % 3 else "small", "word " * (5 + i % 7)) for i in range(300)], "doc_id long, index_name string, text string")
    goals = spark.createDataFrame([("m", "big", 0.4, 1), ("m", "small", 0.6, 3), ("m", "none", 0.1, 1), ("n", "none", 1.0, 1)], "mix string, index_name string, target_share double, max_repeats int")
    selection, shares = mixing.mix(rows, goals, block_rows=20)
    got = {(r.mix, r.index_name): r for r in shares.collect()}
    assert abs(got["m", "big"].reached_share - 0.4) < 0.01 and got["m", "none"].n_tokens == 0 and got["n", "none"].reached_share == 0
    assert selection.agg({"copies": "max"}).first()[0] <= 3 and selection.count() == selection.select("mix", "doc_id").distinct().count()
    assert {r.exponent for r in got.values() if r.mix == "m"} == {1.0} and abs(got["m", "big"].entropy - mixing.entropy({"a": 0.4, "b": 0.6})) < 0.01
    steep = spark.createDataFrame([("m", "big", 0.1, 1), ("m", "small", 0.9, 2)], goals.schema)
    much = mixing.mix(rows, steep, block_rows=20, total="available")[1].collect()
    assert all(0 < r.exponent < 1 and r.most_copies <= r.max_repeats for r in much if r.n_tokens) and sum(r.n_tokens for r in much) > 0.95 * sum(r.available_tokens for r in much)
    empty, report = mixing.mix(odd.limit(0), goals)
    assert empty.count() == 0 and report.count() == 4


# ---- 10


def cut(text, **sets):
    ends = sentences.sentence_ends(text, **sets)
    return [text[a:b].strip() for a, b in zip([0, *ends], ends)]


def test_sentences():
    assert cut("Dr. Bell came at 9 p.m. and left. He ran.") == ["Dr. Bell came at 9 p.m. and left.", "He ran."]
    assert cut("It is 3.5 m long. See Fig. 4, p. 7. “Wait!” he cried. (So it was.) End") == ["It is 3.5 m long.", "See Fig. 4, p. 7.", "“Wait!” he cried.", "(So it was.)", "End"]
    assert cut("A Heading\n\nOne line\ngoes on. Two.") == ["A Heading", "One line\ngoes on.", "Two."]
    assert cut("今天下雨。他说:“好。”明天呢?") == ["今天下雨。", "他说:“好。”", "明天呢?"]
    assert cut("वह गया। डॉ. राम आए।") == ["वह गया।", "डॉ. राम आए।"]
    assert cut("ฉันไปตลาด เขากลับบ้าน") == ["ฉันไปตลาด", "เขากลับบ้าน"]
    assert cut("А. В. Белов ушёл, т. е. уехал. Всё.") == ["А. В. Белов ушёл, т. е. уехал.", "Всё."]
    assert cut("Am 3. Mai kam er. Der Mai war gut, der Rest nicht.") == ["Am 3. Mai kam er.", "Der Mai war gut, der Rest nicht."]
    long = "word " * 160
    assert cut(f"He said “{long}. And {long}. So {long}.” to us. Then he left.") == [f"He said “{long}. And {long}. So {long}.” to us.", "Then he left."]
    assert cut(f"It ({long}. And {long}.) was so. Then he left.") == [f"It ({long}. And {long}.) was so.", "Then he left."]
    assert cut("One." + " " * 90 + "Two.") == ["One.", "Two."] and cut("x" * 50 + "ing ended. Two.") == ["x" * 50 + "ing ended.", "Two."]
    assert sentences.sentence_ends("") == [] and sentences.sentence_ends("  ") == [2] and sentences.sentence_ends("One.  ") == [6]


@settings(max_examples=80, deadline=None)
@given(st.text("aB .!?\n\"(", max_size=120))
def test_ends_rise_to_the_length(text):
    ends = sentences.sentence_ends(text)
    assert ends == sorted(set(ends)) and (not text or ends[-1] == len(text))


def test_split_sentences(spark, odd):
    got = sentences.split_sentences(odd, odd).collect()
    assert {r.doc_id for r in got} == {2 + i for i in (1, 2, 3, 4, 6)} and max(r.sent_end for r in got if r.doc_id == 3) == len(PROSE) * 300
    assert sentences.split_sentences(odd.limit(0), odd).count() == 0


def test_nothing_else_imports_this_package():
    from pathlib import Path

    root = Path(sentences.__file__).parents[1]
    for p in root.rglob("*.py"):
        if p.parent.name != "llm":
            assert not re.search(r"\bllm\b", p.read_text()), p

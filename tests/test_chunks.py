import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.functions.chunks import chunk_code, chunk_text, import_block
from quern.operators import chunking

words = st.text("ab cd\n", max_size=60)


def test_packs_paragraphs_and_carries_overlap():
    a, b, c = "a" * 60, "b" * 60, "c" * 60
    assert chunk_text(f"{a}\n\n{b}\n\n{c}", 130, 10) == [f"{a}\n\n{b}", f"{'b' * 10}\n\n{c}"]
    assert chunk_text(f"{a}\n\n{b}\n\n{c}", 130, 0) == [f"{a}\n\n{b}", c]
    assert chunk_text(f"{a}\n\n{b}\n\n{c}", 130, 0, compat=True) == [f"{a}\n\n{b}", f"{a}\n\n{b}\n\n{c}"]


def test_windows_only_beyond_twice_the_size():
    assert chunk_text("x" * 200, 100, 20) == ["x" * 200]
    got = chunk_text("x" * 201, 100, 20, floor=0)
    assert [len(g) for g in got] == [100, 100, 41]
    assert [len(g) for g in chunk_text("x" * 240, 100, 20, floor=0)] == [100, 100, 80]  # the last lies within the one before


def test_floor_is_strict_and_sizes_are_checked():
    assert chunk_text("y" * 50) == [] and chunk_text("y" * 51) == ["y" * 51]
    for bad in ((100, 100), (100, 120), (100, -1)):
        with pytest.raises(ValueError):
            chunk_text("z", *bad)


@settings(max_examples=60, deadline=None)
@given(st.lists(words, max_size=12))
def test_no_word_is_lost(parts):
    text = "\n\n".join(parts)
    joined = " ".join(chunk_text(text, 40, 5, floor=0)).split()
    assert set("".join(text.split())) == set("".join(joined))


def test_code():
    small = "def f():\n    pass\n"
    assert chunk_code(small, "a.py", "python") == ["# file: a.py\n\n" + small]
    body = "\n".join(f"    x = {i}" for i in range(20))
    text = "import os\n\nLOST = 1\n\n" + "\n\n".join(f"def f{i}():\n{body}" for i in range(5))
    got = chunk_code(text, "a.py", "python", 300, 20)
    assert all(g.startswith("# file: a.py\n\nimport os\n\n") for g in got) and len(got) == 5
    assert "LOST" not in "".join(got) and "LOST" in "".join(chunk_code(text, "a.py", "python", 300, 20, keep_preamble=True))
    assert chunk_code("p\n\n" * 400, "a.xyz", None, 300, 20)[0].startswith("# file: a.xyz\n\np")


def test_import_block():
    assert import_block("\nimport a\n\n# c\nx = 1\nimport b", "python") == "\nimport a\n\n# c"
    assert import_block("import a", "cobol") == "" and import_block("import a", None) == ""


def test_null_empty_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "w " * 40, "k")], "doc_id long, full_text string, _k string")
    assert [r.doc_id for r in chunking.chunk_documents(rows).collect()] == [3]
    assert [r.doc_id for r in chunking.window_documents(rows).collect()] == [3]
    assert chunking.chunk_documents(rows.limit(0)).count() == 0

"""Every query of the engine against its SQL, over whole tables."""

import datetime
import math
import re
from pathlib import Path

import duckdb
import pytest

from quern.fixed import IMPORT_STARTS
from quern.plans.queries import ORACLE, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(names, records):
    return sorted((tuple(plain(r[n]) for n in names) for r in records), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    names = sorted(df.columns)
    cur = duck.execute(ORACLE[name])
    found = [x[0] for x in cur.description]
    assert sorted(found) == names
    assert rows(names, df.collect()) == rows(names, [dict(zip(found, r)) for r in cur.fetchall()])


def test_all_others_are_tested_below():
    assert set(QUERIES) - set(ORACLE) == {"html_to_text", "chunk_code", "import_block", "embed_chunks", "ask_in_words", "index_chunks"}


def got(spark, name, *columns):
    return [tuple(r[c] for c in columns) for r in QUERIES[name](spark, str(DATA)).collect()]


def test_html_to_text(spark, duck):
    texts = dict(duck.execute("select doc_id, full_text from documents").fetchall())
    found = dict(got(spark, "html_to_text", "doc_id", "text"))
    assert found.keys() == texts.keys()
    plain = [k for k, v in texts.items() if "<" not in v and "&" not in v]
    assert len(plain) > 50 and all(found[k] == texts[k] for k in plain)
    assert not any(re.search(r"</?(?:p|div|body|html)\b[^<>]*>", v) for v in found.values())


def test_chunk_code_covers_small_files_and_the_units_of_large_ones(spark, duck):
    files = {k: (s, t) for k, s, t in duck.execute("select doc_id, source, full_text from documents where doc_type = 'code'").fetchall()}
    found = {}
    for k, i, n, text in sorted(got(spark, "chunk_code", "doc_id", "chunk_idx", "chunk_of", "text")):
        found.setdefault(k, []).append((i, n, text))
    for k, (source, text) in files.items():
        parts = found[k]
        assert [p[0] for p in parts] == list(range(parts[0][1])) and all(p[2].startswith(f"# file: {source}\n\n") for p in parts)
        if len(text) <= 3000:
            assert [p[2] for p in parts] == [f"# file: {source}\n\n{text}"]
        else:  # what stands before the first unit may be left out, so one piece can be enough
            assert all(50 < len(p[2]) <= 6000 + len(source) + len(text) // 2 for p in parts)


def test_import_block_is_the_head_of_the_file(spark, duck):
    files = {k: (lang, t) for k, lang, t in duck.execute("select doc_id, language, full_text from documents where doc_type = 'code'").fetchall()}
    found = dict(got(spark, "import_block", "doc_id", "imports"))
    assert found.keys() == files.keys() and any(found.values())
    for k, (lang, text) in files.items():
        assert found[k] == "" or (lang in IMPORT_STARTS and text.lstrip().startswith(found[k].split("\n")[0]))


def test_embeddings_are_unit_vectors_of_their_words(spark, duck):
    texts = dict(duck.execute("select id, text from chunks").fetchall())
    found = dict(got(spark, "embed_chunks", "id", "embedding"))
    assert found.keys() == texts.keys()
    by_text = {}
    for k, v in found.items():
        assert abs(sum(x * x for x in v) - 1) < 1e-5 and by_text.setdefault(texts[k], v) == v


def test_ask_in_words(spark):
    rows = got(spark, "ask_in_words", "qid", "rank", "source", "score")
    assert rows and all(1 <= r[1] <= 3 for r in rows)
    for qid in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == qid)
        assert [r[0] for r in own] == list(range(1, len(own) + 1)) and [r[2] for r in own] == sorted((r[2] for r in own), reverse=True)


def test_index_chunks(spark, duck):
    new = {r[0] for r in duck.execute(ORACLE["index_outcome"].split(" select index_name, count(*) filter")[0] + " select doc_id from w where reason = 'new'").fetchall()}
    rows = got(spark, "index_chunks", "doc_id", "source", "chunk_idx", "chunk_of", "text")
    assert {r[0] for r in rows if r[0] is not None} <= new and all(r[1] == "__project_summary__" for r in rows if r[0] is None)

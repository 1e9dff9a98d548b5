"""The engine's queries over the driver's tables, each with the SQL it is compared with.

Every query runs over its whole tables.  A query that the engine answers for one document, chunk or vector at a time is
asked here for all of them at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixed import CODE_EXTENSIONS, CODE_NAMES, LANGUAGES, READERS
from ..functions import text as T
from ..functions.vectors import l2_normalize
from ..operators import chunking, dedup, navigation, search, vector

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_EXT = r"regexp_extract(regexp_extract(source, '[^/]*$'), '[^.].*?(\.[^.]*)$', 1)"
_STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_CASE = lambda table, value: "case " + value + " " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + " else '' end"


# ---- files and scans ------------------------------------------------------------------------------------------------


@query(f"select doc_id, source from documents where {_EXT} in ({_list(CODE_EXTENSIONS)}) or regexp_extract(source, '[^/]*$') in ({_list(CODE_NAMES)})")
def code_file_filter(spark, d):
    return t(spark, d, "documents").where(T.is_code_file(F.col("source"))).select("doc_id", "source")


@query(f"select doc_id, {_CASE(READERS, f'lower({_EXT})')} as reader from documents")
def route_extractor(spark, d):
    return t(spark, d, "documents").select("doc_id", T.reader_of(F.col("source")).alias("reader"))


@query(f"select doc_id, {_CASE(LANGUAGES, _EXT)} as detected from documents")
def detect_language(spark, d):
    return t(spark, d, "documents").select("doc_id", T.detect_language(F.col("source")).alias("detected"))


@query(r"select doc_id, regexp_extract(source, '[^/]*$') as base, case when contains(source, '/') then regexp_replace(source, '/[^/]*$', '') else '' end as folder from documents")
def path_parts(spark, d):
    folder = F.when(F.col("source").contains("/"), F.regexp_replace("source", "/[^/]*$", "")).otherwise("")
    return t(spark, d, "documents").select("doc_id", T.basename(F.col("source")).alias("base"), folder.alias("folder"))


@query(r"select doc_id, regexp_replace(source, '\.[^.]*$', '') as stem from documents")
def source_stem(spark, d):
    return t(spark, d, "documents").select("doc_id", T.stem(F.col("source")).alias("stem"))


@query("select doc_id, index_name, source, full_text, doc_type, language, ocr from documents where regexp_matches(full_text, '[^\\s]')")
def scan_documents(spark, d):
    return t(spark, d, "documents").where(T.nonblank(F.col("full_text"))).select("doc_id", "index_name", "source", "full_text", "doc_type", "language", "ocr")


@query("select id, doc_id, source, text, chunk_idx, chunk_of, ocr from chunks")
def scan_chunks(spark, d):
    return t(spark, d, "chunks").select("id", "doc_id", "source", "text", "chunk_idx", "chunk_of", "ocr")


@query("select distinct hash, filename from hashes")
def scan_hashes(spark, d):
    return t(spark, d, "hashes").select("hash", "filename").distinct()


@query("select doc_id from documents where regexp_matches(full_text, '[^\\s]')")
def nonblank(spark, d):
    return t(spark, d, "documents").where(T.nonblank(F.col("full_text"))).select("doc_id")


@query()
def html_to_text(spark, d):
    from ..sources.extract import html_documents

    return html_documents(t(spark, d, "documents"), key="doc_id", text="full_text")


# ---- text -----------------------------------------------------------------------------------------------------------

_MESSY = "concat('a', chr(13), chr(10), full_text, ' ', chr(9), chr(10), repeat(chr(10), 5), chr(7), chr(13), 'b')"


@query(
    r"select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + _MESSY + r", '\r\n?', chr(10), 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), "
    r"'\n{4,}', repeat(chr(10), 3), 'g'), '[ \t]+\n', chr(10), 'g') as clean from documents"
)
def sanitize(spark, d):
    messy = F.concat(F.lit("a\r\n"), "full_text", F.lit(" \t\n" + "\n" * 5 + "\x07\rb"))
    return t(spark, d, "documents").select("doc_id", T.sanitize(messy).alias("clean"))


@query("select id, substring(text, 1, 3000) as hit_text, substring(text, 1, 1500) as context_text from chunks")
def truncate_text(spark, d):
    return t(spark, d, "chunks").select("id", T.truncated(F.col("text"), 3000).alias("hit_text"), T.truncated(F.col("text"), 1500).alias("context_text"))


@query(
    "with p as (select doc_id, list_filter(list_transform(regexp_split_to_array(full_text, '\\n\\s*\\n'), lambda x: " + _STRIP.format("x") + "), lambda x: x <> '') ps from documents) "
    "select doc_id, unnest(range(1, len(ps) + 1))::int - 1 as pos, unnest(ps) as paragraph from p"
)
def split_paragraphs(spark, d):
    return t(spark, d, "documents").select("doc_id", F.posexplode(chunking.split_paragraphs(F.col("full_text"))).alias("pos", "paragraph"))


# ---- chunking -------------------------------------------------------------------------------------------------------


@query(
    "with w as (select doc_id, 0 o, full_text c from documents where length(full_text) <= 3000 union all "
    "select doc_id, o, " + _STRIP.format("substring(full_text, (o + 1)::int, 1500)") + " from (select doc_id, full_text, unnest(range(0, length(full_text), 1300)) o from documents where length(full_text) > 3000)) "
    "select doc_id, (row_number() over (partition by doc_id order by o) - 1)::int as chunk_idx, (count(*) over (partition by doc_id))::int as chunk_of, c as text from w where length(c) > 50"
)
def window_chunks(spark, d):
    return chunking.window_documents(t(spark, d, "documents"))


@query(
    "with recursive par as (select doc_id, list_filter(list_transform(regexp_split_to_array(full_text, '\\n\\s*\\n'), lambda x: " + _STRIP.format("x") + "), lambda x: x <> '') ps from documents where doc_type = 'book'), "
    "f as (select doc_id, 1 i, ''::varchar cur, null::varchar emitted from par union all "
    "select f.doc_id, i + 1, case when i > len(ps) then '' when cur <> '' and length(cur) + length(ps[i]) + 2 > 1500 then "
    "case when length(cur) > 200 then right(cur, 200) || chr(10) || chr(10) || ps[i] else ps[i] end when cur = '' then ps[i] else cur || chr(10) || chr(10) || ps[i] end, "
    "case when i > len(ps) then cur when cur <> '' and length(cur) + length(ps[i]) + 2 > 1500 then cur end from f join par using (doc_id) where i <= len(ps) + 1), "
    "e as (select doc_id, i, " + _STRIP.format("emitted") + " c from f where emitted is not null and emitted <> ''), "
    "w as (select doc_id, i, 0 o, c from e where length(c) <= 3000 union all select doc_id, i, o, " + _STRIP.format("substring(c, (o + 1)::int, 1500)") + " from (select doc_id, i, c, unnest(range(0, length(c), 1300)) o from e where length(c) > 3000)) "
    "select doc_id, (row_number() over (partition by doc_id order by i, o) - 1)::int as chunk_idx, (count(*) over (partition by doc_id))::int as chunk_of, c as text from w where length(c) > 50"
)
def chunk_documents(spark, d):
    return chunking.chunk_documents(t(spark, d, "documents").where("doc_type = 'book'"))


@query()
def chunk_code(spark, d):
    return chunking.chunk_code_files(t(spark, d, "documents").where("doc_type = 'code'"))


@query()
def import_block(spark, d):
    return chunking.import_blocks(t(spark, d, "documents").where("doc_type = 'code'"))


@query(
    "with f as (select distinct index_name, source, case when len(string_split(source, '/')) <= 3 then source else array_to_string(string_split(source, '/')[1:3], '/') || '/...' end entry "
    "from documents where doc_type = 'code' and source <> '__project_summary__'), "
    "e as (select index_name, entry, min(source) fst, count(*) n from f group by all), r as (select *, row_number() over (partition by index_name order by fst) i from e), "
    "g as (select index_name, string_agg(entry, chr(10) order by i) filter (i <= 200) tree, sum(n)::bigint n_files from r group by 1) "
    "select index_name, '# Project: ' || index_name || chr(10) || chr(10) || '## File tree (' || n_files || ' files)' || chr(10) || tree as summary, n_files from g"
)
def project_tree(spark, d):
    return chunking.project_summary(t(spark, d, "documents").where("doc_type = 'code' and source <> '__project_summary__'"))


@query("select id, text from chunks where length(text) > 50")
def min_chunk_filter(spark, d):
    return t(spark, d, "chunks").where(F.length("text") > 50).select("id", "text")


# ---- vectors --------------------------------------------------------------------------------------------------------

_USABLE = "from vec_index where embedding is not null and len(embedding) > 0"
_SCORED = (
    'with v as (select "rowid" id, embedding::double[] e {u}), q as (select id qid, e qe from v where id % 20 = 0{z}), '
    "s as (select qid, id, round({score}, 9) raw from v, q{w}), r as (select *, row_number() over (partition by qid order by raw desc, id) rank from s) "
)
_IP = _SCORED.format(u=_USABLE, z="", score="list_inner_product(e, qe)", w="")
_LIVE = "list_inner_product(e, e) > 0"
_COS = _SCORED.format(u=_USABLE, z=f" and {_LIVE}", score="(1 + list_cosine_similarity(e, qe)) / 2", w=f" where {_LIVE}")


def _vectors(spark, d) -> DataFrame:
    return t(spark, d, "vec_index").select(F.col("rowid").alias("id"), "embedding")


def _asked(vectors: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 20."""
    return vectors.where("id % 20 = 0").select(F.col("id").alias("qid"), "embedding")


def _hits(spark, d, k: int, mode: str = "ip") -> DataFrame:
    v = _vectors(spark, d)
    return vector.top_k(_asked(v), v, k, mode=mode)


def _score():
    return F.round("raw", 6).alias("score")


@query(_IP.replace(" where id % 20 = 0", "") + "select qid, id, round(raw, 6) as score, rank from r where rank <= 5")
def knn_ip(spark, d):
    v = _vectors(spark, d)
    return vector.top_k(v.withColumnRenamed("id", "qid"), v, 5).select("qid", "id", _score(), "rank")


@query(_COS + "select qid, id, round(raw, 6) as score, rank from r where rank <= 5")
def knn_cosine(spark, d):
    return _hits(spark, d, 5, "cosine").select("qid", "id", _score(), "rank")


_BATCH = _IP + "select qid, id, round(raw, 6) as score, rank from r where rank <= 20"


@query(_BATCH)
def knn_batch(spark, d):
    return _hits(spark, d, 20).select("qid", "id", _score(), "rank")


@query(_IP + "select qid, h.id, c.source, c.chunk_idx, round(raw, 6) as score, rank from r h join chunks c on c.id = h.id where rank <= 5")
def knn_chunks(spark, d):
    chunks = t(spark, d, "chunks").select("id", "source", "chunk_idx")
    return _hits(spark, d, 5).join(chunks, "id").select("qid", "id", "source", "chunk_idx", _score(), "rank")


@query(
    _IP + ", f as (select qid, h.id, raw, source from r h join chunks c on c.id = h.id where rank <= 50 and contains(coalesce(source, ''), '.py')) "
    "select qid, id, source, round(raw, 6) as score, rank from (select *, row_number() over (partition by qid order by raw desc, id) rank from f) where rank <= 5"
)
def knn_overfetch(spark, d):
    hits = _hits(spark, d, 50).join(t(spark, d, "chunks").select("id", "source"), "id")
    return vector.overfetch(hits, F.col("source").contains(".py"), 5).select("qid", "id", "source", _score(), "rank")


@query(
    _SCORED.format(u=_USABLE, z="", score="list_inner_product(e, qe)", w=" where id in (select id from chunks where contains(source, '.py'))")
    + "select qid, id, round(raw, 6) as score, rank from r where rank <= 5"
)
def knn_prefilter(spark, d):
    v = _vectors(spark, d)
    kept = v.join(t(spark, d, "chunks").where(F.col("source").contains(".py")).select("id"), "id", "left_semi")
    return vector.top_k(_asked(v), kept, 5).select("qid", "id", _score(), "rank")


@query(
    'with v as (select "rowid" id, embedding::double[] e ' + _USABLE + "), n as (select id, e, sqrt(list_inner_product(e, e)) m from v) "
    "select id, i::int as pos, round(e[i + 1] / case when m = 0 then 1 else m end, 6) as x from n, unnest(range(0, len(e))) u(i)"
)
def vec_l2_normalize(spark, d):
    v = _vectors(spark, d).where("embedding is not null")
    return v.select("id", F.posexplode(l2_normalize(F.col("embedding"))).alias("pos", "x")).withColumn("x", F.round("x", 6))


@query()
def embed_chunks(spark, d):
    from ..operators.embed import HashingEmbedder, embed

    return embed(t(spark, d, "chunks"), HashingEmbedder(64), key="id", text="text")


# ---- search results -------------------------------------------------------------------------------------------------


@query(
    _IP + "select qid, rank, round(raw, 3) as score, coalesce(source, '') as source, (chunk_idx + 1) || '/' || chunk_of as place, substring(text, 1, 3000) as text, coalesce(ocr, false) as ocr "
    "from r h join chunks c on c.id = h.id where rank <= 5 and chunk_idx is not null and chunk_of is not null"
)
def format_hits(spark, d):
    c = t(spark, d, "chunks").where("chunk_idx is not null and chunk_of is not null")
    place = F.concat((F.col("chunk_idx") + 1).cast("string"), F.lit("/"), F.col("chunk_of").cast("string"))
    return _hits(spark, d, 5).join(c, "id").select(
        "qid", "rank", F.round("raw", 3).alias("score"), F.coalesce("source", F.lit("")).alias("source"), place.alias("place"), T.truncated(F.col("text"), 3000).alias("text"), F.coalesce("ocr", F.lit(False)).alias("ocr")
    )


@query(
    _IP + "select qid, array_to_string(list_sort(list(distinct source)), ', ') as sources from r h join chunks c on c.id = h.id where rank <= 5 and source is not null group by 1"
)
def result_sources(spark, d):
    c = t(spark, d, "chunks").where("source is not null").select("id", "source")
    return _hits(spark, d, 5).join(c, "id").groupBy("qid").agg(F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"))


@query(
    _IP + "select qid, string_agg('[' || rank || '] ' || coalesce(source, '?') || chr(10) || substring(text, 1, 3000), chr(10) || chr(10) order by rank) as body from r h join chunks c on c.id = h.id where rank <= 5 group by 1"
)
def render_results(spark, d):
    c = t(spark, d, "chunks").select("id", "source", "text")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("source", F.lit("?")), F.lit("\n"), T.truncated(F.col("text"), 3000))
    rows = _hits(spark, d, 5).join(c, "id").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("b")))).alias("_r"))
    return rows.select("qid", F.array_join(F.transform("_r", lambda x: x["b"]), "\n\n").alias("body"))


@query(
    _IP + "select qid, h.id as hit, n.id as neighbour, n.chunk_idx from r h join chunks c on c.id = h.id join chunks n on n.doc_id = c.doc_id and n.chunk_idx between c.chunk_idx - 1 and c.chunk_idx + 1 and n.id <> c.id where rank <= 5"
)
def search_context(spark, d):
    chunks = t(spark, d, "chunks")
    hits = _hits(spark, d, 5).select("qid", "id")
    near = navigation.neighbours(hits.select("id").distinct().join(chunks, "id"), chunks, 1).where("not is_hit")
    return hits.join(near.select(F.col("hit_id").alias("id"), F.col("id").alias("neighbour"), "chunk_idx"), "id").select("qid", F.col("id").alias("hit"), "neighbour", "chunk_idx")


@query(
    r"with n as (select distinct source, lower(regexp_replace(source, '\.[^.]*$', '')) l from documents where source is not null), "
    r"w as (select source, l, string_split(trim(regexp_replace(l, '\s+', ' ', 'g')), ' ') w from n), "
    "k as (select source, l as run from w union select source, array_to_string(w[i:j], ' ') from w, unnest(range(1, len(w) + 1)) a(i), unnest(range(1, len(w) + 1)) b(j) where j >= i and len(w) >= 3), "
    "m as (select run, min(source) source from k where length(run) >= 8 group by 1), q as (select distinct filename qid, lower('What does ' || filename || ' say of the vault?') t from hashes where filename is not null), "
    "h as (select qid, source, length(run) n from q, m where contains(t, run)) select qid, source from h qualify row_number() over (partition by qid order by n desc, source) = 1"
)
def auto_source(spark, d):
    asked = t(spark, d, "hashes").where("filename is not null").select(F.col("filename").alias("qid")).distinct()
    asked = asked.withColumn("text", F.concat(F.lit("What does "), "qid", F.lit(" say of the vault?")))
    return navigation.detect_source(asked, t(spark, d, "documents").where("source is not null"))


# ---- navigation -----------------------------------------------------------------------------------------------------


@query(
    "with a as (select distinct filename asked from hashes where filename is not null), e as (select asked, source, full_text from a join documents on source = asked), "
    "o as (select asked from a where asked not in (select asked from e)), n as (select distinct source from documents where source is not null), "
    "l as (select asked, source from o join n on contains(source, asked) where asked <> '' qualify row_number() over (partition by asked order by source) <= 10) "
    "select asked, true as found, source, length(full_text) as n_chars from e union all select o.asked, false, l.source, null from o left join l using (asked)"
)
def get_document(spark, d):
    """Every name in the hashes, a path or only a base name, asked for as a document."""
    asked = t(spark, d, "hashes").select(F.col("filename").alias("asked"))
    return navigation.documents_by_source(asked, t(spark, d, "documents")).select("asked", "found", "source", F.length("text").cast("long").alias("n_chars"))


@query(
    "with n as (select index_name, source, sum(coalesce(c, 0))::bigint n_chunks from documents left join (select doc_id, count(*) c from chunks group by 1) using (doc_id) where source is not null group by all) "
    "select index_name, total, n, source, n_chunks from (select *, count(*) over (partition by index_name) total, row_number() over (partition by index_name order by source) n from n) where n <= 50"
)
def listing(spark, d):
    return navigation.listing(t(spark, d, "documents"), t(spark, d, "chunks"))


@query(
    "with n as (select index_name, source, sum(coalesce(c, 0))::bigint n_chunks from documents left join (select doc_id, count(*) c from chunks group by 1) using (doc_id) where contains(lower(source), 'tower') group by all) "
    "select *, count(*) over (partition by index_name) total, row_number() over (partition by index_name order by source) n from n"
)
def listing_containing(spark, d):
    return navigation.listing(t(spark, d, "documents"), t(spark, d, "chunks"), containing="Tower")


@query("select d.doc_id, d.index_name, d.source, d.doc_type, d.language, d.ocr, count(c.id) as n_chunks from documents d left join chunks c on c.doc_id = d.doc_id group by all")
def list_documents(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "index_name", "source", "doc_type", "language", "ocr")
    counts = t(spark, d, "chunks").where("doc_id is not null").groupBy("doc_id").agg(F.count("id").alias("n_chunks"))
    return docs.join(counts, "doc_id", "left").fillna(0, ["n_chunks"])


@query("select id, coalesce(c.source, d.source, '') as source, coalesce(c.ocr, d.ocr, false) as ocr, c.text from chunks c left join documents d on c.doc_id = d.doc_id")
def chunks_with_source(spark, d):
    return navigation.with_documents(t(spark, d, "chunks"), t(spark, d, "documents")).select("id", "source", "ocr", "text")


@query("select c.id, d.doc_id, d.source, length(d.full_text) as n_chars from chunks c join documents d on c.doc_id = d.doc_id")
def document_by_chunk(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "source", F.length("full_text").cast("long").alias("n_chars"))
    return t(spark, d, "chunks").select("id", "doc_id").join(docs, "doc_id").select("id", "doc_id", "source", "n_chars")


@query("select d.doc_id, c.id, c.chunk_idx, c.text from documents d join chunks c on (c.doc_id = d.doc_id) or (c.doc_id is null and c.index_name = d.index_name and c.source = d.source)")
def document_chunks(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "index_name", "source")
    chunks = t(spark, d, "chunks").select("id", F.col("doc_id").alias("_d"), "index_name", "source", "chunk_idx", "text")
    by_id = chunks.where("_d is not null").join(docs.select(F.col("doc_id").alias("_d")), "_d").withColumnRenamed("_d", "doc_id")
    by_name = chunks.where("_d is null").join(docs, ["index_name", "source"])
    cols = ["doc_id", "id", "chunk_idx", "text"]
    return by_id.select(cols).unionByName(by_name.select(cols))


@query("select h.id as hit_id, c.id, c.chunk_idx, (h.id = c.id) as is_hit from chunks h join chunks c on c.doc_id = h.doc_id and c.chunk_idx between h.chunk_idx - 1 and h.chunk_idx + 1")
def adjacent_chunks(spark, d):
    chunks = t(spark, d, "chunks")
    return navigation.neighbours(chunks, chunks, 1)


@query(
    "select id, doc_id, string_agg(text, '|' ) over (partition by doc_id order by chunk_idx, id rows between 1 preceding and 1 following) as around from chunks where doc_id is not null"
)
def context_window(spark, d):
    w = Window.partitionBy("doc_id").orderBy("chunk_idx", "id").rowsBetween(-1, 1)
    return t(spark, d, "chunks").where("doc_id is not null").select("id", "doc_id", F.array_join(F.collect_list("text").over(w), "|").alias("around"))


_NTH = (
    "with p as (select doc_id, id, text, (row_number() over (partition by doc_id order by chunk_idx, id) - 1)::int pos, count(*) over (partition by doc_id) total from chunks where doc_id is not null), "
    "k as (select distinct doc_id, total from p) select k.doc_id, {n} as n, p.id, p.pos, k.total, coalesce(p.pos = {n}, false) as is_hit, p.text from k left join p on p.doc_id = k.doc_id and {n} < k.total and p.pos between {n} - {c} and {n} + {c}"
)


@query(_NTH.format(n=1, c=0))
def get_chunk(spark, d):
    """The second chunk of every document, and the number of chunks of those that have no second one."""
    chunks = t(spark, d, "chunks")
    return navigation.nth_chunk(chunks.select("doc_id", F.lit(1).alias("n")), chunks)


@query(_NTH.format(n=3, c=2))
def chunk_context(spark, d):
    """The fourth chunk of every document with two on either side."""
    chunks = t(spark, d, "chunks")
    return navigation.nth_chunk(chunks.select("doc_id", F.lit(3).alias("n")), chunks, context=2)


@query(
    "with p as (select doc_id, text, row_number() over (partition by doc_id order by chunk_idx, id) - 1 pos, count(*) over (partition by doc_id) n from chunks where doc_id is not null) "
    "select doc_id, string_agg(text, chr(10) || chr(10) order by pos) as text, count(*)::int as n, greatest(n - 12, 0) as remaining from p where pos between 2 and 11 group by doc_id, p.n"
)
def read_range(spark, d):
    chunks = t(spark, d, "chunks").where("doc_id is not null")
    return navigation.read_range(chunks, by=["doc_id"], order=["chunk_idx", "id"], start=2, count=10)


@query("select id, source from chunks where contains(source, 'tower')")
def source_filter(spark, d):
    return t(spark, d, "chunks").where(F.col("source").contains("tower")).select("id", "source")


@query("select distinct filename as source from hashes where contains(lower(filename), 'tower')")
def sources_filter_ci(spark, d):
    return t(spark, d, "hashes").where(F.lower("filename").contains("tower")).select(F.col("filename").alias("source")).distinct()


@query("select index_name, source from (select distinct index_name, source from documents where source is not null) qualify row_number() over (partition by index_name order by source) <= 50")
def sources_first50(spark, d):
    names = t(spark, d, "documents").where("source is not null").select("index_name", "source").distinct()
    first = F.row_number().over(Window.partitionBy("index_name").orderBy("source"))
    return names.withColumn("_n", first).where("_n <= 50").drop("_n")


@query("select distinct source from documents where contains(lower(source), 'lighthouse') order by source limit 10")
def suggest_sources(spark, d):
    return t(spark, d, "documents").where(F.lower("source").contains("lighthouse")).select("source").distinct().orderBy("source").limit(10)


# ---- aggregates -----------------------------------------------------------------------------------------------------


@query("select index_name, source, count(*) as n from chunks group by all")
def chunks_per_source(spark, d):
    return t(spark, d, "chunks").groupBy("index_name", "source").agg(F.count("*").alias("n"))


@query("select index_name, count(distinct source) as n_sources from chunks where source <> '' group by 1")
def count_sources(spark, d):
    return t(spark, d, "chunks").where("source <> ''").groupBy("index_name").agg(F.countDistinct("source").alias("n_sources"))


@query("select index_name, count(*) as n_chunks, count(distinct source) as n_files from chunks group by 1")
def index_meta_counts(spark, d):
    return t(spark, d, "chunks").groupBy("index_name").agg(F.count("*").alias("n_chunks"), F.countDistinct("source").alias("n_files"))


@query("select index_name, max(len(embedding)) as dim, count(*) as total, count(embedding) as usable from vec_index group by 1")
def index_stats(spark, d):
    v = t(spark, d, "vec_index").groupBy("index_name")
    return v.agg(F.max(F.size(F.col("embedding"))).cast("long").alias("dim"), F.count("*").alias("total"), F.count("embedding").alias("usable"))


@query(
    "select m.index_name, coalesce(storage_backend, 'faiss') as storage, coalesce(embedding_backend, 'local') as backend, coalesce(embedding_model, 'all-MiniLM-L6-v2') as model, count(c.id) as n_chunks "
    "from index_meta m left join chunks c using (index_name) group by all"
)
def index_catalog(spark, d):
    m = t(spark, d, "index_meta").select(
        "index_name", F.coalesce("storage_backend", F.lit("faiss")).alias("storage"), F.coalesce("embedding_backend", F.lit("local")).alias("backend"), F.coalesce("embedding_model", F.lit("all-MiniLM-L6-v2")).alias("model")
    )
    n = t(spark, d, "chunks").groupBy("index_name").agg(F.count("id").alias("n_chunks"))
    return m.join(n, "index_name", "left").fillna(0, ["n_chunks"])


@query("select index_name, 'local' as place from (select distinct index_name from documents) union all select index_name, 'registered' from index_meta where index_name not in (select index_name from documents where index_name is not null)")
def index_names(spark, d):
    here = t(spark, d, "documents").select("index_name").distinct()
    other = t(spark, d, "index_meta").select("index_name").join(here, "index_name", "left_anti")
    return here.withColumn("place", F.lit("local")).unionByName(other.withColumn("place", F.lit("registered")))


# ---- dedup ----------------------------------------------------------------------------------------------------------


@query("select doc_id, sha256(full_text) as hash from documents")
def content_hash(spark, d):
    return t(spark, d, "documents").select("doc_id", dedup.content_hash(F.col("full_text")).alias("hash"))


@query("select doc_id, sha256(full_text) as hash from documents qualify row_number() over (partition by sha256(full_text) order by source, doc_id) = 1")
def dedup_in_batch(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "source", dedup.content_hash(F.col("full_text")).alias("hash"))
    return dedup.first_of(docs, ["hash"], ["source", "doc_id"]).select("doc_id", "hash")


@query("select doc_id from documents where sha256(full_text) not in (select hash from hashes)")
def dedup_against_index(spark, d):
    docs = t(spark, d, "documents").select("doc_id", dedup.content_hash(F.col("full_text")).alias("hash"))
    return docs.join(t(spark, d, "hashes").select("hash"), "hash", "left_anti").select("doc_id")


_REASONS = (
    "with f as (select doc_id, index_name, source, sha256(full_text) hash from documents), "
    "m as (select *, case when exists (select 1 from hashes s where s.index_name = f.index_name and s.hash = f.hash and s.seen_at < timestamptz '2024-07-01') then 'stored hash' "
    "when exists (select 1 from hashes s where s.index_name = f.index_name and s.filename = f.source and s.seen_at < timestamptz '2024-07-01') then 'stored name' end r from f) "
    "select doc_id, coalesce(r, case when row_number() over (partition by index_name, hash, r order by source, doc_id) = 1 then 'new' else 'batch duplicate' end) as reason from m"
)


@query(_REASONS)
def dedup_reasons(spark, d):
    files = t(spark, d, "documents").select("doc_id", "index_name", "source", dedup.content_hash(F.col("full_text")).alias("hash"))
    stored = t(spark, d, "hashes").where("seen_at < timestamp '2024-07-01 00:00:00'")
    return dedup.dedup_reasons(files, stored, group="index_name", path="source", hash="hash", order=["source", "doc_id"]).select("doc_id", "reason")


@query(
    "with f as (select doc_id, index_name, source, regexp_extract(source, '[^/]*$') base, sha256(full_text) hash from documents), "
    "p as (select *, row_number() over (partition by index_name, source order by doc_id) pn, row_number() over (partition by index_name, hash order by doc_id) hn from f) "
    "select doc_id, case when pn > 1 then 'path' when hn > 1 then 'queue hash' when exists (select 1 from hashes s where s.index_name = p.index_name and s.hash = p.hash) then 'index hash' "
    "when exists (select 1 from hashes s where s.index_name = p.index_name and s.filename = p.base) then 'filename' else 'accepted' end as verdict from p"
)
def dedup_queue(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "index_name", "source", T.basename(F.col("source")).alias("base"), dedup.content_hash(F.col("full_text")).alias("hash"))
    by_path = docs.groupBy("index_name", "source").agg(F.min("doc_id").alias("_p"))
    by_hash = docs.groupBy("index_name", "hash").agg(F.min("doc_id").alias("_h"))
    stored = t(spark, d, "hashes")
    kept = stored.select("index_name", "hash").distinct().withColumn("_s", F.lit(True))
    names = stored.select("index_name", F.col("filename").alias("base")).distinct().withColumn("_n", F.lit(True))
    rows = docs.join(by_path, ["index_name", "source"]).join(by_hash, ["index_name", "hash"]).join(kept, ["index_name", "hash"], "left").join(names, ["index_name", "base"], "left")
    verdict = F.when(F.col("doc_id") > F.col("_p"), "path").when(F.col("doc_id") > F.col("_h"), "queue hash").when(F.col("_s"), "index hash").when(F.col("_n"), "filename").otherwise("accepted")
    return rows.select("doc_id", verdict.alias("verdict"))


@query("select hash, max_by(filename, (seen_at, filename)) as filename from hashes group by 1")
def hash_merge_last(spark, d):
    return dedup.merge_hashes(t(spark, d, "hashes"), order=["seen_at", "filename"], last=True)


@query("select hash, min_by(filename, (seen_at, filename)) as filename from hashes group by 1")
def hash_merge_first(spark, d):
    return dedup.merge_hashes(t(spark, d, "hashes"), order=["seen_at", "filename"], last=False)


@query("select id, source from chunks c where source is not null and not exists (select 1 from documents d where d.index_name = c.index_name and d.source = c.source and d.doc_type = 'book')")
def new_source_chunks(spark, d):
    known = t(spark, d, "documents").where("doc_type = 'book'").select("index_name", "source")
    return t(spark, d, "chunks").where("source is not null").join(known, ["index_name", "source"], "left_anti").select("id", "source")


# ---- writing --------------------------------------------------------------------------------------------------------


@query("with d as (select index_name, source, min(doc_id) nid from documents group by all) select c.id, d.nid as doc_id from chunks c left join d using (index_name, source)")
def assign_doc_id(spark, d):
    docs = t(spark, d, "documents").groupBy("index_name", "source").agg(F.min("doc_id").alias("_n"))
    return t(spark, d, "chunks").select("id", "index_name", "source").join(docs, ["index_name", "source"], "left").select("id", F.col("_n").alias("doc_id"))


@query(
    "with n as (select doc_id, unnest(range(0, (length(full_text) + 1499) // 1500))::int i from documents) "
    "select doc_id, i as chunk_idx, (select coalesce(max(id), -1) from chunks) + row_number() over (order by doc_id, i) as id from n"
)
def append_ids(spark, d):
    from ..operators.store import dense_ids

    pieces = t(spark, d, "documents").select("doc_id", F.ceil(F.length("full_text") / 1500).cast("int").alias("_n")).where("_n > 0")
    base = t(spark, d, "chunks").agg(F.coalesce(F.max("id"), F.lit(-1)) + 1).first()[0]
    return dense_ids(pieces, "doc_id", "_n", base).select("doc_id", F.posexplode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("chunk_idx", "_i"), "_first").select("doc_id", "chunk_idx", (F.col("_first") + F.col("chunk_idx")).alias("id"))


_LATE = "timestamptz '2023-01-06'"


@query(
    f"with o as (select index_name, source from documents where source is not null and indexed_at < {_LATE}) "
    f"select doc_id, source from documents d where source is not null and indexed_at >= {_LATE} and not exists (select 1 from o where o.index_name = d.index_name and o.source = d.source) "
    "qualify row_number() over (partition by index_name, source order by doc_id) = 1"
)
def append_documents_ignore(spark, d):
    """Documents of the later half appended to those before: a known source is ignored, of a repeated one the first counts."""
    from ..operators.store import ignore_known

    docs = t(spark, d, "documents").where("source is not null").select("index_name", "source", "doc_id", "indexed_at")
    late = F.col("indexed_at") >= F.lit("2023-01-06 00:00:00").cast("timestamp")
    return ignore_known(docs.where(late), docs.where(~late), ["index_name", "source"], ["doc_id"]).select("doc_id", "source")


@query(
    "with s as (select distinct index_name, source from documents where contains(source, 'tower')), g as (select doc_id from documents join s using (index_name, source)), "
    "a as (select 'documents' kind, index_name, (index_name, source) in (select (index_name, source) from s) gone from documents union all "
    "select 'chunks', index_name, coalesce((index_name, source) in (select (index_name, source) from s), false) or coalesce(doc_id in (select doc_id from g), false) from chunks union all "
    "select 'hashes', index_name, coalesce((index_name, filename) in (select (index_name, source) from s), false) from hashes) "
    "select kind, index_name, count(*) filter (gone) as removed, count(*) filter (not gone) as kept from a group by all"
)
def remove_source_counts(spark, d):
    """What goes and what stays when every source with 'tower' in its name is removed."""
    from ..operators.store import split_by_source

    docs, chunks, hashes = (t(spark, d, x) for x in ("documents", "chunks", "hashes"))
    sources, on = docs.where(F.col("source").contains("tower")).select("index_name", "source"), ["index_name"]
    parts = {
        "documents": split_by_source(docs.select("doc_id", "index_name", "source"), sources, on=on),
        "chunks": split_by_source(chunks.select("doc_id", "index_name", "source"), sources, on=on, documents=docs),
        "hashes": split_by_source(hashes.select("index_name", "filename"), sources, on=on, column="filename"),
    }
    rows = [df.select(F.lit(kind).alias("kind"), "index_name", "gone") for kind, df in parts.items()]
    whole = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return whole.groupBy("kind", "index_name").agg(F.count(F.when(F.col("gone"), 1)).alias("removed"), F.count(F.when(~F.col("gone"), 1)).alias("kept"))


@query("select id, coalesce(c.source, d.source, '') as source from chunks c left join documents d on c.doc_id = d.doc_id")
def migrate_source(spark, d):
    from ..operators.store import add_source

    old = t(spark, d, "chunks")
    filled = add_source(old.drop("source"), t(spark, d, "documents")).select("id", F.col("source").alias("_f"))
    return old.select("id", "source").join(filled, "id").select("id", F.coalesce("source", "_f").alias("source"))


@query("select doc_id, sha256(full_text) as sha256, strlen(full_text) as size from documents")
def integrity_hash(spark, d):
    return t(spark, d, "documents").select("doc_id", dedup.content_hash(F.col("full_text")).alias("sha256"), F.octet_length("full_text").cast("long").alias("size"))


@query(
    "with a as (select distinct index_name, fname, sha256, size, suppressed from integrity), b as (select i.index_name, i.fname, i.suppressed, i.sha256 is null as no_hash, i.size, m.index_name is null as gone from a i left join index_meta m using (index_name)) "
    "select index_name, fname, case when suppressed then 'suppressed' when gone then 'MISSING' when no_hash then 'untracked' else 'ok' end as state from b"
)
def integrity_diff(spark, d):
    from ..operators.integrity import states

    known = t(spark, d, "index_meta").select("index_name")
    return states(t(spark, d, "integrity"), known)


@query(
    "with r as (select index_name, filename fname, max_by(hash, (seen_at, hash)) was from hashes where filename is not null group by all), f as (select index_name, source fname, min_by(sha256(full_text), doc_id) now from documents where source is not null group by all) "
    "select index_name, fname, case when r.fname is null then 'UNTRACKED_FILE' when f.fname is null then 'MISSING' when was is null then 'untracked' when was = now then 'ok' else 'mismatch' end as state "
    "from (select *, true from r) r full join (select *, true from f) f using (index_name, fname)"
)
def integrity_compare(spark, d):
    """Stored hashes, the latest of each name, against the texts there are."""
    from ..operators.integrity import compare

    on = ["index_name", "fname"]
    was = t(spark, d, "hashes").where("filename is not null").groupBy("index_name", F.col("filename").alias("fname")).agg(F.max_by("hash", F.struct("seen_at", "hash")).alias("sha256"))
    docs = t(spark, d, "documents").where("source is not null").withColumn("_h", dedup.content_hash(F.col("full_text")))
    now = docs.groupBy("index_name", F.col("source").alias("fname")).agg(F.min_by("_h", "doc_id").alias("sha256"))
    return compare(was, now, on)


# ---- whole runs -----------------------------------------------------------------------------------------------------


def _questions(spark, d) -> DataFrame:
    """The stated query set; every third question is limited to sources of Python."""
    return _asked(_vectors(spark, d)).withColumn("source_filter", F.when(F.col("qid") % 60 == 0, ".py"))


@query(
    _IP + ", f as (select qid, h.id, raw, coalesce(source, '') source, chunk_idx, chunk_of, coalesce(ocr, false) ocr, c.text from r h join chunks c on c.id = h.id where case when qid % 60 = 0 then rank <= 50 and contains(coalesce(source, ''), '.py') else rank <= 5 end) "
    "select qid, rank, id, source, chunk_idx, chunk_of, ocr, round(raw, 6) as score, length(text) as n_chars from (select *, (row_number() over (partition by qid order by raw desc, id))::int rank from f) where rank <= 5"
)
def search_hits(spark, d):
    hits = search.search(_questions(spark, d), t(spark, d, "chunks"), _vectors(spark, d), 5)
    return hits.select("qid", "rank", "id", "source", "chunk_idx", "chunk_of", "ocr", F.round("score", 6).alias("score"), F.length("text").cast("long").alias("n_chars"))


_CONTEXT = "string_agg('[context: chunk ' || (n.chunk_idx + 1) || ']' || chr(10) || substring(n.text, 1, 1500), chr(10) || chr(10) order by n.chunk_idx, n.id) filter (n.chunk_idx {0} c.chunk_idx)"


@query(
    _IP + ", h as (select qid, c.id, c.doc_id, raw, coalesce(source, '') source, chunk_idx, chunk_of, coalesce(ocr, false) ocr, text, row_number() over (partition by qid order by raw desc, c.id) rank from r join chunks c on c.id = r.id where rank <= 3), "
    f"x as (select c.id, {_CONTEXT.format('<')} b, {_CONTEXT.format('>')} a from chunks c join chunks n on n.doc_id = c.doc_id and n.chunk_idx between c.chunk_idx - 1 and c.chunk_idx + 1 and n.id <> c.id where c.id in (select id from h) group by c.id) "
    "select qid, string_agg('[' || rank || '] ' || source || ' | chunk ' || (chunk_idx + 1) || '/' || chunk_of || ' | score ' || printf('%.3f', raw) || case when ocr then ' [OCR]' || chr(10) || '" + search.OCR_NOTE + "' || chr(10) else '' end || chr(10) || "
    "coalesce(b || chr(10) || chr(10), '') || substring(text, 1, 3000) || coalesce(chr(10) || chr(10) || a, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) as body from h left join x using (id) group by 1"
)
def search_rendered(spark, d):
    """Questions to the text that is shown, each hit with its neighbours."""
    asked = _asked(_vectors(spark, d))
    return search.render(search.search(asked, t(spark, d, "chunks"), _vectors(spark, d), 3, context=1))


@query()
def ask_in_words(spark, d):
    """Questions in words about every source, answered from chunks embedded by hashed words, limited to the source named."""
    from ..operators.embed import HashingEmbedder, embed

    chunks = t(spark, d, "chunks")
    embedded = chunks.join(embed(chunks, HashingEmbedder(64), key="id", text="text"), "id")
    docs = t(spark, d, "documents").where("source is not null")
    asked = docs.where("doc_type = 'book'").groupBy("source").agg(F.min("doc_id").alias("qid")).select("qid", F.concat(F.lit("What does "), "source", F.lit(" say of the vault?")).alias("text"))
    return search.ask(asked, embedded, HashingEmbedder(64), 3, sources=docs).select("qid", "rank", "id", "source", F.round("score", 6).alias("score"))


_INDEXED = _REASONS.replace("from documents)", "from documents where source is not null)")


@query(
    "with w as (" + _INDEXED + ") select index_name, count(*) filter (reason = 'new') as n_files, count(*) filter (reason in ('stored hash', 'stored name')) as n_known, count(*) filter (reason = 'batch duplicate') as n_repeated, "
    "coalesce(sum(length(full_text)) filter (reason = 'new'), 0)::bigint as n_chars from w join documents using (doc_id) group by 1"
)
def index_outcome(spark, d):
    """A run that indexes all documents beside the hashes stored by a date: what is new, known and repeated in each index."""
    return _indexed(spark, d)["meta"].drop("n_chunks")


@query()
def index_chunks(spark, d):
    """The chunks that such a run stores, with the summaries of projects."""
    return _indexed(spark, d)["chunks"]


def _indexed(spark, d) -> dict[str, DataFrame]:
    from ..operators.indexing import index_files

    return index_files(t(spark, d, "documents"), t(spark, d, "hashes").where("seen_at < timestamp '2024-07-01 00:00:00'"))

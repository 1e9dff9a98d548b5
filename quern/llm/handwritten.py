"""Which source files nobody wrote by hand: generated, minified, vendored, data (problem 1)."""

from __future__ import annotations

import fnmatch
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows, spread

# Statements that tools and vendors put at the head of a file, in the languages they come in.
GENERATED_TEXT = (
    r"@generated\b",
    r"\b(?:code|file|source|classes|bindings|stubs)\s+(?:was\s+|is\s+)?(?:auto(?:matically)?[- ]?)?generated\s+(?:by|from|with)\b",
    r"\bauto[- ]?generated\s+(?:file|code|by|from|source|bindings)\b",
    r"\bautomatically\s+(?:generated|produced|created)\b",
    r"\bmachine[- ](?:made|generated|written)\b",
    r"\bdo\s+not\s+(?:edit|modify)\s*(?:[.!;:*/]|$|this\s+file\b|by\s+hand\b|manually\b|directly\b)",
    r"\b(?:changes|edits)\b[^.]{0,40}\bwill\s+be\s+(?:lost|overwritten|discarded)\b",
    r"\b(?:run|rerun)\s+\S+\s+again\s+instead\s+of\s+editing\b",
    r"\bautomatisch\b[^.]{0,40}\b(?:erzeugt|generiert|erstellt)\b",
    r"\b(?:produit|généré|créé)\s+automatiquement\b",
    r"\b(?:generado|creado|producido)\s+automáticamente\b",
    r"\b(?:generato|creato|prodotto)\s+automaticamente\b",
    r"(?:создан|сгенерирован)\s+(?:программой|автоматически)|\bне\s+редактируйте\b",
    r"(?:δημιουργήθηκε|παράχθηκε)\s+αυτόματα",
    r"自动生成|自動生成",
)
VENDORED_TEXT = (
    r"\bthird[- ]party\s+(?:copy|code|source|library)\b",
    r"\bvendored\s+(?:here|from|copy|by)\b",
    r"\boriginally\s+published\s+as\b",
    r"\bupstream\s+release\b|\bimported\s+unchanged\b",
    r"\bsnapshot\s+of\s+the\s+(?:external|upstream)\b",
    r"\bcontributors\b.{0,20}\bbundled\s+with\s+permission\b",
    r"^\W*[\w.-]+\s+v?\d+\.\d+\.\d+\b.{0,80}\b(?:licen[cs]e|upstream|copyright)\b",
)
# Path patterns in attribute-file syntax that the hosting world treats as generated or vendored.
GENERATED_PATHS = (
    "gen/", "generated/", "__generated__/", "autogen/", "*.gen.*", "*.generated.*", "*_generated.*", "*_autogen.*", "*_pb2.*", "*_pb2_grpc.*", "*.pb.*", "*.g.*", "*.designer.*", "moc_*",
)
VENDORED_PATHS = ("vendor/", "vendored/", "_vendor/", "vendors/", "third_party/", "third-party/", "thirdparty/", "node_modules/", "bower_components/", "Pods/", "deps/", "extern/", "external/", "contrib/vendored/")
MINIFIED_PATHS = ("*.min.*", "*-min.js")

_GENERATED = re.compile("|".join(GENERATED_TEXT), re.I | re.M)
_VENDORED = re.compile("|".join(VENDORED_TEXT), re.I | re.M)
_COMMENT = re.compile(r"^\s*(?://|#|/?\*|--|;|<!--|\"\"\"|''')")
_DEFINED = re.compile(r"(?m)^[ \t]*(?:[\w<>*&]+[ \t]+)*?(?:def|func|function|fn|sub|class|int|void|char|double|float|long|bool|String|const)[ \t*]+(\w+)[ \t]*\(|^(\w+)\s*\(\)\s*\{")
_NUMBERED = re.compile(r"(?:_[0-9a-f]{4,}|_?\d+)$")
_DATA = re.compile(r"[A-Za-z0-9+/=]{60,}|\b0x[0-9a-fA-F]+\b|\b[-+]?\d[\d.eE]*\b|[\"'][0-9a-f]{8,}[\"']")
_LITERAL_GLUE = re.compile(r"[\s\[\](){},;:+\"'\\-]+|\bNULL\b|\b(?:true|false|null|None|True|False)\b")
_QUOTED = re.compile(r"[\"'][\w .:/-]{1,24}[\"']")


def outer_comments(text: str) -> str:
    """The comment lines before the first and after the last line of code, however many there are."""
    lines = [x for x in text.split("\n") if x.strip()]
    head = next((i for i, x in enumerate(lines) if not _COMMENT.match(x)), len(lines))
    tail = next((i for i in range(len(lines), head, -1) if not _COMMENT.match(lines[i - 1])), head)
    return "\n".join(lines[:head] + lines[tail:])


def content_kind(text: str) -> str | None:
    """'generated', 'vendored', 'minified' or 'data' by what the file says or looks like; None for hand-written."""
    said = outer_comments(text)
    if _GENERATED.search(said):
        return "generated"
    if _VENDORED.search(said):
        return "vendored"
    body = "\n".join(x for x in text.split("\n") if not _COMMENT.match(x))
    n = len(body)
    if n >= 200:
        data = sum(len(m) for m in _DATA.findall(body))
        glue = sum(len(m) for m in _LITERAL_GLUE.findall(body))
        if data >= 0.3 * n:
            keys = sum(len(m) for m in _QUOTED.findall(_DATA.sub("", body)))
            if data + glue + keys >= 0.85 * n:
                return "data"
        blank = sum(map(body.count, " \t\n"))
        long = sum(len(x) for x in body.split("\n") if len(x) > 180)
        if long >= 0.5 * n and blank < 0.09 * n:
            return "minified"
    names = [a or b for a, b in _DEFINED.findall(body)]
    if len(names) >= 3 and sum(bool(_NUMBERED.search(x)) for x in names) >= 0.7 * len(names):
        return "generated"
    return None


def path_features(path: str) -> list[str]:
    """Patterns in attribute-file syntax that the path matches and that may be mined: its directories and name marks."""
    *dirs, base = path.split("/")
    out = {f"{d}/" for d in dirs if not re.search(r"\d", d)}
    stem, _, _ = base.rpartition(".")
    if re.search(r"\.[0-9a-f]{8,}$", stem):
        out.add("*.[hash].*")
    if re.search(r"[a-z]-\d+\.\d+(?:\.\d+)*$", stem) or any(re.search(r"[a-z]-\d+\.\d+(?:\.\d+)*$", d) for d in dirs):
        out.add("*-[version]*")
    m = re.search(r"([._])([A-Za-z]\w*?)$", stem)
    if m and m.start():
        last = re.split(r"[._]", stem)[-1]
        out.add(f"*{stem[-len(last) - 1]}{last}.*")
    return sorted(out)


@lru_cache(maxsize=4096)
def _glob(pattern: str) -> re.Pattern:
    """An attribute-file pattern as an expression over the path below its directory.

    A slash at the beginning or inside anchors the pattern to the directory; one at the end asks for a directory and takes
    all that lies below.
    """
    p, tail = pattern, ""
    if p.endswith("/"):
        p, tail = p.rstrip("/"), "/.*"
    anchored = "/" in p or pattern.startswith("/")
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 1 :]:
            j = p.index("]", i + 1)
            out, i = out + fnmatch.translate(p[i : j + 1])[len("(?s:") : -len(")\\z")], j + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return re.compile(("" if anchored else "(?:.*/)?") + out + tail + r"\Z", re.S)


def parse_attributes(text: str) -> list[tuple[str, str, bool | None]]:
    """(pattern, 'generated' | 'vendored', value) of an attribute file's lines, in their order.

    The value is True where the attribute is set, False where it is unset by a minus or set to false, and None where an
    exclamation mark takes back what was said before.
    """
    out = []
    for line in text.splitlines():
        parts = line.split()
        if not parts or parts[0].startswith("#"):
            continue
        for a in parts[1:]:
            m = re.fullmatch(r"([-!]?)linguist-(generated|vendored)(?:=(\w+))?", a)
            if m:
                value = {"!": None, "-": False}.get(m[1], (m[3] or "true").lower() not in ("false", "0", "no"))
                out.append((parts[0], m[2], value))
    return out


@lru_cache(maxsize=1024)
def rules_of(files: tuple[tuple[str, str], ...]) -> list[tuple[str, list[tuple[re.Pattern, str, bool | None]]]]:
    """The rules of a repository's attribute files (directory, text) by directory, higher ones first; parsed once."""
    ordered = sorted(files, key=lambda f: (f[0].count("/") + bool(f[0]), f[0]))
    return [(folder + "/" if folder else "", [(_glob(p), what, on) for p, what, on in parse_attributes(text)]) for folder, text in ordered]


def declared(path: str, files: list[tuple[str, str]]) -> dict[str, bool]:
    """What the attribute files (directory, text) say of a path: deeper files win over higher ones, later lines over earlier."""
    out: dict[str, bool | None] = {}
    for base, rules in rules_of(tuple(files)):
        if path.startswith(base):
            for pattern, what, on in rules:
                if pattern.match(path[len(base) :]):
                    out[what] = on
    return {what: on for what, on in out.items() if on is not None}


def _known(path: str) -> str | None:
    for kind, patterns in (("generated", GENERATED_PATHS), ("vendored", VENDORED_PATHS), ("minified", MINIFIED_PATHS)):
        if any(_glob(p).match(path) for p in patterns):
            return kind
    return None


def mined_patterns(evidence: DataFrame, least_files: int = 5, least_share: float = 0.5, least_lift: float = 4.0) -> DataFrame:
    """(_pattern, _kind) of path patterns whose files are of one kind by their content far more often than files at large.

    Adopted if at least ``least_files`` files match, ``least_share`` of these are of the kind, and that is ``least_lift``
    times the share among all files.  One row per directory or name mark is counted over the whole corpus.
    """
    total = evidence.agg(F.count("*").alias("_all"), F.count("_kind").alias("_marked"))
    rows = evidence.select(F.explode("_patterns").alias("_pattern"), "_kind")
    by_kind = rows.groupBy("_pattern", "_kind").agg(F.count("*").alias("_n"))
    whole = by_kind.groupBy("_pattern").agg(
        F.sum("_n").alias("_all_n"), F.sum(F.when(F.col("_kind").isNotNull(), F.col("_n")).otherwise(0)).alias("_k_n"),
        F.max_by("_kind", F.when(F.col("_kind").isNotNull(), F.col("_n"))).alias("_kind"),
    )
    return (
        whole.crossJoin(F.broadcast(total)).where(F.col("_kind").isNotNull() & (F.col("_all_n") >= least_files))
        .where((F.col("_k_n") >= least_share * F.col("_all_n")) & (F.col("_k_n") * F.col("_all") >= least_lift * F.col("_all_n") * F.col("_marked")))
        .select("_pattern", "_kind")
    )


def not_handwritten(
    documents: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "full_text",
    path: str = "source",
    group: str = "index_name",
    kind: str = "doc_type",
    code: str = "code",
    skip: tuple[str, ...] = ("__project_summary__",),
) -> DataFrame:
    """(key, kind, evidence) of the code files that nobody wrote by hand for their project.

    ``kind`` is generated, vendored, minified or data; ``evidence`` is declared, mined, path or content.  A repository's
    attribute files (documents named .gitattributes) decide for the paths they name, also that a path is hand-written: not
    generated spares a file that looks generated, minified or like data.  What they declare and what the content of files
    shows are the seeds from which path patterns are mined; these are applied to all paths that no file declares, then a
    catalogue of patterns in common use, and where no pattern matches the content itself decides.  The kind is that of the
    content where it has one.  A null path is judged by content alone, a null text by path alone; files of both null are never cases.
    Several rows of one key give one row.  Further columns are ignored.
    """
    key_type = documents.schema[key].dataType.simpleString()
    files = documents.where(F.col(kind) == code).select(F.col(key).alias("_k"), F.col(group).alias("_g"), F.col(path).alias("_p"), F.col(text).alias("_t"))
    files = files.where("_k is not null").where(F.col("_p").isNull() | ~F.col("_p").isin(*skip))
    base = F.element_at(F.split("_p", "/"), -1)
    declared_in = files.where((base == ".gitattributes") & F.col("_t").isNotNull() & F.col("_g").isNotNull())
    rules = declared_in.groupBy("_g").agg(F.collect_list(F.struct(F.regexp_replace("_p", "/?[^/]*$", "").alias("d"), F.col("_t").alias("t"))).alias("_rules"))

    def look(cols: dict[str, list]):
        for k, g, p, t in zip(cols["_k"], cols["_g"], cols["_p"], cols["_t"]):
            yield k, g, p, content_kind(t) if t else None, path_features(p) if p else []

    evidence = map_rows(spread(files), look, f"_k {key_type}, _g string, _p string, _kind string, _patterns array<string>").join(rules, "_g", "left")

    def seed(cols: dict[str, list]):
        for k, p, content, patterns, r in zip(*(cols[c] for c in ("_k", "_p", "_kind", "_patterns", "_rules"))):
            said = declared(p, [(x["d"], x["t"]) for x in r]) if r and p else {}
            named = next((w for w, on in said.items() if on), None)
            spared = {"generated": ("generated", "minified", "data"), "vendored": ("vendored",)}
            no = {x for w, on in said.items() if not on for x in spared[w]}
            yield k, p, named, content if content not in no else None, named or (content if content not in no else None), sorted(no), patterns

    evidence = cut(
        map_rows(evidence.select("_k", "_p", "_kind", "_patterns", "_rules"), seed, f"_k {key_type}, _p string, _named string, _content string, _kind string, _no array<string>, _patterns array<string>")
    )
    mined = mined_patterns(evidence)
    by_mined = (
        evidence.select("_k", F.explode("_patterns").alias("_pattern")).join(mined, "_pattern").groupBy("_k").agg(F.min("_kind").alias("_mined"))
    )
    rows = evidence.select("_k", "_p", "_named", "_content", "_no").join(by_mined, "_k", "left")

    def decide(cols: dict[str, list]):
        for k, p, named, content, no, mined_kind in zip(*(cols[c] for c in ("_k", "_p", "_named", "_content", "_no", "_mined"))):
            for found, how in ((named, "declared"), (mined_kind, "mined"), (_known(p) if p else None, "path"), (content, "content")):
                if found and found not in no:
                    yield k, (found if how == "declared" else content or found), how
                    break

    found = map_rows(rows, decide, f"`{key}` {key_type}, kind string, evidence string")
    return found.groupBy(key).agg(F.min_by("kind", F.struct("kind", "evidence")).alias("kind"), F.min_by("evidence", F.struct("kind", "evidence")).alias("evidence"))

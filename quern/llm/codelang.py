"""Natural language hidden in source code: comments and strings, their languages and shares (problem 3)."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import schema_of, spread

# ---- byte classes and the automaton ---------------------------------------------------------------------------------

_OTHER, _NL, _DQ, _SQ, _BQ, _BS, _SL, _ST, _HA, _DA, _WD, _OP, _LB, _RB, _LC, _RC, _DO = _CLASSES = range(17)
_CLASS = np.zeros(256, np.uint8)
for _c, _k in (("\n", _NL), ('"', _DQ), ("'", _SQ), ("`", _BQ), ("\\", _BS), ("/", _SL), ("*", _ST), ("#", _HA), ("-", _DA)):
    _CLASS[ord(_c)] = _k
# where a slash may begin a pattern, what stands before it counts, and templates hold code in braces
_CLASS_JS = _CLASS.copy()
for _c in range(256):
    if _c >= 128 or chr(_c).isalnum() or chr(_c) in "_)":
        _CLASS_JS[_c] = _WD
for _c, _k in (*((x, _OP) for x in "=(,:;!&|?+%^~<>"), ("[", _LB), ("]", _RB), ("{", _LC), ("}", _RC), ("$", _DO)):
    _CLASS_JS[ord(_c)] = _k
_CLASS_JS[ord("*")], _CLASS_JS[ord("-")] = _ST, _OP

CODE, COMMENT, STRING = 0, 1, 2


class _Machine:
    """One transition table for all syntaxes; each has its own start state."""

    def __init__(self):
        self.rows: list[list[int]] = []
        self.kind: list[int] = []
        self.starts: dict[str, int] = {}

    def state(self, kind: int) -> int:
        self.rows.append([len(self.rows)] * len(_CLASSES))
        self.kind.append(kind)
        return len(self.rows) - 1

    def on(self, s: int, to: int, *classes: int) -> None:
        for c in classes or _CLASSES:
            self.rows[s][c] = to

    def string(self, home: int, quote: int, escapes: bool, lines: bool) -> int:
        s = self.state(STRING)
        self.on(s, home, quote)
        if not lines:
            self.on(s, home, _NL)
        if escapes:
            e = self.state(STRING)
            self.on(e, s)
            self.on(s, e, _BS)
        return s

    def triple(self, home: int, quote: int) -> int:
        """The state after a first quote that may open a short or a long string."""
        one, two, short = self.state(STRING), self.state(STRING), self.string(home, quote, True, False)
        self.on(one, short)
        self.on(one, two, quote)
        self.on(one, home, _NL)
        esc = self.state(STRING)
        self.on(esc, short)
        self.on(one, esc, _BS)
        long, l1, l2, le = (self.state(STRING) for _ in range(4))
        self.rows[two] = list(self.rows[home])  # an empty string has ended: read on as code
        self.on(two, long, quote)
        self.on(long, l1, quote)
        self.on(l1, long)
        self.on(l1, l2, quote)
        self.on(l2, long)
        self.on(l2, home, quote)
        self.on(le, long)
        for s in (long, l1, l2):
            self.on(s, le, _BS)
        return one

    def syntax(self, name: str, *, line: str = "", block: bool = False, quotes: dict[int, tuple[bool, bool]], long: tuple[int, ...] = ()) -> None:
        home = self.state(CODE)
        self.starts[name] = home
        if line or block:
            rem = self.state(COMMENT)
            self.on(rem, home, _NL)
        if line == "#":
            self.on(home, rem, _HA)
        for q, (escapes, lines) in quotes.items():
            self.on(home, self.string(home, q, escapes, lines), q)
        if line == "//" or block:
            slash = self.state(CODE)
            self.on(home, slash, _SL)
            self.rows[slash] = list(self.rows[home])
            self.on(slash, rem if line == "//" else slash, _SL)
            if block:
                body, star = self.state(COMMENT), self.state(COMMENT)
                self.on(slash, body, _ST)
                self.on(body, star, _ST)
                self.on(star, body)
                self.on(star, star, _ST)
                self.on(star, home, _SL)
        if line == "--":
            dash = self.state(CODE)
            self.on(home, dash, _DA)
            self.rows[dash] = list(self.rows[home])
            self.on(dash, rem, _DA)
        for q in long:
            self.on(home, self.triple(home, q), q)

    def character(self, home: int) -> None:
        """A quote that begins a character, which may be a quote or an escape, or else stands alone before a name."""
        one, two, esc = self.state(CODE), self.state(CODE), self.state(CODE)
        self.on(home, one, _SQ)
        self.on(one, two)
        self.on(one, esc, _BS)
        self.on(esc, two)
        self.rows[two] = list(self.rows[home])
        self.on(two, home, _SQ)

    def script(self, name: str, depth: int = 3) -> None:
        """A syntax with comments, strings, patterns between slashes and templates.  Templates and
        braces in templates are told apart to ``depth`` within each other."""

        def code(leave: int | None, level: int) -> int:
            """The state before an operand of code that a closing brace leaves to ``leave``."""
            before, after = self.state(CODE), self.state(CODE)
            quoted = {q: self.string(after, q, True, False) for q in (_DQ, _SQ)}
            for s in (before, after):
                for q, string in quoted.items():
                    self.on(s, string, q)
                self.on(s, after, _WD, _RB, _DO)
                self.on(s, before, _OP, _LB, _LC, _DA, _ST)
                self.on(s, after if leave is None else leave, _RC)
            body, star, line = self.state(COMMENT), self.state(COMMENT), self.state(COMMENT)
            self.on(body, star, _ST)
            self.on(star, body)
            self.on(star, star, _ST)
            self.on(star, before, _SL)
            self.on(line, before, _NL)
            rx, rx_esc, rx_set, set_esc = (self.state(CODE) for _ in range(4))
            self.on(rx, after, _SL)
            self.on(rx, before, _NL)
            self.on(rx, rx_esc, _BS)
            self.on(rx_esc, rx)
            self.on(rx, rx_set, _LB)
            self.on(rx_set, rx, _RB)
            self.on(rx_set, before, _NL)
            self.on(rx_set, set_esc, _BS)
            self.on(set_esc, rx_set)
            starts, divides = self.state(CODE), self.state(CODE)
            self.rows[starts], self.rows[divides] = list(self.rows[rx]), list(self.rows[before])
            for s in (starts, divides):
                self.on(s, line, _SL)
                self.on(s, body, _ST)
            self.on(before, starts, _SL)
            self.on(after, divides, _SL)
            template, escape, dollar = self.state(STRING), self.state(STRING), self.state(STRING)
            for s in (before, after):
                self.on(s, template, _BQ)
            self.on(template, escape, _BS)
            self.on(escape, template)
            self.on(template, after, _BQ)
            self.on(template, dollar, _DO)
            self.rows[dollar] = list(self.rows[template])
            self.on(dollar, code(template, level - 1) if level else template, _LC)
            if leave is not None and level:  # braces of its own
                inner = code(after, level - 1)
                for s in (before, after):
                    self.on(s, inner, _LC)
            self.rows[divides][_BQ], self.rows[starts][_BQ] = template, rx
            return before

        self.starts[name] = code(None, depth)


_M = _Machine()
_M.syntax("c", line="//", block=True, quotes={_DQ: (True, False), _SQ: (True, False)})
_M.script("js")
_M.syntax("java", line="//", block=True, quotes={_SQ: (True, False)}, long=(_DQ,))
_M.syntax("go", line="//", block=True, quotes={_DQ: (True, False), _SQ: (True, False), _BQ: (False, True)})
_M.syntax("rust", line="//", block=True, quotes={_DQ: (True, True)})
_M.character(_M.starts["rust"])
_M.syntax("css", block=True, quotes={_DQ: (True, False), _SQ: (True, False)})
_M.syntax("sql", line="--", block=True, quotes={_SQ: (False, True), _DQ: (False, False)})
_M.syntax("shell", line="#", quotes={_DQ: (True, True), _SQ: (False, True)})
_M.syntax("python", line="#", quotes={}, long=(_DQ, _SQ))
_NEXT, _KIND = np.array(_M.rows, np.uint16), np.array(_M.kind, np.uint8)
# The syntax of each language name; unknown names are read as C.
SYNTAX = {
    "python": "python", "bash": "shell", "shell": "shell", "sh": "shell", "ruby": "shell", "perl": "shell", "yaml": "shell", "r": "shell", "sql": "sql",
    "javascript": "js", "typescript": "js", "go": "go", "rust": "rust", "css": "css", "c": "c", "cpp": "c", "java": "java", "kotlin": "java", "scala": "java", "swift": "java",
}


def runs(data: np.ndarray, offsets: np.ndarray, syntaxes: list[str]) -> list[list[tuple[int, int, int]]]:
    """For each text, given as a slice of UTF-8 bytes: the (kind, start, end) byte runs of comments and strings.

    A run of bytes that no syntax cares for is one step.  All texts step together, the longest first, so each step is one
    table lookup over the texts still going.
    """
    n = len(syntaxes)
    events: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(n):
        raw = data[offsets[i] : offsets[i + 1]]
        cls = (_CLASS_JS if syntaxes[i] == "js" else _CLASS)[raw]
        if syntaxes[i] in ("shell",):
            hashes = np.flatnonzero(cls == _HA)
            before = raw[np.maximum(hashes - 1, 0)]
            word = (hashes > 0) & ~np.isin(before, np.frombuffer(b" \t\n;(|&", np.uint8))
            cls[hashes[word]] = _OTHER
        keep = np.ones(len(cls), bool)
        same = cls[1:] == cls[:-1]
        keep[1:] = ~(same & ((cls[1:] == _OTHER) | (cls[1:] == _WD)))
        at = np.flatnonzero(keep)
        events.append((at, cls[at]))
    order = sorted(range(n), key=lambda i: -len(events[i][0]))
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    lo = 0
    while lo < n and len(events[order[lo]][0]):
        steps = len(events[order[lo]][0])
        hi = lo
        while hi < n and len(events[order[hi]][0]) * 3 >= steps:
            hi += 1
        group = order[lo:hi]
        lanes = np.zeros((steps, len(group)), np.uint8)
        for j, i in enumerate(group):
            lanes[: len(events[i][1]), j] = events[i][1]
        lengths = np.array([len(events[i][0]) for i in group])
        alive = len(group) - np.searchsorted(lengths[::-1], np.arange(1, steps + 1), side="left")
        state = np.array([_M.starts[syntaxes[i]] for i in group], np.uint16)
        states = np.empty((steps, len(group)), np.uint16)
        for t in range(steps):
            k = alive[t]
            state[:k] = _NEXT[state[:k], lanes[t, :k]]
            states[t] = state
        for j, i in enumerate(group):
            at, cls = events[i]
            kinds = _KIND[states[: len(at), j]]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], kinds, [0]])))
            ends = np.append(at, offsets[i + 1] - offsets[i])
            for a, b in zip(edges[:-1], edges[1:]):
                if kinds[a]:
                    out[i].append((int(kinds[a]), int(at[a]) + 1, int(ends[b])))
        lo = hi
    return out


# ---- passages -------------------------------------------------------------------------------------------------------

_MARKS = re.compile(r"^[ \t]*(?:/{1,3}!?(?!\*)|/?\*+!?/?|#+!?|--+|//!)?[ \t]?|[ \t]*\*+/?[ \t]*$", re.M)
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]{1,6})\}|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|x([0-9a-fA-F]{2})|(.))", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\n", "b": " ", "f": " ", "a": " ", "v": " ", "0": " "}


def _unescape(m: re.Match) -> str:
    code = m[1] or m[2] or m[3] or m[4]
    if code:
        v = int(code, 16)
        return chr(v) if v < 0x110000 else " "
    return _PLAIN.get(m[5], m[5])


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    if re.search(r"\\[dD][89abAB]|\\u[dD][89abAB]", text):  # surrogate pairs
        text = re.sub(r"\\u([dD][89abAB][0-9a-fA-F]{2})\\u([dD][c-fC-F][0-9a-fA-F]{2})", lambda m: chr(0x10000 + ((int(m[1], 16) & 0x3FF) << 10) + (int(m[2], 16) & 0x3FF)), text)
    return _ESCAPE.sub(_unescape, text).encode("utf-8", "replace").decode("utf-8")


def passages(raw: bytes, found: list[tuple[int, int, int]]) -> list[tuple[str, int]]:
    """(text, length in the file) of the comments and strings; line comments on successive lines are one passage."""
    out: list[list] = []
    last_end, last_kind = -1, 0
    for kind, a, b in found:
        piece = raw[a:b].decode("utf-8", "replace")
        if kind == COMMENT:
            if piece.endswith("*") and raw[b : b + 1] == b"/":
                piece = piece[:-1]  # the first half of the mark that closes it
            body = _MARKS.sub("", piece)
            between = raw[last_end:a] if last_kind == COMMENT else b"x"
            if last_kind == COMMENT and between.count(b"\n") <= 1 and not between.strip(b" \t\n/#-*"):
                out[-1][0] += "\n" + body
                out[-1][1] += len(piece)
            else:
                out.append([body, len(piece)])
        else:
            out.append([unescape(piece.strip("\"'`")), len(piece)])
        last_end, last_kind = b, kind
    return [(t, n) for t, n in out]


# ---- Kneser-Ney character models --------------------------------------------------------------------------------------

LATIN = ("de", "en", "es", "fr", "it")
_SYMBOLS = " abcdefghijklmnopqrstuvwxyzàáâäæçèéêëìíîïñòóôöœùúûüßÿ’"
_N = len(_SYMBOLS) + 1
_CODE = {c: i for i, c in enumerate(_SYMBOLS)} | {"'": _SYMBOLS.index("’")}


def encode(text: str) -> np.ndarray:
    """Symbols of a text: small letters, one blank for whatever stands between words, one symbol for all other letters."""
    text = re.sub(r"[^\w'’]+|[\d_]+", " ", " " + text.lower() + " ")
    return np.fromiter((_CODE.get(c, _N - 1) for c in text), np.int32, len(text))


def train(texts: list[str], discount: float = 0.75) -> np.ndarray:
    """Log probabilities of every trigram of symbols by interpolated Kneser-Ney smoothing."""
    tri = np.zeros(_N**3)
    for t in texts:
        c = encode(t)
        if len(c) > 2:
            tri += np.bincount((c[:-2] * _N + c[1:-1]) * _N + c[2:], minlength=_N**3)
    tri = tri.reshape(_N, _N, _N)
    before = (tri > 0).sum(0)  # of (b, c): how many different a stand before
    uni = before.sum(0).astype(float)
    p1 = (uni + 0.5) / (uni.sum() + 0.5 * _N)
    n2 = before.sum(1, keepdims=True)
    p2 = np.where(n2 > 0, (np.maximum(before - discount, 0) + discount * (before > 0).sum(1, keepdims=True) * p1) / np.maximum(n2, 1), p1)
    n3 = tri.sum(2, keepdims=True)
    p3 = np.where(n3 > 0, (np.maximum(tri - discount, 0) + discount * (tri > 0).sum(2, keepdims=True) * p2) / np.maximum(n3, 1), p2)
    return np.log(p3).astype(np.float32).ravel()


def fit_models(books: DataFrame, *, text: str = "full_text", lang: str = "lang", per_language: int = 150, chars: int = 20000) -> np.ndarray:
    """Models of the languages of ``LATIN``, fitted to at most ``per_language`` labelled texts each, the least by a hash,
    ``chars`` characters of each.  A second fit leaves out the tenth of each sample that its own language explains worst against the others, as
    labels may be wrong."""
    rows = books.where(F.length(text) > 300).select(F.lower(F.substring(lang, 1, 2)).alias("_l"), F.xxhash64(text).alias("_h"), F.substring(text, 1, chars).alias("_t"))
    rows = rows.where(F.col("_l").isin(*LATIN))
    # only hashes go through the choice; of the texts no more than are asked for leave their tasks
    least = {code: [r[0] for r in rows.where(F.col("_l") == code).select("_h").orderBy("_h").limit(per_language).collect()] for code in LATIN}
    wanted = functools.reduce(lambda x, y: x | y, ((F.col("_l") == code) & (F.col("_h") <= max(h)) for code, h in least.items() if h), F.lit(False))
    found = rows.where(wanted).select("_l", "_h", "_t").distinct().collect() if any(least.values()) else []
    samples = [[t for _, t in sorted((r["_h"], r["_t"]) for r in found if r["_l"] == code)[:per_language]] for code in LATIN]
    models = np.stack([train(s) for s in samples])
    kept = []
    for i, s in enumerate(samples):
        scored = []
        for t in s:
            c = encode(t)
            ids = (c[:-2] * _N + c[1:-1]) * _N + c[2:]
            m = models[:, ids].mean(1)
            scored.append((m[i] - np.delete(m, i).max(), t))
        scored.sort(key=lambda x: -x[0])
        kept.append([t for gain, t in scored[: max(1, len(scored) * 9 // 10)] if gain > 0] or s)
    return np.stack([train(s) for s in kept])


# ---- languages of a passage ---------------------------------------------------------------------------------------------

_SCRIPTS = {
    "ru": re.compile(r"[Ѐ-ӿ]+(?:-[Ѐ-ӿ]+)*"), "el": re.compile(r"[Ͱ-Ͽἀ-῿]+"), "hi": re.compile(r"[ऀ-ॿ]+"), "ar": re.compile(r"[؀-ۿ]+"),
}
_NOT_RUSSIAN = re.compile(r"[іїєґўђјљњћџІЇЄҐЎЂЈЉЊЋЏ]")
_HAN, _KANA = re.compile(r"[㐀-鿿]"), re.compile(r"[぀-ヿ]")
_LATIN_WORD = re.compile(r"(?<![\w$@.\\/:-])[A-Za-zÀ-ÿœŒ]+(?:[’'-][A-Za-zÀ-ÿœ]+)*(?![\w(=\\/\[{@]|\.\w|-\w|:\w)")
_TOKEN = re.compile(r"\S+")
_CAMEL = re.compile(r"[a-z][A-Z]")
_CODE_LINE = re.compile(
    r"[;{}]\s*$|^\s*[})\]]|\w\(|\w\[|[=!<>+*/%&|^-]=|(?<=\w)\s*=\s*\S|->|=>|::|&&|\|\||\+\+|--$|\$\(|\$\{?\w|^\s*#\s*(?:include|define|if|endif)"
    r"|^\s*(?:if|for|while|with|def|class|try|except|elif|else|async|switch|case|func|fn|let|var|const|do|done|fi|return|import|from|package|use|mod|export|local|test)\b[^.!?]*[:{(;]?\s*$"
)


def languages(text: str, models: np.ndarray, comment_words: int = 4, cjk_chars: int = 6) -> dict[str, int]:
    """Language -> characters of the running text in one passage: four words, or six characters in Chinese and Japanese."""
    out: dict[str, int] = {}
    if not text.isascii():
        for code, rx in _SCRIPTS.items():
            words = rx.findall(text)
            if len(words) >= comment_words and not (code == "ru" and _NOT_RUSSIAN.search(text)):
                out[code] = sum(map(len, words))
        han = len(_HAN.findall(text))
        kana = len(_KANA.findall(text))
        if han + kana >= cjk_chars:
            out["ja" if kana >= 0.1 * (han + kana) else "zh"] = han + kana
    lines = [x for x in text.split("\n") if x.strip() and not _CODE_LINE.search(x)]
    if not lines:
        return out
    prose = "\n".join(lines)
    words = [w for w in _LATIN_WORD.findall(prose) if not _CAMEL.search(w)]
    tokens = [t for t in _TOKEN.findall(prose) if any(c.isalnum() for c in t)]
    if len(words) >= comment_words and len(words) >= 0.6 * len(tokens) and sum(len(w) > 1 for w in words) >= comment_words - 1:
        c = encode(" ".join(words))
        score = models[:, (c[:-2] * _N + c[1:-1]) * _N + c[2:]].sum(1)
        out[LATIN[int(score.argmax())]] = sum(map(len, words))
    return out


def code_languages(
    documents: DataFrame, models: np.ndarray, *, key: str = "doc_id", text: str = "full_text", kind: str = "doc_type", code: str = "code", language: str = "language"
) -> DataFrame:
    """(key, lang, n_passages, n_chars, share): languages of the running text in comments and strings of each source file.

    ``share`` is of the file's characters.  Only rows of the code kind with a programming language count; null or empty
    texts and files without running text give no rows, an unknown language is read with the syntax of C.  Repeated keys
    give repeated rows; other columns are ignored.
    """
    key_type = documents.schema[key].dataType.simpleString()
    rows = documents.where((F.col(kind) == code) & F.col(language).isNotNull() & (F.length(text) > 0)).select(
        F.col(key).alias("_k"), F.lower(language).alias("_l"), F.col(text).alias("_t")
    )
    ddl = f"`{key}` {key_type}, lang string, n_passages int, n_chars bigint, share double"
    arrow = to_arrow_schema(schema_of(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column(2)
                wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
                offsets = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
                data = np.frombuffer(texts.buffers()[2], np.uint8)
                keys, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                out = []
                for i, found in enumerate(runs(data, offsets, [SYNTAX.get(x, "c") for x in names])):
                    raw = data[offsets[i] : offsets[i + 1]].tobytes()
                    n: Counter[str] = Counter()
                    times: Counter[str] = Counter()
                    for passage, _ in passages(raw, found):
                        if len(passage) >= 6:
                            for lang, chars in languages(passage, models).items():
                                n[lang] += chars
                                times[lang] += 1
                    total = len(raw.decode("utf-8", "replace")) if n else 1
                    out += [(keys[i], lang, times[lang], n[lang], n[lang] / total) for lang in sorted(n)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return spread(rows).mapInArrow(run, ddl)

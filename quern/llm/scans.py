"""Noise in text from scanned pages: page lines, broken words, misread characters, and their repair (problem 4)."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows, spread

# What a reader of pages takes for what (seen, meant).
CONFUSIONS = (
    ("c", "e"), ("@", "a"), ("|", "i"), ("|", "l"), ("!", "l"), ("!", "i"), ("f", "t"), ("5", "s"), ("0", "o"), ("ri", "n"), ("ii", "u"), ("1", "l"), ("1", "i"),
    ("b", "h"), ("cl", "d"), ("9", "g"), ("0", "O"), ("rn", "m"), ("vv", "w"), ("l", "I"), ("1", "I"), ("h", "li"), ("m", "rn"), ("8", "B"), ("5", "S"), ("6", "b"), ("$", "s"), ("$", "S"),
    ("c", "è"), ("c", "é"), ("tl", "d"), ("li", "h"), ("ni", "m"), ("nn", "m"), ("q", "g"), ("н", "и"), ("п", "л"), ("0", "о"), ("6", "б"), ("3", "з"), ("ш", "щ"), ("0", "О"),
    ("ο", "σ"), ("0", "ο"), ("ν", "υ"), ("υ", "ν"), ("и", "н"), ("с", "е"), ("рн", "м"), ("lo", "b"), ("I", "l"), ("ı", "i"), ("ť", "t"), ("ß", "B"), ("6", "é"),
)
_BY_FIRST: dict[str, list[tuple[str, str]]] = defaultdict(list)
for _a, _b in CONFUSIONS:
    _BY_FIRST[_a[0]].append((_a, _b))

_SYMBOL = "0-9@|$!"
WORD = re.compile(r"[^\W\d_](?:[^\W_]|[@|]|[$!](?=[^\W_]))*|[0-9@|$](?:[^\W_]|[@|$!](?=[^\W_]))*[^\W\d_](?:[^\W_]|[@|]|[$!](?=[^\W_]))*")
_LETTERS = re.compile(r"[^\W\d_]+")
_BROKEN = re.compile(r"([^\W\d_](?:[^\W_]|[@|$!])*(?:[’'][^\W\d_]+)?|[’'][^\W\d_]+)([-=¬­])[ \t]*$")
_CJK = re.compile(r"[぀-ヿ㐀-鿿฀-๿]")
_NUMBER = re.compile(r"^(?P<l>[—–\-\[(~•·*]*\s*)(?P<p>(?:p|pp|pag|pág|page|seite|s|с|стр|σελ)\.?\s*)?(?P<n>[0-9lIOo|]{1,5})(?P<r>\s*[—–\-\])~•·*]*|\.)$", re.I)
_NUMBERED = re.compile(r"^(?P<a>\S.*?\S)\s{2,}[—–\-\[(]?(?P<n>[0-9lIOo|]{1,5})[—–\-\])]?$|^[—–\-\[(]?(?P<m>[0-9lIOo|]{1,5})[—–\-\])]?\s{2,}(?P<b>\S.*\S)$")
_CHAPTER = re.compile(r"^(?:chapter|kapitel|chapitre|capítulo|capitulo|capitolo|глава|κεφάλαιο|part|teil|partie|parte|book|section)\b|^\d+[.)]\s|^第", re.I)
_BLOCK_TAG = re.compile(r"</?(?:p|div|html|pre|li|h\d)\b", re.I)
_TERMINAL = re.compile(r"[.!?…:。！？।؟;][\"'”’»」』)\]]*$")


def _value(digits: str) -> int | None:
    d = digits.translate(str.maketrans("lIOo|", "11001"))
    return int(d) if d.isdigit() and any(c.isdigit() for c in digits) or digits in ("l", "ll") else None


def _shape(line: str) -> str:
    """A running head as it is compared: letters only, common misreadings undone."""
    s = re.sub(r"[\d\W_]+$|^[\d\W_]+", "", line.translate(str.maketrans("0158|@", "OISBIA")).upper())
    return re.sub(r"[IL1]", "I", s)


_LOWER = re.compile("[a-km-zß-öø-ÿα-ωа-я]")


def _capitals(line: str) -> bool:
    """A line of capitals with at least two words; digits may stand for letters."""
    if len(_LOWER.findall(line)) > 0.03 * len(line):
        return False
    words = line.split()
    letters = [c for c in line if c.isalpha()]
    return len(words) >= 2 and len(letters) >= 6 and sum(c.isupper() or c == "l" for c in letters) >= 0.97 * len(letters) and sum(c.isupper() for c in letters) >= 0.7 * len(letters)


def page_lines(lines: list[str]) -> set[int]:
    """Numbers (from 0) of the lines that belong to the page and not to the text."""
    out: set[int] = set()
    numbers: dict[int, tuple[int, bool]] = {}
    heads: dict[str, list[int]] = defaultdict(list)
    for i, raw in enumerate(lines):
        line = raw.strip()
        if not line:
            continue
        m = _NUMBER.match(line)
        if m and (v := _value(m["n"])) is not None:
            numbers[i] = (v, bool(m["l"].strip() or m["p"]))
            continue
        if _CHAPTER.match(line):
            continue
        m = _NUMBERED.match(line)
        if m and (v := _value(m["n"] or m["m"])) is not None:
            title = m["a"] or m["b"]
            heads[_shape(title)].append(i)
            numbers[i] = (v, True)
        elif _capitals(line):
            heads[_shape(line)].append(i)
    near_numbers = {j for i in numbers for j in (i - 1, i + 1)}
    for i, raw in enumerate(lines):
        line = raw.strip()
        # a running head in small letters is short or stands beside a number
        if line and i not in numbers and (len(line) < 60 or i in near_numbers) and not _CHAPTER.match(line) and not _capitals(line) and not _TERMINAL.search(line):
            heads["~" + _shape(line)].append(i)
    values = Counter(v for v, _ in numbers.values())
    for i, (v, marked) in numbers.items():
        line = lines[i].strip()
        runs_on = values[v - 1] or values[v + 1]
        before = lines[i - 1].strip() if i else ""
        after = lines[i + 1].strip() if i + 1 < len(lines) else ""
        year = 1400 <= v <= 2100 and line.endswith(".")
        ends_paragraph = before and not after and not _TERMINAL.search(before) and line.endswith(".")
        if _NUMBERED.match(line) or marked or runs_on or not (year or ends_paragraph):
            if marked or runs_on or not before or not after or not re.search(r"[+=<>]", before + after):
                out.add(i)
    numeric = set(out)
    for shape, at in heads.items():
        if shape.startswith("~"):
            plain = shape[1:]
            # a short line that recurs, or stands by a page number each time, is a running head even in small letters
            near = [i for i in at if (i - 1 in numeric or i + 1 in numeric)]
            if len(plain) >= 4 and len(at) >= 2 and len(near) >= 2:
                out.update(at)
            elif plain in heads:
                out.update(at)
        else:
            out.update(at)
    return out


def scan_lines(text: str, ocr: bool | None) -> tuple[list[str], set[int], list[tuple[int, str, str, str, int]]]:
    """Lines (blank where they are markup), page lines, and breaks (line, head, mark, tail, line of the tail)."""
    lines = text.split("\n")
    marked = marked_lines(lines) if "```" in text or "\\begin{" in text or _BLOCK_TAG.search(text) else set()
    # stretches of markup were not read from pages; their lines are blank to what is asked here
    lines = ["" if i in marked else x for i, x in enumerate(lines)] if marked else lines
    pages = page_lines(lines)
    if not ocr and len(pages) == 1 and not any(c.isdigit() for c in lines[min(pages)].strip()):
        i = min(pages)
        if (not i or not lines[i - 1].strip()) and (i + 1 >= len(lines) or not lines[i + 1].strip()) and not any(_BROKEN.search(x) for x in lines):
            pages = set()  # one line of capitals set off by blank lines is a heading
    breaks = []
    for i, line in enumerate(lines):
        if i in pages:
            continue
        end = line.rstrip(" \t")
        m = _BROKEN.search(line) if end and end[-1] in "-=¬\u00ad" else None
        if not m:
            continue
        j = i + 1
        while j < len(lines) and (j in pages or (not lines[j].strip() and (j - 1 in pages or j + 1 in pages))):
            j += 1
        if j >= len(lines):
            continue
        tail = re.match(r"\s*((?:[^\W_]|[@|$!](?=[^\W_]))+(?:[-’'][^\W\d_]+)*)", lines[j])
        if tail:
            breaks.append((i, m[1], m[2], tail[1], j))
    return lines, pages, breaks


def variants(word: str, most: int = 2) -> set[str]:
    """What a word may have been before up to ``most`` misreadings."""
    found: set[str] = set()
    layer = {(word, 0)}
    for _ in range(most):
        following = set()
        for w, start in layer:
            for i in range(start, len(w)):
                for a, b in _BY_FIRST.get(w[i], ()):
                    if w.startswith(a, i):
                        following.add((w[:i] + b + w[i + len(a) :], i + len(b)))
        found |= {w for w, _ in following}
        layer = following
    found.discard(word)
    return {w for w in found if w.isalpha()}


def distinct_texts(books: DataFrame, text: str) -> DataFrame:
    """(_t): each text once, by an aggregate over digests that combines the copies of a text before they are shuffled."""
    rows = books.select(F.col(text).alias("_t")).where(F.length("_t") > 0).withColumn("_h", F.md5("_t"))
    return rows.groupBy("_h").agg(F.first("_t").alias("_t")).select("_t")


_JOINT = re.compile(r"[-=¬\u00ad][ \t]*\n\s*")
_COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")


def without_broken(text: str) -> str:
    """The text without what a line end breaks: the words on both sides of it."""
    out, at, n = [], 0, len(text)
    for m in _JOINT.finditer(text):
        if m.start() < at:
            continue
        a, b = m.start(), m.end()
        while a > at and not text[a - 1].isspace():
            a -= 1
        while b < n and not text[b].isspace():
            b += 1
        out += [text[at:a], " "]
        at = b
    return "".join([*out, text[at:]])


def word_counts(books: DataFrame, text: str) -> DataFrame:
    """(word, n): how often each word, and each compound with its hyphen, stands in the middle of a line of the distinct
    texts of the corpus; copies of a text count once, so that a word misread in a much copied book stays rare."""

    def run(cols: dict[str, list]):
        seen: Counter[str] = Counter()
        for t in cols["_t"]:
            body = without_broken(t)
            seen.update(WORD.findall(body))
            if "-" in body:
                seen.update(x for w in body.split() if "-" in w for x in _COMPOUND.findall(w))
        yield from seen.items()

    return map_rows(spread(distinct_texts(books, text)), run, "word string, n bigint", 2048).groupBy("word").agg(F.sum("n").alias("n"))


# ---- the lattice ------------------------------------------------------------------------------------------------------
#
# A word costs -log of its share of all words, a misreading log(20), two log(40), one that leaves a sign in the word log(3), a
# blank lost or added log(1000).  An edge of the lattice takes one or two words of the text to the words they stand for; its
# gain is what it saves against the words as they stand.  Edges depend on the words alone, so each is found once for all
# places where the words stand; the best path through a line is chosen there.

BLANK, LETTER = math.log(1000), 0.75


def longest(counts: DataFrame, known: int) -> int:
    """Letters of the longest known word."""
    return counts.where(F.col("n") >= known).agg(F.max(F.length("word"))).first()[0] or 0


def misread_words(words: DataFrame, counts: DataFrame, *, known: int = 10, ratio: int = 20) -> DataFrame:
    """(word, fix, gain) of ``words`` (word, n) that are a known word seen through one or two misreadings.

    The known word occurs at least ``known`` times and gains: it is ``ratio`` times as frequent for each misreading, three
    times if a sign shows it.  Of several the one with fewest misreadings, then the most frequent, is meant."""

    def run(cols: dict[str, list]):
        for w, n in zip(cols["word"], cols["n"]):
            if len(w) >= 2 and not _CJK.search(w):
                one = variants(w, 1)
                for v in one:
                    yield w, n, v, 1
                if len(w) >= 4:
                    for v in variants(w, 2) - one:
                        yield w, n, v, 2
                if w[1:2].islower() and w[0].isupper():  # a word at the beginning of a sentence
                    low = w[0].lower() + w[1:]
                    for v in variants(low, 1) - {x[0].lower() + x[1:] for x in one}:
                        yield w, n, v, 2

    # two misreadings make a word at most two letters longer than the known word, so the longest are nothing to look for
    guesses = map_rows(words.where(F.length("word") <= longest(counts, known) + 2), run, "word string, n bigint, fix string, edits int", 1024)
    good = counts.where(F.col("n") >= known).select(F.col("word").alias("fix"), F.col("n").alias("m"))
    odd = F.col("word").rlike(f"[{_SYMBOL}]")
    least = F.when(odd, F.least(F.lit(3), ratio * F.col("edits"))).otherwise(ratio * F.col("edits"))
    gain = (F.log("m") - F.log("n") - F.log(least)).alias("gain")
    hits = guesses.join(good, "fix").select("word", "fix", "edits", "m", gain).where("gain >= -1e-9")
    best = F.struct(-F.col("edits"), "m", "fix")
    return hits.groupBy("word").agg(F.max_by("fix", best).alias("fix"), F.max_by("gain", best).alias("gain"))


def blank_edges(words: DataFrame, pairs: DataFrame, counts: DataFrame, total: int, *, known: int = 10) -> DataFrame:
    """(word, other, fix, gain): words that are two with the blank lost (other null), and pairs that are one word with a
    blank added or two with the blank displaced by up to two letters."""
    size = F.lit(math.log(max(2, total)))
    good = counts.where((F.col("n") >= known) & F.col("word").rlike(r"^\p{L}{2,}$"))
    most = longest(counts, known)
    words, pairs = words.where(F.length("word") <= 2 * most), pairs.where(F.length("word") + F.length("other") <= 2 * most)
    first = good.select(F.col("word").alias("_u"), F.log("n").alias("_lu"))
    second = good.select(F.col("word").alias("_v"), F.log("n").alias("_lv"))
    as_seen = F.log("n") - F.when(F.col("n") < known, LETTER * F.length("word")).otherwise(0.0)  # a word as it stands
    log_n = counts.select("word", as_seen.alias("_ln"))
    long = words.where(F.length("word") >= 4).withColumn("_i", F.explode(F.sequence(F.lit(2), F.length("word") - 2)))
    cut_ = long.select("word", as_seen.alias("_ln"), F.expr("substring(word, 1, _i)").alias("_u"), F.expr("substring(word, _i + 1)").alias("_v"))
    lost = cut_.join(first, "_u").join(second, "_v")
    lost = lost.select("word", F.lit(None).cast("string").alias("other"), F.concat_ws(" ", "_u", "_v").alias("fix"), (F.col("_lu") + F.col("_lv") - F.col("_ln") - size - BLANK).alias("gain"))
    own = pairs.join(log_n, "word").withColumnRenamed("_ln", "_la").join(log_n.select(F.col("word").alias("other"), F.col("_ln").alias("_lb")), "other")
    added = own.withColumn("_u", F.concat("word", "other")).join(first, "_u")
    added = added.select("word", "other", F.col("_u").alias("fix"), (size - F.col("_la") - F.col("_lb") + F.col("_lu") - BLANK).alias("gain"))
    moved = own.withColumn("_d", F.explode(F.array(*map(F.lit, (-2, -1, 1, 2))))).withColumn("_at", F.length("word") + F.col("_d"))
    moved = moved.withColumn("_w", F.concat("word", "other")).where((F.col("_at") >= 2) & (F.col("_at") <= F.length("_w") - 2))
    moved = moved.select("word", "other", "_la", "_lb", F.expr("substring(_w, 1, _at)").alias("_u"), F.expr("substring(_w, _at + 1)").alias("_v")).join(first, "_u").join(second, "_v")
    moved = moved.select("word", "other", F.concat_ws(" ", "_u", "_v").alias("fix"), (F.col("_lu") + F.col("_lv") - F.col("_la") - F.col("_lb") - 2 * BLANK).alias("gain"))
    edges = lost.unionByName(added).unionByName(moved).where(F.col("gain") >= math.log(20))
    return edges.groupBy("word", "other").agg(F.max_by("fix", F.struct("gain", "fix")).alias("fix"), F.max("gain").alias("gain"))


def best_path(edges: list[tuple[int, int, float, int]]) -> list[int]:
    """Of edges (first word, number of words, gain, name) of one text the names of those on its best path."""
    by_start: dict[int, list[tuple[int, int, float, int]]] = defaultdict(list)
    for e in edges:
        by_start[e[0]].append(e)
    nodes = sorted(by_start.keys() | {e[0] + e[1] for e in edges}, reverse=True)
    best: dict[int, tuple[float, int | None, int]] = {}  # gain from here on, the edge taken, the node it leads to
    following = None
    for at in nodes:
        found = (best[following][0], None, following) if following is not None else (0.0, None, -1)
        for _, n, gain, name in by_start.get(at, ()):
            if gain + best[at + n][0] >= found[0]:
                found = (gain + best[at + n][0], name, at + n)
        best[at], following = found, at
    path, at = [], nodes[-1] if nodes else -1
    while at >= 0:
        _, name, to = best[at]
        path += [name] if name is not None else []
        at = to
    return path


def scan_noise(
    documents: DataFrame, *, key: str = "doc_id", text: str = "full_text", kind: str = "doc_type", book: str = "book", ocr: str = "ocr", common: int = 50000
) -> tuple[DataFrame, DataFrame]:
    """Noisy lines of books, and what repairs them.

    ``noise`` (key, line_no, kind) names lines from 1: 'page' for running heads, feet and page numbers, 'hyphen' for a word
    broken by the line end alone, 'chars' for a line with a misread word.  ``fixes`` (key, line_no, word, fix, glued) are the
    words to put: a word for a word, two for one, one or two for two, and with ``glued`` what is to be put when the line is
    joined with the next.  Null and empty texts give no rows; a null ocr counts as unknown.  Keys should be unique.

    The words of every book are judged, whatever its flag and whether or not it shows lines of pages, in one lattice over
    its stream of words without page lines: misread words, blanks lost, added and displaced, and words broken by line ends,
    joined and read together.  Counts are those of the whole corpus, met in joins.  Only the ``common`` most frequent words, a
    bound, go to the workers: these need no judgement by themselves, and pairs of two of them are not looked at.
    """
    key_type = documents.schema[key].dataType.simpleString()
    books = documents.where(F.col(kind) == book)
    counts = cut(word_counts(books, text))
    misread = cut(misread_words(counts, counts))
    usual = counts.join(misread.select("word"), "word", "left_anti").where("n >= 20")
    lexicon = frozenset(r[0] for r in usual.orderBy(F.desc("n"), "word").limit(common).select("word").collect())
    rows = books.select(F.col(key).alias("_k"), F.col(ocr).alias("_ocr"), F.col(text).alias("_t")).where(F.length("_t") > 0)

    def look(cols: dict[str, list]):
        for k, flag, t in zip(cols["_k"], cols["_ocr"], cols["_t"]):
            lines, pages, breaks = scan_lines(t, flag)
            for i in pages:
                yield k, i + 1, 0, "page", None, None, None, None
            broken, carried = {b[0] for b in breaks}, {b[4] for b in breaks}
            for i, head, mark, tail, j in breaks:
                first = re.match(r"(?:[^\W_]|[@|$!])+", tail).group()
                head = head.lstrip("’'")
                yield k, i + 1, len(head), "hyphen", head + first, head + "-" + first, mark, j + 1
            at, end = 0, None  # the number of the next word in the stream; the last word of the line before, if it ends there
            for i, line in enumerate(lines):
                if not line or i in pages:
                    continue
                words = WORD.findall(line)
                if not words:
                    end = None
                    continue
                lo, hi = int(i in carried), len(words) - (i in broken)
                odd = [x for x in range(lo, hi) if words[x] not in lexicon]
                for x in odd:
                    yield k, i + 1, at + x, "word", words[x], None, None, None
                if end and not lo and hi and (end[2] or 0 in odd) and words[0].isalpha() and not _CJK.search(words[0]) and line.lstrip().startswith(words[0]):
                    yield k, end[1], at - 1, "pair", end[0], words[0], None, i + 1
                spans = None
                for x in sorted({y for x in odd for y in (x - 1, x) if lo <= y < hi - 1}):
                    a, b = words[x], words[x + 1]
                    if a.isalpha() and b.isalpha() and not _CJK.search(a):
                        spans = spans or [m.span() for m in WORD.finditer(line)]
                        if spans[x + 1][0] - spans[x][1] == 1 and line[spans[x][1]] == " ":
                            yield k, i + 1, at + x, "pair", a, b, None, None
                last = words[-1]
                end = (last, i + 1, hi - 1 in odd) if i not in broken and last.isalpha() and line.rstrip().endswith(last) else None
                at += len(words)

    asked = cut(map_rows(spread(rows), look, f"_k {key_type}, line_no int, pos int, what string, word string, other string, mark string, tail_no int", 256))
    page = asked.where("what = 'page'").select(F.col("_k").alias(key), "line_no", F.lit("page").alias("kind"))
    odd_words = asked.where("what = 'word'").select("_k", "line_no", "pos", "word")
    odd_pairs = asked.where("what = 'pair'").select("_k", "line_no", "pos", "word", "other", "tail_no")
    total = counts.agg(F.sum("n")).first()[0] or 0
    alone = odd_words.select("word").distinct().join(counts, "word").where(F.col("word").rlike(r"^\p{L}+$"))
    blanks = cut(blank_edges(alone, odd_pairs.select("word", "other").distinct(), counts, total))

    one = odd_words.join(misread.withColumn("chars", F.lit(True)).unionByName(blanks.where("other is null").drop("other").withColumn("chars", F.lit(False))), "word")
    two = odd_pairs.join(blanks.where("other is not null").withColumn("chars", F.lit(False)), ["word", "other"])
    edge = lambda n, word, glued: F.struct("pos", F.lit(n).alias("n"), "line_no", word, "fix", "gain", "chars", glued.alias("glued")).alias("_e")
    edges = one.select("_k", edge(1, F.col("word"), F.lit(False)))
    edges = edges.unionByName(two.select("_k", edge(2, F.concat_ws(" ", "word", "other").alias("word"), F.col("tail_no").isNotNull())))

    def decode(cols: dict[str, list]):
        for k, found in zip(cols["_k"], cols["_es"]):
            found = sorted(found, key=lambda e: (e["pos"], e["n"], e["fix"]))
            for i in best_path([(e["pos"], e["n"], e["gain"], i) for i, e in enumerate(found)]):
                yield k, found[i]["line_no"], found[i]["word"], found[i]["fix"], found[i]["chars"], found[i]["glued"]

    by_text = edges.groupBy("_k").agg(F.collect_list("_e").alias("_es"))
    chosen = cut(map_rows(by_text, decode, f"_k {key_type}, line_no int, word string, fix string, chars boolean, glued boolean", 512))

    hyphens = asked.where("what = 'hyphen'").select("_k", "line_no", "pos", "word", "other", "mark", "tail_no")
    joined = (
        hyphens.join(counts.select("word", F.col("n").alias("n_joined")), "word", "left")
        .join(counts.select(F.col("word").alias("other"), F.col("n").alias("n_hyphen")), "other", "left")
        .fillna(0, ["n_joined", "n_hyphen"])
    )
    hyphen = joined.where((F.col("n_joined") > F.col("n_hyphen")) | (F.col("n_hyphen") == 0))
    # a broken word is read as the word it makes: one that is known nowhere else counts as seen once
    strange = hyphen.where("n_joined < 20").select("word", F.greatest("n_joined", F.lit(1)).alias("n")).distinct()
    glued = cut(hyphen.join(misread_words(strange, counts), "word"))
    head_same = F.expr("substring(fix, 1, pos) = substring(word, 1, pos)")
    where_ = glued.select("_k", F.when(head_same, F.col("tail_no")).otherwise(F.col("line_no")).alias("line_no"))
    chars = chosen.where("chars").select("_k", "line_no").unionByName(where_).distinct()
    noise = page.unionByName(chars.select(F.col("_k").alias(key), "line_no", F.lit("chars").alias("kind"))).unionByName(
        hyphen.select(F.col("_k").alias(key), "line_no", F.lit("hyphen").alias("kind")).distinct()
    )
    fixes = chosen.select("_k", "line_no", "word", "fix", "glued").unionByName(glued.select("_k", "line_no", "word", "fix", F.lit(True).alias("glued")))
    return noise, fixes.withColumnRenamed("_k", key)


def paragraphs(lines: list[str], hard: set[int]) -> list[list[int]]:
    """Line numbers of each paragraph by dynamic programming over the gaps between lines of text.

    A gap is cut or joined; each choice has a cost by what stands on either side of it, and a paragraph of one short line
    that does not end a sentence costs more unless it is set off on both sides.  ``hard`` are gaps (by the line after) with
    a blank line that no page boundary explains.
    """
    n = len(lines)
    if not n:
        return []
    widths = sorted(map(len, lines))
    full = widths[int(0.8 * (n - 1))]
    best: list[tuple[float, float]] = [(0.0, 0.0)]  # cost of (joined, cut) before line i
    back: list[tuple[int, int]] = [(1, 1)]
    for i in range(1, n):
        prev, cur = lines[i - 1].rstrip(), lines[i].lstrip()
        ends = bool(_TERMINAL.search(prev))
        capital = not cur[:1].islower()
        cut_cost = (0.0 if i in hard else 2.5) + (0.0 if ends else 1.5) + (0.0 if capital else 4.0) + (0.0 if len(prev) < 0.75 * full else 0.4)
        join_cost = (4.0 if i in hard else 0.0) + (3.0 if ends and capital and len(prev) < 0.75 * full else 0.0)
        if _CHAPTER.match(prev) or _CHAPTER.match(cur):
            join_cost += 4.0
        j, c = best[-1]
        alone = 0.3
        best.append((min(j, c) + join_cost, min(j, c + alone) + cut_cost))
        back.append((int(c < j), int(c + alone < j)))
    out: list[list[int]] = []
    state = int(best[-1][1] < best[-1][0])
    group: list[int] = []
    for i in range(n - 1, -1, -1):
        group.append(i)
        if state or i == 0:
            out.append(group[::-1])
            group = []
        state = back[i][state]
    return out[::-1]


def put(line: str, fixes: dict[str, str]) -> str:
    """A line with words, and pairs of words, put for others."""
    for pair, fix in fixes.items():
        if " " in pair:
            line = re.sub(rf"(?<!\w){re.escape(pair)}(?!\w)", lambda _: fix, line)  # noqa: B023
    return WORD.sub(lambda m: fixes.get(m.group(), m.group()), line)


def marked_lines(lines: list[str]) -> set[int]:
    """Numbers (from 0) of the lines in fences and environments and of those with tags of blocks; their ends mean something."""
    out: set[int] = set()
    fence, depth = False, 0
    for i, line in enumerate(lines):
        ticks = line.lstrip().startswith("```")
        opened, closed = line.count("\\begin{"), line.count("\\end{")
        if ticks or fence or depth or opened or closed or _BLOCK_TAG.search(line):
            out.add(i)
        fence ^= ticks
        depth = max(0, depth + opened - closed)
    return out


def hard_wrapped(lines: list[str]) -> bool:
    """Whether most lines with a line after them end where the next word would have passed the longest line."""
    kept = [x.rstrip() for x in lines]
    width = max(map(len, kept), default=0)
    inner = [(a, b.lstrip()) for a, b in zip(kept, kept[1:]) if a and b]
    full = sum(len(a) + (1 if _CJK.search(b[:1]) else 1 + len(b.split(None, 1)[0])) > width for a, b in inner)
    return len(inner) >= 2 and width <= 120 and full >= 0.7 * len(inner)


def repair(text: str, pages: set[int], hyphens: set[int], fixes: dict[int, dict[str, str]], glued: dict[str, str] | None = None) -> str:
    """Continuous paragraphs of a scanned text: page lines go, broken words are joined, misread words are put right, also
    joined ones (``glued``).  Lines of marked-up stretches stay lines."""
    lines, hard, gap, at_page = [], set(), False, False
    glue: set[int] = set()
    raw: set[int] = set()
    source = text.split("\n")
    marked = marked_lines(source)
    for i, line in enumerate(source):
        if i + 1 in pages:
            at_page = True
            continue
        if not line.strip() and i not in marked:
            gap = True
            continue
        if gap and not at_page:
            hard.add(len(lines))
        gap = at_page = False
        own = fixes.get(i + 1)
        if own:
            line = put(line, own)
        if i in marked:
            raw.add(len(lines))
        elif i + 1 in hyphens:
            line = re.sub(r"[-=¬­][ \t]*$", "", line)
            glue.add(len(lines))
        lines.append(line)
    out = []
    hard -= {g + 1 for g in glue}
    at = 0
    while at < len(lines):
        to = at + 1
        while to < len(lines) and (to in raw) == (at in raw):
            to += 1
        if at in raw:
            out.append("\n".join(lines[at:to]))
        else:
            for group in paragraphs(lines[at:to], {h - at for h in hard}):
                s = ""
                for i in (at + x for x in group):
                    piece = lines[i].strip()
                    joined = bool(s) and (i - 1 in glue or s.endswith("-") and piece[:1].islower() or (_CJK.search(s[-1]) is not None and _CJK.search(piece[:1]) is not None))
                    s = s + piece if joined or not s else s + " " + piece
                out.append(put(s, glued) if glued else s)
        at = to
    return "\n\n".join(out)


def repair_scans(documents: DataFrame, *, key: str = "doc_id", text: str = "full_text", kind: str = "doc_type", book: str = "book", ocr: str = "ocr", **more) -> DataFrame:
    """(key, text, n_page, n_hyphen, n_chars): the repaired text of every book that is flagged as a scan, has noise or is
    hard-wrapped, also where nothing but line ends goes; see ``scan_noise``."""
    noise, fixes = scan_noise(documents, key=key, text=text, kind=kind, book=book, ocr=ocr, **more)
    key_type = documents.schema[key].dataType.simpleString()
    lines = noise.groupBy(key).agg(
        *(F.collect_set(F.when(F.col("kind") == k, F.col("line_no"))).alias(f"_{k}") for k in ("page", "hyphen", "chars"))
    )
    words = fixes.groupBy(key).agg(F.collect_set(F.struct("line_no", "word", "fix", "glued")).alias("_fixes"))
    books = documents.where((F.col(kind) == book) & (F.length(text) > 0))
    rows = books.select(F.col(key), F.col(ocr).alias("_ocr"), F.col(text).alias("_t")).join(lines, key, "left").join(words, key, "left")

    def run(cols: dict[str, list]):
        for k, flag, t, p, h, c, f in zip(*(cols[x] for x in (key, "_ocr", "_t", "_page", "_hyphen", "_chars", "_fixes"))):
            p, h, c = p or (), h or (), c or ()
            if not (flag or p or h or c or f or hard_wrapped(t.split("\n"))):
                continue
            own: dict[int, dict[str, str]] = defaultdict(dict)
            glued = {}
            for x in f or ():
                (glued if x["glued"] else own[x["line_no"]])[x["word"]] = x["fix"]
            yield k, repair(t, set(p), set(h), own, glued), len(p), len(h), len(c)

    return map_rows(rows, run, f"`{key}` {key_type}, text string, n_page int, n_hyphen int, n_chars int", 128)

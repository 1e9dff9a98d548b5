"""Text out of document files: plain text, HTML and e-books here; scans and rich formats through plug-ins."""

from __future__ import annotations

import base64
import io
import posixpath
import re
import shutil
import subprocess
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from pathlib import Path
from typing import Protocol
from xml.etree import ElementTree

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import READERS
from ..functions.text import sanitize
from ..operators.rows import map_columns, spread
from ..settings import Settings
from .files import document_paths, read_files


class OcrEngine(Protocol):
    """Recognises the text on one page, given as encoded bytes or as pixels (rows x columns[ x colours], 255 is white)."""

    def __call__(self, image: bytes | np.ndarray, *, language: str, negative: bool) -> str: ...


class Renderer(Protocol):
    """The pages or frames of a file of some kind as pixels, one after the other."""

    def __call__(self, data: bytes, kind: str, *, dpi: int) -> Iterator[np.ndarray]: ...


class Unavailable(RuntimeError):
    """A format whose plug-in is not installed."""


class _Text(HTMLParser):
    _HIDDEN = {"script", "style", "template"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self._HIDDEN

    def handle_endtag(self, tag):
        if tag in self._HIDDEN and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden and data:
            self.parts.append(data)


def html_text(markup: str) -> str:
    """All visible text of a page, its parts joined by line feeds."""
    p = _Text()
    p.feed(markup)
    p.close()
    return "\n".join(p.parts)


def html_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "html") -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where("_t is not null")
    return map_columns(spread(rows), lambda c: ((k, html_text(t)) for k, t in zip(c["_k"], c["_t"])), f"`{key}` {kind}, text string", 64)


def plain_text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def epub_text(data: bytes) -> str:
    """The documents of an e-book in reading order, or in order of name where the package file does not tell."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        pages = [n for n in names if n.lower().endswith((".xhtml", ".html", ".htm"))]
        package = next((n for n in names if n.lower().endswith(".opf")), None)
        if package:
            try:
                tree = ElementTree.fromstring(z.read(package))
                ns = {"o": tree.tag.partition("}")[0].lstrip("{")}
                items = {i.get("id"): i.get("href") for i in tree.iterfind(".//o:manifest/o:item", ns)}
                spine = [items.get(r.get("idref")) for r in tree.iterfind(".//o:spine/o:itemref", ns)]
                listed = [posixpath.normpath(posixpath.join(posixpath.dirname(package), h)) for h in spine if h]
                pages = [n for n in listed if n in names] or sorted(pages)
            except ElementTree.ParseError:
                pages = sorted(pages)
        texts = (html_text(z.read(n).decode("utf-8", "replace")) for n in pages)
        return "\n\n".join(x for x in texts if x.strip())


def find_gutter(gray: np.ndarray) -> int:
    """The lightest column in the middle 30 % of a page image (rows x columns, 255 is white)."""
    w = gray.shape[1]
    a, b = int(w * 0.35), max(int(w * 0.35) + 1, int(w * 0.65))
    return a + int(gray[:, a:b].mean(axis=0).argmax())


def split_spread(gray: np.ndarray) -> list[np.ndarray]:
    """Two pages of an image much wider than high, or the image itself."""
    if gray.shape[1] <= 1.3 * gray.shape[0]:
        return [gray]
    cut = find_gutter(gray)
    return [gray[:, :cut], gray[:, cut:]]


def _djvu(program: str, data: bytes, *args: str, timeout: float) -> bytes:
    """The output of one of the DjVu programs, which read files only: scratch of one call, gone when it ends."""
    if not shutil.which(program):
        raise Unavailable(f"{program} is not installed")
    with tempfile.NamedTemporaryFile(suffix=".djvu") as f:
        f.write(data)
        f.flush()
        return subprocess.run([program, *args, f.name], capture_output=True, timeout=timeout, check=True).stdout


def djvu_text(data: bytes, timeout: float = 60) -> str:
    """The text layer by the djvutxt program."""
    return _djvu("djvutxt", data, timeout=timeout).decode("utf-8", "replace")


def netpbm(data: bytes) -> np.ndarray:
    """The pixels of one binary PGM or PPM image."""
    m = re.match(rb"P([56])(?:\s+#[^\n]*)*\s+(\d+)\s+(\d+)\s+(\d+)\s", data)
    if not m or int(m[4]) > 255:
        raise ValueError("not a binary PGM or PPM image of one byte a value")
    w, h, colours = int(m[2]), int(m[3]), 3 if m[1] == b"6" else 1
    pixels = np.frombuffer(data, np.uint8, w * h * colours, m.end())
    return pixels.reshape((h, w, 3) if colours == 3 else (h, w))


def rendered(data: bytes, kind: str, *, dpi: int = 300) -> Iterator[np.ndarray]:
    """Pages by the programs and libraries that are installed: PyMuPDF for PDF, ddjvu for DjVu, Pillow for images and the
    frames of TIFF; PGM and PPM need none."""
    if kind == "pdf":
        try:
            import fitz  # optional
        except ImportError as e:
            raise Unavailable("rendering PDF needs PyMuPDF") from e
        with fitz.open(stream=data, filetype="pdf") as doc:
            for page in doc:
                pix = page.get_pixmap(dpi=dpi, colorspace="gray")
                yield np.frombuffer(pix.samples, np.uint8).reshape(pix.height, pix.stride)[:, : pix.width]
        return
    if kind == "djvu":
        n = int(_djvu("djvused", data, "-e", "n", timeout=30))
        for i in range(1, n + 1):
            yield netpbm(_djvu("ddjvu", data, "-format=pgm", f"-page={i}", f"-scale={dpi}", timeout=60))
        return
    if data[:2] in (b"P5", b"P6"):
        yield netpbm(data)
        return
    try:
        from PIL import Image, ImageSequence  # optional
    except ImportError as e:
        raise Unavailable("images need Pillow") from e
    with Image.open(io.BytesIO(data)) as image:
        for frame in ImageSequence.Iterator(image):
            yield np.asarray(frame.convert("RGB" if frame.mode not in ("1", "L", "I;16") else "L"))


def recognised(data: bytes, kind: str, ocr: OcrEngine, *, language: str = "eng", negative: bool = False, split_spreads: bool = False, dpi: int = 300, render: Renderer | None = None) -> str:
    """The text on all pages of a file, joined by line feeds; with ``split_spreads`` the halves of a double page one by one.

    Without a renderer, an image file goes to the engine as it is."""
    if render is None and kind == "image" and not split_spreads:
        return ocr(data, language=language, negative=negative)
    texts = []
    for page in (render or rendered)(data, kind, dpi=dpi):
        gray = page if page.ndim == 2 else page.mean(axis=2)
        cuts = [0, find_gutter(gray), gray.shape[1]] if split_spreads and gray.shape[1] > 1.3 * gray.shape[0] else [0, gray.shape[1]]
        texts += (ocr(page[:, a:b], language=language, negative=negative) for a, b in zip(cuts, cuts[1:]))
    return "\n".join(t for t in texts if t.strip())


_EMBEDDED = re.compile(r"data:image/(?:png|jpe?g);base64,([A-Za-z0-9+/=\s]+)")


def epub_images(data: bytes) -> Iterator[tuple[bytes, bool]]:
    """(image, whether it is a file of its own) of an e-book of pictures, in the order of their names; pictures of SVG files
    are those embedded in them."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in sorted(z.namelist()):
            low = name.lower()
            if low.endswith((".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp", ".pgm", ".ppm")):
                yield z.read(name), True
            elif low.endswith(".svg"):
                yield from ((base64.b64decode(m[1]), False) for m in _EMBEDDED.finditer(z.read(name).decode("utf-8", "replace")))


def epub_recognised(data: bytes, ocr: OcrEngine, *, min_size: int = 200, render: Renderer | None = None, **more) -> str:
    """The text on the pictures of an e-book; picture files with a side below ``min_size`` pixels are ornaments."""
    texts = []
    for image, own in epub_images(data):
        if own and min_size and any(min(page.shape[:2]) < min_size for page in (render or rendered)(image, "image", dpi=72)):
            continue
        texts.append(recognised(image, "image", ocr, render=render, **more))
    return "\n\n".join(t for t in texts if t.strip())


def pdf_text(data: bytes) -> str:
    try:
        import fitz  # optional
    except ImportError as e:
        raise Unavailable("PDF needs PyMuPDF") from e
    with fitz.open(stream=data, filetype="pdf") as doc:
        return "\n".join(x for p in doc if (x := p.get_text()).strip())


TEXT_READERS: dict[str, Callable[[bytes], str]] = {"text": plain_text, "epub": epub_text, "djvu": djvu_text, "pdf": pdf_text}


def extract(
    data: bytes, kind: str, *, ocr: OcrEngine | None = None, force_ocr: bool = False, min_size: int = 200, render: Renderer | None = None, unpack: Callable[[bytes], str] | None = None, **more
) -> tuple[str | None, bool]:
    """(text or None if there is none, whether it was recognised from images); ``more`` goes to ``recognised``.

    ``unpack`` turns a MOBI file into text or HTML, which no library here does.
    """
    text = ""
    if kind == "mobi":
        if unpack is None:
            raise Unavailable("mobi needs an unpacker")
        got = unpack(data)
        text = html_text(got) if re.search(r"<(?:html|body|p)\b", got, re.I) else got
        return (text, False) if text.strip() else (None, False)
    if kind in TEXT_READERS and not (force_ocr and ocr and kind in ("pdf", "djvu")):
        text = TEXT_READERS[kind](data)
    if text.strip():
        return text, False
    if kind == "epub" and ocr is not None:
        text = epub_recognised(data, ocr, min_size=min_size, render=render, **more)
    elif kind in ("image", "tiff", "pdf", "djvu"):
        if ocr is None:
            raise Unavailable(f"{kind} without a text layer needs an OCR engine")
        text = recognised(data, kind, ocr, render=render, **more)
    else:
        return None, False
    return (text, True) if text.strip() else (None, True)


def missing_languages(requested: str, installed: list[str]) -> list[str]:
    """Of languages joined by plus signs those that are not installed, in order."""
    return [x for x in dict.fromkeys(requested.split("+")) if x and x not in installed]


def options_of(settings: Settings, ocr: OcrEngine | None, *, use_ocr: bool | None = None) -> dict:
    """What ``book_documents`` is to be told by the settings; a run's own wish about OCR beats them."""
    engine = ocr if settings.ocr_enabled(use_ocr) else None
    return {
        "ocr": engine, "force_ocr": settings.force_ocr, "language": settings.ocr_lang, "negative": settings.ocr_negative,
        "split_spreads": settings.split_spreads, "dpi": settings.render_dpi, "min_size": settings.min_image_size,
    }


def book_documents(spark: SparkSession, root: str | Path, *, ocr: OcrEngine | None = None, **options) -> DataFrame:
    """(source, full_text, doc_type, language, ocr, hash, error) of the documents below a folder; a file that cannot be
    read has a null text and the reason."""
    raw = read_files(spark, root, document_paths(root))

    def run(cols):
        for p, data in zip(cols["source"], cols["content"]):
            kind = READERS[re.search(r"\.[^./]*$", p).group().lower()]
            try:
                if data is None:
                    raise FileNotFoundError(p)
                text, scanned = extract(bytes(data), kind, ocr=ocr, **options)
                yield p, text, scanned, None
            except Exception as e:  # one bad file must not end the run
                yield p, None, False, f"{type(e).__name__}: {e}"

    texts = map_columns(raw.select("source", "content"), run, "source string, _t string, ocr boolean, error string", 8)
    hashes = raw.select("source", F.sha2("content", 256).alias("hash"))
    return texts.join(hashes, "source").select("source", sanitize(F.col("_t")).alias("full_text"), F.lit("book").alias("doc_type"), F.lit(None).cast("string").alias("language"), "ocr", "hash", "error")

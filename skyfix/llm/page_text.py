"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: text between block-level tags, with the
path of open block elements (tags, classes, ids). Each block is a vector of the hashed path,
hashed words and a few measures (length, share of link text, punctuation). Containers that say
nothing (``div`` and ``section`` without a name, say) leave no trace in the path: of the others it
holds which names occur, and the innermost ones by their distance from the text. So it matters
neither how deep a text lies nor how often a name recurs. A bidirectional
LSTM in NumPy reads the whole sequence, so each block is labelled with everything before
and after it in view. Blocks labelled as article are the text. Weights come from
``training/train_page_text.py`` (bounded, generated pages) and travel with the job.

Scripts, styles, comments, the head, frames and lists of choices hold no visible text and make
no blocks; a head without an end tag ends where anything else begins, and an element left open
hides nothing after it unless its content is raw. Text in formulas, drawings, objects and
``noscript`` reaches the labeller like any other. Tags end where browsers end them. Character
references are decoded, white space inside a block becomes one space.

Defined results: a null or empty page, or one without article blocks, has the empty text;
pages of any length are read whole; repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import columns

WEIGHTS = Path(__file__).parent / "models" / "page_text.npz"
#: Sizes of the hashed path and word vectors, the measures, and each direction's state.
NAME_SIZE, NEAR_SIZE, WORD_SIZE, MEASURES, STATE = 128, 64, 16, 8, 16
PATH_SIZE = NAME_SIZE + NEAR_SIZE
INPUT = PATH_SIZE + WORD_SIZE + MEASURES
#: Elements that say nothing by their tag, and how many others count by their distance.
PLAIN = set("html body div section span center table tbody tr".split())
NEAREST = 3
#: After so many tags without an end (each is read to the end of the page) tags end at ``>``.
ENDLESS_TAGS = 32
#: Pages labelled together, by padded blocks; a longer page is read in stretches of so many.
GROUP_BLOCKS = 40_000

#: Fixed values (HTML living standard): elements whose content is raw. Without an end tag
#: those of ``TO_END`` run to the end of the page.
RAW = set("script style title textarea iframe".split())
TO_END = set("script style title textarea".split())
#: Elements never shown as text, from a start tag to its own end tag.
HIDDEN = set("template select datalist desc metadata annotation annotation-xml".split())
#: Those of them that are hidden only inside a drawing or a formula.
HIDDEN_INSIDE = {"desc": "svg", "metadata": "svg", "annotation": "math", "annotation-xml": "math"}
#: Elements inside a line of text, drawings and formulas among them.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr meta link base source".split())
INLINE |= set("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd semantics".split())
INLINE |= set("object canvas svg g path rect circle ellipse line polygon polyline defs use symbol text tspan".split())
#: Elements that are a block of their own unless a paragraph is open around them.
EITHER = {"noscript"}
#: Elements that leave an open head open.
OF_HEAD = set("head meta link base basefont bgsound noframes script style title noscript template".split())
SPACE = r"[\t\n\f\r ]"
#: A tag as browsers end it: a quote opens a value only behind an equals sign. A value whose
#: quote never closes ends like one without quotes.
TAG = re.compile(
    r"<(?P<close>/?)(?P<tag>[a-zA-Z][^\t\n\f\r />]*+)"
    rf"(?P<attributes>(?:[\t\n\f\r /]++|[^\t\n\f\r />][^\t\n\f\r />=]*+(?:{SPACE}*+={SPACE}*+(?:\"[^\"]*\"|'[^']*'|(?![\"'])[^\t\n\f\r >]++)?+)?+)*+)>"
)
#: A tag that just ends at the next ``>``, where it has no other end.
BARE_TAG = re.compile(r"<(?P<close>/?)(?P<tag>[a-zA-Z][^\t\n\f\r />]*+)(?P<attributes>[^>]*+)>")
MARKUP = re.compile(r"<(?:/?[a-zA-Z]|[!?]|/[^a-zA-Z])")
COMMENT_END = re.compile(r"--!?>")
RAW_END = {t: re.compile(rf"</{t}(?=[\t\n\f\r />])", re.I) for t in RAW}
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: An element that opens inside one of these closes it first.
CLOSES = {"p": {"p"}, "li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "td", "th", "tr"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
#: What any other element closes.
CHOICES = {"option", "optgroup"}
VOID = {"hr", "embed", "param", "col", "area", "track"}
#: Inline elements that part the words around them.
APART = set("br img input object canvas svg text".split())
PATH_ENDS = 12


def tokens(page: str) -> list[tuple[int, int, str, str, str]]:
    """Tags and other markup in page order: start, end, ``/`` of an end tag, tag, attributes.

    Comments, raw elements and hidden ones are one token without a tag. A hidden element ends
    at its own end tag; where that is missing, only the start tag is left out. Each character
    is read a bounded number of times: after ``ENDLESS_TAGS`` tags without an end all end at ``>``.
    """
    found: list[tuple[int, int, str, str, str]] = []
    failed, inside = 0, Counter()
    opened: dict[str, list[int]] = {t: [] for t in HIDDEN}
    endless: set[str] = set()
    at = 0
    while mark := MARKUP.search(page, at):
        start = mark.start()
        if not page[start + 1].isalpha() and not (page[start + 1] == "/" and page[start + 2].isalpha()):
            if page.startswith("<!--", start):
                # ``<!-->`` and ``<!--->`` are whole comments.
                end = COMMENT_END.search(page, start + 2) if page.startswith((">", "->"), start + 4) else COMMENT_END.search(page, start + 4)
                at = end.end() if end else len(page)
            else:
                at = page.find(">", start) + 1 or len(page)
            found.append((start, at, "", "", ""))
            continue
        m = TAG.match(page, start) if failed < ENDLESS_TAGS else None
        if not m:
            failed += 1
            m = BARE_TAG.match(page, start)
        if not m:
            break  # no tag ends any more: the rest is text
        at = m.end()
        tag = m["tag"].lower()
        if tag in RAW:
            end = None if m["close"] or tag in endless else RAW_END[tag].search(page, at)
            if end:
                close = (TAG.match(page, end.start()) if failed < ENDLESS_TAGS else None) or BARE_TAG.match(page, end.start())
                at = close.end() if close else len(page)
            elif not m["close"]:
                endless.add(tag)
                at = len(page) if tag in TO_END else at
            # The head still sees which element it was.
            found.append((start, at, "", "", tag))
            continue
        found.append((start, at, m["close"], tag, m["attributes"]))
        if tag in ("svg", "math"):
            inside[tag] = max(0, inside[tag] - 1) if m["close"] else inside[tag] + (not m["attributes"].endswith("/"))
        if tag in HIDDEN and (tag not in HIDDEN_INSIDE or inside[HIDDEN_INSIDE[tag]]):
            if not m["close"]:
                opened[tag].append(len(found) - 1)
            elif opened[tag]:
                first = opened[tag].pop()
                start = found[first][0]
                # What opened inside goes with it.
                for places in opened.values():
                    while places and places[-1] > first:
                        places.pop()
                del found[first:]
                found.append((start, at, "", "", tag))
    return found


def blocks(page: str) -> list[tuple[str, str, float]]:
    """Leaf blocks in page order: path, text, share of the text in links.

    A path of more than twice ``PATH_ENDS`` elements keeps that many at both of its ends.
    """
    out: list[tuple[str, str, float]] = []
    stack: list[tuple[str, str]] = []
    depth: Counter[str] = Counter()
    text: list[str] = []
    linked, in_link, at = 0, 0, 0

    def close() -> None:
        nonlocal linked
        words = " ".join("".join(text).split())
        if words and not depth["head"] and not depth["option"]:
            ends = stack if len(stack) <= 2 * PATH_ENDS else stack[:PATH_ENDS] + stack[-PATH_ENDS:]
            out.append((" ".join(n for _, n in ends), words, min(1.0, linked / len(words))))
        text.clear()
        linked = 0

    def leave(tag: str) -> None:
        while depth[tag]:
            name, _ = stack.pop()
            depth[name] -= 1
            if name == tag:
                break

    for start, end, closes, tag, attributes in tokens(page):
        if start > at:
            # Text ends a head whose end tag is left out, as do all elements but those of a head.
            if stack and stack[-1][0] == "head" and not page[at:start].isspace():
                leave("head")
            text.append(html.unescape(page[at:start]))
            linked += (start - at) * (in_link > 0)
        at = end
        if not closes and (tag or attributes) and depth["head"] and (tag or attributes) not in OF_HEAD:
            close()
            leave("head")
        if not tag or tag in INLINE or tag in HIDDEN or (tag in EITHER and depth["p"]):
            if tag == "a":
                in_link = 0 if closes else 1
            elif tag in APART:
                text.append(" ")
            continue
        close()
        in_link = 0
        if closes:
            leave(tag)
        elif tag not in VOID and not attributes.endswith("/"):
            ends = CLOSES.get(tag, {"p"}) | (set() if tag in CHOICES else CHOICES)
            while stack and stack[-1][0] in ends:
                leave(stack[-1][0])
            names = " ".join(a or b or c for a, b, c in NAMES.findall(attributes)).lower()
            stack.append((tag, " ".join([tag, *("." + n for n in re.split(r"[\s_-]+", names) if n)])))
            depth[tag] += 1
    if stack and stack[-1][0] == "head" and page[at:].strip():
        leave("head")
    text.append(html.unescape(page[at:]))
    close()
    return out


def path_vector(path: str) -> np.ndarray:
    """Which names occur in the path (hashed), and the tags of its innermost telling elements."""
    v = np.zeros(PATH_SIZE, np.float32)
    elements: list[list[str]] = []
    for name in path.split():
        if name.startswith(".") and elements:
            elements[-1].append(name)
        else:
            elements.append([name])
    telling = [e for e in elements if len(e) > 1 or e[0] not in PLAIN]
    for name in {n for e in telling for n in e if n not in PLAIN}:
        v[crc32(name.encode()) % NAME_SIZE] = 1.0
    for k, e in enumerate(reversed(telling[-NEAREST:])):
        v[NAME_SIZE + crc32(f"{k}{e[0]}".encode()) % NEAR_SIZE] = 1.0
    return v


def features(found: list[tuple[str, str, float]], paths: dict[str, np.ndarray], first: int = 0, total: int = 0) -> np.ndarray:
    """Vectors of a page's blocks, or of those from ``first`` on of a page of ``total``."""
    x = np.zeros((len(found), INPUT), np.float32)
    for i, (path, text, linked) in enumerate(found):
        if path not in paths:
            if len(paths) > 50_000:
                paths.clear()
            paths[path] = path_vector(path)
        x[i, :PATH_SIZE] = paths[path]
        words = text.lower().encode("utf-8", "replace").split()
        hashed = np.fromiter((crc32(w) % WORD_SIZE for w in words), np.int64, len(words))
        x[i, PATH_SIZE : PATH_SIZE + WORD_SIZE] = np.bincount(hashed, minlength=WORD_SIZE) / max(1, len(words))
        n = len(text)
        x[i, PATH_SIZE + WORD_SIZE :] = (
            np.log1p(len(words)) / 5, np.log1p(n) / 7, linked, text[-1] in ".!?…:\"", text.count(",") / (1 + len(words)),
            sum(map(text.count, "©|»·")) > 0, len(words) > 12, (first + i) / (total or len(found)),
        )
    return x


State = tuple[np.ndarray, np.ndarray]


def lstm(x: np.ndarray, w: dict[str, np.ndarray], side: str, state: State | None = None) -> tuple[np.ndarray, State]:
    """Outputs of one direction over padded sequences ``x[page, place, :]`` (the caller
    reverses), and the state to go on from."""
    n, steps, _ = x.shape
    into = x @ w[side + "x"] + w[side + "b"]
    h, c = state or (np.zeros((n, STATE), np.float32), np.zeros((n, STATE), np.float32))
    out = np.zeros((n, steps, STATE), np.float32)
    for t in range(steps):
        z = into[:, t] + h @ w[side + "h"]
        gates = 1 / (1 + np.exp(-z[:, : 3 * STATE]))
        i, f, o = gates[:, :STATE], gates[:, STATE : 2 * STATE], gates[:, 2 * STATE :]
        c = f * c + i * np.tanh(z[:, 3 * STATE :])
        h = o * np.tanh(c)
        out[:, t] = h
    return out, (h, c)


def reversed_rows(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each page's own places in reverse, padding left at the end."""
    place = np.arange(x.shape[1])[None, :]
    back = np.where(place < lengths[:, None], lengths[:, None] - 1 - place, place)
    return np.take_along_axis(x, back[:, :, None], axis=1)


def scores(pages: list[np.ndarray], w: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Log-odds of article for every block of every page."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
    group: list[int] = []
    for k, i in enumerate(order):
        if not len(pages[i]):
            continue
        group.append(i)
        last = k + 1 == len(order)
        if last or (len(group) + 1) * len(pages[order[k + 1]]) > GROUP_BLOCKS:
            lengths = np.array([len(pages[j]) for j in group])
            x = np.zeros((len(group), lengths.max(), INPUT), np.float32)
            for row, j in enumerate(group):
                x[row, : len(pages[j])] = pages[j]
            ahead, _ = lstm(x, w, "f")
            back = reversed_rows(lstm(reversed_rows(x, lengths), w, "r")[0], lengths)
            z = np.concatenate([ahead, back, x], axis=2) @ w["out"] + w["bias"]
            for row, j in enumerate(group):
                out[j] = z[row, : lengths[row], 0]
            group = []
    return out


def long_scores(found: list[tuple[str, str, float]], paths: dict[str, np.ndarray], w: dict[str, np.ndarray], step: int = GROUP_BLOCKS) -> np.ndarray:
    """The same for one page of any length, ``step`` blocks at a time: each direction's state
    goes on from one stretch to the next, so vectors of the whole page never stand side by side."""
    z = np.zeros(len(found), np.float32)
    starts = range(0, len(found), step)
    vectors = lambda at: features(found[at : at + step], paths, at, len(found))[None]
    parts = {"f": w["out"][:STATE], "r": w["out"][STATE : 2 * STATE], "": w["out"][2 * STATE :]}
    state = None
    for at in starts:
        x = vectors(at)
        out, state = lstm(x, w, "f", state)
        z[at : at + step] += (out @ parts["f"] + x @ parts[""] + w["bias"])[0, :, 0]
    state = None
    for at in reversed(starts):
        out, state = lstm(vectors(at)[:, ::-1], w, "r", state)
        z[at : at + step] += (out @ parts["r"])[0, ::-1, 0]
    return z


def load_weights() -> dict[str, np.ndarray]:
    with np.load(WEIGHTS) as f:
        return {k: f[k].astype(np.float32) for k in f.files}


def label(df: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """``page_id, url, blocks``: every block's ``path, text, score`` (article above 0)."""
    rows = columns(df, page_id=id_col, url=url_col, html=html_col)
    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    weights = load_weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [blocks(p or "") for p in part.column(2).to_pylist()]
                scored = scores([features(b, paths) if len(b) <= GROUP_BLOCKS else features([], paths) for b in found], weights)
                scored = [long_scores(b, paths, weights) if len(b) > GROUP_BLOCKS else z for b, z in zip(found, scored)]
                ends = np.concatenate([[0], np.cumsum([len(b) for b in found])])
                flat = pa.StructArray.from_arrays(
                    [pa.array([x[0] for b in found for x in b], pa.string()), pa.array([x[1] for b in found for x in b], pa.string()), pa.array(np.concatenate([np.zeros(0, np.float32), *scored]), pa.float32())],
                    names=["path", "text", "score"],
                )
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["page_id", "url", "blocks"])

    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, blocks array<struct<path:string,text:string,score:float>>")


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """``page_id, url, text``: the article blocks, joined by line feeds."""
    kept = "array_join(transform(filter(blocks, b -> b.score > 0), b -> b.text), '\\n')"
    return label(df, id_col, html_col, url_col).selectExpr("page_id", "url", f"{kept} AS text")

"""Main-text extraction with a bidirectional LSTM over the text blocks of a page.

A page is cut into leaf blocks, in page order. Each block is described by the tags, classes
and ids on its path, by hashed vectors of its words and by a few shares; a numpy LSTM reads
the blocks forwards and another one backwards, so each decision sees the whole page.

There is no labelled page. The network learns from a bounded sample of the pages themselves:
blocks whose path says plainly what they are (navigation, footer, advertisement, ...) against
the others, on the pages as they are and on copies whose parts are wrapped anew.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .words import chunks, cut, mix

# HTML elements that start a block of their own, and those whose content is never text.
BLOCK_TAGS = set(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
SILENT_TAGS = set("head script style noscript template svg iframe object canvas math audio video textarea".split())
VOID_TAGS = set("area base br col embed hr img input link meta source track wbr".split())
# Opening one of these ends an open element of the same family.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
         "option": {"option"}, "optgroup": {"option", "optgroup"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"},
          "option": {"select"}, "optgroup": {"select"}}

# Names that say what a part of a page is; the teacher of the network.
BOILER_TAGS = set("nav footer aside form button menu select dialog".split())
BOILER_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner comment comments reply "
    "replies disqus cookie cookies consent notice notices gdpr sidebar side menu nav navbar navigation navi breadcrumb "
    "breadcrumbs footer foot header masthead topbar share sharing social related recommended subscribe newsletter "
    "signup login search popup modal overlay widget widgets toolbar pagination pager tags copyright legal alert".split()
)
CONTENT_TAGS = {"article", "main"}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_QUOTE_OR_END = re.compile(r"""["'>]""")
DEEPEST = 512  # elements that stand deeper are not opened, as in browsers
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b|display\s*:\s*none""", re.I)


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: float  # share of the characters inside links


def _tokens(tag: str, attrs: str) -> tuple[str, ...]:
    out = [tag]
    if attrs:
        for _, value in _NAMES.findall(attrs):
            out += ["." + part for part in re.split(r"[\s_\-]+", value.strip("\"'").lower()) if part]
        if _HIDDEN.search(attrs):
            out.append(".hidden")
    return tuple(out)


class _Markup:
    """Finds the markup of a page from left to right; no part is read again and again, however broken.

    A tag ends at the first ``>`` outside quotes, or at the first one at all where quotes do not
    close. Where an attempt by quotes has failed once, a later one that comes to the same quote
    fails too, so it stops there.
    """

    def __init__(self, html: str):
        self.html = html
        self.last_end = html.rfind(">")
        self.last_quote = {q: html.rfind(q) for q in "\"'"}
        self.failed: set[int] = set()

    def _tag_end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag whose attributes begin at ``at``."""
        seen, place = [], at
        while found := _QUOTE_OR_END.search(self.html, place):
            if found[0] == ">":
                return found.start()
            opened = found.start()
            seen.append(opened)
            if opened in self.failed or self.last_quote[found[0]] <= opened:
                break
            place = self.html.index(found[0], opened + 1) + 1
        self.failed.update(seen)
        return self.html.index(">", at)

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """``(start, end, tag, closing, attributes)`` of the next markup; the tag is empty for comments and the like."""
        html = self.html
        while (start := html.find("<", at)) >= 0:
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(html), "", False, ""
            if start < self.last_end:
                if html[start + 1] in "!?":
                    return start, html.index(">", start + 2) + 1, "", False, ""
                if found := _TAG.match(html, start):
                    end = self._tag_end(found.end())
                    return start, end + 1, found[2].lower(), bool(found[1]), html[found.end() : end]
            at = start + 1
        return None


def blocks_of(html: str | None) -> list[Block]:
    """The leaf blocks of a page. Unclosed, crossing and unknown tags are taken as browsers mostly do."""
    html = html or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    state = {"links": 0, "linked": 0}

    def flush() -> None:
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                path = tuple(dict.fromkeys(t for _, tokens in stack for t in tokens))
                leaf = ("leaf:" + stack[-1][0],) if stack else ()
                out.append(Block(path + leaf, whole, min(1.0, state["linked"] / max(len(whole), 1))))
            text.clear()
        state["linked"] = 0

    def put(raw: str) -> None:
        if raw:
            plain = html_lib.unescape(raw)
            text.append(plain)
            if state["links"]:
                state["linked"] += len(plain.strip())

    def pop_to(depth: int) -> None:
        flush()
        del stack[depth:]
        state["links"] = 0

    at, end = 0, len(html)
    markup, never_closed = _Markup(html), set()
    while at < end:
        found = markup.next(at)
        if found is None:
            put(html[at:])
            break
        start, following, tag, closing, attrs = found
        put(html[at:start])
        at = following
        if not tag:
            continue
        if tag in SILENT_TAGS:
            if not closing and not attrs.endswith("/"):
                stop = None
                if tag not in never_closed:
                    stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>" + (r"|(?=<body\b)" if tag == "head" else ""), re.I).search(html, at)
                    if stop is None:
                        never_closed.add(tag)
                at = stop.end() if stop else (end if tag in ("script", "style") else at)
            continue
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            state["links"] = 0 if closing else 1
        elif tag not in BLOCK_TAGS:
            continue
        elif closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    pop_to(depth)
                    break
        else:
            flush()
            state["links"] = 0
            if tag in _ENDS:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] in _SCOPE[tag]:
                        break
                    if stack[depth][0] in _ENDS[tag]:
                        del stack[depth:]
                        break
            elif stack and stack[-1][0] == "p":
                stack.pop()
            if len(stack) < DEEPEST and tag not in VOID_TAGS and not (tag in ("html", "body") and any(t == tag for t, _ in stack)):
                stack.append((tag, _tokens(tag, attrs)))
    flush()
    return out


def teacher(path: tuple[str, ...]) -> int:
    """1 for main text, by the plain words of the path. A header inside the article belongs to it."""
    inside = bool(CONTENT_TAGS & set(path))
    for token in path:
        if token in BOILER_TAGS or (token == "header" and not inside):
            return 0
        if token.startswith(".") and (token[1:] in BOILER_NAMES or token == ".hidden"):
            return 0
    return 1


# How training copies wrap their parts anew.
_WRAP_CONTENT = [("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", ".post"), ("section", ".entry"),
                 ("div", ".main"), ("article", "section"), ("div", ".article", ".body"), ()]
_WRAP_BOILER = [("nav", "ul", "li"), ("header",), ("header", "div"), ("footer",), ("footer", "div"), ("aside",), ("aside", "div"),
                ("form",), ("form", "div"), ("button",), ("dialog",), ("menu", "li"), ("select", "option"), ("article", "aside"), ("article", "footer")]


def _rewrapped(page: list[tuple[Block, int]], rng: np.random.Generator) -> list[tuple[Block, int]]:
    out = []
    names = sorted(BOILER_NAMES)
    body = ("html", "body") if rng.random() < 0.8 else ()
    content = _WRAP_CONTENT[rng.integers(len(_WRAP_CONTENT))]
    extra: list[tuple[Block, int]] = []
    texts = [b for b, _ in page]
    for _ in range(rng.integers(1, 6)):  # parts that the page lacks, with any of its texts
        b = texts[rng.integers(len(texts))]
        for _ in range(rng.integers(1, 4)):
            extra.append((b, 0))
    kept = [(b, y) for b, y in page if rng.random() < 0.7] or list(page)  # shorter and longer pages
    places = sorted(rng.integers(0, len(kept) + 1, len(extra)), reverse=True)
    for place, item in zip(places, extra):
        kept.insert(place, item)
    wrap, last = (), None
    for b, y in kept:
        if y != last or (not y and rng.random() < 0.3):
            if y:
                wrap = content
            elif rng.random() < 0.5:
                wrap = _WRAP_BOILER[rng.integers(len(_WRAP_BOILER))]
            else:
                tag = ("div", "section", "ul", "p")[rng.integers(4)]
                within = content if rng.random() < 0.3 else ()
                wrap = (*within, tag, "." + names[rng.integers(len(names))])
            last = y
        leaf = ("p", "h1", "h2", "li", "blockquote", "div")[rng.choice(6, p=[0.6, 0.08, 0.08, 0.08, 0.06, 0.1])]
        leaves = ("ul", leaf) if leaf == "li" else (leaf,)
        noise = ("div", f".x{rng.integers(100_000)}") if rng.random() < 0.35 else ()
        path = tuple(dict.fromkeys((*body, *noise, *wrap, *leaves) if rng.random() < 0.5 else (*body, *wrap, *noise, *leaves)))
        text = b.text
        if rng.random() < 0.4:  # neither length nor words alone tell the parts apart
            text = texts[rng.integers(len(texts))].text
        if rng.random() < 0.4:
            text = " ".join(text.split()[: rng.integers(1, 12)])
        out.append((Block((*path, "leaf:" + leaf), text, rng.random() * (rng.random() < (0.15 if y else 0.5))), y))
    return out


PATH, WORD, SHARES, HIDDEN = 2048, 12, 4, 12


def _path_row(path: tuple[str, ...]) -> np.ndarray:
    row = np.zeros(PATH, np.float32)
    for token in path:
        row[zlib.crc32(token.encode()) % PATH] = 1.0
    return row


def vectors(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct path rows, the path number of each block, and its word vector with its shares."""
    kinds: dict[tuple[str, ...], int] = {}
    which = np.fromiter((kinds.setdefault(b.path, len(kinds)) for b in blocks), np.int64, len(blocks))
    rows = np.stack([_path_row(p) for p in kinds]) if kinds else np.zeros((0, PATH), np.float32)
    rest = np.zeros((len(blocks), WORD + SHARES), np.float32)
    for first, chunk in chunks([b.text for b in blocks]):
        words = cut(chunk)
        counts = words.counts()
        for d in range(WORD):  # hashed signs, averaged over the words of a block
            sign = (((words.hashes >> np.uint64(d + 5)) & np.uint64(1)).astype(np.float64) * 2) - 1
            rest[first : first + len(chunk), d] = np.bincount(words.owner, weights=sign, minlength=len(chunk)) / np.maximum(counts, 1)
        rest[first : first + len(chunk), WORD] = np.log1p(counts) / 5
    for i, b in enumerate(blocks):
        rest[i, WORD + 1 :] = (b.linked, b.text[-1] in ".!?…", min(len(b.text), 1000) / 1000)
    return rows, which, rest


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """One direction; gates in the order input, forget, output, candidate."""

    def __init__(self, inputs: int, rng: np.random.Generator):
        self.wx = (rng.standard_normal((inputs, 4 * HIDDEN)) * 0.15).astype(np.float32)
        self.wh = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.15).astype(np.float32)
        self.b = np.zeros(4 * HIDDEN, np.float32)
        self.b[HIDDEN : 2 * HIDDEN] = 1.0

    def forward(self, z: np.ndarray, mask: np.ndarray, keep: bool = False):
        """``z``: time x batch x gates, the inputs times ``wx``; padding leaves the state as it is."""
        steps, batch, _ = z.shape
        h, c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
        out, trace = np.zeros((steps, batch, HIDDEN), np.float32), []
        for t in range(steps):
            a = z[t] + h @ self.wh + self.b
            gates = _sigmoid(a[:, : 3 * HIDDEN])
            g = np.tanh(a[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            h2 = o * tc
            m = mask[t][:, None]
            if keep:
                trace.append((h, c, i, f, o, g, tc, m))
            h, c = np.where(m, h2, h), np.where(m, c2, c)
            out[t] = h
        return (out, trace) if keep else out

    def backward(self, dout: np.ndarray, trace: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of the gate inputs (time x batch x gates), of ``wh`` and of ``b``."""
        steps, batch, _ = dout.shape
        dz = np.zeros((steps, batch, 4 * HIDDEN), np.float32)
        dwh = np.zeros_like(self.wh)
        dh, dc = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, g, tc, m = trace[t]
            dh = dh + dout[t]
            dh2, dc2 = dh * m, dc * m
            dct = dc2 + dh2 * o * (1 - tc * tc)
            da = np.concatenate((dct * g * i * (1 - i), dct * c * f * (1 - f), dh2 * tc * o * (1 - o), dct * i * (1 - g * g)), axis=1)
            dz[t] = da
            dwh += h.T @ da
            dh = da @ self.wh.T + dh * (1 - m)
            dc = dct * f + dc * (1 - m)
        return dz, dwh, dz.sum(axis=(0, 1))


class Labeller:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.sides = [Lstm(PATH + WORD + SHARES, rng) for _ in range(2)]
        self.out = (rng.standard_normal(2 * HIDDEN) * 0.3).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def weights(self) -> list[np.ndarray]:
        return [w for s in self.sides for w in (s.wx, s.wh, s.b)] + [self.out, self.bias]

    def to_bytes(self) -> bytes:
        return np.concatenate([w.ravel() for w in self.weights()]).astype(np.float32).tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Labeller:
        self, flat, at = cls(), np.frombuffer(raw, np.float32), 0
        for w in self.weights():
            w[...] = flat[at : at + w.size].reshape(w.shape)
            at += w.size
        return self

    @staticmethod
    def _order(lengths: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Block number at (time, page), and the mask; backwards for side 1."""
        steps = int(lengths.max())
        t = np.arange(steps)[:, None]
        mask = t < lengths
        within = lengths - 1 - t if side else t
        first = np.cumsum(lengths) - lengths
        return np.where(mask, first + within, 0), mask

    def logits(self, lengths: np.ndarray, rows: np.ndarray, which: np.ndarray, rest: np.ndarray, keep: bool = False):
        hidden = np.zeros((int(lengths.sum()), 2 * HIDDEN), np.float32)
        traces = []
        for k, side in enumerate(self.sides):
            z = (rows @ side.wx[:PATH])[which] + rest @ side.wx[PATH:]
            at, mask = self._order(lengths, k)
            got = side.forward(z[at], mask, keep)
            states, trace = got if keep else (got, None)
            hidden[at[mask], k * HIDDEN : (k + 1) * HIDDEN] = states[mask]
            traces.append((at, mask, trace))
        result = hidden @ self.out + self.bias[0]
        return (result, hidden, traces) if keep else result

    def step(self, pages: list[list[tuple[Block, int]]], rate: float, memory: list) -> float:
        """One step of Adam on a batch of labelled pages; the mean loss before it."""
        lengths = np.array([len(p) for p in pages])
        flat = [b for p in pages for b, _ in p]
        y = np.array([v for p in pages for _, v in p], np.float32)
        rows, which, rest = vectors(flat)
        logit, hidden, traces = self.logits(lengths, rows, which, rest, keep=True)
        p = _sigmoid(logit)
        d = ((p - y) / len(y)).astype(np.float32)
        grads = []
        for k, (at, mask, trace) in enumerate(traces):
            dout = np.zeros((*at.shape, HIDDEN), np.float32)
            dout[mask] = np.outer(d[at[mask]], self.out[k * HIDDEN : (k + 1) * HIDDEN])
            dz, dwh, db = self.sides[k].backward(dout, trace)
            per_block = np.zeros((len(flat), 4 * HIDDEN), np.float32)
            per_block[at[mask]] = dz[mask]
            per_path = np.zeros((len(rows), 4 * HIDDEN), np.float32)
            np.add.at(per_path, which, per_block)
            grads += [np.concatenate((rows.T @ per_path, rest.T @ per_block)), dwh, db]
        grads += [hidden.T @ d, np.array([d.sum()], np.float32)]
        if not memory:
            memory += [[np.zeros_like(w), np.zeros_like(w)] for w in self.weights()] + [0]
        memory[-1] += 1
        for w, g, m in zip(self.weights(), grads, memory):
            m[0][...] = 0.9 * m[0] + 0.1 * g
            m[1][...] = 0.99 * m[1] + 0.01 * g * g
            w -= rate * (m[0] / (1 - 0.9 ** memory[-1])) / (np.sqrt(m[1] / (1 - 0.99 ** memory[-1])) + 1e-6)
        return float(-np.mean(np.log(np.where(y > 0, p, 1 - p) + 1e-9)))


def train(pages: list[str], max_blocks: int = 400, copies: int = 4, epochs: int = 10, batch: int = 16, seed: int = 5) -> Labeller:
    """A network taught by the first ``max_blocks`` blocks of each page, as they are and in ``copies`` other wrappers."""
    rng, model, memory = np.random.default_rng(seed), Labeller(seed), []
    real = [[(b, teacher(b.path)) for b in blocks_of(p)][:max_blocks] for p in pages]
    real = [p for p in real if p]
    for epoch in range(epochs if real else 0):
        data = real + [_rewrapped(p, rng) for p in real for _ in range(copies)]
        order = rng.permutation(len(data))
        for at in range(0, len(order), batch):
            model.step([data[i] for i in order[at : at + batch]], 0.01 * (1 - epoch / epochs), memory)
    return model


BATCH_BLOCKS = 20_000


def extract(model: Labeller, pages: list[str | None]) -> list[str]:
    """Main text of each page: the chosen blocks in page order, one per line."""
    out = [""] * len(pages)
    parsed: list[tuple[int, list[Block]]] = []

    def label() -> None:
        parsed.sort(key=lambda x: len(x[1]))
        at = 0
        while at < len(parsed):
            stop, longest = at, 0
            while stop < len(parsed) and (stop == at or len(parsed[stop][1]) * (stop - at + 1) <= BATCH_BLOCKS):
                stop += 1
            group = parsed[at:stop]
            lengths = np.array([len(b) for _, b in group])
            chosen = model.logits(lengths, *vectors([b for _, bs in group for b in bs])) > 0
            first = 0
            for i, bs in group:
                out[i] = "\n".join(b.text for b, yes in zip(bs, chosen[first : first + len(bs)]) if yes)
                first += len(bs)
            at = stop
        parsed.clear()

    held = 0
    for i, page in enumerate(pages):
        found = blocks_of(page)
        if found:
            parsed.append((i, found))
            held += len(found)
        if held >= BATCH_BLOCKS:
            label()
            held = 0
    label()
    return out


_WEIGHTS = T.StructType([T.StructField("weights", T.BinaryType())])


def _fit(batches: Iterator[pd.DataFrame], max_blocks: int) -> Iterator[pd.DataFrame]:
    held = [b for b in batches if len(b)]
    if not held:
        return
    rows = pd.concat(held, ignore_index=True)
    yield pd.DataFrame({"weights": [train(rows["html"].tolist(), max_blocks).to_bytes()]})


def training_pages(pages: DataFrame, max_pages: int, id_col: str, html_col: str) -> DataFrame:
    """``_i, html``: about ``max_pages`` distinct pages, picked by a hash of the id, or of the page where the id is null.

    At most twice ``max_pages`` rows, however many rows share an id; of more, those of the smallest page hash.
    Where no id is picked, because few ids repeat over all rows, pages are picked by their own hash.
    """
    rows = pages.filter(F.col(html_col).isNotNull()).select(F.col(id_col).alias("_i"), F.col(html_col).alias("html"))
    bound = F.lit(float(max_pages) / max(pages.count(), 1))
    own = F.xxhash64("html")

    def drawn(key: Column) -> DataFrame:
        share = F.pmod(key, F.lit(1 << 30)) / F.lit(float(1 << 30))
        return rows.filter(share < bound).distinct().orderBy(own, "_i").limit(2 * max_pages)

    picked = drawn(F.when(F.col("_i").isNull(), own).otherwise(F.xxhash64("_i")))
    return drawn(own) if picked.isEmpty() else picked


def extract_main_text(
    pages: DataFrame, max_pages: int = 150, id_col: str = "page_id", html_col: str = "html", max_blocks: int = 400
) -> DataFrame:
    """Add ``text``, the main text of every page; all blocks that the network takes for it, whole.

    About ``max_pages`` pages, picked by :func:`training_pages`, teach the network (in one task; a
    training page longer than ``max_blocks`` blocks is learned from in part, extraction always reads all).
    Null and empty pages and pages without text give the empty string; rows that repeat are all
    answered; other columns pass through; an empty table gives an empty result.
    """
    sample = training_pages(pages, max_pages, id_col, html_col).repartition(1).sortWithinPartitions("_i", "html")
    row = sample.mapInPandas(lambda batches: _fit(batches, max_blocks), _WEIGHTS).first()
    shared = pages.sparkSession.sparkContext.broadcast(row.weights if row else Labeller().to_bytes())

    @F.pandas_udf(T.StringType())
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Labeller.from_bytes(shared.value)
        for html in batches:
            yield pd.Series(extract(model, html.tolist()), dtype=object)

    return pages.withColumn("text", answer(F.col(html_col)))

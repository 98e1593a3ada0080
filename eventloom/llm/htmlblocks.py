"""HTML main text by a recurrent block labeller.

A page is cut into leaf blocks in order; each is a vector of its hashed tag path, its
hashed words and a few measures. A bidirectional LSTM (numpy) reads the whole sequence
and classifies every block, so that a block is judged with the page around it. The model
is trained on the driver from a bounded sample of ``SAMPLE`` pages (whole, cut into runs of
``RUN`` blocks), on labels that tag and class names give away, together with made-up pages
of other layouts from the sample's words. From half of them all names are taken, and tags
that name a part are made plain, before the model reads them: it then has to tell furniture
by links, length, stops, place and neighbours, and so reads pages whose names say nothing.

Defined cases: a null or empty page has an empty text; scripts, styles, forms, markup
and comments are never blocks; white space of a block becomes one space; an unclosed
script or comment runs to the end. Repeated rows are read each. Other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that the model is trained on, at most.
SAMPLE = 400
PATHS, WORDS, MEASURES, HIDDEN = 192, 64, 6, 24
#: Blocks of a page that are read in training at once.
RUN = 300

#: Element names of HTML by their part in the page.
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template svg iframe object head title form button select textarea option canvas audio video".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Elements that a head may hold; any other one, or text, ends it.
IN_HEAD = frozenset("base link meta noscript script style template title head html".split())
#: Names in tags, classes and ids that tell furniture from content.
FURNITURE = frozenset("nav menu header footer aside sidebar ad ads advert advertisement banner sponsor sponsored promo cookie cookies consent notice notification alert comment comments reply replies disqus share social related recommended subscribe newsletter breadcrumb breadcrumbs pagination pager widget popup modal login signup copyright legal toolbar masthead".split())
CONTENT = frozenset("article main content story post entry body text".split())
#: Elements that name a part of a page.
PARTS = frozenset("nav header footer aside main article section menu".split())

TOKEN = re.compile(
    r"<!---?>|<!--.*?(?:--!?>|\Z)|<(script|style|noscript|template|svg|iframe|object|textarea|title)(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>",
    re.S | re.I,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")


def blocks(page: str | None) -> list[tuple[str, tuple[str, ...], float]]:
    """(text, names on the path, share of characters in links) of every leaf block, in order."""
    page = page or ""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out: list[tuple[str, tuple[str, ...], float]] = []
    parts: list[str] = []
    links, at, path, seen = 0, 0, (), False

    def flush() -> None:
        nonlocal links, seen
        text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            out.append((text, path, min(1.0, links / max(1, len(text)))))
        parts.clear()
        links, seen = 0, False

    def body() -> None:
        """Ends a head whose end tag is left out."""
        at_head = next((i for i, (t, _) in enumerate(stack) if t == "head"), None)
        if at_head is not None:
            del stack[at_head:]

    def say(raw: str) -> None:
        nonlocal links, path, seen
        if raw and not raw.isspace():
            body()
        if raw and not any(t in UNSEEN for t, _ in stack):
            if not seen:
                path = tuple(n for t, names in stack if t not in INLINE or names for n in (t, *names))
            parts.append(raw)
            seen = seen or not raw.isspace()
            if any(t == "a" for t, _ in stack):
                links += len(raw.strip())

    for m in TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if m[2]:
            if name == "p" or name not in INLINE:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
        elif name == "br":
            parts.append(" ")
        else:
            if name not in IN_HEAD:
                body()
            if name not in INLINE:
                flush()
                while stack and stack[-1][0] in INLINE:
                    stack.pop()
                if stack and stack[-1][0] == "p":
                    stack.pop()
                while stack and stack[-1][0] in CLOSES.get(name, ()):
                    stack.pop()
            if name not in VOID and not m[4].endswith("/"):
                names = " ".join(next((g for g in found if g), "") for found in NAMES.findall(m[4])) if "=" in m[4] else ""
                stack.append((name, told_names(names)))
    say(page[at:])
    flush()
    return out


def told_names(names: str) -> tuple[str, ...]:
    """The words of classes and ids; of a name of three words or more, which tells a topic rather than a part, only the last."""
    out: list[str] = []
    for name in names.lower().split():
        words = re.findall(r"[a-z]+", name)
        out += words if len(words) <= 2 else words[-1:]
    return tuple(out)


def nameless(path: tuple[str, ...]) -> tuple[str, ...]:
    """A path as on a page whose names say nothing."""
    return tuple(n for n in ("div" if n in PARTS else n for n in path) if n not in FURNITURE and n not in CONTENT or n == "body")


def told(path: tuple[str, ...]) -> int:
    """1 if the names on a block's path say content, 0 if furniture."""
    return int(not FURNITURE & set(path))


_memo: dict[tuple[int, str], int] = {}


def slot(kind: int, word: str, slots: int) -> int:
    key = (kind, word)
    if key not in _memo:
        if len(_memo) > 200_000:
            _memo.clear()
        _memo[key] = zlib.crc32(f"{kind} {word}".encode("utf-8", "surrogatepass")) % slots
    return _memo[key]


def vectors(found: list[tuple[str, tuple[str, ...], float]]) -> np.ndarray:
    x = np.zeros((len(found), PATHS + WORDS + MEASURES), np.float32)
    for i, (text, path, links) in enumerate(found):
        for n in path:
            x[i, slot(0, n, PATHS)] = 1
        words = text.lower().split()
        if words:
            x[i, PATHS : PATHS + WORDS] = np.bincount([slot(1, w, WORDS) for w in words], minlength=WORDS)
            x[i, PATHS : PATHS + WORDS] /= np.linalg.norm(x[i, PATHS : PATHS + WORDS])
        x[i, -6:] = np.log1p(len(words)) / 5, links, float(text[-1:] in ".!?…"), (i + 1) / len(found), min(i, 20) / 20, float(any(c in text[:40] for c in "©®"))
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output per block, over padded batches (batch, time, inputs)."""

    def __init__(self, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        n = PATHS + WORDS + MEASURES
        make = lambda a, b: (rng.normal(size=(a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {"out": make(2 * HIDDEN, 1), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": make(n, 4 * HIDDEN), f"h{d}": make(HIDDEN, 4 * HIDDEN), f"c{d}": np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)}

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, traced: bool = False) -> tuple[np.ndarray, list]:
        b, t, _ = x.shape
        h = c = np.zeros((b, HIDDEN), np.float32)
        z_in = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        out, trace = np.zeros((b, t, HIDDEN), np.float32), []
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            z = z_in[:, s] + h @ self.p[f"h{d}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, s, None]
            new = f * c + i * g
            tc = np.tanh(new)
            if traced:
                trace.append((s, h, c, i, f, o, g, tc, m))
            c, h = m * new + (1 - m) * c, m * o * tc + (1 - m) * h
            out[:, s] = h
        return out, trace

    def forward(self, x: np.ndarray, mask: np.ndarray, traced: bool = False) -> tuple[np.ndarray, tuple]:
        (f, tf), (b, tb) = self._pass(x, mask, "f", traced), self._pass(x, mask, "b", traced)
        both = np.concatenate([f, b], 2)
        return _sigmoid((both @ self.p["out"])[..., 0] + self.p["bias"]), (both, tf, tb)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, (both, tf, tb) = self.forward(x, mask, True)
        n = mask.sum()
        loss = -float((mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / n)
        dz = (mask * (p - y) / n)[..., None].astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"] = np.einsum("bth,bto->ho", both, dz)
        g["bias"] = dz.sum((0, 1))
        back = dz @ self.p["out"].T
        for d, trace, part in (("f", tf, back[..., :HIDDEN]), ("b", tb, back[..., HIDDEN:])):
            dh = dc = np.zeros((len(x), HIDDEN), np.float32)
            for s, h, c, i, f, o, gg, tc, m in reversed(trace):
                dh = dh + part[:, s]
                do = m * dh * tc
                dn = m * (dc + dh * o * (1 - tc * tc))
                dz4 = np.concatenate([dn * gg * i * (1 - i), dn * c * f * (1 - f), do * o * (1 - o), dn * i * (1 - gg * gg)], 1)
                g[f"x{d}"] += x[:, s].T @ dz4
                g[f"h{d}"] += h.T @ dz4
                g[f"c{d}"] += dz4.sum(0)
                dh, dc = dz4 @ self.p[f"h{d}"].T + (1 - m) * dh, dn * f + (1 - m) * dc
        return loss, g

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = 7, rate: float = 0.01, batch: int = 16, seed: int = 2) -> float:
        """Adam over batches of pages of like length; the last round's mean loss."""
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        pages = sorted((q for q in pages if len(q[1])), key=lambda q: len(q[1]))
        groups = [pages[i : i + batch] for i in range(0, len(pages), batch)]
        losses = [0.0]
        for _ in range(rounds):
            losses = []
            for k in rng.permutation(len(groups)):
                x, mask, y = padded(groups[k])
                loss, g = self.gradients(x, mask, y)
                losses.append(loss)
                step += 1
                for a in self.p:
                    m[a] = 0.9 * m[a] + 0.1 * g[a]
                    v[a] = 0.999 * v[a] + 0.001 * g[a] ** 2
                    self.p[a] = (self.p[a] - rate * (m[a] / (1 - 0.9**step)) / (np.sqrt(v[a] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return float(np.mean(losses))


def padded(group: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = max(len(y) for _, y in group)
    x = np.zeros((len(group), t, PATHS + WORDS + MEASURES), np.float32)
    mask, y = np.zeros((len(group), t), np.float32), np.zeros((len(group), t), np.float32)
    for i, (a, b) in enumerate(group):
        x[i, : len(b)], mask[i, : len(b)], y[i, : len(b)] = a, 1, b
    return x, mask, y


def invented(words: list[str], count: int, seed: int = 3) -> list[str]:
    """Pages of many layouts, from given words: the labels are in their names as on real ones."""
    rng = np.random.default_rng(seed)
    words = words or ["word"]
    say = lambda n: " ".join(rng.choice(words, n))
    furniture, content = sorted(FURNITURE), sorted(CONTENT)

    def box(kind: str) -> str:
        body = "".join(f"<li><a href='/'>{say(int(rng.integers(1, 4)))}</a></li>" for _ in range(rng.integers(2, 9)))
        if kind in ("footer", "copyright", "legal") and rng.random() < 0.6:
            body = f"<p>© {rng.integers(1990, 2030)} {say(int(rng.integers(1, 5)))}</p>"
        body = body if body.startswith("<p>") else f"<ul>{body}</ul>" if rng.random() < (0.9 if kind in ("nav", "menu", "header", "breadcrumb", "sidebar", "related") else 0.4) else "".join(f"<p>{say(int(rng.integers(2, 60)))}.</p>" for _ in range(rng.integers(1, 4)))
        if kind in ("nav", "header", "footer", "aside") and rng.random() < 0.6:
            return f"<{kind}>{body}</{kind}>"
        tag = rng.choice(["div", "section", "ul", "aside"])
        return f"<{tag} {rng.choice(['class', 'id'])}='{kind}{rng.choice(['', '-box', ' wide', '_1'])}'>{body}</{tag}>"

    pages = []
    for _ in range(count):
        inner = []
        for _ in range(rng.integers(1, 9)):
            if rng.random() < 0.12:
                inner.append(box(str(rng.choice(furniture))))
            inner.append(f"<{(t := rng.choice(['p', 'p', 'p', 'h2', 'div', 'blockquote', 'li']))}>{say(int(rng.integers(1, 80)))}{rng.choice(['.', '', '.'])}</{t}>")
        kind = str(rng.choice(content))
        tag = kind if kind in ("article", "main", "body") else "div"
        before, after = (["".join(box(str(rng.choice(furniture))) for _ in range(rng.integers(0, 4)))] for _ in range(2))
        pages.append("".join([*before, f"<{tag} class='{kind}'><h1>{say(5)}</h1>", *inner, f"</{tag}>", *after]))
    return pages


def trained(pages: list[str]) -> Labeller:
    """A labeller from raw pages (a bounded sample) and as many invented ones."""
    found = [b for p in pages if (b := blocks(p))]
    words = sorted({w for page in found for text, _, _ in page for w in text.split()})
    words = words[:: max(1, len(words) // 5000)]
    found = [page for page in found if not all(told(path) for _, path, _ in page)]  # a page without telling names has no labels
    found += [b for p in invented(words, max(300, len(found) // 2)) if (b := blocks(p))]
    runs = [page[i : i + RUN] for page in found for i in range(0, len(page), RUN)]
    model, learned = Labeller(), []
    for i, run in enumerate(runs):
        read = [(text, nameless(path), links) for text, path, links in run] if i % 2 else run
        learned.append((vectors(read), np.array([told(path) for _, path, _ in run], np.float32)))
    model.train(learned, rounds=max(7, -(-5600 // max(1, len(learned)))))  # about as many steps for few pages as for many
    return model


def main_text(pages: DataFrame, model: Labeller, group: int = 64) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of (page_id, url, html)."""
    weights = model.p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller()
        own.p = weights
        for batch in batches:
            for a in range(0, batch.num_rows, group):
                part = batch.slice(a, group)
                found = [blocks(p) for p in part.column("html").to_pylist()]
                texts = [""] * len(found)
                order = sorted((i for i in range(len(found)) if found[i]), key=lambda i: len(found[i]))
                while order:
                    some = [order.pop()]
                    while order and (len(some) + 1) * len(found[some[0]]) <= 4096:
                        some.append(order.pop())
                    x, mask, _ = padded([(vectors(found[i]), np.zeros(len(found[i]), np.float32)) for i in some])
                    score = own.forward(x, mask)[0]
                    for i, s in zip(some, score, strict=True):
                        texts[i] = "\n\n".join(t for (t, _, _), k in zip(found[i], s, strict=False) if k > 0.5)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id").cast(pa.int64()), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Trains on at most ``sample`` pages, the first by a hash of the id, and reads all."""
    rows = pages.where("html is not null").orderBy(F.xxhash64("page_id"), "page_id").limit(sample).select("html").collect()
    return main_text(pages, trained([r["html"] for r in rows]))

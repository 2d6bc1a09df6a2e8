"""Main text of web pages by a recurrent block labeller: a bidirectional LSTM in numpy over the leaf blocks of a page.

A page becomes a sequence of leaf blocks (runs of text between block-level tags). Each block is a vector: its tag path (tags,
classes and ids of all open elements) hashed to `PATH` places, all its words as roots of their shares in `WORDS` hashed
places, and a few shares. The network reads the whole sequence in both directions and gives every block its chance of being
main text.

It is trained here, once a process, on `PAGES` pages of a generator with a fixed seed: articles in several kinds of layout
among menus, headers, sidebars, notices, adverts, forms, footers and reader comments, some with tags left open. On half of
the pages adverts, notices and comments hold words of their kind (`TELLING`), and some of these have no telling tag or class.

Edge cases: a null or empty page, or one without main text, gives an empty text; broken markup is read as far as it goes;
repeated rows give equal rows; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlark.llm.common import small_batches

PATH, WORDS, HIDDEN, PAGES, STEPS = 64, 1024, 16, 800, 350
DIM = PATH + WORDS + 6
#: Added to a block's number of words, so that few words weigh little.
DAMP = 30
#: Tags inside running text; all others end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math maction menclose merror mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover q rp rt ruby s samp semantics small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements passed over from start tag to end tag; without an end tag they are read like any other.
SILENT = {t: re.compile(rf"</{t}\s*>", re.I) for t in "noscript template svg iframe object canvas".split()}
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>]).*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<[!?/][^>]*>""", re.S | re.I)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
CLOSED_BY = {"p": frozenset("p div ul ol table section article aside header footer nav form h1 h2 h3 h4 h5 h6 blockquote pre main figure".split()),
             "li": frozenset(["li"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]),
             "option": frozenset(["option"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"])}
SPACES = re.compile(r"\s+")
MARKS = b".,;:!?()[]\"'*"
#: Words of adverts, notices and comments in English, German, French and Spanish.
TELLING = {
    "ad": """buy sale offer offers discount price prices free shipping order shop save deal deals coupon subscribe click limited sponsored today exclusive guarantee bestseller trial
    kaufen angebot angebote rabatt preis gratis versand bestellen sparen gutschein jetzt acheter offre promo prix gratuit livraison commander soldes comprar oferta ofertas descuento precio envío pedido ahorra""".split(),
    "notice": """cookies cookie consent privacy policy accept agree settings browser site website terms personalise analytics preferences partners continue
    datenschutz zustimmen akzeptieren einstellungen webseite nutzung confidentialité accepter paramètres navigateur conditions privacidad aceptar configuración navegador términos""".split(),
    "comment": """thanks thank great nice i my lol agree disagree reply post posted comment wrote author imho awesome please anyone
    danke super ich finde kommentar antworten toll merci bravo je commentaire répondre génial gracias yo comentario responder genial""".split(),
}
#: Words that any text of these languages has, frequent ones first.
COMMON = [x.split() for x in ("the of and to in a is that for it with as was on are by this be from at or an which not have you they has had its",
                              "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er so wir sie",
                              "de la le et les des en un du une que est pour qui dans par sur au plus pas ne se ce il sont avec elle",
                              "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le")]


def blocks(page: str) -> list[tuple[str, frozenset, float]]:
    """(text, names on the tag path, share of link text) of the leaf blocks, in page order."""
    out: list[tuple[str, frozenset, float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    run: list[str] = []
    links, in_link, path = 0, 0, None

    def flush() -> None:
        nonlocal run, links, path
        if run:
            text = SPACES.sub(" ", html.unescape("".join(run))).strip()
            if text:
                out.append((text, path or frozenset(), min(1.0, links / max(1, len(text)))))
        run, links, path = [], 0, None

    def add(text: str) -> None:
        nonlocal links, path
        if not text:
            return
        run.append(text)
        if path is None and not text.isspace():
            path = frozenset(n for _, names in stack for n in names)
        if in_link:
            links += len(text)

    at, endless = 0, set()
    while m := TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag in SILENT and not m[2] and tag not in endless:
            if tag == "svg" and m[4].endswith("/"):
                continue
            if end := SILENT[tag].search(page, at):
                at = end.end()
                continue
            endless.add(tag)
        if tag == "br":
            add(" ")
            continue
        if tag not in INLINE:
            flush()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    gone = stack[k:]
                    del stack[k:]
                    in_link = max(0, in_link - sum(t == "a" for t, _ in gone))
                    break
        elif tag not in VOID and not m[4].rstrip().endswith("/"):
            for k in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                if tag in CLOSED_BY.get(stack[k][0], ()):
                    in_link = max(0, in_link - sum(t == "a" for t, _ in stack[k:]))
                    del stack[k:]
                    break
            names = (tag, *(f"{tag}.{x}".lower() if len(x) > 24 else x.lower() for a in NAMES.findall(m[4]) for v in a if v for x in re.split(r"[\s_-]+", v) if x)) if m[4] else (tag,)
            stack.append((tag, names))
            in_link += tag == "a"
    add(page[at:])
    flush()
    return out


@lru_cache(maxsize=100_000)
def _place(name: str, size: int) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % size


def vectors(page: list[tuple[str, frozenset, float]]) -> np.ndarray:
    x = np.zeros((len(page), DIM), np.float32)
    for k, (text, path, links) in enumerate(page):
        for name in path:
            x[k, _place(name, PATH)] = 1
        words = text.lower().encode("utf-8", "replace").translate(None, MARKS).split()
        if words:
            at = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % WORDS
            x[k, PATH : PATH + WORDS] = np.sqrt(np.bincount(at, minlength=WORDS) / (len(words) + DAMP))
        n = text.count(" ") + 1
        x[k, PATH + WORDS :] = (min(1.0, n / 50), n < 6, links, text[-1] in ".!?", k / len(page), len(text) / n / 10)
    return x


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Weights of both directions (input, recurrent, bias for gates i, f, o, g) and of the output."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        h = HIDDEN
        self.w = [{"x": r.normal(0, 0.15, (DIM, 4 * h)), "h": r.normal(0, 0.15, (h, 4 * h)), "b": np.r_[np.zeros(h), np.ones(h), np.zeros(2 * h)]} for _ in range(2)]
        for w in self.w:
            w["x"][PATH : PATH + WORDS] = 0  # a word not met in training says nothing
        self.out = {"w": r.normal(0, 0.2, 2 * h), "b": np.zeros(1)}

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Chances for padded pages x (pages, blocks, DIM); mask is 1 where there is a block."""
        n, t, _ = x.shape
        h = HIDDEN
        states, trace = [], []
        for d, w in enumerate(self.w):
            gx = x @ w["x"] + w["b"]
            a, c = np.zeros((n, h)), np.zeros((n, h))
            seq, kept = np.zeros((n, t, h)), []
            for k in range(t) if d == 0 else range(t - 1, -1, -1):
                g = gx[:, k] + a @ w["h"]
                s, u = _sigmoid(g[:, : 3 * h]), np.tanh(g[:, 3 * h :])
                i, f, o = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :]
                m = mask[:, k, None]
                c1 = f * c + i * u
                a1 = o * np.tanh(c1)
                if keep:
                    kept.append((k, a, c, i, f, o, u, c1, m))
                a, c = m * a1 + (1 - m) * a, m * c1 + (1 - m) * c
                seq[:, k] = a
            states.append(seq)
            trace.append(kept)
        both = np.concatenate(states, axis=2)
        return _sigmoid(both @ self.out["w"] + self.out["b"]), both, trace

    def train(self, x: list[np.ndarray], y: list[list[bool]], steps: int, batch: int = 32) -> None:
        params = [p for w in self.w for p in w.values()] + list(self.out.values())
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        order = np.random.default_rng(1)
        for step in range(1, steps + 1):
            pick = order.choice(len(x), min(batch, len(x)), replace=False)
            longest = max(len(x[k]) for k in pick)
            bx, bm, by = np.zeros((len(pick), longest, DIM), np.float32), np.zeros((len(pick), longest)), np.zeros((len(pick), longest))
            for row, k in enumerate(pick):
                bx[row, : len(x[k])], bm[row, : len(x[k])], by[row, : len(x[k])] = x[k], 1, y[k]
            p, both, trace = self.run(bx, bm, keep=True)
            d = (p - by) * bm / bm.sum()
            grads = []
            for k, (w, kept) in enumerate(zip(self.w, trace, strict=True)):
                grads += self._back(bx, w, kept, d[:, :, None] * self.out["w"][k * HIDDEN : (k + 1) * HIDDEN])
            grads += [np.einsum("nt,nth->h", d, both), np.array([d.sum()])]
            for q, g, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= 0.04 * (1 - step / (steps + 1)) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)

    @staticmethod
    def _back(x, w, kept, dseq):
        gx, gh, gb = (np.zeros_like(w[k]) for k in ("x", "h", "b"))
        da = dc = np.zeros((x.shape[0], HIDDEN))
        for k, a0, c0, i, f, o, u, c1, m in reversed(kept):
            da = da + dseq[:, k]
            tc = np.tanh(c1)
            da1, dc1 = da * m, dc * m
            dct = dc1 + da1 * o * (1 - tc * tc)
            dg = np.concatenate([dct * u * i * (1 - i), dct * c0 * f * (1 - f), da1 * tc * o * (1 - o), dct * i * (1 - u * u)], axis=1)
            gx += x[:, k].T @ dg
            gh += a0.T @ dg
            gb += dg.sum(axis=0)
            da, dc = da * (1 - m) + dg @ w["h"].T, dc * (1 - m) + dct * f
        return [gx, gh, gb]

    def label(self, pages: list[list]) -> list[np.ndarray]:
        """For each page, which of its blocks are main text; pages of like length go together."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            longest = len(pages[order[at]])
            end = at
            while end < len(order) and len(pages[order[end]]) <= 1.25 * longest + 4 and end - at < max(1, 20_000 // len(pages[order[end]])):
                end += 1
            end = max(end, at + 1)
            part = order[at:end]
            size = len(pages[part[-1]])
            x, mask = np.zeros((len(part), size, DIM), np.float32), np.zeros((len(part), size), np.float32)
            for r, k in enumerate(part):
                x[r, : len(pages[k])], mask[r, : len(pages[k])] = vectors(pages[k]), 1
            p = self.run(x, mask)[0]
            for r, k in enumerate(part):
                out[k] = p[r, : len(pages[k])] > 0.5
            at = end
        return out


def generated(count: int, seed: int = 11) -> list[tuple[str, list[bool]]]:
    """Pages with the truth of each block, in block order."""
    r = np.random.default_rng(seed)
    sounds = [a + b + c for a in "b c d f g h k l m n p r s t v w sh th ch".split() for b in "a e i o u é ä ou".split() for c in ("", "n", "r", "st", "l")]
    word = lambda: common[int(len(common) * r.random() ** 2)] if r.random() < often else "".join(r.choice(parts, r.integers(1, 4)))
    text = lambda a, b: " ".join(word() for _ in range(r.integers(a, b))).capitalize()
    sent = lambda a, b: text(a, b) + "."
    prose = lambda: " ".join(sent(3, 16) for _ in range(r.integers(1, 6)))
    one = lambda *xs: xs[r.integers(len(xs))]
    out = []

    def of_kind(kind: str) -> str:
        """Prose with words of a kind on pages whose words tell, and of no kind on the others."""
        if not telling:
            return prose()
        share = r.uniform(0.2, 0.6)
        said = [one(*TELLING[kind]) if r.random() < share else word() for _ in range(r.integers(5, 80))]
        return " ".join(said).capitalize() + one(".", ".", "!", "")

    def story() -> str:
        """Prose of articles; it has a word of the other kinds now and then."""
        if not telling:
            return prose()
        said = [one(*TELLING[one("ad", "notice", "comment")]) if r.random() < 0.02 else word() for _ in range(r.integers(5, 80))]
        return " ".join(said).capitalize() + "."

    for _ in range(count):
        page, truth = [], []
        parts, common, often = r.choice(sounds, 18, replace=False), COMMON[r.integers(4)], r.uniform(0, 0.7)
        telling = r.random() < 0.5

        def put(markup: str, *blocks_true: bool, page=page, truth=truth) -> None:
            page.append(markup)
            truth.extend(blocks_true)

        def menu(n: int) -> str:
            return "<ul>" + "".join(f'<li><a href="/{word()}">{text(1, 3)}</a></li>' for _ in range(n)) + "</ul>"

        def plain() -> None:
            put(one("<p>%s</p>", "<div>%s</div>", "<div><p>%s</p></div>") % of_kind(one("ad", "notice", "comment")), False)

        def aside() -> None:
            kind = r.integers(9)
            if telling and r.random() < 0.3:
                plain()
            elif kind == 0:
                put(f'<div class="{one("ad", "ads", "advert", "banner ad", "sponsored", "promo")}">{of_kind("ad")}</div>', False)
            elif kind == 1:
                n = int(r.integers(1, 6))
                put(f'<aside{one("", " class=sidebar")}><h3>{text(1, 4)}</h3>{menu(n)}</aside>', *[False] * (n + 1))
            elif kind == 2:
                put(f'<div class="{one("cookie-notice", "notice", "gdpr consent", "alert", "newsletter popup")}"><p>{of_kind("notice")}</p></div>', False)
            elif kind == 3:
                put(f'<form action="/{word()}"><label>{text(1, 3)}</label> <input name="q"><button>{text(1, 2)}</button></form>', False, False)
            elif kind == 4:
                put(f'<div class="{one("sidebar", "widget", "related", "side")}" id="{one("sidebar", "right", "rel")}"><h4>{text(1, 4)}</h4><p>{prose()}</p></div>', False, False)
            elif kind == 5:
                n = int(r.integers(1, 4))
                box, item = one(("section", "div"), ("div", "div"), ("ol", "li"), ("ul", "li"))
                put(f'<{box} {one("class", "id")}="{one("comments", "comment-list", "responses", "discussion")}">' + "".join(f'<{item} class="comment"><p>{of_kind("comment")}</p></{item}>' for _ in range(n)) + f"</{box}>", *[False] * n)
            elif kind == 6:
                n = int(r.integers(2, 6))
                put(f'<div class="{one("share", "social", "breadcrumb", "breadcrumbs", "pagination", "tags")}">' + "".join(f'<p><a href="#">{text(1, 3)}</a></p>' for _ in range(n)) + "</div>", *[False] * n)
            elif kind == 7:
                put(f"<aside><p>{prose()}</p></aside>", False)
            else:
                n = int(r.integers(2, 6))
                put(f'<div class="{one("menu", "nav", "navbar", "topnav")}">{menu(n)}</div>', *[False] * n)

        title = text(3, 9)
        if r.random() < 0.1:
            put("<body>")
        else:
            put(f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";f(1);</script></head><body>', False)
        if r.random() < 0.5:
            put(f"<header{one('', ' class=site-header', ' id=header')}>{one('<h1>%s</h1>', '<p>%s</p>', '<div class=logo>%s</div>') % text(1, 4)}</header>", False)
        if r.random() < 0.8:
            n = int(r.integers(1, 9))
            put(f"<nav>{menu(n)}</nav>", *[False] * n)
        for _ in range(r.integers(0, 3)):
            aside()
        opener, closer = one(("<article>", "</article>"), ("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"), ('<div class="content">', "</div>"),
                             ('<div id="main-content" class="post">', "</div>"), ('<div class="article-body entry">', "</div>"), ("<section class=story>", "</section>"))
        put(opener)
        if r.random() < 0.85:
            put(one("<h1>%s</h1>", "<h1>%s</h1>", "<header><h1>%s</h1></header>", "<h2>%s</h2>") % title, True)
        for _ in range(r.integers(1, 12)):
            kind = r.random()
            if telling and r.random() < 0.15:
                plain()
            if kind < 0.7:
                put(f"<p>{story()}</p>", True)
            elif kind < 0.8:
                put(f"<p><b>{story()}<br>", True)
            elif kind < 0.85:
                put(f"<h2>{text(1, 6)}</h2>", True)
            elif kind < 0.89:
                n = int(r.integers(1, 5))
                put("<ul>" + "".join(f"<li>{sent(1, 10)}</li>" for _ in range(n)) + "</ul>", *[True] * n)
            elif kind < 0.92:
                put(f"<blockquote>{story()}</blockquote>", True)
            elif kind < 0.95:
                put(f'<p>{sent(1, 6)} <a href="/{word()}">{text(1, 4)}</a> {story()}</p>', True)
            elif kind < 0.97:
                put(f"<table><tr><td>{text(1, 3)}</td><td>{text(1, 3)}</td></tr></table>", True, True)
            else:
                aside()
        put(closer)
        for _ in range(r.integers(0, 3)):
            aside()
        if r.random() < 0.85:
            put(f"<footer>{one('', '&copy; ')}{word()}.example.com &middot; {prose()}</footer>", False)
        if r.random() < 0.8:
            put("</body></html>")
        out.append(("".join(page), truth))
    return out


@lru_cache(maxsize=1)
def trained() -> Labeller:
    pages, truth = [], []
    for page, y in generated(PAGES):
        got = blocks(page)
        if len(got) == len(y):
            pages.append(got)
            truth.append(y)
    model = Labeller()
    model.train([vectors(p) for p in pages], truth, STEPS)
    return model


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    model = trained()

    def task(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                split = [blocks(p or "") for p in part.column(2).to_pylist()]
                texts = ["\n".join(b[0] for b, y in zip(p, keep, strict=True) if y) for p, keep in zip(split, model.label(split), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return small_batches(pages).selectExpr("cast(page_id as bigint)", "url", "html").mapInArrow(task, "page_id long, url string, text string, n_chars long")

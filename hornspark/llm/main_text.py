"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is a sequence of blocks, each main text or not. Features of a block are its ancestors' tags, the words of
their class, id and role attributes, and properties of its own text. The field is trained, once per process, by gradient ascent on the
likelihood of labelled pages; these are drawn here, in many layouts, with every kind of part that isn't main text.
Viterbi decoding gives each page's most likely labelling.

The result joins the main blocks in page order by one line end. Null, empty or cut-off pages give what they have, maybe the empty text; repeated rows
give repeated results; pages of any length are read whole. An empty table gives no rows. Extra columns aren't read.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hornspark.llm.common import map_batches, texts
from hornspark.llm.html_blocks import Block, leaf_blocks

# Words in class and id attributes, by what they tell; others are no features.
NAME_GROUPS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs skip sitemap",
    "head": "header masthead topbar banner logo branding hero",
    "foot": "footer foot copyright colophon legal credits",
    "side": "sidebar side aside widget related recommended popular trending more rail secondary complementary tags archive",
    "ad": "ad ads adv advert advertisement adsense sponsor sponsored promo promotion dfp outbrain taboola teaser",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall toast message disclaimer privacy",
    "comment": "comment comments reply replies respond disqus discussion feedback review reviews reader thread",
    "share": "share sharing social follow author byline meta print tools toolbar",
    "form": "form search searchbox login signin input contact captcha",
    "main": "article content main post entry story body text page single blog hentry articlebody maincontent prose",
    "hidden": "hidden",
}
GROUP_OF = {w: g for g, ws in NAME_GROUPS.items() for w in ws.split()}
TAGS = "article main section div p h1 h2 h3 h4 ul ol li nav header footer aside form table td th blockquote pre figure figcaption dl dd dt fieldset details label button body address".split()
NOTICE_WORDS = "cookie cookies consent subscribe newsletter copyright rights reserved privacy terms sponsored advertisement sign login share".split()


def block_features(b: Block, k: int, n: int) -> list[str]:
    path = set(b.path)
    out = [f"in:{t}" for t in path if t in TAGS]
    if b.path:
        out.append(f"tag:{b.path[-1]}")
    groups = {GROUP_OF[w] for w in b.names if w in GROUP_OF}
    out += [f"name:{g}" for g in groups]
    if not groups and not path & {"article", "main", "nav", "header", "footer", "aside", "form"}:
        out.append("plain")
    size = len(b.text)
    share = b.link_chars / size
    out.append(f"size:{min(6, size.bit_length() // 2)}")
    out.append("links:most" if share > 0.7 else "links:some" if share > 0.25 else "links:none")
    if b.text[-1] in ".!?…\"”»":
        out.append("ends")
    if b.text[:1] in "©®":
        out.append("mark")
    words = b.text.lower().split()
    told = sum(w.strip(".,:;!?") in NOTICE_WORDS for w in words)
    if told:  # how many, and how densely: long texts speak of such things now and then
        where = "inside" if path & {"article", "main"} or "main" in groups else "outside"
        out += [f"notice:{where}", f"notice:{where}:{'dense' if told * 12 > len(words) else 'thin'}"]
    if k == 0:
        out.append("first")
    if k == n - 1:
        out.append("last")
    return out


# --- labelled pages --------------------------------------------------------------------------------------------


def _words(rng: random.Random, n: int) -> str:
    parts = "ka lo mer tis no ven dra sil pu re ta gon el mi su".split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def _sentence(rng: random.Random, lo: int = 4, hi: int = 16) -> str:
    return _words(rng, rng.randint(lo, hi)).capitalize() + rng.choice(["."] * 8 + ["!", "?", ""])


def _text(rng: random.Random) -> str:
    if rng.random() < 0.08:  # articles, too, speak of such things
        return " ".join([_sentence(rng)] * rng.randint(0, 1) + [f"{_words(rng, rng.randint(0, 2))} {rng.choice(NOTICE_WORDS)} {rng.choice(NOTICE_WORDS)}.".strip().capitalize()])
    return " ".join(_sentence(rng) for _ in range(rng.choice([1, 1, 2, 3, 5, 9])))


#: In drawn pages main text stands between these characters, so that blocks can be told apart when the page is cut.
OPEN, SHUT = "\ue000", "\ue001"


def _main(text: str) -> str:
    return f"{OPEN}{text}{SHUT}"


def _links(rng: random.Random, n: int) -> str:
    items = [f'<a href="/{k}">{_words(rng, rng.randint(1, 3))}</a>' for k in range(n)]
    return rng.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "<p>" + " ".join(items) + "</p>", "<ul><li>" + "<li>".join(items) + "</ul>"])


def _other(rng: random.Random, kind: str) -> str:
    """A part that isn't main text."""
    name = rng.choice(NAME_GROUPS[kind].split())
    attr = rng.choice([f' class="{name}"', f' id="{name}"', f' class="x {name}-{rng.randint(1, 9)}"'])
    tag = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}.get(kind, "div")
    if rng.random() < 0.45:
        attr = "" if tag != "div" else attr
    else:
        tag = rng.choice(["div", "section", "div"])
    short, long = _sentence(rng), _text(rng)
    body = {
        "menu": lambda: _links(rng, rng.randint(2, 9)),
        "head": lambda: rng.choice([f"<h1>{_words(rng, 2)}</h1>", f"<p>{short}</p>", f"<a href='/'>{_words(rng, 2)}</a> {_links(rng, 4)}", short]),
        "foot": lambda: rng.choice([f"&copy; {_words(rng, 2)} &middot; {short}", f"<p>&copy; 2020 {_words(rng, 2)}. All rights reserved.</p>{_links(rng, 3)}", short, long]),
        "side": lambda: rng.choice([f"<h3>{_words(rng, 2)}</h3>{_links(rng, 5)}", f"<p>{long}</p>", f"<h4>{_words(rng, 2)}</h4><p>{short}</p>"]),
        "ad": lambda: rng.choice([short, f"<p>{long}</p>", f'<a href="#">{short}</a>']),
        "notice": lambda: rng.choice([f"<p>We use cookies. {short}</p><button>OK</button>", f"{short} <a href='/privacy'>privacy</a>", f"<p>Subscribe to our newsletter. {short}</p>", short]),
        "comment": lambda: f"<h3>{_words(rng, 2)}</h3>" * rng.randint(0, 1) + "".join(rng.choice([f"<div><b>{_words(rng, 1)}</b><p>{_text(rng)}</p></div>", f"<p>{_text(rng)}</p>", f"<li>{_text(rng)}</li>"]) for _ in range(rng.randint(1, 4))),
        "share": lambda: rng.choice([_links(rng, 3), f"By {_words(rng, 2)}", f"<span>{_words(rng, 3)}</span>"]),
        "form": lambda: f"<label>{_words(rng, 2)}</label><input type=text><p>{short}</p><button>{_words(rng, 1)}</button>",
    }[kind]()
    return f"<{tag}{attr}>{body}</{tag}>"


def _article(rng: random.Random) -> str:
    out = []
    if rng.random() < 0.85:
        out.append(f"<h1>{_main(_words(rng, rng.randint(1, 9)))}</h1>")
    for _ in range(rng.choice([1, 2, 3, 5, 8, 14])):
        kind = rng.random()
        if kind < 0.62:
            shut = rng.choice(["</p>", "</p>", "</p>", ""])
            lead = rng.choice(["", "", "", "<b>", "<span>"])
            out.append(f"<p>{lead}{_main(_text(rng))}{rng.choice(['', '<br>'])}{shut}")
        elif kind < 0.74:
            out.append(f"<h{(h := rng.randint(2, 4))}>{_main(_words(rng, rng.randint(1, 6)))}</h{h}>")
        elif kind < 0.82:
            out.append("<ul>" + "".join(f"<li>{_main(_sentence(rng))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
        elif kind < 0.87:
            out.append(f"<blockquote><p>{_main(_text(rng))}</p></blockquote>")
        elif kind < 0.91:
            out.append("<table>" + "".join(f"<tr><td>{_main(_words(rng, 2))}</td><td>{_main(_words(rng, 1))}</td></tr>" for _ in range(2)) + "</table>")
        elif kind < 0.94:
            out.append(f"<pre>{_main(_words(rng, 12))}</pre>")
        else:
            out.append(_other(rng, rng.choice(["ad", "share", "notice", "side"])))
    return "".join(out)


def labelled_page(rng: random.Random) -> list[tuple[Block, int]]:
    before = [_other(rng, k) for k in ("notice", "head", "menu", "ad", "form") if rng.random() < 0.5]
    after = [_other(rng, k) for k in ("share", "side", "comment", "comment", "ad", "form", "menu", "foot") if rng.random() < 0.45]
    rng.shuffle(before)
    open_, shut = rng.choice([("<article>", "</article>")] * 4 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main-content"><div class="post">', "</div></div>"), ('<div class="entry-content">', "</div>"), ("<div>", "</div>"), ('<section class="story-body">', "</section>"), ("", "")])
    page = f"<html><head><title>{_words(rng, 3)}</title></head><body>{''.join(before)}{open_}{_article(rng)}{shut}{''.join(after)}</body></html>"
    if rng.random() < 0.1:
        page = page[: rng.randint(len(page) // 2, len(page))]
    out = []
    for b in leaf_blocks(page):
        label = int(OPEN in b.text)
        b.text = b.text.replace(OPEN, "").replace(SHUT, "").strip()
        if b.text:
            out.append((b, label))
    return out


# --- the field -------------------------------------------------------------------------------------------------


class Field:
    """Two labels; weights of features for label 1, of the label before, and of the first label."""

    def __init__(self, index: dict[str, int]):
        self.index = index
        self.weights = np.zeros(len(index))
        self.step, self.begin = np.zeros((2, 2)), np.zeros(2)

    def decode(self, rows: list[list[str]]) -> list[int]:
        """Viterbi."""
        get, w = self.index.get, self.weights
        (t00, t01), (t10, t11) = self.step.tolist()
        a, b = self.begin.tolist()
        back: list[tuple[int, int]] = []
        for k, features in enumerate(rows):
            score = 0.0
            for f in features:
                i = get(f)
                if i is not None:
                    score += w[i]
            if k:
                from0, from1 = (0 if a + t00 >= b + t10 else 1), (0 if a + t01 >= b + t11 else 1)
                back.append((from0, from1))
                a, b = max(a + t00, b + t10), max(a + t01, b + t11) + score
            else:
                b += score
        label = int(b > a)
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1] if rows else []

    @classmethod
    def train(cls, pages: list[list[tuple[Block, int]]], rounds: int = 220, ridge: float = 0.02) -> Field:
        """Maximum likelihood by forward-backward over all pages at once and adaptive gradient steps."""
        rows = [[block_features(b, k, len(p)) for k, (b, _) in enumerate(p)] for p in pages]
        names = sorted({f for p in rows for fs in p for f in fs})
        field = cls({f: i for i, f in enumerate(names)})
        longest = max(map(len, rows))
        m = len(rows)
        x = np.zeros((longest, m, len(names)), np.float32)
        y = np.zeros((longest, m), int)
        live = np.zeros((longest, m), bool)
        for j, (p, fs) in enumerate(zip(pages, rows, strict=True)):
            for k, ((_, label), f) in enumerate(zip(p, fs, strict=True)):
                x[k, j, [field.index[i] for i in f]] = 1
                y[k, j], live[k, j] = label, True
        theta = np.zeros(len(names) + 6)
        seen = np.full(len(theta), 1e-6)
        for _ in range(rounds):
            w, step, begin = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
            emit = np.stack([np.zeros((longest, m)), x @ w.astype(np.float32)], axis=2) * live[:, :, None]
            forward, backward = np.zeros((longest, m, 2)), np.zeros((longest, m, 2))
            forward[0] = begin + emit[0]
            for k in range(1, longest):
                new = np.logaddexp.reduce(forward[k - 1][:, :, None] + step, axis=1) + emit[k]
                forward[k] = np.where(live[k][:, None], new, forward[k - 1])
            for k in range(longest - 2, -1, -1):
                new = np.logaddexp.reduce(step + (emit[k + 1] + backward[k + 1])[:, None, :], axis=2)
                backward[k] = np.where(live[k + 1][:, None], new, 0)
            total = np.logaddexp.reduce(forward[-1], axis=1)
            p1 = np.exp(forward[:, :, 1] + backward[:, :, 1] - total) * live
            grad = np.zeros_like(theta)
            grad[:-6] = np.tensordot((y - p1) * live, x, axes=2)
            pair = np.exp(forward[:-1, :, :, None] + step + (emit[1:] + backward[1:])[:, :, None, :] - total[:, None, None]) * live[1:, :, None, None]
            observed = np.zeros((2, 2))
            np.add.at(observed, (y[:-1][live[1:]], y[1:][live[1:]]), 1)
            grad[-6:-2] = (observed - pair.sum(axis=(0, 1))).ravel()
            grad[-2:] = np.bincount(y[0], minlength=2) - np.array([m - p1[0].sum(), p1[0].sum()])
            grad = grad / m - ridge / 10 * theta
            seen += grad**2
            theta = theta + 0.5 * grad / np.sqrt(seen)
        field.weights, field.step, field.begin = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
        return field


@lru_cache(1)
def trained_field(pages: int = 500, seed: int = 20) -> Field:
    rng = random.Random(seed)
    drawn = [p for p in (labelled_page(rng) for _ in range(pages)) if p]
    return Field.train(drawn)


def main_text(page: str, field: Field) -> str:
    blocks = leaf_blocks(page)
    labels = field.decode([block_features(b, k, len(blocks)) for k, b in enumerate(blocks)])
    return "\n".join(b.text for b, label in zip(blocks, labels, strict=True) if label)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(trained_field())  # some hundred weights

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [main_text(t, shared.value) for t in texts(batch.column(2))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_batches(pages, ["page_id", "url", "html"], work, "page_id long, url string, text string, n_chars long")

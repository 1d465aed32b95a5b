"""Training of the block labeller: ``python -m weftgraph.llm.html_training [FILE]`` writes the weights.

Pages of many designs are drawn at random with a label for every block. Running text is made of invented words
in both classes, so that place and markup, not vocabulary, decide; notices and menus draw on usual words too.
"""

from __future__ import annotations

import random
import sys

import numpy as np

from weftgraph.llm.html_blocks import Block, blocks
from weftgraph.llm.html_lstm import HIDDEN, WEIGHTS, WIDTH, one_way, turned, vectors

SYLLABLES = "the an er ti ion ou re st ha ing nt is ed ly ver ein ge zu lich keit ung que le ment aux la es ci do rr ue ka mo shi to рус ски ция ал ος αν κα".split()
MENU = "home about contact news sport login register search products shop help blog archive categories tags next previous more inicio accueil startseite kontakt über mentions privacy terms".split()
NOTICES = ("We use cookies to improve your experience.", "Accept all cookies", "Subscribe to our newsletter", "Sign up now", "Advertisement", "Sponsored", "Diese Website verwendet Cookies.", "Nous utilisons des cookies.", "This site uses cookies", "Please enable JavaScript", "Follow us", "Share this", "Read more", "Log in to comment", "Leave a reply", "All rights reserved", "Related articles", "Most popular", "Back to top", "Enter your email")
OPENING = "\x01"  # marks main text in drawn pages


class Page:
    """Draws one page; main blocks begin with a mark that is taken off again."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.noise = self.r.random() < 0.25  # a design whose class names say nothing
        self.style = self.r.random()  # some articles are odd: bars, repeats, capitals
        self.junk = self.r.choice(("", "", "", "%%%", "***", "!!", "&amp;"))

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 3)))

    def sentence(self, low: int = 2, high: int = 16) -> str:
        words = [self.word() + self.junk for _ in range(self.r.randint(low, high))]
        return " ".join(words).capitalize() + self.r.choice((".", ".", ".", ".", "!", "?", ""))

    def prose(self, low: int = 1, high: int = 6) -> str:
        if self.style < 0.06:
            return " | ".join(self.word() for _ in range(self.r.randint(2, 30)))
        if self.style < 0.1:
            return " ".join(self.r.choice([self.word()] * 3 + [self.sentence(1, 3)]) for _ in range(self.r.randint(2, 40)))
        if self.style < 0.14:
            return "!! ".join(self.word().upper() for _ in range(self.r.randint(2, 40))) + "!!"
        text = " ".join(self.sentence() for _ in range(self.r.randint(low, high)))
        return f"{text} {self.graphic()} {self.sentence()}" if self.r.random() < 0.02 else text

    def graphic(self) -> str:
        """Formulas, graphics and fallbacks within a line."""
        return self.r.choice((f"<math><mi>{self.word()}</mi><mo>=</mo><mn>{self.r.randint(1, 9)}</mn></math>", "<svg viewBox='0 0 9 9'><title>icon</title><path d='M0 0'/></svg>", f"<object data='x'>{self.word()}</object>"))

    def unseen(self) -> str:
        """An element that browsers do not show."""
        tag = self.r.choice(("div", "div", "p", "section", "span"))
        return f"<{tag} {self.r.choice(('hidden', 'style="display:none"', 'hidden=""', 'style="color:red; display: none"', 'class="x" hidden'))}>{self.r.choice((self.prose(1, 3), self.sentence(), f'<b>{self.sentence()}</b>', self.r.choice(NOTICES)))}</{tag}>"

    def choices(self) -> str:
        return "<select name='x'>" + "".join(f"<option>{self.r.choice((self.word(), self.sentence(1, 3)))}</option>" for _ in range(self.r.randint(1, 8))) + "</select>"

    def named(self, tag: str, *names: str, chance: float = 0.8) -> str:
        """A start tag, mostly with one of the names."""
        if self.r.random() > chance:
            return f"<{tag}>"
        name = "".join(self.r.choices("abcdefghijklmnop", k=6)) if self.noise else self.r.choice(names)
        extra = self.r.choice(("", "", f" {self.word()}", "-1", " clearfix", "-wrap", "Box"))
        return f'<{tag} {self.r.choice(("class", "class", "id"))}="{name}{extra}">'

    def links(self, n: int) -> str:
        one = lambda: f'<a href="/{self.word()}">{self.r.choice((self.r.choice(MENU).title(), self.word(), self.sentence(2, 6)))}</a>'
        kind = self.r.random()
        if kind < 0.65:
            return "<ul>" + "".join(f"<li>{one()}</li>" for _ in range(n)) + "</ul>"
        return self.r.choice((" | ", " ", " &middot; ")).join(one() for _ in range(n)) if kind < 0.85 else "".join(f"<div>{one()}</div>" for _ in range(n))

    def nav(self) -> str:
        if self.r.random() < 0.7:
            return f"{self.named('nav', 'nav', 'menu', chance=0.4)}{self.links(self.r.randint(2, 9))}</nav>"
        return f"{self.named('div', 'menu', 'nav', 'navbar', 'navigation', 'breadcrumb', 'topbar', chance=1)}{self.links(self.r.randint(2, 9))}</div>"

    def header(self) -> str:
        tag = self.r.choice(("header", "header", "div"))
        inner = self.r.choice((f"<h1>{self.sentence(1, 4)}</h1>", f"<p>{self.sentence()}</p>", f"<a href='/'>{self.word()}</a>", f"<div>{self.sentence(1, 5)}</div><p>{self.prose(1, 2)}</p>"))
        return f"{self.named(tag, 'header', 'masthead', 'banner', 'site-header', 'top', chance=1 if tag == 'div' else 0.6)}{inner}{self.nav() if self.r.random() < 0.5 else ''}{self.form() if self.r.random() < 0.2 else ''}</{tag}>"

    def form(self) -> str:
        return f"<form action='/x'>{self.r.choice(('', f'<p>{self.prose(1, 2)}</p>', f'<h3>{self.r.choice(NOTICES)}</h3>'))}<label>{self.r.choice(NOTICES)}</label><input type='text'>{self.choices() if self.r.random() < 0.3 else ''}<button>{self.word()}</button></form>"

    def aside(self) -> str:
        tag = self.r.choice(("aside", "aside", "div"))
        inner = "".join(self.r.choice((lambda: f"<h3>{self.sentence(1, 4)}</h3>", lambda: self.links(self.r.randint(2, 7)), lambda: f"<p>{self.prose(1, 4)}</p>", self.form))() for _ in range(self.r.randint(1, 4)))
        return f"{self.named(tag, 'sidebar', 'related', 'widget', 'aside', 'side', 'popular', 'recommended', chance=1 if tag == 'div' else 0.5)}{inner}</{tag}>"

    def advert(self) -> str:
        tag = self.r.choice(("div", "div", "div", "section", "aside", "p"))
        text = self.r.choice((self.prose(1, 2), self.sentence(), self.r.choice(NOTICES)))
        inner = text if self.r.random() < 0.6 or tag == "p" else f"<p>{text}</p>"
        return f"{self.r.choice(('', f'<!-- ad {self.word()} -->'))}{self.named(tag, 'ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'ad-slot', 'banner-ad', chance=1)}{inner}</{tag}>"

    def notice(self) -> str:
        tag = self.r.choice(("div", "section", "p", "aside"))
        text = self.r.choice((*NOTICES, self.prose(1, 2)))
        return f"{self.named(tag, 'cookie', 'cookies', 'consent', 'notice', 'alert', 'newsletter', 'subscribe', 'popup', 'gdpr', 'share', 'social', 'cookie-banner', chance=1)}{text if tag == 'p' else f'<p>{text}</p>' if self.r.random() < 0.5 else text}{f'<button>{self.word()}</button>' if tag != 'p' and self.r.random() < 0.4 else ''}</{tag}>"

    def comments(self) -> str:
        tag, each = self.r.choice(("section", "div", "div", "ol")), self.r.choice(("article", "div", "li", "div", "p"))
        one = lambda: f"{self.named(each, 'comment', 'comment-body', 'reply', 'comment-item', chance=0.85)}{'' if each == 'p' else f'<span>{self.word()} {self.r.randint(1, 30)}.{self.r.randint(1, 12)}.</span>' if self.r.random() < 0.4 else f'<h4>{self.word()}</h4>' if self.r.random() < 0.3 else ''}{self.prose(1, 3) if each == 'p' or self.r.random() < 0.4 else f'<p>{self.prose(1, 4)}</p>'}</{each}>"
        return f"{self.named(tag, 'comments', 'comment-list', 'discussion', 'responses', 'disqus', chance=1)}{f'<h2>{self.r.choice(("Comments", "Kommentare", "Commentaires", self.sentence(1, 3)))}</h2>' if self.r.random() < 0.6 else ''}{''.join(one() for _ in range(self.r.randint(1, 6)))}{self.form() if self.r.random() < 0.4 else ''}</{tag}>"

    def footer(self) -> str:
        tag = self.r.choice(("footer", "footer", "footer", "div"))
        text = self.r.choice((f"&copy; {self.word()}.example.com &middot; {self.prose(1, 3)}", f"© {self.r.randint(1990, 2025)} {self.word()}", self.prose(1, 3)))
        return f"{self.named(tag, 'footer', 'foot', 'site-footer', 'bottom', 'copyright', 'colophon', chance=1 if tag == 'div' else 0.4)}{self.r.choice((text, f'<p>{text}</p>', f'{self.links(self.r.randint(1, 5))}<p>{text}</p>'))}</{tag}>"

    def body(self) -> str:
        """Blocks of the article itself."""
        m, out = OPENING, []
        title = f"<h1>{m}{self.sentence(2, 12)}</h1>"
        if self.r.random() < 0.85:
            out.append(f"<header>{title}</header>" if self.r.random() < 0.15 else title)
        broken = self.r.random() < 0.4
        if self.r.random() < 0.04:  # one paragraph over and over
            return "".join(out) + f"<p>{m}{self.prose(1, 2)}</p>" * self.r.randint(5, 80)
        for _ in range(self.r.choice((1, 2, 4, 8, 15, 30))):
            k = self.r.random()
            if k < 0.7:
                text = self.prose(1, 8)
                out.append(f"<p><b>{m}{text}<br>" if broken and self.r.random() < 0.2 else f"<p>{m}{text}</p>")
            elif k < 0.78:
                out.append(f"<h{(n := self.r.randint(2, 4))}>{m}{self.sentence(1, 8)}</h{n}>")
            elif k < 0.84:
                tag = self.r.choice(("ul", "ol"))
                out.append(f"<{tag}>" + "".join(f"<li>{m}{self.sentence(1, 14)}</li>" for _ in range(self.r.randint(1, 6))) + f"</{tag}>")
            elif k < 0.88:
                out.append(f"<blockquote><p>{m}{self.prose(1, 3)}</p></blockquote>")
            elif k < 0.9:
                out.append(f"<div>{m}{self.prose(1, 4)}</div>")
            elif k < 0.92:
                out.append(f"<table><tr><td>{m}{self.sentence(1, 5)}</td><td>{m}{self.sentence(1, 3)}</td></tr></table>")
            elif k < 0.94:
                out.append(f"<figure><img src='x'><figcaption>{m}{self.sentence()}</figcaption></figure>")
            elif k < 0.96:
                out.append(f'<p>{m}{self.prose(1, 3)} <a href="/x">{self.sentence(1, 4)}</a> {self.prose(1, 2)}</p>')
            elif k < 0.975:
                out.append(self.advert())
            elif k < 0.985:
                out.append(self.r.choice((self.unseen, self.unseen, self.choices))())
            else:
                out.append(self.notice())
        return "".join(out)

    def article(self) -> str:
        tag = self.r.choice(("article", "article", "article", "main", "div", "div", "section"))
        names = ("content", "article", "post", "entry-content", "main", "article-body", "story", "post-content", "text")
        inner = self.body()
        if self.r.random() < 0.12:
            inner += self.r.choice((self.comments, self.notice, self.aside, self.advert))()
        if self.r.random() < 0.25:
            inner = f"{self.named('div', *names)}{inner}</div>"
        return f"{self.named(tag, *names, chance=0.9 if tag in ('div', 'section') else 0.35)}{inner}</{tag}>"

    def draw(self) -> str:
        top = [f() for f, p in ((self.notice, 0.25), (self.header, 0.4), (self.nav, 0.75), (self.advert, 0.5), (self.notice, 0.1), (self.aside, 0.15), (self.unseen, 0.1), (self.choices, 0.05)) if self.r.random() < p]
        below = [f() for f, p in ((self.advert, 0.2), (self.aside, 0.3), (self.comments, 0.35), (self.notice, 0.15), (self.form, 0.1), (self.footer, 0.85), (self.unseen, 0.08)) if self.r.random() < p]
        if self.r.random() < 0.15:
            self.r.shuffle(top)
        inside = self.article()
        for name in ("wrapper", "container", "row"):
            if self.r.random() < 0.2:
                inside = f"{self.named('div', name, 'page', 'layout')}{inside}</div>"
        page = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{self.sentence()}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{''.join(top)}{inside}{''.join(below)}</body></html>"
        return page[: self.r.randint(len(page) // 2, len(page))] if self.r.random() < 0.1 else page


def drawn(seed: int) -> tuple[list[Block], np.ndarray]:
    """Blocks of a page and their labels."""
    found = blocks(Page(seed).draw())
    labels = np.array([OPENING in b.text for b in found], dtype=np.float32)
    return [b._replace(text=b.text.replace(OPENING, "") or "x") for b in found], labels


def initial(seed: int = 0) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    w = {}
    for way in "fb":
        w[f"{way}_in"] = r.normal(0, 0.1, (WIDTH, 4 * HIDDEN))
        w[f"{way}_recur"] = r.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
        w[f"{way}_bias"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
        w[f"{way}_out"] = r.normal(0, 0.2, HIDDEN)
    w["bias"] = np.zeros(1)
    return {k: v.astype(np.float32) for k, v in w.items()}


def _back(z_grad_h: np.ndarray, kept: list, recur: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients by the projected inputs and the recurrent weights."""
    steps, pages, _ = h.shape
    gz, gr = np.zeros((steps, pages, 4 * HIDDEN), np.float32), np.zeros_like(recur)
    dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        s, g, before, r = kept[t]
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        dh = dh + z_grad_h[t]
        dc = dc + dh * o * (1 - r * r)
        a = np.concatenate((dc * g * i * (1 - i), dc * before * f * (1 - f), dh * r * o * (1 - o), dc * i * (1 - g * g)), axis=1)
        gz[t] = a
        if t:
            gr += h[t - 1].T @ a
        dh, dc = a @ recur.T, dc * f
    return gz, gr


def gradients(w: dict[str, np.ndarray], pages: list[tuple[list[Block], np.ndarray]]) -> tuple[float, dict[str, np.ndarray]]:
    """Mean logistic loss over the blocks, and its gradients."""
    lengths = np.array([len(b) for b, _ in pages])
    x = vectors([b for b, _ in pages])
    steps = int(lengths.max())
    row, page = np.concatenate([np.arange(n) for n in lengths]), np.repeat(np.arange(len(pages)), lengths)
    y, total, states = np.zeros((steps, len(pages)), np.float32), np.zeros((steps, len(pages)), np.float32), {}
    y[row, page] = np.concatenate([v for _, v in pages])
    mask = np.zeros_like(y)
    mask[row, page] = 1
    for way in "fb":
        z = np.zeros((steps, len(pages), 4 * HIDDEN), np.float32)
        at = (lengths[page] - 1 - row) if way == "b" else row
        z[at, page] = x @ w[f"{way}_in"] + w[f"{way}_bias"]
        h = one_way(z, w[f"{way}_recur"], kept := [])
        states[way] = h, kept, at
        total += (turned(h, lengths) if way == "b" else h) @ w[f"{way}_out"]
    p = 1 / (1 + np.exp(-(total + w["bias"])))
    d = (p - y) * mask / mask.sum()
    loss = float(-(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / mask.sum())
    out = {"bias": np.array([d.sum()], np.float32)}
    for way, (h, kept, at) in states.items():
        dw = turned(d[:, :, None], lengths)[:, :, 0] if way == "b" else d
        out[f"{way}_out"] = np.einsum("tp,tpk->k", dw, h)
        gz, out[f"{way}_recur"] = _back(dw[:, :, None] * w[f"{way}_out"], kept, w[f"{way}_recur"], h)
        flat = gz[at, page]
        out[f"{way}_in"], out[f"{way}_bias"] = x.T @ flat, flat.sum(0)
    return loss, out


def train(pages: int = 8000, epochs: int = 12, seed: int = 1, rate: float = 0.01) -> dict[str, np.ndarray]:
    """Adam over drawn pages, in batches of pages of similar length."""
    data = [p for p in map(drawn, range(seed * 1_000_000, seed * 1_000_000 + pages)) if p[0]]
    data.sort(key=lambda p: len(p[0]))
    batches = [data[i : i + 32] for i in range(0, len(data), 32)]
    w, r, turn = initial(seed), random.Random(seed), 0
    m, v = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}
    for epoch in range(epochs):
        r.shuffle(batches)
        step = rate * (1 - epoch / epochs) + rate / 20
        for batch in batches:
            _, g = gradients(w, batch)
            turn += 1
            for k in w:
                grad = np.clip(g[k], -1, 1) + 1e-5 * w[k]
                m[k] += 0.1 * (grad - m[k])
                v[k] += 0.001 * (grad * grad - v[k])
                w[k] -= step * (m[k] / (1 - 0.9**turn)) / (np.sqrt(v[k] / (1 - 0.999**turn)) + 1e-8)
    return w


if __name__ == "__main__":
    np.savez_compressed(sys.argv[1] if len(sys.argv) > 1 else WEIGHTS, **{k: v.astype(np.float16) for k, v in train().items()})

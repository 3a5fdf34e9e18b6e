"""Fits the block labeller of ``page_text`` on generated pages (bounded by PAGES).

Run ``python -m skyfix.llm.training.train_page_text``; it writes models/page_text.npz and
prints the accuracy on pages that were held out.
"""

from __future__ import annotations

import random

import numpy as np

from ..page_text import INPUT, STATE, WEIGHTS, blocks, features, reversed_rows, scores

PAGES, EPOCHS, BATCH, RATE = 8000, 8, 48, 0.004
MARK = "⁠"  # word joiner in front of each article block of a generated page


#: What untidy texts put behind every word.
STYLES = (" |", "|", "%%%", "###", "!!", "$$$", " -", ".", "&amp;&amp;")


#: Names of containers of an article, and of any container.
OWN = ["content", "article", "post", "entry-content", "article-body", "story", "text", "body-text", "main-content"]
ANY = ["wrap", "wrapper", "container", "row", "col", "col-md-8", "inner", "page", "layout", "grid", "box", "block", "outer", "site", "root", "app", "clearfix", "left", "center"]


def words(r: random.Random, n: int) -> str:
    made = ["".join(r.choice(["th", "an", "er", "in", "ou", "ti", "sch", "eau", "ción", "ge", "mo", "ra", "é", "ü", "st", "ly", "a"]) for _ in range(r.choice([1, 1, 2, 2, 3, 4]))) + r.choice(["", "", "", "", ",", "***", ""]) for _ in range(n)]
    tail = r.choice(STYLES) if n > 1 and r.random() < 0.3 else ""
    return (tail + " ").join(made).capitalize() + tail * (r.random() < 0.5)


def page(r: random.Random) -> str:
    """A page with its article blocks marked."""
    p = lambda lo, hi: words(r, r.randint(lo, hi)) + r.choice([".", ".", ".", "", "!", "?"])
    link = lambda: f'<a href="/{words(r, 1)}">{words(r, r.randint(1, 3))}</a>'
    cls = lambda names: r.choice(names)
    links = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 9))) + "</ul>"
    inline = lambda t: r.choice([t, t, t, f"<b>{t}</b>", f"{t} <a href=\"x\">{words(r, 2)}</a> {words(r, 5)}", f"<em>{t}</em>", f"<b>{t}<br>"])

    def menu() -> str:
        return r.choice([f"<nav>{links()}</nav>", f'<div class="{cls(["menu", "nav", "navbar", "main-menu", "breadcrumbs"])}">{r.choice([links(), " ".join(link() for _ in range(5))])}</div>', f'<ul class="{cls(["menu", "nav", "topnav"])}">' + "".join(f"<li>{link()}</li>" for _ in range(5)) + "</ul>"])

    def header() -> str:
        return r.choice([f"<header><h1>{p(1, 3)}</h1><p>{p(2, 6)}</p></header>", f'<div class="{cls(["header", "site-header", "masthead", "topbar"])}"><div>{p(1, 4)}</div></div>', f"<header>{menu()}</header>", ""])

    def advert() -> str:
        return f'<{(t := r.choice(["div", "div", "aside", "section"]))} class="{cls(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner"])}">{r.choice([p(4, 14), f"<p>{p(4, 12)}</p>", p(2, 6) + " " + link()])}</{t}>'

    def aside() -> str:
        inner = r.choice([f"<h3>{words(r, 2)}</h3>{links()}", f"<p>{p(6, 25)}</p><p>{p(3, 12)}</p>", f"<h4>{words(r, 2)}</h4><p>{p(5, 20)}</p>"])
        return r.choice([f"<aside>{inner}</aside>", f'<div class="{cls(["sidebar", "side", "related", "widget", "recommended"])}">{inner}</div>', f'<aside class="sidebar">{inner}</aside>'])

    def notice() -> str:
        return f'<div {r.choice(["class", "id"])}="{cls(["cookie", "cookie-notice", "notice", "consent", "gdpr", "alert", "popup", "subscribe", "paywall"])}">{r.choice([p(6, 20), f"<p>{p(6, 20)}</p>"])}{r.choice(["", "<button>Ok</button>"])}</div>' if r.random() < 0.8 else f"<noscript>{r.choice([p(4, 16), f'<p>{p(4, 16)}</p>'])}</noscript>"

    def form() -> str:
        return r.choice([f"<form><label>{p(1, 3)}</label><input><button>{words(r, 1)}</button></form>", f'<form class="{cls(["search", "signup", "login", "newsletter"])}"><p>{p(3, 10)}</p><input name="q"><button>{words(r, 2)}</button></form>', f'<div class="newsletter"><form>{p(3, 9)}<input></form></div>'])

    def comments() -> str:
        one = lambda: r.choice([f'<div class="comment"><b>{words(r, 1)}</b><p>{p(4, 30)}</p></div>', f"<li><p>{p(4, 30)}</p></li>", f'<article class="comment"><p>{p(4, 30)}</p></article>'])
        many = "".join(one() for _ in range(r.randint(1, 6)))
        return r.choice([f'<section class="{cls(["comments", "comment-list", "discussion", "responses"])}"><h2>{words(r, 1)}</h2>{many}</section>', f'<div id="comments">{many}</div>', f'<ol class="commentlist">{many}</ol>'])

    def footer() -> str:
        inner = r.choice([f"&copy; {words(r, 1)} &middot; {p(3, 10)}", f"<p>{p(3, 12)}</p>{links()}", f"{links()}<p>&copy; 2020 {words(r, 2)}</p>", p(4, 12)])
        return r.choice([f"<footer>{inner}</footer>", f'<div class="{cls(["footer", "site-footer", "bottom"])}">{inner}</div>', f"<footer>{inner}</footer>"])

    def article() -> str:
        body = [f"<h1>{MARK}{p(2, 12)}</h1>"] if r.random() < 0.8 else []
        unclosed = r.random() < 0.25
        for _ in range(r.randint(1, 14) if r.random() < 0.9 else r.randint(15, 40)):
            n = r.choice([(1, 3), (4, 20), (20, 90), (20, 90), (90, 160)])
            body.append(r.choice([f"<p>{MARK}{inline(p(*n))}" + "</p>" * (not unclosed)] * 7 + [f"<h2>{MARK}{words(r, 3)}</h2>", "<ul>" + "".join(f"<li>{MARK}{p(2, 15)}</li>" for _ in range(3)) + "</ul>", f"<blockquote><p>{MARK}{p(5, 30)}</p></blockquote>", f"<pre>{MARK}{p(3, 12)}</pre>", f"<table><tr><td>{MARK}{p(1, 4)}</td><td>{MARK}{p(1, 4)}</td></tr></table>", f"<div>{MARK}{p(8, 40)}</div>"]))
            if r.random() < 0.06:
                body.append(r.choice([advert, aside, notice])())
        text = "".join(body)
        tag = r.choice(["article", "section", "div", "main", ""])
        if not tag:
            return text
        return wrapped(f"<{tag}{name(OWN)}>{text}</{tag}>", r.choice([0, 0, 1, 2, 3, 6, 12]))

    def name(known: list[str]) -> str:
        """No name, a known one, one that any container may have, or one that says nothing."""
        chosen = r.choice(["", "", r.choice(known), r.choice(ANY), words(r, 1).lower().strip(",*. |-#%!$"), f"{r.choice(ANY)} {words(r, 1).lower()}"])
        return f' {r.choice(["class", "class", "id"])}="{chosen}"' if chosen else ""

    def wrapped(inner: str, depth: int) -> str:
        for _ in range(r.randint(0, depth)):
            tag = r.choice(["div", "div", "div", "section", "main"])
            inner = f"<{tag}{r.choice(['', name(ANY)])}>{inner}</{tag}>"
        return inner

    top = [x() for x in r.sample([menu, header, notice, advert, form, aside], r.randint(0, 4))]
    rest = [x() for x in r.sample([aside, comments, advert, notice, form, menu], r.randint(0, 4))] + ([footer()] if r.random() < 0.85 else [])
    kind = r.random()
    if kind < 0.25:  # a common plain layout
        top, rest = [menu(), "<!-- ad -->", advert()], [footer()]
    top, rest = [wrapped(x, r.choice([0, 0, 0, 1, 3])) for x in top], [wrapped(x, r.choice([0, 0, 0, 1, 3])) for x in rest]
    head = f"<head><title>{words(r, 4)}</title><style>p{{}}</style><script>var t=\"</p>\";</script></head>" if r.random() < 0.9 else ""
    return f"<!DOCTYPE html><html>{head}<body>{wrapped(''.join(top) + article() + ''.join(rest), r.choice([0, 0, 1, 4]))}</body></html>"


def labelled(r: random.Random) -> tuple[np.ndarray, np.ndarray]:
    found = blocks(page(r))
    y = np.array([MARK in t for _, t, _ in found], np.float32)
    clean = [(a, t.replace(MARK, "") or "x", c) for a, t, c in found]
    return features(clean, {}), y


def forward_back(x: np.ndarray, lengths: np.ndarray, w: dict, side: str):
    """States and what the gradient needs, for one direction."""
    n, steps, _ = x.shape
    into, h, c, kept = x @ w[side + "x"] + w[side + "b"], np.zeros((n, STATE)), np.zeros((n, STATE)), []
    out = np.zeros((n, steps, STATE))
    for t in range(steps):
        z = into[:, t] + h @ w[side + "h"]
        g = 1 / (1 + np.exp(-z[:, : 3 * STATE]))
        i, f, o, u = g[:, :STATE], g[:, STATE : 2 * STATE], g[:, 2 * STATE :], np.tanh(z[:, 3 * STATE :])
        before, last = c, h
        c = f * c + i * u
        h = o * np.tanh(c)
        kept.append((i, f, o, u, before, c, last))
        out[:, t] = h
    return out, kept


def gradient(x: np.ndarray, kept: list, d_out: np.ndarray, w: dict, side: str, grads: dict) -> None:
    n, steps, _ = x.shape
    dh, dc = np.zeros((n, STATE)), np.zeros((n, STATE))
    dz_all = np.zeros((n, steps, 4 * STATE))
    for t in range(steps - 1, -1, -1):
        i, f, o, u, before, c, last = kept[t]
        dh = dh + d_out[:, t]
        tc = np.tanh(c)
        dc = dc + dh * o * (1 - tc**2)
        dz = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u**2)], axis=1)
        dz_all[:, t] = dz
        grads[side + "h"] += last.T @ dz
        dh, dc = dz @ w[side + "h"].T, dc * f
    grads[side + "x"] += np.einsum("nti,ntj->ij", x, dz_all, optimize=True)
    grads[side + "b"] += dz_all.sum(axis=(0, 1))


def main() -> None:
    r, rng = random.Random(11), np.random.default_rng(11)
    data = [labelled(r) for _ in range(PAGES)]
    data, held = data[: PAGES * 9 // 10], data[PAGES * 9 // 10 :]
    w = {f"{s}{k}": rng.normal(0, 0.1, shape) for s in "fr" for k, shape in (("x", (INPUT, 4 * STATE)), ("h", (STATE, 4 * STATE)))}
    w |= {s + "b": np.concatenate([np.zeros(STATE), np.ones(STATE), np.zeros(2 * STATE)]) for s in "fr"}
    w |= {"out": rng.normal(0, 0.1, (2 * STATE + INPUT, 1)), "bias": np.zeros(1)}
    m, v, step = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    for epoch in range(EPOCHS):
        order = sorted(range(len(data)), key=lambda i: len(data[i][1]) + rng.random() * 6)
        groups = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        r.shuffle(groups)
        loss = 0.0
        for group in groups:
            lengths = np.array([max(1, len(data[i][1])) for i in group])
            x, y, real = np.zeros((len(group), lengths.max(), INPUT)), np.zeros((len(group), lengths.max())), np.zeros((len(group), lengths.max()))
            for row, i in enumerate(group):
                n = len(data[i][1])
                x[row, :n], y[row, :n], real[row, :n] = data[i][0], data[i][1], 1
            x[:, :, :-1] *= rng.random(x[:, :, :-1].shape) > 0.05
            back = reversed_rows(x, lengths)
            hf, kf = forward_back(x, lengths, w, "f")
            hr, kr = forward_back(back, lengths, w, "r")
            top = np.concatenate([hf, reversed_rows(hr, lengths), x], axis=2)
            p = 1 / (1 + np.exp(-(top @ w["out"] + w["bias"])[:, :, 0]))
            loss -= float((real * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / real.sum())
            d = (real * (p - y) / real.sum())[:, :, None]
            grads = {k: np.zeros_like(a) for k, a in w.items()}
            grads["out"], grads["bias"] = np.einsum("nti,ntj->ij", top, d), d.sum(axis=(0, 1))
            d_top = d @ w["out"].T
            gradient(x, kf, d_top[:, :, :STATE] * real[:, :, None], w, "f", grads)
            gradient(back, kr, reversed_rows(d_top[:, :, STATE : 2 * STATE] * real[:, :, None], lengths), w, "r", grads)
            step += 1
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                w[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        small = {k: a.astype(np.float32) for k, a in w.items()}
        z = scores([x for x, _ in held], small)
        right = np.mean(np.concatenate([(s > 0) == (y > 0) for s, (_, y) in zip(z, held)]))
        print(f"epoch {epoch}: loss {loss / len(groups):.4f}, held-out block accuracy {right:.4f}", flush=True)
    WEIGHTS.parent.mkdir(exist_ok=True)
    np.savez_compressed(WEIGHTS, **{k: a.astype(np.float16) for k, a in w.items()})


if __name__ == "__main__":
    main()

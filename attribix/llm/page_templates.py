"""Composed pages with a label for every block: what the block labeller is trained on.

A page is a random arrangement of site parts (header, menus, notices, adverts, forms, sidebars, comments, footer) around
an article, each part in one of the many ways sites mark it up: by element, by class, by id or not at all. Running text
has the same words in all parts, so a label has to be learned from markup, shape and what stands around. Labels come from
the composition; no page of the given tables is looked at.
"""

from __future__ import annotations

import random
from html import escape

#: Word parts of class names and ids, by what they mark.
NAMES = {
    "article": "article post entry content story main body text single blogpost page primary hentry prose document news",
    "head": "header masthead top topbar banner branding logo site title hero",
    "menu": "nav navbar menu navigation breadcrumb breadcrumbs topnav links pagination pager tabs toc sitemap skip",
    "notice": "notice cookie cookies consent gdpr alert popup modal privacy warning message overlay paywall toast",
    "ad": "ad ads advert advertisement adsense sponsored sponsor promo promotion banner dfp outbrain taboola commercial",
    "form": "form search login signup subscribe newsletter contact register signin subscription",
    "side": "sidebar aside widget related recommended popular trending side more teaser rail recent secondary tags share social author bio",
    "comment": "comment comments discussion respond responses replies reply disqus commentlist feedback reviews thread reader",
    "foot": "footer foot copyright legal bottom colophon imprint credits",
}
NEUTRAL = "container wrapper wrap inner outer row col grid box block area section module region layout left right clearfix js item".split()

#: Phrases that sites use in their parts.
PHRASES = {
    "head": ["Daily News", "The Journal", "Home page of the project", "Skip to content", "A blog about things", "Welcome"],
    "menu": ["Home", "About", "About us", "Contact", "News", "Blog", "Products", "Archive", "Next", "Previous", "Login", "Sports", "Start", "Kontakt", "Accueil", "Inicio"],
    "notice": ["We use cookies to improve your experience.", "By using this site you agree to our privacy policy.", "Accept all cookies", "Manage consent", "You have read 3 of 5 free articles this month.", "This site is under maintenance tonight.", "Diese Seite verwendet Cookies.", "Ce site utilise des cookies."],
    "ad": ["Advertisement", "Sponsored", "Buy now and save 20%", "Special offer: click here", "Anzeige", "Try it free for 30 days!", "Promoted content"],
    "form": ["Email address", "Your name", "Subscribe", "Search", "Send", "Password", "Sign up for our newsletter", "Log in", "Submit"],
    "side": ["Related articles", "Read more", "Popular posts", "Share on Facebook", "Tweet", "Tags", "Categories", "Recent posts", "About the author", "You may also like"],
    "comment": ["Comments", "3 comments", "Leave a reply", "Reply", "says:", "Posted on 12 March 2019 at 10:21", "Great article, thank you!", "I do not agree with this at all.", "Report", "Kommentare"],
    "foot": ["&copy; 2021 example.com", "All rights reserved.", "Terms of use &middot; Privacy policy", "Powered by the engine", "&copy; www.example.org", "Impressum"],
}

SYLLABLES = [
    "the and of to in is on ing er ed th ea an re he nt ti or st ou ble ha wh es at en ly tion sh nd".split(),
    "der die und ein sch ung ch ver ge keit lich be st zu heit pf tz ie en ä ö ü ß au er".split(),
    "le la de et que eau tre ai ou ment ier pa ré é è ê ç vi oi eux re on an ch aux".split(),
    "el los que ción ar mi ga do ez ll rr ñ í ó as bo ja co ra os ie ue ta sa".split(),
]


class Composer:
    """Pages from one random state."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def word(self) -> str:
        return "".join(self.rng.choices(self.syllables, k=self.rng.randint(1, 4)))

    def sentence(self, low: int = 3, high: int = 18) -> str:
        words = [self.word() for _ in range(self.rng.randint(low, high))]
        if self.rng.random() < 0.05:
            words = [w + self.rng.choice(["&amp;", "###", "***", "$$$", "%%%"]) for w in words]
        return " ".join(words).capitalize() + self.rng.choice([".", ".", ".", "!", "?", ""])

    def paragraph(self, short: bool = False) -> str:
        text = [self.sentence() for _ in range(1 if short else self.rng.choice([1, 2, 3, 5, 9]))]
        if self.rng.random() < 0.3:
            at = self.rng.randrange(len(text))
            name = self.rng.choice(["b", "i", "em", "strong", "a", "span", "code"])
            text[at] = f"<{name}{' href=/x' if name == 'a' else ''}>{text[at]}</{name}>"
        return self.rng.choice([" ", "<br>", "\n"] if self.rng.random() < 0.2 else [" "]).join(text)

    def name(self, part: str) -> str:
        """An attribute that marks a part, or none."""
        words = [self.rng.choice(NAMES[part].split())]
        if self.rng.random() < 0.4:
            words.insert(self.rng.randint(0, 1), self.rng.choice(NEUTRAL + NAMES[part].split()))
        if self.rng.random() < 0.15:
            words.append(str(self.rng.randint(1, 99)))
        joined = self.rng.choice(["-", "_", " ", "-"]).join(words)
        if self.rng.random() < 0.1:
            joined = words[0] + "".join(w.capitalize() for w in words[1:])
        quote = self.rng.choice(['"', '"', "'"])
        return f" {self.rng.choice(['class', 'class', 'id'])}={quote}{joined}{quote}"

    def neutral(self) -> str:
        return f' class="{self.rng.choice(NEUTRAL)}"' if self.rng.random() < 0.5 else ""

    def phrase(self, part: str) -> str:
        return self.rng.choice(PHRASES[part]) if self.rng.random() < 0.5 else self.sentence(1, 6)

    def heading(self, text: str) -> str:
        level = self.rng.randint(2, 4)
        return f"<h{level}>{text}</h{level}>"

    def inside(self, part: str) -> str:
        """What a part other than the article may hold."""
        kind = self.rng.random()
        links = "".join(f'<li><a href="/{k}">{self.word() if self.rng.random() < 0.6 else self.phrase(part)}</a></li>' for k in range(self.rng.randint(1, 7)))
        if part == "menu" or kind < 0.2:
            return self.rng.choice([f"<ul>{links}</ul>", links.replace("li>", "span>"), f"<ol>{links}</ol>"])
        if part == "form":
            return f"<form{self.neutral()}><label>{self.phrase(part)}</label><input><p>{self.phrase(part)}</p><button>{self.phrase(part)}</button></form>"
        if part == "comment":
            one = lambda: f"<div{self.name('comment')}><span>{self.word()}</span><p>{self.paragraph() if self.rng.random() < 0.7 else self.phrase(part)}</p></div>"
            return f"<h3>{self.phrase(part)}</h3>" + "".join(one() for _ in range(self.rng.randint(1, 4)))
        if kind < 0.5:
            return self.phrase(part)
        if kind < 0.8:
            return f"<p>{self.paragraph(self.rng.random() < 0.6)}</p>"
        return f"{self.heading(self.phrase(part))}<p>{self.paragraph(True)}</p><a href=/y>{self.phrase(part)}</a>"

    def part(self, part: str) -> list[tuple[str, bool]]:
        element = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}.get(part)
        if element and self.rng.random() < 0.5:
            head = element + (self.name(part) if self.rng.random() < 0.5 else self.neutral())
        else:
            element = self.rng.choice(["div", "div", "section", "ul" if part == "menu" else "div"])
            head = element + self.name(part)
        held = self.inside(part)
        if part == "head" and self.rng.random() < 0.5:
            held += f"<nav>{self.inside('menu')}</nav>"
        if self.rng.random() < 0.3:
            held = f"<div{self.neutral()}>{held}</div>"
        return [(f"<{head}>{held}</{element}>", False)]

    def article(self) -> list[tuple[str, bool]]:
        out = []
        title = self.sentence(2, 12)
        if self.rng.random() < 0.9:
            out.append((f"<h1{self.neutral()}>{title}</h1>", True))
        for _ in range(self.rng.choice([1, 2, 3, 5, 8, 12, 25])):
            kind = self.rng.random()
            if self.rng.random() < 0.06:  # the article goes on after a part of the site
                out += self.part(self.rng.choice(["ad", "side", "form", "notice"]))
            if kind < 0.08:
                out.append((f"<p>{self.sentence(1, 3)}</p>", True))
            elif kind < 0.14:  # what parts of sites say may also be said in an article
                out.append((f"<p>{self.rng.choice(PHRASES[self.rng.choice(list(PHRASES))])}</p>", True))
            elif kind < 0.18:
                out.append((f"<div{self.neutral()}>{self.paragraph()}</div>", True))
            elif kind < 0.72:
                out.append((f"<p{self.neutral() if self.rng.random() < 0.2 else ''}>{self.paragraph(self.rng.random() < 0.25)}</p>", True))
            elif kind < 0.77:
                out.append((f"<p><b>{self.sentence()}<br>", True))
            elif kind < 0.83:
                out.append((self.heading(self.sentence(1, 7)), True))
            elif kind < 0.88:
                name = self.rng.choice(["ul", "ol"])
                out.append((f"<{name}>{''.join(f'<li>{self.sentence(1, 9)}</li>' for _ in range(self.rng.randint(1, 6)))}</{name}>", True))
            elif kind < 0.91:
                out.append((f"<blockquote><p>{self.paragraph()}</p></blockquote>", True))
            elif kind < 0.93:
                out.append((f"<pre>{escape(self.sentence())}\n  {self.word()}</pre>", True))
            elif kind < 0.95:
                out.append((f"<table><tr><td>{self.word()}</td><td>{self.sentence(1, 4)}</td></tr></table>", True))
            elif kind < 0.955:
                out.append((f"<dl><dt>{self.sentence(1, 3)}</dt><dd>{self.sentence()}</dd></dl>", True))
            elif kind < 0.96:
                out.append((f"<figure><figcaption>{self.sentence()}</figcaption></figure>", True))
            else:
                out += self.part(self.rng.choice(["ad", "ad", "side", "form", "notice"]))
        return out

    def page(self) -> list[tuple[str, bool]]:
        """Markup in pieces, each with whether its text belongs to the article."""
        rng = self.rng
        self.syllables = rng.choice(SYLLABLES)
        out = [(f"<!DOCTYPE html><html><head><title>{self.sentence(2, 12)}</title><style>p{{margin:0}}</style><script>var t='<p>';</script></head><body>", False)]
        before = [p for p, share in (("head", 0.5), ("menu", 0.7), ("notice", 0.3), ("ad", 0.5), ("form", 0.2), ("side", 0.2)) if rng.random() < share]
        after = [p for p, share in (("side", 0.4), ("ad", 0.3), ("comment", 0.4), ("form", 0.2), ("menu", 0.2), ("notice", 0.2)) if rng.random() < share]
        rng.shuffle(before)
        rng.shuffle(after)
        for p in before:
            out += self.part(p)
            if rng.random() < 0.1:
                out.append(("<!-- a note -->", False))
        held = self.article()
        way = rng.random()
        if way < 0.45:
            element, name = "article", self.name("article") if rng.random() < 0.4 else ""
        elif way < 0.55:
            element, name = "main", ""
        elif way < 0.92:
            element, name = rng.choice(["div", "div", "section"]), self.name("article")
        else:
            element = name = ""
        if element and rng.random() < 0.25 and after and "comment" in after:
            held += self.part("comment")  # comments inside the container
            after.remove("comment")
        if element == "article" and rng.random() < 0.15:
            held += self.part("foot")
        if element and rng.random() < 0.1 and held[0][0].startswith("<h1"):
            held[0] = (f"<header>{held[0][0]}</header>", True)
        if element and rng.random() < 0.08:  # columns of a table
            cells = [(f"<td{self.name(p)}>{self.inside(p)}</td>", False) for p in ("menu", "side") if rng.random() < 0.6]
            middle = [(f"<td{self.name('article') if rng.random() < 0.6 else self.neutral()}>", False), *held, ("</td>", False)]
            at = rng.randint(0, len(cells))
            out += [(f"<table{self.neutral()}><tr>", False), *cells[:at], *middle, *cells[at:], ("</tr></table>", False)]
        elif element:
            out += [(f"<{element}{name}>", False), *held, (f"</{element}>", False)]
        else:
            out += held
        for p in after:
            out += self.part(p)
        if rng.random() < 0.8:
            out += self.part("foot")
        if rng.random() < 0.5:  # one more level around all
            out = [out[0], (f"<div{rng.choice([self.neutral(), ' id=page', ' id=main'])}>", False), *out[1:], ("</div>", False)]
        return [*out, ("</body></html>", False)]


def composed(pages: int, seed: int) -> list[list[tuple[str, bool]]]:
    made = Composer(seed)
    return [made.page() for _ in range(pages)]

"""Lines of scanned documents: running lines, page numbers, candidates of word joins; and made-up scans to fit on."""

from __future__ import annotations

import random
import re
import unicodedata

import numpy as np

from foliospark.llm.boosting import Boosting

#: Lines at each edge of a page that may be furniture, beyond what is known to be; pages that every line there is compared
#: with before and after its own (lines of other pages are compared with the running lines found by then).
EDGE, NEAR = 3, 4
#: Characters that end a line inside a word.
HYPHENS = "-‐‑­¬"
#: Characters and what scanners misread them as.
CONFUSIONS = [
    ("l", "1"), ("i", "1"), ("i", "l"), ("l", "i"), ("o", "0"), ("e", "c"), ("c", "e"), ("t", "f"), ("f", "t"), ("a", "@"), ("m", "rn"), ("rn", "m"),
    ("d", "cl"), ("cl", "d"), ("u", "ii"), ("n", "ri"), ("ri", "n"), ("ti", "h"), ("é", "6"), ("ó", "6"), ("h", "b"), ("b", "h"), ("g", "9"), ("s", "5"), ("b", "6"), ("w", "vv"), ("h", "li"),
    ("n", "u"), ("u", "n"), ("k", "lc"), ("z", "2"), ("g", "q"), ("q", "g"), ("y", "v"), ("o", "c"), ("ü", "ii"), ("ä", "a"), ("ö", "o"),
    ("é", "e"), ("è", "e"), ("á", "a"), ("ó", "o"), ("í", "i"), ("о", "0"), ("з", "3"), ("б", "6"), ("ш", "щ"), ("и", "н"), ("н", "и"), ("п", "н"), ("е", "с"), ("с", "е"),
]
_NUMBER = re.compile(
    r"[\W_]*(?:(?:page|pag|pagina|página|seite|strona|str|стр|страница|bladzijde|blz|folha|hoja|feuille|blatt|fol|p|s|第)[.\s]*)?"
    r"([0-9lIoOSB|]{1,4}|[ivxlc]{1,8})(?:\s*(?:of|von|de|di|van|z|из|sur|aus|/|\||-|–|共)\s*[0-9lIoOSB|]{1,4})?[\s页]*[\W_]*",
    re.IGNORECASE,
)
_FIGURE = re.compile(r"[\W\d_]*\d[\W\d_]*|[A-Z]{1,3}-\d+")
_DIGITS = str.maketrans("lIoOSB|", "1100581")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def number_of(line: str) -> int | None:
    """The number of a line that has nothing else than one, in any decoration; None for other lines."""
    m = _NUMBER.fullmatch(line.strip())
    if m is None:
        return None
    text = m[1]
    if any(c.isdigit() for c in text):
        return int(text.translate(_DIGITS))
    if re.fullmatch("[ivxlcIVXLC]+", text):
        values = [_ROMAN[c] for c in text.lower()]
        return sum(-v if v < max(values[k:]) else v for k, v in enumerate(values))
    return None


def skeleton(line: str) -> str:
    """A line without case and with one sign for each number."""
    return re.sub(r"\d[\d.,]*", "#", unicodedata.normalize("NFKC", line).lower()).strip()


def _grams(s: str) -> frozenset:
    s = f"^{re.sub(r'[#\\W_]+', ' ', s).strip()}$"
    return frozenset(s[k : k + 2] for k in range(len(s) - 1))


class Page:
    """The lines of one document with their pages and their places on them."""

    def __init__(self, content: str):
        raw = content.split("\n")
        self.lines = [x.replace("\f", "").strip() for x in raw]
        self.raw = raw
        n = len(raw)
        self.value = [number_of(x) if x and sum(map(str.isalnum, x)) < 24 else None for x in self.lines]
        page, pages = 0, []
        full = [k for k in range(n) if self.lines[k]]
        after = {a: b for a, b in zip(full, full[1:], strict=False)}
        before = {b: a for a, b in zip(full, full[1:], strict=False)}
        feeds = "\f" in content
        for k in range(n):
            # form feeds part pages; in a text without them, empty lines do
            if full and k > full[0] and ("\f" in raw[k] if feeds else not self.lines[k] and bool(self.lines[k - 1])):
                page += 1
            pages.append(page)
        self.page = pages
        by: dict[int, list[int]] = {}
        for k in full:
            by.setdefault(pages[k], []).append(k)
        self.top, self.bottom = {}, {}
        for own in by.values():
            for j, k in enumerate(own):
                self.top[k], self.bottom[k] = j, len(own) - 1 - j
        self.after, self.before, self.n_pages = after, before, len(by)
        self.by_page = by
        self.edge = self.edges(set())

    def edges(self, known: set[int]) -> list[int]:
        """The lines at the edges of the pages: EDGE at each, not counting those known to be furniture.

        Sets their depths: the places of the outermost lines, for others the place among the lines that are not known.
        """
        out = set()
        self.depth: dict[int, list[int]] = {}
        for own in self.by_page.values():
            for side in (own, own[::-1]):
                n = 0
                for k in side:
                    place = (self.top if side is own else self.bottom)[k]
                    self.depth.setdefault(k, []).append(place if place < EDGE else n)
                    if n < EDGE:
                        out.add(k)
                    n += k not in known
        return sorted(out)

    def pair_features(self, a: int, b: int, grams: dict[int, frozenset]) -> list[float]:
        ga, gb = grams[a], grams[b]
        la, lb = self.lines[a], self.lines[b]
        same = 2 * len(ga & gb) / max(1, len(ga) + len(gb))
        tops, bottoms = zip(self.depth[a], self.depth[b], strict=True)
        return [
            same, float(len(la)), abs(len(la) - len(lb)), min(max(tops), max(bottoms)), float(la[:1].islower()) + lb[:1].islower(),
            float(la[-1] in ".,;:") + (lb[-1] in ".,;:"), float(len(la.split())), float(skeleton(la) == skeleton(lb)),
        ]

    def pairs(self):
        """Pairs of edge lines of different pages that may be one running line: all with the same words, others of pages near."""
        rows = [k for k in self.edge if self.value[k] is None]
        grams = {k: _grams(skeleton(self.lines[k])) for k in rows}
        last: dict[str, int] = {}
        for x, a in enumerate(rows):
            s = skeleton(self.lines[a])
            if s in last and self.page[last[s]] != self.page[a]:
                yield last[s], a, grams
            last[s] = a
            for b in rows[x + 1 :]:
                if self.page[b] - self.page[a] > NEAR:
                    break
                if self.page[b] != self.page[a] and len(grams[a] & grams[b]) * 2.5 > len(grams[a] | grams[b]) and (self.lines[a] != self.lines[b] or s != last.get(s)):
                    yield a, b, grams

    def pairs_with(self, running: set[int]):
        """Edge lines that are not known, with each different running line of far pages."""
        rows = [k for k in self.edge if self.value[k] is None and k not in running]
        models: dict[str, int] = {}
        for k in sorted(running):
            models.setdefault(skeleton(self.lines[k]), k)
        if not rows or not models:
            return
        grams = {k: _grams(skeleton(self.lines[k])) for k in {*rows, *models.values()}}
        for a in rows:
            for b in models.values():
                if abs(self.page[a] - self.page[b]) > NEAR and len(grams[a] & grams[b]) * 2.5 > len(grams[a] | grams[b]):
                    yield a, b, grams

    def number_features(self, k: int) -> list[float]:
        line = self.lines[k]
        value = self.value[k] or 0
        fits = misfits = 0
        for j in self.edge:
            if j != k and self.value[j] is not None and 0 < abs(self.page[j] - self.page[k]) <= NEAR:
                good = self.value[j] - value == self.page[j] - self.page[k]
                fits, misfits = fits + good, misfits + (not good)
        prev, nxt = self.before.get(k), self.after.get(k)
        beside = sum(1 for j in (prev, nxt) if j is not None and self.page[j] == self.page[k] and _FIGURE.fullmatch(self.lines[j]))
        bare = line.isdigit()
        short = prev is not None and self.page[prev] == self.page[k] and len(self.lines[prev]) < 30 and self.lines[prev][-1] not in ".,;"
        gap = (k > 0 and not self.lines[k - 1]) + (k + 1 < len(self.lines) and not self.lines[k + 1])
        return [float(self.top[k]), float(self.bottom[k]), fits, misfits, float(beside), float(bare), float(len(line)), float(short), float(gap), float(self.n_pages), min(value, 5000)]


def furniture(page: Page, pair_model: Boosting, number_model: Boosting) -> tuple[set[int], set[int]]:
    """Line numbers (from 0) of running lines and of page numbers.

    Once lines are known, the next ones behind them are looked at too, and lines of far pages that are misread.
    """
    running: set[int] = set()
    numbers: set[int] = set()
    rows = [k for k, v in enumerate(page.value) if v is not None and k in page.top]
    while True:
        found = list(page.pairs())
        if found:
            p = pair_model.predict(np.array([page.pair_features(a, b, g) for a, b, g in found]))
            for (a, b, _), s in zip(found, p, strict=True):
                if s > 0.5:
                    running |= {a, b}
            far = list(page.pairs_with(running))
            if far:
                p = pair_model.predict(np.array([page.pair_features(a, b, g) for a, b, g in far]))
                running |= {a for (a, _, _), s in zip(far, p, strict=True) if s > 0.5}
        if rows:
            p = number_model.predict(np.array([page.number_features(k) for k in rows]))
            numbers = {k for k, s in zip(rows, p, strict=True) if s > 0.5}
        edge = page.edges(running | numbers)
        if len(edge) <= len(page.edge):
            return running, numbers - running
        page.edge = edge


def misread(word: str, rng: random.Random) -> str:
    """The word with one character, or pair, misread; the word itself where nothing fits."""
    options = [(m.start(), a, b) for a, b in CONFUSIONS for m in re.finditer(re.escape(a), word)]
    if not options:
        return word
    at, a, b = rng.choice(options)
    return word[:at] + b + word[at + len(a) :]


def made_up_scan(text: str, rng: random.Random) -> tuple[str, set[int], set[int]]:
    """A scan of a clean text with furniture at known lines: content, running lines, page numbers."""
    words = text.split()
    width, height = rng.randint(45, 75), rng.randint(8, 30)
    lines, now = [], ""
    for w in words:
        if len(now) + len(w) + 1 > width:
            lines.append(now)
            now = w
        else:
            now = f"{now} {w}".strip()
    lines.append(now)
    title = " ".join(words[2 : rng.choice([5, 5, 5, 5, 5, 4, 6, 7])])[:40].strip(".,;: ") or "Report"
    below = [" ".join(words[k : k + rng.randint(2, 4)]).strip(".,;: ").capitalize() for k in range(8, 8 + 4 * (rng.choice([1, 2, 4]) if rng.random() < 0.08 else 0), 4)]  # more lines of the head
    if rng.random() < 0.3:
        title = title.upper()
    if rng.random() < 0.3:
        title = f"{title.split()[0]} {rng.randint(10, 99999)}"
    block = " ".join(words[6:8]).strip(".,;: ").capitalize()
    style = rng.choice(["{n}", "{n}", "- {n} -", "– {n} –", "[{n}]", "{n}/{t}", "Page {n} of {t}", "roman", "Seite {n}", "p. {n}"])
    head, foot = rng.random() < 0.5, rng.random() < 0.3
    with_number, number_top, has_number = rng.random() < 0.3, rng.random() < 0.2, rng.random() < 0.75
    start, feed = rng.randint(1, 60), rng.random() < 0.75
    out: list[str] = []
    running, numbers = set(), set()
    pages = [lines[k : k + height] for k in range(0, len(lines), height)]
    if rng.random() < 0.3:
        pages = pages[:1]
    for k, page in enumerate(pages):
        n, total = start + k, start + len(pages) - 1
        page = list(page)
        for _ in range(rng.choice([0, 0, 1])):  # a small table: a heading and figures
            at = rng.randint(1, max(1, len(page) - 1))
            figures = [str(rng.randint(5, 9999)), f"{rng.randint(1, 99)},{rng.randint(100, 999)}", f"{rng.randint(1, 99)}.{rng.randint(1, 9)}", f"TH-{rng.randint(10, 9999)}", str(rng.randint(2, 99))]
            page[at:at] = [block, *rng.sample(figures, rng.randint(2, 3))]
        label = "".join(("c" * (n // 100), "xc" if n % 100 >= 90 else "l" * (n % 100 >= 50) + "x" * (n % 50 // 10), ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"][n % 10])) if style == "roman" else style.format(n=n, t=total)
        if rng.random() < 0.05:
            label = label.replace("1", "l", 1)
        line = (f"{title}   {n}" if n % 2 else f"{n}   {title}") if with_number and not title[-1:].isdigit() else title
        if rng.random() < 0.15:
            line = misread(line, rng)
        several = len(pages) > 1
        if has_number and number_top:
            numbers.add(len(out))
            out.append(label)
        if head and several and rng.random() < 0.95:
            for x in [line, *below]:
                running.add(len(out))
                out.append(x)
        out += page
        if foot and several and not head:
            running.add(len(out))
            out.append(line)
        if has_number and not number_top:
            numbers.add(len(out))
            out.append(label)
        if k + 1 < len(pages):
            out.append("\f" if feed else "")
    return "\n".join(out), running, numbers


def fit_furniture(texts: list[str], seed: int = 9) -> tuple[Boosting, Boosting]:
    """Classifiers of line pairs (one running line?) and of number lines (page number?), fitted on made-up scans."""
    rng = random.Random(seed)
    px, py, nx, ny = [], [], [], []
    for text in texts * 3:
        if len(text) < 400:
            continue
        content, running, numbers = made_up_scan(text[: rng.randint(600, 6000)], rng)
        page = Page(content)
        for a, b, grams in page.pairs():
            px.append(page.pair_features(a, b, grams))
            py.append(a in running and b in running)
        for k, v in enumerate(page.value):
            if v is not None and k in page.top:
                nx.append(page.number_features(k))
                ny.append(k in numbers)
    pair = Boosting(40).fit(np.array(px or [[0.0] * 8]), np.array(py or [0]))
    return pair, Boosting(60).fit(np.array(nx or [[0.0] * 11]), np.array(ny or [0]))

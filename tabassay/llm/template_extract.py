"""Main text of web pages by deducing each host's template.

Tokens are tags, with their class or id, and the pieces of text between tags. Over
a block of pages of one host, tokens with the same number of occurrences on every
page form an equivalence class. A class is valid if its tokens come in the same
order on all pages. The valid classes nest: one lies between two tokens of
another. The outermost class is the template's frame; what lies between its tokens
are the slots, and a text that belongs to a valid class itself is part of the
template, not data, wherever it stands. The slots that hold the article are read
from every page: those that tags or classes mark on some page, or without any mark
those whose text differs between pages. Where most of the text is equal on all
pages, the pages are copies of one article, and equal texts say nothing.

A host with very many pages is cut into blocks by a hash of the page, so no task
gets a whole host, and a block is deduced for itself.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabassay.llm.shared import same, ship_package

#: About so many pages of one host are looked at together.
BLOCK_PAGES = 64
#: A frame or a repeated text needs at least so many different pages to be believed.
LEAST_PAGES = 4
#: A token of a template is on at least this share of the pages.
SHARE = 0.9

#: What HTML treats as blocks, as raw text, and as elements without an end.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre "
    "section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript template iframe svg textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, and words in a class or id, that hold no part of an article.
OUTSIDE = RAW | frozenset("nav footer aside head menu dialog button select object canvas audio video".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies copyright "
    "disqus footer header menu menubar modal nav navbar navigation newsletter notice notices pager pagination "
    "popup promo related reply replies respond share sharing sidebar social sponsor sponsored subscribe "
    "subscription toolbar widget widgets".split()
)
ARTICLES = frozenset("article main".split())
ARTICLE_WORDS = frozenset("article content entry main post story".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|iframe|svg|textarea|title|xmp)\b(?P<more>[^>]*)>"
    r"(?:.*?(?=</(?P=raw)\b)|.*\Z)|<[/!?]?[a-zA-Z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|<[/!?]?[a-zA-Z][^<>]*(?:>|\Z|(?=<))"
    r"|[^<]+|<",
    re.DOTALL | re.IGNORECASE,
)
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Page:
    """A page as tokens: texts and tags, each with its key, and where every text stands."""

    def __init__(self, source: str) -> None:
        self.keys: list[str] = []
        #: Per text: its number among the tokens, its words, whether a block begins before it.
        self.texts: list[tuple[int, str, bool]] = []
        #: Per text: whether it lies outside any article, and whether it lies in one.
        self.outside: list[bool] = []
        self.inside: list[bool] = []
        #: Per text: whether only a class around an article puts it outside, and the outermost form around it.
        self._wrapped: list[bool] = []
        self._form: list[int] = []
        self._forms = 0
        self._read(source)
        self._settle()

    def _settle(self) -> None:
        """A form with most of the page's text is a wrapper; so is a class around the only article."""
        sizes, total = Counter(), 0
        for (_, text, _), outside, wrapped, form in zip(
            self.texts, self.outside, self._wrapped, self._form, strict=True
        ):
            if not outside or wrapped:
                sizes[form] += len(text.strip())
                total += len(text.strip())
        forms = {form for form, n in sizes.items() if form and 2 * n <= total}
        for i, form in enumerate(self._form):
            if form in forms:
                self.outside[i], self._wrapped[i] = True, False
        free = any(
            inside and not outside and text.strip()
            for (_, text, _), inside, outside in zip(self.texts, self.inside, self.outside, strict=True)
        )
        if not free:
            self.outside = [o and not w for o, w in zip(self.outside, self._wrapped, strict=True)]

    def _read(self, source: str) -> None:
        open_: list[tuple[str, bool, bool, bool, int]] = []
        block = True
        for found in _TOKEN.finditer(source):
            token = found.group()
            if token[0] != "<" or len(token) == 1:
                self._text(token, block, open_)
                block = False
                continue
            raw = found.group("raw")
            name = _NAME.match(token)
            if raw:
                self.keys.append(f"<{raw.lower()}>")
                open_.append((raw.lower(), True, False, False, 0))
                block = True
                continue
            if not name:
                continue  # a comment or a declaration
            closing, tag = name.group(1), name.group(2).lower()
            block |= tag in BLOCKS
            if closing:
                self.keys.append(f"</{tag}>")
                self._close(tag, open_)
                continue
            names = _attribute_names(token)
            words = sorted(frozenset().union(*names))
            self.keys.append(f"<{tag} {' '.join(words)}>" if words else f"<{tag}>")
            if tag not in VOID and not token.endswith("/>"):
                self._open(tag, names, open_)

    def _open(self, tag: str, names: list[frozenset[str]], open_: list[tuple[str, bool, bool, bool, int]]) -> None:
        # `wrapped`: outside by a class alone, with an article begun within it.
        _, outside, inside, wrapped, form = open_[-1] if open_ else ("", False, False, False, 0)
        by_tag = any(x[0] in OUTSIDE for x in open_) if tag in ARTICLES and outside else False
        named = any(_outside_name(x) for x in names)
        starts = tag in ARTICLES or (tag not in ("body", "html") and any(_article_name(x) for x in names))
        # A header within an article belongs to it.
        unwanted = tag in OUTSIDE or (tag == "header" and not inside) or named
        if tag in ("body", "html") or (tag in ARTICLES and not named):
            unwanted = False
        if tag == "form" and not form:
            self._forms += 1
            form = self._forms
        wrapped = not unwanted and (wrapped or (outside and tag in ARTICLES and not by_tag))
        open_.append((tag, outside or unwanted, inside or starts, wrapped, form))

    @staticmethod
    def _close(tag: str, open_: list[tuple[str, bool, bool, bool, int]]) -> None:
        # An end without a beginning ends nothing; what was left open inside ends too.
        for k in range(len(open_) - 1, -1, -1):
            if open_[k][0] == tag:
                del open_[k:]
                return

    def _text(self, token: str, block: bool, open_: list[tuple[str, bool, bool, bool, int]]) -> None:
        self.texts.append((len(self.keys), token, block))
        self.outside.append(bool(open_) and open_[-1][1])
        self.inside.append(bool(open_) and open_[-1][2])
        self._wrapped.append(bool(open_) and open_[-1][3])
        self._form.append(open_[-1][4] if open_ else 0)
        self.keys.append("'" + " ".join(token.split()))


def _attribute_names(tag: str) -> list[frozenset[str]]:
    """The words of each class, id and role."""
    if "=" not in tag:
        return []
    return [frozenset(_WORD.findall(x)) for found in _ATTRIBUTE.findall(tag) for x in "".join(found).lower().split()]


def _outside_name(words: frozenset[str]) -> bool:
    """A whole name of such words; `has-sidebar` or `social-history` say nothing, `entry-header` is the article's."""
    own = words - ARTICLE_WORDS
    return bool(own) and own <= OUTSIDE_WORDS and (own == words or own != {"header"})


def _article_name(words: frozenset[str]) -> bool:
    return bool(words & ARTICLE_WORDS) and words & OUTSIDE_WORDS <= {"header"}


def equivalence_classes(pages: list[Page]) -> list[list[str]]:
    """Valid classes of tokens with equal occurrence vectors, the most frequent on most pages first."""
    vectors: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for k, page in enumerate(pages):
        for key, n in Counter(page.keys).items():
            if key != "'":
                vectors[key].append((k, n))
    least = max(SHARE * len(pages), 2)
    classes: dict[tuple, list[str]] = defaultdict(list)
    for key, vector in vectors.items():
        if len(vector) >= least:
            classes[tuple(vector)].append(key)
    valid = [(_in_order(keys, pages, vector), vector) for vector, keys in classes.items()]
    valid = [x for x in valid if x[0]]
    valid.sort(key=lambda x: (-len(x[1]), sum(n for _, n in x[1]), -len(x[0])))
    return [keys for keys, _ in valid]


def _in_order(keys: list[str], pages: list[Page], vector: tuple) -> list[str]:
    """The tokens that come in one repeated order on all pages; the others are left out."""
    wanted = set(keys)
    order: list[str] = []
    for k, n in vector:
        sequence = [x for x in pages[k].keys if x in wanted]
        if not order:
            order = list(dict.fromkeys(sequence))
        place = {x: i for i, x in enumerate(order)}
        for at in range(0, len(sequence), len(order)):
            turn = sequence[at : at + len(order)]
            if turn != order[: len(turn)] or len(turn) < len(order):
                wrong = {x for i, x in enumerate(turn) if i >= len(order) or place.get(x) != i}
                wanted -= wrong
        if len(wanted) < len(order):
            order = [x for x in order if x in wanted]
        if not order or n == 0:
            return []
    return order


class Template:
    """The frame of a block of pages, its slots, and the texts that belong to it."""

    def __init__(self, pages: list[Page]) -> None:
        classes = equivalence_classes(pages) if len(pages) >= LEAST_PAGES else []
        # The outermost class: once on every page that has it.
        self.frame = next((c for c in classes if all(p.keys.count(c[0]) <= 1 for p in pages)), [])
        self.texts = {key for keys in classes for key in keys if key[0] == "'"}
        self.slots = self._article_slots(pages)

    def slot_numbers(self, page: Page) -> list[int]:
        """The slot of each text: how many tokens of the frame stand before it."""
        frame, numbers, before, at = set(self.frame), [], 0, 0
        for place, _, _ in page.texts:
            while at < place:
                before += page.keys[at] in frame
                at += 1
            numbers.append(before)
        return numbers

    def _article_slots(self, pages: list[Page]) -> set[int]:
        """Slots that lie in an article on some page; without any, those whose text differs between pages."""
        marked, seen = set(), defaultdict(list)
        sizes = Counter()
        for page in pages:
            parts: dict[int, list[str]] = defaultdict(list)
            for k, (place, text, _), outside, inside in zip(
                self.slot_numbers(page), page.texts, page.outside, page.inside, strict=True
            ):
                if not outside and text.strip():
                    if inside:
                        marked.add(k)
                    sizes[inside, page.keys[place] in self.texts] += len(text)
                    parts[k].append(page.keys[place])
            for k, own in parts.items():
                seen[k].append(tuple(own))
        # Articles, or else all that may be one: mostly equal texts are copies and no template.
        kinds = (True,) if marked else (False, True)
        equal, own = (sum(sizes[i, same_] for i in kinds) for same_ in (True, False))
        if equal >= own:
            self.texts = set()
            return marked or set(seen)
        return marked or {k for k, texts in seen.items() if len(texts) == 1 or len(set(texts)) > 1}


def extract(page: Page, template: Template) -> str:
    """The data in the article's slots; blocks are joined by one space."""
    numbers = template.slot_numbers(page)
    # Where a page marks its article, the rest of that slot is none of it.
    marked = {
        k for k, i, o, (_, x, _) in zip(numbers, page.inside, page.outside, page.texts, strict=True)
        if i and not o and x.strip()
    }
    parts: list[str] = []
    pending = False
    previous = -1
    for k, (place, text, _), outside, inside in zip(numbers, page.texts, page.outside, page.inside, strict=True):
        # A block border anywhere since the last text taken separates the two.
        pending |= _breaks(page, previous, place)
        previous = place
        other = (template.slots and k not in template.slots) or (k in marked and not inside)
        if outside or other or page.keys[place] in template.texts:
            pending = True
            continue
        parts.append((" " if pending else "") + html.unescape(text))
        pending = False
    return _SPACE.sub(" ", "".join(parts)).strip()


def _breaks(page: Page, after: int, before: int) -> bool:
    for key in page.keys[after + 1 : before]:
        if key[0] == "<" and key.strip("</>").split(" ")[0] in BLOCKS:
            return True
    return False


def extract_block(sources: list[str]) -> list[str]:
    """Texts of pages of one host. Equal pages count once in the template."""
    pages = [Page(x) for x in sources]
    different = {source: page for source, page in zip(sources, pages, strict=True)}
    template = Template(list(different.values()))
    return [extract(page, template) for page in pages]


def main_text(df: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): one row per row of `df`.

    A NULL or empty page has an empty text; pages without a URL form one host.
    Repeated pages get equal texts. An empty table gives no rows.
    """
    ship_package(df.sparkSession)
    kinds = [df.schema[c].dataType.simpleString() for c in (page_id, url)]

    def run(rows: pa.Table) -> pa.Table:
        texts = extract_block([x or "" for x in rows["source"].to_pylist()])
        return pa.table(
            {
                "page_id": rows["page_id"],
                "url": rows["url"],
                "text": pa.array(texts, pa.string()),
                "n_chars": pa.array([len(x) for x in texts], pa.int64()),
            }
        )

    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    rows = df.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("source"), host.alias("host")
    )
    counts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).withColumnRenamed("host", "_host")
    sized = rows.join(counts, F.col("host") == F.col("_host"))
    blocks = F.floor(F.col("pages") / BLOCK_PAGES) + 1
    dealt = sized.withColumn("block", F.pmod(F.xxhash64("page_id", "url"), blocks)).drop("_host", "pages")
    schema = f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long"
    return dealt.groupBy("host", "block").applyInArrow(run, schema)

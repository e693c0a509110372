"""Main text of web pages by two passes over their blocks.

First pass: a block of a page (what stands between two tags that break the line) is decided by its place in the page,
its length, its share of stop words and its share of linked characters. Second pass: blocks too short to be decided
take the label of the nearest decided neighbour in the same part of the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.llm.common import by_bytes

# Limits of the first pass.
LONG = 70  # characters
STOP_HIGH, STOP_LOW = 0.30, 0.20  # share of stop words
STOP_KNOWN = 0.20  # share on a whole page from which its language is known
VERY_LONG, FEW_LINKS = 140, 0.2  # characters and share inside links from which the lower share, or none in an unknown language, is enough
LINKED = 0.5  # share of characters inside links
NAMED = 4  # by which each further name around a text divides it, where only named elements hold main text

# Frequent function words by language.
STOP_WORDS = {language: frozenset(words.split()) for language, words in {
    "en": "the of and to in a is that for it was on with as are be by this at from or have an they which you were not",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie",
    "fr": "de la le et les des en un du une est pour qui que dans par plus pas au sur ne se ce il sont avec ses ou elle leur",
    "es": "de la el los las del que y en un una por con no su para es al lo como más o pero sus le ha me si sin sobre este ya",
    "it": "di e che la il un a per in una è non sono del si della le con dei da al come i più nel alla ma lo gli ha delle o ed",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas ao das à seu sua ou ser quando foi",
    "nl": "de van een het en in is dat op te zijn voor met die niet aan er om ook als maar bij door over ze uit nog naar was wordt",
    "pl": "i w na z się nie do to że jest o jak po od za co ale przez dla tak są był która który oraz czy tym być ich jego może",
    "sv": "och i att det som en på är av för med den till inte ett om har de var han från men sig kan så vi eller hon ska när",
    "ru": "и в не на что с по как это он к из но за то все у от так о для же его а был она они было или мы бы при только",
}.items()}

LANGUAGES = tuple(STOP_WORDS)
_STOPS = {word: tuple(k for k, words in enumerate(STOP_WORDS.values()) if word in words) for words in STOP_WORDS.values() for word in words}

# Elements by what they do. All others are part of a line.
BREAKS = frozenset("""
address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot
th thead title tr ul
""".split())
SKIPPED = frozenset("script style noscript template head title iframe object svg canvas audio video select textarea button".split())
ASIDE = frozenset("nav footer aside menu dialog fieldset search".split())
ARTICLE = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that are only followed for their effect on the blocks inside them.
FOLLOWED = ASIDE | ARTICLE | frozenset("form header section div ul ol table td details figure body html span p a li h1 h2 h3 h4 h5 h6 blockquote".split())

# Words in class, id and role that name what is hardly the article; they lower a block's score, no more.
_ASIDE_NAMES = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|"
    r"side-?bar\w*|menus?|nav\w*|breadcrumbs?|pagination|pager|foot(?:er)?|masthead|top-?bar|comments?|comment\w*|disqus|repl(?:y|ies)|discussion|"
    r"related|recommend\w*|share|sharing|social|newsletter|subscribe|signup|login|search|widgets?|complementary|contentinfo|"
    r"navigation|form|tags?|copyright|legal|skip)(?:$|[^a-z])"
)
_ARTICLE_NAMES = re.compile(r"(?:^|[^a-z])(?:article|articlebody|post-?content|entry-?content|main-?content|story-?body)(?:$|[^a-z])")
# Names that stay what they are inside a longer class word.
_NEVER = re.compile(r"comment|disqus|repl|discussion|related|recommend|cookie|consent|gdpr|ad|sponsor|promo|newsletter|subscribe")
# Class words that tell a state or subject of an element, not what it is.
_STATE = re.compile(r"(?:no|not|has|have|with|without|is|hide|tag|category|cat|type|format|status|post|author)-")
_UNNAMED = frozenset("html body main article".split())
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<raw>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*+>|[^>]*(?:>|\Z))", re.S)
_NAMED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in SKIPPED}
_LANG = re.compile(r"<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z_-]+)", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")
_HREF = re.compile(r"\bhref\s*=", re.I)
_NEXT_A = re.compile(r"<(/?)a(?=[\s/>])", re.I)


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    part: str  # "aside", "article" or "page"
    names: tuple[str, ...] = ()  # what the elements around it are named, if that is hardly the article

    @cached_property
    def words(self) -> tuple[int, list[int]]:
        """Number of words, and of stop words by language, counted once."""
        words, stops = _WORD.findall(self.text.lower()), [0] * len(LANGUAGES)
        for w in words:
            for k in _STOPS.get(w, ()):
                stops[k] += 1
        return len(words), stops

    def stop_share(self, language: int) -> float:
        n, stops = self.words
        return stops[language] / max(1, n)


def _hidden(rest: str) -> bool:
    """Whether attributes hide the element: ``hidden``, or a style that does not show it."""
    if "hidden" not in (low := rest.lower()) and "none" not in low:
        return False
    for m in _ATTRIBUTE.finditer(low):
        value = (m[2] or "").strip("\"'")
        if m[1] == "hidden" and value not in ("until-found", "false") or m[1] == "style" and _HIDING.search(value):
            return True
    return False


def _aside_name(names: str) -> str | None:
    """The word by which names tell that an element is hardly the article. Inside a longer class word it ends with "-": that
    may be a layout, say ``sidebar-right``."""
    layout = None
    for token in names.split():
        if (hit := None if _STATE.match(token) else _ASIDE_NAMES.search(token)):
            name = hit[0].strip("-_:.0123456789")
            if token.rstrip("s") == name.rstrip("s") or _NEVER.match(name):
                return name
            layout = layout or f"{name}-"
    return layout


def blocks_of(html: str) -> list[Block]:
    """Blocks of a page in its order, with what they are part of; those without text are left out."""
    found: list[Block] = []
    stack: list[tuple[str, str, tuple[str, ...]]] = []  # (element, part and names around it)
    pieces: list[tuple[str, bool]] = []
    at, part = 0, "page"
    link = ""  # "closed": up to </a>; "open": an <a> that none closes before the next, which ends with its block
    around: tuple[str, ...] = ()

    def close_block() -> None:
        if pieces:
            text = _SPACE.sub(" ", unescape("".join(p for p, _ in pieces))).strip()
            if text:
                linked = len(_SPACE.sub(" ", unescape("".join(p for p, inside in pieces if inside))).strip())
                found.append(Block(text, linked, part, around))
            pieces.clear()

    while at < len(html):
        tag = _TAG.search(html, at)
        if tag is None:
            pieces.append((html[at:], bool(link)))
            break
        if tag.start() > at:
            pieces.append((html[at : tag.start()], bool(link)))
        at = tag.end()
        if tag["raw"] is not None:
            pieces.append((tag["raw"].replace("&", "&amp;"), bool(link)))
        if tag["name"] is None:
            continue
        name, closes = tag["name"].lower(), bool(tag["close"])
        if name in BREAKS:
            close_block()
            if link == "open":
                link = ""
        if name in SKIPPED and name != "head":
            if not closes and not tag["rest"].endswith("/>"):
                end = _END[name].search(html, at)
                at = end.end() if end else len(html)
            continue
        if name == "head" and not closes:
            end = _END[name].search(html, at)
            body = re.compile(r"<body\b|<article\b|<main\b", re.I).search(html, at)
            at = end.end() if end and not (body and body.start() < end.start()) else body.start() if body else at
            continue
        if name == "a":
            link = ""
            if not closes and _HREF.search(tag["rest"]):
                ahead = _NEXT_A.search(html, at)
                link = "closed" if ahead and ahead[1] else "open"
        if name in VOID or name not in FOLLOWED:
            continue
        if not closes:
            rest = tag["rest"]
            names = " ".join(x for m in _NAMED.findall(rest) for x in m if x).lower() if "=" in rest else ""
            inner, within = part, around
            if part != "aside":
                if name in ASIDE or name == "header" and part != "article" or name not in ("html", "body") and _hidden(rest):
                    inner = "aside"
                else:
                    if name in ARTICLE or names and name not in _UNNAMED and _ARTICLE_NAMES.search(names):
                        inner = "article"
                        if all(called.endswith("-") for called in around):
                            within = ()  # a layout around the article
                    if (called := "form-" if name == "form" else _aside_name(names) if names and name not in _UNNAMED else None):
                        within = (*around, called)
            changed = inner != part or within != around
            if changed or name not in ("p", "a", "span", "li"):
                if changed:
                    close_block()
                stack.append((name, part, around))
                part, around = inner, within
        else:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    if stack[depth][1:] != (part, around):
                        close_block()
                    part, around = stack[depth][1:]
                    del stack[depth:]
                    break
                if name in ("p", "a", "span", "li"):
                    break  # only the innermost can be meant
    close_block()
    return found


def language_of(blocks: list[Block], declared: str | None) -> int | None:
    """The language whose stop words the long blocks of a page show: the declared one, else the one with most of them.

    None, if none of the known languages has enough of them: the declaration may be wrong, or the language unknown.
    """
    counted = [b.words for b in blocks if b.part != "aside" and len(b.text) >= LONG]
    total = max(1, sum(n for n, _ in counted))
    share = [sum(stops[k] for _, stops in counted) / total for k in range(len(LANGUAGES))]
    code = re.split("[-_]", (declared or "").strip().lower())[0]
    if code in LANGUAGES and share[LANGUAGES.index(code)] >= STOP_KNOWN:
        return LANGUAGES.index(code)
    best = max(range(len(LANGUAGES)), key=lambda k: share[k])
    return best if share[best] >= STOP_KNOWN else None


def first_pass(block: Block, language: int | None) -> bool | None:
    """True: main text, False: not, None: undecided. Without a language, length and links decide.

    In an article the limits are lower: a prior, no more. There nothing but links is decided against; code, tables and other
    text without stop words go with their neighbours.
    """
    if block.part == "aside":
        return False
    article = block.part == "article"
    if block.linked > LINKED * len(block.text):
        return None if article else False
    if len(block.text) < LONG:
        return None
    prose = len(block.text) >= VERY_LONG and block.linked <= FEW_LINKS * len(block.text)
    if language is None:
        return True if article or prose else None
    stop = block.stop_share(language)
    if article:
        return True if stop >= STOP_LOW else None
    return True if stop >= (STOP_LOW if prose else STOP_HIGH) else None if stop >= STOP_LOW else False


def second_pass(blocks: list[Block], labels: list[bool | None]) -> list[bool]:
    """Undecided blocks take the label of the nearest decided one of their part; main text, if two are as near.

    In a part without any decided block the article is kept, and on a page without an article whatever is not a run of links.
    """
    out: list[bool] = [bool(x) for x in labels]
    has_article = any(b.part == "article" for b in blocks)
    for part in ("article", "page"):
        places = [k for k, b in enumerate(blocks) if b.part == part]
        decided = [k for k in places if labels[k] is not None]
        after = 0
        for k in places:
            if labels[k] is not None:
                continue
            while after < len(decided) and decided[after] < k:
                after += 1
            near = decided[max(0, after - 1) : after + 1]
            if near:
                out[k] = bool(labels[min(near, key=lambda d: (abs(d - k), not labels[d]))])
            else:
                out[k] = part == "article" or not has_article and blocks[k].linked <= LINKED * len(blocks[k].text)
    return out


def _evidence(block: Block, language: int | None) -> int:
    """Characters of main text that a block is counted for: undecided text of an article counts as well."""
    label = first_pass(block, language)
    some = label or label is None and block.part == "article" and block.linked <= LINKED * len(block.text)
    return len(block.text) if some else 0


def without_named(blocks: list[Block], language: int | None) -> list[Block]:
    """Blocks outside of named elements. Comments, menus and boxes never win by their size.

    Only if no block outside holds main text, names count as wrong, say for a form around a whole page: then the blocks
    under the names that hold most of it are kept too, where each name divides by NAMED and one inside a longer word does not.
    """
    found: dict[tuple[str, ...], int] = {(): 0}
    for b in blocks:
        found[b.names] = found.get(b.names, 0) + _evidence(b, language)
    best: tuple[str, ...] = ()
    if not found[()]:
        best = max(found, key=lambda names: (found[names] / NAMED ** sum(not n.endswith("-") for n in names), -len(names), names))
    return [b for b in blocks if b.names in ((), best)]


def main_text(html: str | None) -> str:
    """Main text of a page, its blocks joined by blanks.

    Being in an article element is a prior: it lowers the limits of the first pass, if the articles of the page hold at
    least as much main text as the rest; else they are blocks like others, say cards of related stories.
    """
    blocks = [b for b in blocks_of(html or "") if b.part != "aside"]
    lang = _LANG.search(html or "")
    language = language_of(blocks, lang[1] if lang else None)
    blocks = without_named(blocks, language)
    inside, outside = (sum(_evidence(b, language) for b in blocks if b.part == part) for part in ("article", "page"))
    if inside < outside:
        for b in blocks:
            b.part = "page"
    keep = second_pass(blocks, [first_pass(b, language) for b in blocks])
    return " ".join(b.text for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replaces ``html`` by ``text``, the main text of the page, and adds ``n_chars``, its code points.

    Works on whole pages; a null page is an empty one, and a page without main text has the empty text. Other columns
    stay, but for those with the names of the added ones. Repeated rows stay rows of their own; empty tables stay empty.
    """
    rows = pages.drop("text", "n_chars") if html != "text" else pages.drop("n_chars")
    kept = [f for f in rows.schema.fields if f.name != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, html):
            texts = [main_text(h) for h in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(texts, pa.string())], names=[*[f.name for f in kept], "text"])

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("text", T.StringType())])).withColumn("n_chars", F.length("text").cast("long"))

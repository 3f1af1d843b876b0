"""Main text of web pages by their maximum-scoring subsequence.

A page is read as a sequence of words and tags. Words score by the element that holds them, in general
positively; tags score negatively. The weights come from labelled pages, those that mark their main part
with an ``article`` or ``main`` element: a word's weight is the log-odds of lying in that part, given the
innermost sectioning element (with its class) and whether it is linked; a tag's is the log-odds of lying
outside it. A linear scan over the sums finds the contiguous region with the largest total, and the
text of this region, without the elements that are no content wherever they stand, is the result.

Where a page marks its main part, its words there score at least 1, all others at most -1, and the tags in that part share a
cost of half a word, so no list, table or heading of few words is cut off; only text of that part is kept. Several such elements that hold
fewer words than the rest of the page, teasers say, mark nothing. Other pages are scored with the learnt weights alone; elements that
no labelled page has get the weights in ``UNKNOWN``. Tags of elements that are no content teach no weight.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.sample import by_hash

#: Labelled pages that the weights are learnt from (those with the smallest hashes of their ids), and keys kept.
SAMPLE, KEYS = 4_000, 2_000
LEAST_SEEN = 20
STEEPEST, FLATTEST = 3.0, 0.1
UNKNOWN = {"word": 1.0, "linked": 0.25, "tag": -3.25, "prose": -0.25}

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
SECTIONS = frozenset("article aside body div footer form header main nav section table".split())
#: Elements that are common within texts.
PROSE = frozenset("a abbr b blockquote br cite code dd dl dt em figcaption figure h1 h2 h3 h4 h5 h6 hr i img li mark ol p pre q s small span strong sub sup td th tr u ul".split())
MAIN = frozenset(("article", "main"))
ENDS = frozenset(f"tag /{name}" for name in MAIN)
#: Elements whose text is never content.
NEVER = frozenset("aside button datalist dialog footer form head iframe menu nav noframes noscript object select svg template title".split())
#: Words of class and id names of elements that are no content.
JUNK = frozenset(
    "ad ads adslot advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer masthead menu modal nav navbar navigation newsletter notice notices popup promo promotion related respond share sharing sidebar "
    "skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: The same, but only as whole names: as words of longer names they are also topics of articles.
WHOLE = frozenset("colophon copyright foot replies responses".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_RAW = "script|style|textarea|xmp|noembed|plaintext"
_TOKEN = re.compile(
    rf"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:{_RAW})\b[^>]*+>.*?(?:</(?:{_RAW})\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[a-zA-Z/][^>]*+>|<[!?/][^>]*+>|([^<]++|<)",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")


#: How a tag tells that it is no content: not, by a word in a longer name, by a whole name, by an attribute.
NOT, PARTLY, NAMED, OUTRIGHT = range(4)


def _marks(attributes: str) -> tuple[str, int]:
    """The first class or id name of a tag, and how its names or attributes tell that it is no content."""
    if not attributes or attributes.isspace():
        return "", NOT
    names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes))
    first = names.split()[0] if names.strip() else ""
    if _HIDDEN.search(attributes):
        return first[:40], OUTRIGHT
    if any(n.lower() in WHOLE for n in names.split()):
        return first[:40], NAMED
    if not any(w.lower() in JUNK for w in _WORDS.findall(names)):
        return first[:40], NOT
    return first[:40], NAMED if any(n.lower() in JUNK for n in names.split()) else PARTLY


def read(page: str) -> list[tuple[str, str, bool, bool, int, str, bool, int]]:
    """The tokens of a page. Names hide no element with most of the words of the page: not an article at all, others
    not by a word in a longer name."""
    counts: dict[int, int] = {}
    seen = list(tokens(page, counts=counts))
    half = sum(words for _, _, _, _, words, *_ in seen) / 2
    kept = frozenset(at for at, words in counts.items() if words > half)
    return list(tokens(page, kept)) if kept else seen


def tokens(page: str, kept: frozenset[int] = frozenset(), counts: dict[int, int] | None = None) -> Iterator[tuple[str, str, bool, bool, int, str, bool, int]]:
    """(key, kind, visible, in the main part, words, text, hidden, home) of each tag and each piece of text.

    kind is ``block`` or ``inline`` for tags and ``text`` for text. Elements left open end with the element
    around them, paragraphs with the next block; an element that is no content doesn't outlast the start of a main element.
    Hidden are the tags and texts of elements that are no content. The home is the number of the innermost
    section around that can be content, 0 outside of all, negative for ``body``. The end of a main element lies outside of it. Names never hide ``html`` and ``body``, a word
    in a longer name no heading and no article outside of others, and neither an element whose place is in ``kept``; ``counts``
    gets the words of the elements that could be.
    """
    # Name of each open element, key of its text, whether that text can be content.
    names, keys, shown, homes = ["#"], ["word "], [True], [0]
    main = sections = total = 0
    marked: list[tuple[int, int, int]] = []  # depth, place and words before it of open elements hidden by names

    def close(k: int) -> int:
        left = sum(n in MAIN and v for n, v in zip(names[k:], shown[k:], strict=True))
        del names[k:], keys[k:], shown[k:], homes[k:]
        while marked and marked[-1][0] >= k:
            _, at, before = marked.pop()
            if counts is not None:
                counts[at] = total - before
        return left

    for found in _TOKEN.finditer(page):
        slash, name, attributes, text = found.groups()
        if text is not None:
            words = text.count(" ") + 1 if not text.isspace() else 0
            total += words
            yield keys[-1], "text", shown[-1], main > 0, words, text, not shown[-1], homes[-1]
            continue
        if name is None:  # comments, declarations, scripts, styles
            yield "tag !", "inline", False, main > 0, 0, "", not shown[-1], homes[-1]
            continue
        name = name.lower()
        kind = "block" if name in BLOCKS else "inline"
        if slash:
            inside, hidden, home = main > 0, not shown[-1], homes[-1]
            if name in names:
                k = len(names) - 1
                while names[k] != name:
                    k -= 1
                main -= close(k)
            yield f"tag /{name}", kind, True, main > 0 if name in MAIN else inside, 0, "", hidden, home
            continue
        if name in VOID or kind == "inline" and attributes.endswith("/"):
            yield f"tag {name}", kind, True, main > 0, 0, " " if name == "br" else "", not shown[-1], homes[-1]
            continue
        first, told = _marks(attributes) if attributes else ("", NOT)
        junk = told == OUTRIGHT or told != NOT and name not in ("html", "body") and found.start() not in kept
        if junk and told == PARTLY and (name in HEADINGS or name in MAIN and not main and shown[-1]):
            junk = False
        if kind == "block" and "p" in names:  # an open paragraph ends
            k = len(names) - 1
            while names[k] != "p" and names[k] not in SECTIONS:
                k -= 1
            if names[k] == "p":
                main -= close(k)
        if name in MAIN and not junk:
            while not shown[-1]:
                close(len(names) - 1)
        key = keys[-1]
        if name in SECTIONS:
            key = f"word {name}.{first}"
        elif name == "a":
            key = "linked " + key.partition(" ")[2]
        visible = shown[-1] and not (junk or name in NEVER or name == "header" and not main)
        if junk and (told == PARTLY or told == NAMED and name in MAIN):
            marked.append((len(names), found.start(), total))
        names.append(name)
        keys.append(key)
        shown.append(visible)
        sections += 1
        homes.append(homes[-1] if name not in SECTIONS or not visible else -sections if name == "body" else sections)
        main += name in MAIN and visible
        yield f"tag {name}", kind, True, main > 0, 0, "", not visible, homes[-1]
    close(1)


def _places(key: str) -> list[str]:
    """A key and the one without the class, for sections seen too rarely with it."""
    return [key, key.partition(".")[0] + "."] if "." in key else [key]


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, times in the main part, times outside it) of labelled pages; words count each."""
    inside, outside = Counter(), Counter()
    for batch in batches:
        for page in batch.column(0).to_pylist():
            seen = read(page or "")
            if marks_main(seen):
                for key, kind, visible, main, words, _, hidden, _ in seen:
                    if kind != "text" and hidden:
                        continue
                    many = words if kind == "text" else 1
                    # What is no content by its class tells nothing about its element without it.
                    for place in _places(key) if visible else [key]:
                        (inside if main and visible else outside)[place] += many
    keys = list(inside | outside)
    yield pa.record_batch([pa.array(keys, pa.string()), pa.array([inside[k] for k in keys], pa.int64()), pa.array([outside[k] for k in keys], pa.int64())], names=["key", "inside", "outside"])


def learn(df: DataFrame, id_column: str = "page_id", html_column: str = "html", sample: int = SAMPLE) -> dict[str, float]:
    """The weight of each key, from at most ``sample`` labelled pages. Without any, none: all keys are unknown."""
    pages = df.select(F.col(id_column).cast("string").alias("id"), F.col(html_column).cast("string").alias("page"))
    marked = pages.where(F.col("page").rlike("(?i)<(article|main)[\\s>]"))
    drawn = by_hash(marked.select("id"), "id", sample).distinct()
    rows = marked.join(F.broadcast(drawn), "id", "left_semi")  # at most ``sample`` ids
    counts = rows.select("page").mapInArrow(_labelled, "key string, inside long, outside long").groupBy("key")
    counts = counts.agg(F.sum("inside").alias("a"), F.sum("outside").alias("b")).orderBy(F.desc(F.expr("sum(inside) + sum(outside)")), "key").limit(KEYS)
    weights = {}
    for key, a, b in counts.collect():
        odds = math.log((a + 0.5) / (b + 0.5))
        if key.startswith("tag "):
            weights[key] = -min(STEEPEST, max(FLATTEST, -odds))
        elif a + b >= LEAST_SEEN:
            weights[key] = min(STEEPEST, max(-STEEPEST, odds))
    return weights


def _weight(key: str, weights: dict[str, float]) -> float:
    """The weight of a key that is not in ``weights`` as it is."""
    kind, _, name = key.partition(" ")
    known = next((weights[p] for p in _places(key) if p in weights), None)
    if known is not None:
        return known
    return UNKNOWN["prose" if kind == "tag" and name.lstrip("/") in PROSE else kind]


def region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous part with the largest positive sum: the first, and the longest from there.
    Empty if no score is positive."""
    best, first, end = 0.0, 0, 0
    total, start = 0.0, 0
    for k, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += score
        if total > best or total == best > 0 and start == first:
            best, first, end = total, start, k + 1
    return first, end


def marks_main(seen: list[tuple[str, str, bool, bool, int, str, bool, int]]) -> bool:
    """Whether a page marks its main part: by one element, or by several with at least half of the words that can be content."""
    inside = outside = parts = 0
    before = False
    for _, kind, visible, main, words, *_ in seen:
        parts += main and not before
        before = main
        if kind == "text" and visible:
            inside, outside = (inside + words, outside) if main else (inside, outside + words)
    return inside > 0 and (parts == 1 or inside >= outside)


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The blocks of the best region, one line each."""
    if not page:
        return ""
    seen = read(page)
    marked = marks_main(seen)
    share = -0.5 / (1 + sum(kind != "text" and (main or key in ENDS) for key, kind, _, main, *_ in seen))
    telling = {home for _, kind, visible, _, words, _, _, home in seen if kind == "text" and visible and words}
    scores = []
    for key, kind, visible, main, words, _, hidden, home in seen:
        if hidden and (main if marked else home > 0 or home in telling):  # within content: never emitted, so it parts nothing
            scores.append(0.0)
            continue
        known = weights.get(key)
        if known is None:
            known = weights[key] = _weight(key, weights)
        if kind != "text":
            scores.append(share if marked and (main or key in ENDS) else known)
        elif marked:
            scores.append(words * (max(1.0, known) if main else -max(1.0, abs(known))))
        else:
            scores.append(words * (known if visible else -abs(known)))
    first, end = region(scores)
    blocks, parts = [], []
    for _, kind, visible, main, _, text, _, _ in seen[first:end]:
        if kind == "block":
            blocks.append("".join(parts))
            parts = []
        if visible and text and (main or not marked):
            parts.append(html.unescape(text))
    blocks.append("".join(parts))
    lines = (" ".join(b.split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def extract(df: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """(id, url, ``text``, ``n_chars``) of every row of ``df``.

    Character references are decoded, white space within a block is one space, blocks are joined by line
    breaks. A NULL or empty page has no text. NULL and repeated ids are kept. Other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    learnt = df.sparkSession.sparkContext.broadcast(learn(df, id_column, html_column) if weights is None else weights)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = dict(learnt.value)  # also takes the weights of keys without one, as they come
        for batch in batches:
            if len(memo) > 100_000:
                memo = dict(learnt.value)
            text = [main_text(page, memo) for page in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())]
            yield pa.record_batch(columns, names=["id", "url", "text", "n_chars"])

    rows = df.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).cast("string").alias("page"))
    kinds = dict(rows.dtypes)
    found = rows.mapInArrow(texts, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long")
    return found.withColumnsRenamed({"id": id_column, "url": url_column})

"""Main-text extraction by consensus of a host's pages.

Each page's containers are scored by the text they hold in blocks, less links and boilerplate. A container's path is
generalised: tag names with their class words, digits dropped, named by a hash of them all. Pages vote for the path of
their best container; votes are summed per host and path in Spark, and the host's winning path then says which containers
of each page are read. A page on which the winning path holds no text falls back on its own best container.

Boilerplate is told by tags, roles and class or id words. A header within an article belongs to it. Words that name
page furniture but may as well describe a paragraph (a `reply`, a `notice-board`) count on containers only.

Defined cases: a null or empty html has the empty text; a null url votes with the other null urls; broken markup
is read as far as it goes: a tag ends at the first `>` outside a quoted value that is followed by white space, `/` or
`>`, so a stray or missing quote costs no text beyond its tag; unclosed tags end with their parent, and an unclosed comment
or script with the page; pages of any length and depth are read in memory in proportion to their length, one at a time;
repeated rows give repeated results; an empty table gives an empty table; only page_id, url and html are read, whatever
other columns are called.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bound_batches, cut

# A value in quotes is one only if the tag goes on or ends behind it; all else is read up to white space or the end of the tag.
_ONE = r"[^\s/>=][^\s/>=]*+(?:\s*=\s*(?:\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>])|[^\s>]+))?"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]+|=|{_ONE})*)>?|([^<]+|<)",
    re.S,
)
_ATTR = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"(?=[\s/>]|\Z)|'([^']*)'(?=[\s/>]|\Z)|([^\s>]+)))?")
_RAW = {t: re.compile(rf"</{t}\s*[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp")}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements whose text never belongs to an article.
_DROP = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "label", "fieldset", "menu", "dialog", "object", "audio", "video", "canvas", "head"}
_BLOCK = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6",
    "aside", "dialog", "fieldset", "footer", "form", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_CONTAINER = {"article", "body", "center", "div", "main", "section", "td", "blockquote", "html"}
#: Elements besides containers through which a start tag ends nothing.
_BOUNDS = {"ul", "ol", "table", "dl", "aside", "dialog", "fieldset", "footer", "form", "header", "menu", "nav", "figure", "details", "button", "object"}
#: Elements that are furniture as a whole where their words say so.
_FURNITURE = {"div", "section", "ul", "ol", "dl", "table", "td", "tr", "center", "details", "figure", "address", "span", "a", "iframe"}
#: A start tag that ends an open element of the same kind.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in a class or an id that mark what is not the article, on any element and on containers only.
_NOISE = re.compile(
    r"(?:^|[-_\s])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|cookie\w*|consent|popup|nav|navbar|navigation|menu\w*|breadcrumb\w*|sidebar\w*|side-bar|footer|masthead|topbar|"
    r"share|sharing|social|related|recommend\w*|comments|comment-?list|disqus|newsletter|subscribe|signup|pagination|pager|toolbar|skip-link|copyright)(?:$|[-_\s])",
    re.I,
)
_NOISE_BOX = re.compile(r"(?:^|[-_\s])(?:banner\w*|notices?|alert|modal|overlay|nav\w*|widget\w*|header|comment|respond|reply|replies|login)(?:$|[-_\s])", re.I)
_PAGE = {"html", "body", "article", "main"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search"}
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_DIGITS = re.compile(r"\d+")
_KEY = 12


class Page:
    """The blocks of one page: text, number of the container around it (0: none), whether boilerplate, characters in links. Containers: parent, depth and path."""

    def __init__(self, source: str | None):
        self.blocks: list[tuple[str, int, bool, int]] = []
        self.parents, self.paths = [0], [b""]
        self.depths = [0]
        self._read(source or "")

    def _enter(self, parent: int, name: str) -> int:
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1)
        self.paths.append(hashlib.blake2b(self.paths[parent] + name.encode("utf-8", "surrogatepass"), digest_size=_KEY).digest())
        return len(self.parents) - 1

    def _read(self, s: str) -> None:
        stack: list[tuple[str, bool, int]] = []  # tag, boilerplate, number of the innermost container
        noise = links = articles = 0
        words: list[str] = []
        linked = 0

        def flush() -> None:
            nonlocal linked
            text = " ".join("".join(words).split())
            if text:
                self.blocks.append((text, stack[-1][2] if stack else 0, noise > 0, linked))
            words.clear()
            linked = 0

        def pop(n: int) -> None:
            nonlocal noise, links, articles
            if any(t in _BLOCK or bad for t, bad, _ in stack[n:]):
                flush()
            for t, bad, _ in stack[n:]:
                noise -= bad
                links -= t == "a"
                articles -= t == "article"
            del stack[n:]

        at, end = 0, len(s)
        match = _TOKEN.match
        while at < end:
            m = match(s, at)
            at = m.end()
            closing, tag, attrs, text = m.groups()
            if text is not None:
                text = html_lib.unescape(text) if "&" in text else text
                words.append(text)
                if links:
                    linked += len(text)
                continue
            if tag is None:
                continue
            tag = tag.lower()
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        pop(i)
                        break
                    if stack[i][0] in ("td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                        break
                else:
                    if tag in ("p", "br"):
                        flush()
                continue
            if tag in _RAW:
                if not m.group().endswith("/>"):
                    close = _RAW[tag].search(s, at)
                    at = close.end() if close else end
                continue
            if tag == "br":
                words.append("\n")
                continue
            if tag in _VOID:
                if tag == "hr":
                    flush()
                continue
            if tag in _BLOCK:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in _ENDS.get(tag, ()) or tag not in ("li", "dt", "dd", "tr", "td", "th") and stack[i][0] == "p":
                        pop(i)
                        break
                    if stack[i][0] in _CONTAINER or stack[i][0] in _BOUNDS:
                        break
                flush()
            bad, classes = tag in _DROP and not (tag == "header" and articles), ""
            if attrs and ("=" in attrs or "hidden" in attrs.lower()):
                found: dict[str, str] = {}
                for k, a, b, c in _ATTR.findall(attrs):
                    found.setdefault(k.lower(), a or b or c)
                classes = found.get("class", "")
                marks = f"{classes} {found.get('id', '')}"
                bad = bad or tag not in _PAGE and bool(_NOISE.search(marks) or tag in _FURNITURE and _NOISE_BOX.search(marks) or found.get("role") in _ROLES)
                bad = bad or "hidden" in found or "none" in found.get("style", "") and bool(_UNSEEN.search(found["style"]))
            if bad and tag not in _BLOCK:
                flush()
            inside = stack[-1][2] if stack else 0
            if tag in _CONTAINER:
                inside = self._enter(inside, tag + "".join(f".{w}" for w in sorted(set(_DIGITS.sub("", classes.lower()).split()))))
            stack.append((tag, bad, inside))
            noise += bad
            links += tag == "a"
            articles += tag == "article"
        flush()

    def votes(self) -> dict[str, float]:
        """Score of each generalised path: text of the blocks directly in such containers or in what they hold, damped by depth."""
        gained, lost, total = [0.0] * len(self.parents), [0.0] * len(self.parents), 0.0
        for text, c, bad, linked in self.blocks:
            weight = 0.0 if bad else max(0.0, len(text) - 2.0 * linked) * (1.0 if len(text) >= 40 or text[-1:] in ".!?…。" else 0.3)
            total += weight
            gained[c] += weight
            lost[c] += len(text) - weight
        out: dict[str, float] = {}
        for c in range(len(self.parents) - 1, 0, -1):  # children have larger numbers than their parents
            gained[self.parents[c]] += 0.98 * gained[c]
            lost[self.parents[c]] += lost[c]
            score = gained[c] - 0.5 * lost[c]
            if score > 0:
                key = self.key(c)
                out[key] = out.get(key, 0.0) + score / (total or 1.0)
        return out

    def key(self, c: int) -> str:
        """The generalised path of a container: its depth and the hash of the names from the outermost on."""
        return f"{self.depths[c]:06d}>{self.paths[c].hex()}"

    def best(self) -> str | None:
        """The path with the most votes; of equal ones the deeper, then the greater name."""
        votes = self.votes()
        return max(votes, key=lambda p: (round(votes[p], 9), p)) if votes else None

    def text(self, path: str | None) -> str:
        """The blocks, boilerplate left out, within containers of this path (of any, if None)."""
        keep = [path is None]
        for c in range(1, len(self.parents)):
            keep.append(keep[self.parents[c]] or self.key(c) == path)
        return "\n".join(t for t, c, bad, _ in self.blocks if not bad and keep[c])


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][-+.\w]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def consensus(pages: DataFrame) -> DataFrame:
    """host, path, pages: the path with the most votes on each host (of equal ones the deeper, then the greater name), and how many pages voted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, str], float] = {}
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1)):
                path = Page(source.as_py()).best()
                if path is not None:
                    votes[host, path] = votes.get((host, path), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in votes], pa.string()), pa.array([p for _, p in votes], pa.string()), pa.array(list(votes.values()), pa.int64())], names=["host", "path", "n"])

    cast = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string, n bigint")
    summed = cast.groupBy("host", "path").agg(F.sum("n").alias("n"))
    return summed.groupBy("host").agg(F.max_by("path", F.struct("n", "path")).alias("path"), F.sum("n").alias("pages"))


#: Hosts whose winning paths are sent to every task: those with most pages (about 100 bytes each). The pages of all others are joined by host.
SENT_HOSTS = 50_000


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    bound_batches(pages.sparkSession)
    read = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    winners = cut(consensus(pages), "html-paths")
    sent = F.broadcast(cut(winners.orderBy(F.desc("pages"), "host").limit(SENT_HOSTS), "html-sent").select("host", "path"))
    rest = read.join(sent.select("host"), "host", "left_anti").join(winners.select("host", "path"), "host", "left")
    joined = read.join(sent, "host").select("page_id", "url", "html", "path").unionByName(rest.select("page_id", "url", "html", "path"))
    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, path in zip(batch.column(2), batch.column(3).to_pylist()):
                page = Page(source.as_py())
                text = page.text(path) if path is not None else ""
                texts.append(text or page.text(page.best()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))

"""Main text of web pages by nearest-URL page differencing, and by structure.

A page's blocks are its lines, those of its menus, headers and footers too.
The pages of a host are ordered by URL path, each is paired with its nearest
neighbours there, their lines are aligned by longest common subsequence, and
shared lines are deleted: that is the template.  A neighbour whose main text is
mostly the same is a copy of the article and tells nothing about the template:
the next ones are tried, at doubling distance up to the ends of the host.
Inside an ``article`` or ``main`` element lines are never deleted this way.

What boilerplate a page does not share with its neighbours (comments, adverts,
related links, a menu of its own) goes by its element or its class, id or role.
A class or id counts only if it names the element itself and the element holds
no article text.

Pages of a host with equal lines count as one.  Pages are numbered in URL
order, so neighbours are joined by number, without a window over a host.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.text import bound_batches
from skylattice.operators.numbering import number_rows
from skylattice.storage import broadcast_if_small, materialize

_DROP = {"script", "style", "noscript", "template", "nav", "header", "footer", "aside", "form", "button", "select", "textarea", "iframe", "svg", "object", "head", "title", "menu", "dialog", "canvas", "video", "audio", "label", "fieldset"}
#: Of these not even the lines are compared: they are no text.
_NO_TEXT = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "object", "head", "title", "canvas", "video", "audio", "select"}
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set(
    "address article aside blockquote body br canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_MAIN = {"article", "main"}
_INSIDE = {"header", "label"}
#: What a class or id may name: the last word of it, before words for parts.
_BAD = re.compile(
    r"ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu|breadcrumbs?|sidebar|footer|header|masthead|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|comments?|replies|disqus|toolbar|pagination|pager|tags|copyright|skip"
)
_PARTS_OF = re.compile(r"lists?|links?|bars?|box|buttons?|icons?|items?|area|section|form|posts|articles|stories|left|right|top|bottom|primary|secondary|\d+")
#: Says what the page looks like, not what this is.
_STATE = {"no", "has", "with", "without", "is", "not", "by", "and", "for"}
#: These hold prose of their own.
_PROSE = re.compile(r"ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|copyright|footer|comments?|replies|disqus")
_COMMENT = re.compile(r"comments?|replies|disqus")
_TEXT = 200  # characters outside links from which an element holds article text
_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?[a-zA-Z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|<[^<]*|[^<]+", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"(class|id|role|hidden|style|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")


def _named(token: str) -> str:
    """What a class or id says its element is, if that is nothing of the article."""
    parts = [x for x in re.split(r"[-_]+", token.lower()) if x]
    if any(x in _STATE for x in parts):
        return ""
    while len(parts) > 1 and _PARTS_OF.fullmatch(parts[-1]):
        parts.pop()
    return parts[-1] if parts and _BAD.fullmatch(parts[-1]) else ""


def _holds_text(tokens: list[str], at: int, name: str, prose: bool) -> bool:
    """Whether the element opened at ``at`` holds an article, main or h1 element, or (``prose``) much text outside links."""
    depth, link, size, raw = 1, 0, 0, ""
    for k in range(at + 1, len(tokens)):
        tag = _TAG.match(tokens[k]) if tokens[k][0] == "<" else None
        if not tag:
            if prose and not link and not raw and tokens[k][0] != "<":
                size += len(tokens[k].strip())
                if size >= _TEXT:
                    return True
            continue
        closing, other = tag.group(1), tag.group(2).lower()
        if raw:
            raw = "" if closing and other == raw else raw
            continue
        if not closing and (other in _MAIN or other == "h1"):
            return True
        if not closing and other in _RAW:
            raw = other
        if other == "a":
            link = 0 if closing else 1
        if other == name:
            depth += -1 if closing else not tokens[k].endswith("/>")
            if not depth:
                return False
    return False


def _bad(tokens: list[str], at: int, name: str, inside: bool) -> bool:
    tag = tokens[at]
    if name in _DROP:
        return not (inside and name in _INSIDE)
    if "=" not in tag or name in ("html", "body", *_MAIN):
        return False
    for key, *values in _ATTR.findall(tag):
        value, key = "".join(values), key.lower()
        if key in ("class", "id"):
            for word in filter(None, map(_named, value.split())):
                if inside and word in _INSIDE:
                    continue
                if _COMMENT.fullmatch(word) or not _holds_text(tokens, at, name, not _PROSE.fullmatch(word)):
                    return True
        if key == "role" and value.lower() in _ROLE:
            return True
        if key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def lines(page: str | None) -> tuple[list[str], list[bool], list[bool]]:
    """The text blocks of a page, whether each is inside an article or main element, and whether it is boilerplate by structure."""
    out: list[str] = []
    main: list[bool] = []
    bad_: list[bool] = []
    buffer: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # open elements: name, boilerplate, without text, main
    dropped, mute, inside, raw = 0, 0, 0, ""

    def flush() -> None:
        if buffer:
            text = _SPACE.sub(" ", html.unescape("".join(buffer))).strip()
            if text:
                out.append(text)
                main.append(inside > 0)
                bad_.append(dropped > 0)
            buffer.clear()

    def close(k: int) -> None:
        nonlocal dropped, mute, inside
        for _, bad, no_text, is_main in stack[k:]:
            dropped -= bad
            mute -= no_text
            inside -= is_main
        del stack[k:]

    tokens = _TOKEN.findall(page or "")
    for at, token in enumerate(tokens):
        tag = _TAG.match(token) if token[0] == "<" else None
        if not tag:
            if token[0] != "<" or (len(token) > 1 and not token[1].isalpha() and token[1] not in "!?/"):
                if not mute and not raw:
                    buffer.append(token)
            continue
        closing, name = tag.group(1), tag.group(2).lower()
        if raw:  # nothing counts inside scripts and the like but their end
            if not closing or name != raw:
                continue
            raw = ""
        if name in _BLOCK and not mute:
            flush()
        if closing:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if k is not None:
                if any(bad and not no_text for _, bad, no_text, _ in stack[k:]):
                    flush()  # a line never holds both boilerplate and text
                close(k)
        elif name not in _VOID and not token.endswith("/>"):
            if name == "p" and stack and stack[-1][0] == "p":
                close(len(stack) - 1)
            bad = not dropped and _bad(tokens, at, name, inside > 0)
            # lines are blocks: what is dropped inside a line is left out of it
            no_text = bad and (name in _NO_TEXT or name not in _BLOCK)
            is_main = name in _MAIN and not dropped
            if name in _RAW:
                raw = name
            stack.append((name, bad, no_text, is_main))
            dropped += bad
            mute += no_text
            inside += is_main
    flush()
    return out, main, bad_


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which entries of ``a`` lie on a longest common subsequence with ``b``.

    Common ends are taken first.
    """
    out = np.zeros(len(a), bool)
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(same.argmin())
    out[:head] = True
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    same = a[::-1][:n] == b[::-1][:n]
    tail = n if same.all() else int(same.argmin())
    if tail:
        out[len(out) - tail :] = True
        a, b = a[:-tail], b[:-tail]
    here = np.flatnonzero(np.isin(a, b))
    b = b[np.isin(b, a)]
    if not len(here) or not len(b):
        return out
    out[head + here[_align(a[here], b)]] = True
    return out


#: Cells of the table of one alignment that may be held at once, as bytes.
_CELLS = 1 << 24


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of a longest common subsequence of ``a`` with every prefix of ``b``."""
    score = np.zeros(len(b) + 1, np.int32)
    for x in a:
        score[1:] = np.maximum.accumulate(np.maximum(np.where(b == x, score[:-1] + 1, 0), score[1:]))
    return score


def _align(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places in ``a`` of a longest common subsequence.

    Rows of the table advance by whole vectors, with a bit a cell for the way
    back; a table that is too large is halved where the best scores of both
    halves add up to the most, so memory is linear in long pages.
    """
    if not len(a) or not len(b):
        return np.empty(0, np.int64)
    if len(a) > 1 and len(a) * len(b) > _CELLS:
        mid = len(a) // 2
        cut = int((_scores(a[:mid], b) + _scores(a[mid:][::-1], b[::-1])[::-1]).argmax())
        return np.concatenate([_align(a[:mid], b[:cut]), mid + _align(a[mid:], b[cut:])])
    score = np.zeros(len(b) + 1, np.int32)
    up = np.zeros((len(a), len(b)), bool)
    for i, x in enumerate(a):
        new = np.maximum.accumulate(np.maximum(np.where(b == x, score[:-1] + 1, 0), score[1:]))
        up[i] = score[1:] == new
        score[1:] = new
    found, i, j = [], len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if up[i, j]:
            i -= 1
        elif b[j] == a[i]:
            found.append(i)
            i, j = i - 1, j - 1
        else:
            j -= 1
    return np.array(found[::-1], np.int64)


def _hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


_PARTS = re.compile(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)")


def host_path(url: str | None) -> tuple[str, str]:
    """Host without user, port and a leading ``www.`` or ``m.``; path in lower case."""
    m = _PARTS.match(url or "")
    if not m:
        return "", (url or "").lower()
    host = m.group(1).rpartition("@")[2].partition(":")[0].lower()
    return re.sub(r"^(?:www|m)\.", "", host), m.group(2).lower().rstrip("/")


def prefix_length(a: str, b: str) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def shared_lines(own: tuple, others: list[tuple], copy: float = 0.5, template: np.ndarray | None = None) -> np.ndarray:
    """Lines of a page to delete: shared with its nearest neighbour by path that is no copy; none if all are copies."""
    found = difference(own, others, copy, template)
    return np.zeros(len(own[1]), bool) if found is None else found


def difference(own: tuple, others: list[tuple], copy: float = 0.5, template: np.ndarray | None = None) -> np.ndarray | None:
    """The same, and None if all neighbours are copies.

    A page is (path, hashes, weights, inside article); of equally near
    neighbours the earlier in URL order comes first.  A neighbour is a copy if
    it shares more than ``copy`` of the weight of the lines that are the
    page's own: those inside the article, else those not in ``template`` (the
    lines of most pages of the host), else, where these are under a tenth of
    the text, all lines.
    """
    path, hashes, weights, inside = own
    tell = inside
    if not inside.any():
        tell = ~np.isin(hashes, template) if template is not None else ~inside
        if weights[tell].sum() < 0.1 * weights.sum():
            tell = ~inside
    for other in sorted((o for o in others if o is not None), key=lambda o: -prefix_length(path, o[0])):
        shared = common(hashes, other[1])
        if weights[shared & tell].sum() > copy * weights[tell].sum():
            continue
        return shared & ~inside
    return None


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars.

    Null html is empty and gives an empty text; a null url belongs to the
    empty host.  Rows that repeat url and html get equal results.  An empty
    table gives none; other columns are not read.
    """
    bound_batches(pages)
    rows = pages.select(F.col(id_col).alias("own"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    key = F.xxhash64("url", "html"), F.crc32(F.col("html").cast("binary"))
    rows = rows.select("own", "url", "html", key[0].alias("k1"), key[1].alias("k2"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for url, page in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                text, main, bad = lines(page)
                host, path = host_path(url)
                hashes = [_hash(t) for t in text]
                # boilerplate by structure weighs nothing when copies of an article are told from other pages
                weights = [0 if b else len(t) for t, b in zip(text, bad, strict=True)]
                sig = hashlib.blake2b(repr((host, hashes, main, weights)).encode("utf-8", "replace"), digest_size=16).digest()
                for o, x in zip(out, (sig, host, path, hashes, weights, main), strict=True):
                    o.append(x)
            kinds = (pa.binary(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))], ["k1", "k2", "sig", "host", "path", "hashes", "weights", "inside"]
            )

    fields = "k1 long, k2 long, sig binary, host string, path string, hashes array<long>, weights array<int>, inside array<boolean>"
    sketches = materialize(rows.select("k1", "k2", "url", "html").mapInArrow(sketch, fields).dropDuplicates(["k1", "k2"]), "page-lines")
    # pages of a host with equal lines are one page here; a page without lines pairs with none
    some = sketches.filter(F.size("hashes") > 0).groupBy("sig").agg(F.min(F.struct("host", "path", "hashes", "weights", "inside")).alias("p")).select("sig", "p.*")
    pages_ = materialize(number_rows(some, ["host", "path", "sig"], "pos"), "page-order")
    hosts = pages_.groupBy("host").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    # lines of most pages of a host: at most twice as many as a page has on average
    seen = pages_.select("host", F.explode(F.array_distinct("hashes")).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    most = seen.join(broadcast_if_small(materialize(hosts, "page-hosts")), "host").filter("hi - lo >= 2 and 2 * n > hi - lo + 1")
    most = most.groupBy("host").agg(F.collect_list("line").alias("template"))
    hosts = materialize(hosts.join(most, "host", "left"), "page-templates")
    todo = pages_.join(broadcast_if_small(hosts), "host")

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, hashes, weights, inside, template, *others in zip(*(batch.column(i).to_pylist() for i in range(1, 8)), strict=True):
                own = (path, np.array(hashes, np.int64), np.array(weights, np.int64), np.array(inside, bool))
                near = [(o["path"], np.array(o["hashes"], np.int64)) for o in others if o]
                found.append(difference(own, near, template=None if template is None else np.array(template, np.int64)))
            gone = [None if g is None else np.flatnonzero(g).astype(np.int32) for g in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.list_(pa.int32()))], ["sig", "gone"])

    # neighbours at distance 1, 2, 4 and so on, the last at the host's ends, until one is no copy
    page = F.struct("path", "hashes")
    done, far = None, 1
    while True:
        todo = todo.filter("lo < hi").withColumns({"b": F.greatest(F.col("pos") - far, "lo"), "a": F.least(F.col("pos") + far, "hi")})
        before, after = (pages_.select(F.col("pos").alias(k), page.alias(f"at_{k}")) for k in "ba")
        near = todo.join(before, "b").join(after, "a")
        at = lambda k: F.when(F.col(k) != F.col("pos"), F.col(f"at_{k}"))
        near = near.select("sig", "path", "hashes", "weights", "inside", "template", at("b").alias("prev"), at("a").alias("next"))
        found = materialize(near.mapInArrow(delete, "sig binary, gone array<int>"), "page-differences")
        good = found.filter(F.size("gone") > 0)
        done = good if done is None else done.unionByName(good)
        # copies on both sides: look further, unless both ends of the host are copies
        left = found.filter("gone is null").select("sig")
        todo = todo.filter("b > lo or a < hi").join(broadcast_if_small(left), "sig", "left_semi").drop("a", "b")
        todo = materialize(todo, "page-copies")
        if todo.isEmpty():
            break
        far *= 2
    gone = materialize(sketches.select("k1", "k2", "sig").join(broadcast_if_small(materialize(done, "page-lines-gone")), "sig").select("k1", "k2", "gone"), "page-shared")

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, drop in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                drop = set(drop or ())
                text, _, bad = lines(page)
                out.append("\n\n".join(t for i, (t, b) in enumerate(zip(text, bad, strict=True)) if not b and i not in drop))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["own", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    out = rows.join(broadcast_if_small(gone), ["k1", "k2"], "left").select("own", "url", "html", "gone")
    out = out.mapInArrow(text, f"own {kind}, url string, text string, n_chars long")
    return out.select(F.col("own").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")

"""HTML extraction: page structure, and a suffix array over each host's token streams for what structure leaves open."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import map_batches, mix, read, ship, word_hashes
from weft.session import materialize, parallelism

#: Tokens that a run repeated on distinct pages of a host must have, and the share of a block that such runs must cover.
RUN_TOKENS, COVERED = 12, 0.5
#: Pages of a host that are held against each other at once, tokens of one suffix array, and pages of a task.
HOST_PAGES, ARRAY_TOKENS, TASK_PAGES = 512, 400_000, 2048
#: Hosts of more than HOST_PAGES pages whose sizes may be sent to all tasks; more are joined by shuffling.
BROADCAST_HOSTS = 100_000
#: Pages of such a host for each of its buckets of run hashes, and runs that a task holds before it sends them.
BUCKET_PAGES, HELD_RUNS = 2000, 1_500_000

#: Elements without text of their own, elements that are never part of an article, and elements that
#: begin and end a block of text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = set("script style noscript template svg math iframe object head title nav header footer aside form button select textarea dialog menu fieldset datalist".split())
RAW = set("script style textarea title noscript iframe".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCKS - {"body", "html", "head", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "title"}
#: Words of class, id, role or aria-label that mark what isn't part of an article.
MARKS = set(
    "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner popup modal overlay cookie cookies consent gdpr notice notification alert menu nav navbar navigation breadcrumb breadcrumbs sidebar side aside footer header masthead topbar toolbar comment comments reply replies disqus respond form subscribe newsletter signup login search share sharing social related recommended trending widget pagination pager complementary contentinfo feedback disclaimer toc teaser teasers".split()
)
#: Those of the marks that also hold for an article inside the marked element, or for one so marked itself.
STRICT = set("ad ads advert advertisement advertising sponsor sponsored promo comment comments reply replies disqus respond related recommended trending widget cookie cookies consent newsletter subscribe popup modal feedback teaser teasers".split())

#: Words that only say how a marked element is laid out.
LAYOUT = set("bar block bottom box btn button buttons col column container content area group inner item items left link links list main outer page panel right row section site text title top wrap wrapper".split())

#: Words that, with "more", name a list of other articles; and styles that hide an element.
OTHERS = set("articles news posts reading stories".split())
HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)

#: A comment's start, a tag (end mark, name, attributes) or a declaration. Quotes only count right after "=".
TAG = re.compile(r"""<(?:(!--)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))*+)>|(?:[!?]|/[^a-zA-Z])[^>]*+>|/>)""")
ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?)?+""")
SPACES = re.compile(r"\s+")


def _attributes(text: str) -> dict[str, str]:
    """The attributes that matter, by name in lower case; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        name = name.lower()
        if name in ("class", "id", "role", "aria-label", "hidden", "style"):
            out.setdefault(name, html.unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    return out


def _marks(attributes: dict[str, str], in_article: bool) -> set[str]:
    """The marks among the words of class, id, role and label; a hidden element counts as a popup.

    Inside an article a name counts for the milder marks only if its other words speak of layout: "share-bar" does,
    "share-price" doesn't. A mark and a word of layout may be written as one: "commentlist".
    """
    out: set[str] = set()
    for name, value in attributes.items():
        if name == "hidden":
            if not value or value.lower() == "hidden":
                out.add("popup")
            continue
        if name == "style":
            if HIDDEN.search(value):
                out.add("popup")
            continue
        for one in value.split():
            words = set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", one).lower())) - {""}
            joined = {w[:k] for w in words - MARKS for k in range(2, len(w)) if w[:k] in MARKS and w[k:] in LAYOUT}
            words = {w for w in words if w in MARKS or not any(w.startswith(m) and w[len(m) :] in LAYOUT for m in joined)} | joined
            found = MARKS & words
            if "more" in words and words & OTHERS:
                found = found | {"related"}
            if found and in_article and not found & STRICT and words - MARKS - LAYOUT:
                continue
            out |= found
    return out


def blocks_of(page: str) -> list[tuple[str, bool, bool]]:
    """placed_blocks without their kinds."""
    return [x[:3] for x in placed_blocks(page)]


def _kind(open_tags: list[tuple]) -> str:
    """The place of what follows: the blocks open inside the article, up to eight, each with its class and id."""
    out: list[str] = []
    for x in reversed(open_tags):
        if x[4] is None or len(out) == 8:
            break
        if x[4]:
            out.append(x[4])
    return ">".join(reversed(out))


def placed_blocks(page: str) -> list[tuple[str, bool, bool, str]]:
    """(text, in_article, outside, kind) of every block of text in page order.

    in_article: within <article> or <main>; outside: within an element that is never part of an article, by its name or
    its marks. Marks of layout around an article ("with-sidebar") don't hold inside it, those of adverts and comments do. kind: the elements around it inside the article. Character references are
    decoded where no tag divides them, runs of white space are one space. Tags left open at the end of the page end there; a closing tag closes what is still open inside its element, and one without an open element nothing.
    """
    out: list[tuple[str, bool, bool, str]] = []
    # name, the counts that hold again once it is closed, and its part of a kind ("": none, None: an article begins)
    open_tags: list[tuple[str, int, int, int, str | None]] = []
    text: list[str] = []
    article = outside = layout = 0

    def end_block() -> None:
        if text:
            joined = SPACES.sub(" ", "".join(map(html.unescape, text))).strip()
            if joined:
                out.append((joined, article > 0, outside + layout > 0, _kind(open_tags)))
            text.clear()

    def close(upto: int) -> None:
        nonlocal article, outside, layout
        while len(open_tags) > upto:
            if open_tags[-1][0] in BLOCKS:
                end_block()
            _, article, outside, layout, _ = open_tags.pop()

    at, n = 0, len(page)
    while at < n:
        sign = page.find("<", at)
        text.append(page[at : sign if sign >= 0 else n])
        if sign < 0:
            break
        found = TAG.match(page, sign)
        if not found:
            if page[sign + 1 : sign + 2].isalpha() or page[sign + 1 : sign + 2] in ("/", "!", "?"):
                # a tag that the page's end cuts off isn't text
                break
            text.append("<")
            at = sign + 1
            continue
        at = found.end()
        if found[1]:
            end = page.find("-->", found.start() + 4)
            at = n if end < 0 else end + 3
            continue
        if not found[3]:
            continue
        name, closing = found[3].lower(), bool(found[2])
        if name == "br":
            text.append(" ")
            continue
        if closing:
            places = [i for i, x in enumerate(open_tags) if x[0] == name]
            if places:
                close(places[-1])
            elif name in BLOCKS:
                end_block()
            continue
        if name in BLOCKS:
            end_block()
        if name in CLOSES_P:
            places = [i for i, x in enumerate(open_tags) if x[0] == "p"]
            # a paragraph ends where another block begins, unless an element that holds blocks lies between
            if places and not any(x[0] in BLOCKS and x[0] != "p" for x in open_tags[places[-1] + 1 :]):
                close(places[-1])
        if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            if open_tags and open_tags[-1][0] == name:
                close(len(open_tags) - 1)
        if name in VOID:
            continue
        if found[4].endswith("/") and name in ("svg", "math", "iframe", "script"):
            continue
        attributes = _attributes(found[4])
        is_article = name in ("article", "main") or attributes.get("role", "").lower() == "main"
        marks = _marks(attributes, article > 0) if attributes and name not in ("body", "html") else set()
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        own = "" if name not in BLOCKS else name + re.sub(r"\d+", "0", "".join(f" {attributes[x]}" for x in ("class", "id") if x in attributes).lower())
        open_tags.append((name, article, outside, layout, None if is_article else own))
        outside += name in OUTSIDE or bool(marks & STRICT)
        if is_article:
            article, layout = article + 1, 0 if not article else layout
        else:
            layout += bool(marks)
    close(0)
    end_block()
    return out


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, number of tokens that each has in common with the one before it) by prefix doubling.

    The last token must occur once. Ranks are refined among suffixes that still share one; those of each round tell by
    doubling how far neighbours agree.
    """
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(tokens, kind="stable")
    sorted_tokens = tokens[order]
    new = np.concatenate([[True], sorted_tokens[1:] != sorted_tokens[:-1]])
    # a suffix's rank is the place of the first one that it agrees with so far; behind the end stands -1
    rank = np.full(n + 1, -1, np.int32)
    begin = np.flatnonzero(new)
    rank[order] = np.repeat(begin, np.diff(np.append(begin, n)))
    open_at = np.flatnonzero(~(new & np.append(new[1:], True)))
    levels, width = [rank], 1
    while len(open_at):
        # open_at: places in the order whose suffixes share their rank
        some = order[open_at]
        key = rank[some].astype(np.int64) * (n + 2) + rank[np.minimum(some + width, n)] + 1
        by = np.argsort(key, kind="stable")
        key, some = key[by], some[by]
        order[open_at] = some
        new = np.concatenate([[True], key[1:] != key[:-1]])
        begin = np.flatnonzero(new)
        rank = rank.copy()
        rank[some] = np.repeat(open_at[begin], np.diff(np.append(begin, len(some))))
        open_at = open_at[~(new & np.append(new[1:], True))]
        levels.append(rank)
        width *= 2
    common = np.zeros(n, np.int64)
    x, y = order[:-1].copy(), order[1:].copy()
    which = np.arange(1, n)
    for level in range(len(levels) - 1, -1, -1):
        same = levels[level][x] == levels[level][y]
        common[which[same]] += 1 << level
        x[same] += 1 << level
        y[same] += 1 << level
    return order, common


def longest_elsewhere(suffixes: np.ndarray, common: np.ndarray, label: np.ndarray) -> np.ndarray:
    """How many tokens of each suffix, by its place in the tokens, occur in a row at some place of another label.

    In order of suffixes the nearest ones of another label share most: the least number in common between them counts.
    """
    n = len(suffixes)
    own = label[suffixes]
    change = np.flatnonzero(own[1:] != own[:-1]) + 1
    starts, ends = np.concatenate([[0], change]), np.append(change, n)
    out = np.zeros(n, np.int64)

    def least(values: np.ndarray, segment: np.ndarray) -> np.ndarray:
        # running minima of each segment: later segments are shifted below all earlier ones
        shift = segment * (int(values.max(initial=0)) + 1)
        return np.minimum.accumulate(values - shift) + shift

    segment = np.repeat(np.arange(len(starts)), ends - starts)
    before = least(common, segment)
    before[segment == 0] = 0
    after = least(np.append(common[1:], 0)[::-1], (len(starts) - 1 - segment)[::-1])[::-1].copy()
    after[segment == len(starts) - 1] = 0
    out[suffixes] = np.maximum(before, after)
    return out


def repeated_across_pages(tokens: np.ndarray, page: np.ndarray, depth: int = RUN_TOKENS) -> np.ndarray:
    """Marks the tokens covered by runs of `depth` tokens or more that occur on several pages.

    `page` numbers the tokens' pages; each page's stream must end with a token of its own, so that no run crosses pages.
    """
    return repeated_by(tokens, [page], depth)[0]


def repeated_by(tokens: np.ndarray, labels: list[np.ndarray], depth: int = RUN_TOKENS) -> list[np.ndarray]:
    """repeated_across_pages for several numberings of the pages, from one suffix array. Pages may share a number."""
    n = len(tokens)
    if not n:
        return [np.zeros(0, bool) for _ in labels]
    suffixes, common = suffix_array(tokens)
    out = []
    for label in labels:
        run = longest_elsewhere(suffixes, common, label)
        at = np.flatnonzero(run >= depth)
        out.append(covered_from(at, n, run[at]))
    return out


def covered_from(begins: np.ndarray, n: int, lengths: np.ndarray | int) -> np.ndarray:
    """Which of n tokens lie in the runs of these lengths that begin at these places."""
    edges = np.bincount(begins, minlength=n + 1)
    edges[: n + 1] -= np.bincount(np.minimum(begins + lengths, n), minlength=n + 1)
    return np.cumsum(edges)[:n] > 0


def _wanted(blocks: list[tuple[str, bool, bool, str]]) -> list[bool]:
    """Which blocks may be the page's text, by structure alone."""
    has_article = any(x[1] for x in blocks)
    return [not outside and (in_article or not has_article) for _, in_article, outside, _ in blocks]


#: What zones() says of a block: of a page without an article, at the edge of an article's body, of the body, neither.
PLAIN, EDGE, BODY, NEITHER = range(4)


def zones(blocks: list[tuple[str, bool, bool, str]]) -> list[int]:
    """The zone of each block of a page.

    The body of an article are the wanted blocks of the kind that holds most of its words (of equals the first). At its edge
    are wanted blocks of other kinds, but for an <h1>, before the first or after the last block of the body, and in between
    those that carry a class or an id. An article without such blocks has neither zone.
    """
    if not any(x[1] for x in blocks):
        return [PLAIN] * len(blocks)
    words: dict[str, int] = {}
    wanted = _wanted(blocks)
    for (text, *_, kind), good in zip(blocks, wanted):
        if good:
            words[kind] = words.get(kind, 0) + text.count(" ") + 1
    if len(words) < 2:
        return [NEITHER] * len(blocks)
    most = max(words, key=words.__getitem__)
    body = [i for i, (x, good) in enumerate(zip(blocks, wanted)) if good and x[3] == most]
    out = [NEITHER] * len(blocks)
    for i, (x, good) in enumerate(zip(blocks, wanted)):
        last = x[3].rpartition(">")[2].split(" ")[0]
        if good and x[3] == most:
            out[i] = BODY
        elif good and last != "h1" and (i < body[0] or i > body[-1] or " " in x[3]):
            out[i] = EDGE
    return out if EDGE in out else [NEITHER] * len(blocks)


def segments(page: np.ndarray, zone: np.ndarray) -> np.ndarray:
    """A number for each stretch of words of one page and zone."""
    return np.cumsum(np.concatenate([[False], (page[1:] != page[:-1]) | (zone[1:] != zone[:-1])])) if len(page) else page


def article_runs(words: np.ndarray, page: np.ndarray, zone: np.ndarray, hosts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes) of the runs at the edges of articles, and of those in their bodies. A run has other hashes in bodies
    than at edges."""
    at, h = window_hashes(words, page, hosts, segment=segments(page, zone))
    edge, body = zone[at] == EDGE, zone[at] == BODY
    with np.errstate(over="ignore"):
        h = mix(h + zone[at].astype(np.uint64))
    return at[edge], h[edge], at[body], h[body]


def content_labels(pages: list[list[tuple[str, bool, bool, str]]], words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each page's wanted words, or of all words where none are wanted: copies of a page share it, whatever
    surrounds them."""
    out = np.zeros(len(pages), np.uint64)
    block = begin = 0
    for i, blocks in enumerate(pages):
        n = counts[block : block + len(blocks)]
        here = words[begin : begin + int(n.sum())]
        wanted = here[np.repeat(np.array(_wanted(blocks), bool), n)]
        out[i] = int.from_bytes(hashlib.blake2b((wanted if len(wanted) else here).tobytes(), digest_size=8).digest(), "little")
        block, begin = block + len(blocks), begin + len(here)
    return out


def window_hashes(words: np.ndarray, page: np.ndarray, hosts: np.ndarray, depth: int = RUN_TOKENS, segment: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the runs of `depth` words that lie in one page, or segment of it; equal on pages of one host alone.
    `page` numbers the words' pages in order, `hosts` has a hash for each page."""
    segment = page if segment is None else segment
    at = np.flatnonzero(segment[: max(len(page) - depth + 1, 0)] == segment[depth - 1 :])
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(depth):
            out = (out + words[at + j]) * np.uint64(0x9E3779B97F4A7C15)
        return at, mix(out ^ mix(hosts[page[at]] + np.uint64(1)))


def across_parts(pages: DataFrame) -> DataFrame:
    """(host, part, hashes, folded): the runs of RUN_TOKENS words of a part, of all pages, and once more at the edges of
    articles and in the bodies of articles that have edges, that another part of the host has too, as packed hashes, and
    whether pages of different content have them. From (html, host, part, hh, n) of hosts in parts, n the host's pages.

    Each task folds its own runs by run and part, then a bucket of a host's hashes meets in one task. What is sent for a run
    is its hash and the numbers of the contents that have it in a list of those of its part.
    """

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        places: dict[tuple[str, int, int], int] = {}
        waiting = 0

        def flush():
            h, g, label = (np.concatenate([x[i] for x in held]) for i in range(3))
            order = np.lexsort((label, g, h))
            h, g, label = h[order], g[order], label[order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]))
            last = np.append(first[1:], len(h)) - 1
            h, g, low, high = h[first], g[first], label[first], label[last]
            keys = list(places)
            buckets = np.array([n for *_, n in keys], np.uint64)[g]
            bucket = (h % buckets).astype(np.int64)
            both = g * int(buckets.max()) + bucket
            order = np.argsort(both, kind="stable")
            both, bucket, g, h, low, high = (x[order] for x in (both, bucket, g, h, low, high))
            starts = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
            rows = []
            for x, y in zip(starts.tolist(), np.append(starts[1:], len(both)).tolist()):
                labels = np.unique(np.concatenate([low[x:y], high[x:y]]))
                first, last = (np.searchsorted(labels, v[x:y]).astype(np.uint16 if len(labels) < 1 << 16 else np.uint32) for v in (low, high))
                # the second is mostly the first again, and no difference packs well
                rows.append((*keys[g[x]][:2], int(bucket[x]), h[x:y].tobytes(), labels.tobytes(), first.tobytes(), (last - first).tobytes()))
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 4])], names=["host", "part", "bucket", "h", "labels", "low", "high"])
            held.clear(), places.clear()
            return out

        for batch in batches:
            every = [placed_blocks(x or "") for x in batch.column(0).to_pylist()]
            words, counts = word_hashes([b[0].encode() for blocks in every for b in blocks])
            n = np.bincount(np.repeat(np.arange(len(every)), [len(x) for x in every]), weights=counts, minlength=len(every)).astype(np.int64)
            page = np.repeat(np.arange(len(every)), n)
            label = content_labels(every, words, counts)
            g = np.array([places.setdefault((x, part, -(-size // BUCKET_PAGES)), len(places)) for x, part, size in zip(*(batch.column(c).to_pylist() for c in (1, 2, 4)))], np.int64)
            zone = np.repeat(np.array([z for blocks in every for z in zones(blocks)], np.int64), counts)
            hh = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            at, h = window_hashes(words, page, hh)
            edge_at, edge_h, body_at, body_h = article_runs(words, page, zone, hh)
            at, h = np.concatenate([at, edge_at, body_at]), np.concatenate([h, edge_h, body_h])
            if len(h):
                held.append((h, g[page[at]], label[page[at]]))
                waiting += len(h)
            if waiting > HELD_RUNS:
                yield flush()
                waiting = 0
        if held:
            yield flush()

    raw = map_batches(pages.select("html", "host", "part", "hh", "n"), run, "host string, part bigint, bucket bigint, h binary, labels binary, low binary, high binary")

    def numbers(packed: bytes, n: int) -> np.ndarray:
        return np.frombuffer(packed, np.uint16 if len(packed) == 2 * n else np.uint32)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["h"]])
        n = (pdf["h"].str.len() // 8).to_numpy()
        labels = [np.frombuffer(x, np.uint64) for x in pdf["labels"]]
        first = [numbers(x, k) for x, k in zip(pdf["low"], n)]
        low = np.concatenate([x[i] for x, i in zip(labels, first)])
        high = np.concatenate([x[i + numbers(more, len(i))] for x, i, more in zip(labels, first, pdf["high"])])
        host = pdf["host"].iloc[0]
        group, named = pd.factorize(pdf["part"])
        g = np.repeat(group, n)
        order = np.argsort(h, kind="stable")
        h, low, high, g = h[order], low[order], high[order], g[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(first, len(h)))
        several = np.repeat(np.minimum.reduceat(g, first) != np.maximum.reduceat(g, first), size)
        folded = np.repeat(np.minimum.reduceat(low, first) != np.maximum.reduceat(high, first), size)
        out = []
        key = g * 2 + folded
        order = np.flatnonzero(several)
        order = order[np.argsort(key[order], kind="stable")]
        key, h = key[order], h[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
        for a, b in zip(starts, np.append(starts[1:], len(key)) if len(key) else []):
            out.append((host, named[key[a] // 2], np.unique(h[a:b]).tobytes(), bool(key[a] & 1)))
        return pd.DataFrame(out, columns=["host", "part", "hashes", "folded"])

    ship()
    return raw.groupBy("host", "bucket").applyInPandas(merge, "host string, part bigint, hashes binary, folded boolean")


def repeated_edges(words, page, zone, label, hosts, numbers, folded_elsewhere) -> np.ndarray:
    """Marks the words at the edges of articles that maximal runs on pages of other content cover, from a suffix array of the
    edges alone, where the body is the page's own: less than half of its runs occur in bodies of other content.

    `hosts` has the hash of each page's host, `numbers` the number of its part, folded_elsewhere the runs by such numbers
    that other parts have.
    """
    out = np.zeros(len(words), bool)
    at = np.flatnonzero(zone == EDGE)
    if not len(at):
        return out
    segment = segments(page, zone)[at]
    last = np.flatnonzero(np.concatenate([segment[1:] != segment[:-1], [True]]))
    with np.errstate(over="ignore"):
        tokens = mix(words[at] ^ mix(hosts[page[at]] + np.uint64(1)))
        stops = mix(np.arange(len(last), dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))
    stream, owner = np.insert(tokens, last + 1, stops), np.insert(page[at], last + 1, page[at[last]])
    covered = repeated_by(stream, [label[owner]])[0]
    out[at] = np.delete(covered, last + 1 + np.arange(len(last)))
    edge_at, edge_h, body_at, body_h = article_runs(words, page, zone, hosts)
    # of the body's runs, those that pages of two contents have
    order = np.lexsort((label[page[body_at]], body_h))
    h, own = body_h[order], label[page[body_at]][order]
    shared = np.zeros(len(h), bool)
    if len(h):
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(first, len(h)))
        shared[order] = np.repeat(np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first), size)
    for number, hashes in folded_elsewhere.items():
        here = edge_at[numbers[page[edge_at]] == number]
        out |= covered_from(here[np.isin(edge_h[numbers[page[edge_at]] == number], hashes)], len(words), RUN_TOKENS)
        mine = numbers[page[body_at]] == number
        shared[mine] |= np.isin(body_h[mine], hashes)
    n = np.bincount(page[body_at], minlength=len(label))
    k = np.bincount(page[body_at], weights=shared, minlength=len(label))
    return out & (2 * k < n)[page] & (zone == EDGE)


def _decide(pages: list[tuple[int, list[tuple[str, bool, bool, str]]]], hosts: list[int], known: dict[int, list[tuple[np.ndarray, bool]]]) -> Iterator[tuple[str, int]]:
    """(text, tokens in repeated runs) of each of (host number, blocks). known: for host numbers of parts, the runs that
    other parts have, by `hosts`' hashes, and whether pages of different content have them."""
    texts = [b[0].encode() for _, blocks in pages for b in blocks]
    words, counts = word_hashes(texts)
    block_page = np.array([i for i, (_, blocks) in enumerate(pages) for _ in blocks], np.int64)
    host = np.array([h for h, _ in pages], np.uint64)
    owner = np.repeat(np.arange(len(texts)), counts)
    page = block_page[owner] if len(texts) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        # tokens of different hosts differ, so that one array serves many hosts
        tokens = mix(words ^ mix(host[page] + np.uint64(1))) if len(words) else words
        ends = np.searchsorted(page, np.arange(len(pages)), "right")
        stops = mix(np.arange(len(pages), dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))
    stream = np.insert(tokens, ends, stops)
    stream_page = np.insert(page, ends, np.arange(len(pages)))
    # copies of a page count as one page where blocks are judged
    label = content_labels([blocks for _, blocks in pages], words, counts)
    on_rows, covered = (np.delete(x, ends + np.arange(len(pages))) for x in repeated_by(stream, [stream_page, label[stream_page]]))
    if known:
        at, h = window_hashes(words, page, np.array(hosts, np.int64).view(np.uint64))
        number = np.array([x for x, _ in pages], np.uint64)[page[at]]
        for x, runs in known.items():
            for only_folded, marks in ((False, on_rows), (True, covered)):
                wanted = [hashes for hashes, folded in runs if folded or not only_folded]
                here = at[number == np.uint64(x)]
                begins = here[np.isin(h[number == np.uint64(x)], np.concatenate(wanted))] if wanted else here[:0]
                marks |= covered_from(begins, len(words), RUN_TOKENS)
    zone = np.array([z for _, blocks in pages for z in zones(blocks)], np.int64)
    elsewhere = {np.uint64(x): np.concatenate([hashes for hashes, folded in runs if folded]) for x, runs in known.items() if any(folded for _, folded in runs)}
    edges = repeated_edges(words, page, np.repeat(zone, counts), label, np.array(hosts, np.int64).view(np.uint64), host, elsewhere)
    covered = np.where(np.repeat(zone, counts) == PLAIN, covered, edges)
    share = np.bincount(owner, weights=covered, minlength=len(texts)) / np.maximum(counts, 1)
    tokens_covered = np.bincount(page, weights=on_rows, minlength=len(pages))
    at = 0
    for i, (_, blocks) in enumerate(pages):
        n = len(blocks)
        kept = [b[0] for b, good, part in zip(blocks, _wanted(blocks), share[at : at + n]) if good and part < COVERED]
        yield "\n".join(kept), int(tokens_covered[i])
        at += n


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_repeated) per row of pages: the article's blocks in page order, joined by line ends, and how many
    tokens of the page lie in runs that the host repeats.

    What an <article> or <main> holds, less its menus, headers, forms, adverts, notices and comments, is the text of a
    page that has one, less what a suffix array of the host tells: blocks of other kinds than its body at the edges of an
    article (see zones) that are mostly covered by maximal runs of RUN_TOKENS tokens or more at the edges of articles of
    other content go. A body that pages of other content share for half or more, as near copies do, or of under
    RUN_TOKENS words, keeps its edges: an article printed twice is no boilerplate. On a page without an article or main the
    host's suffix array decides alone: of the blocks outside such elements, those that are mostly covered by maximal runs of
    RUN_TOKENS tokens or more found on other pages of the host go, and unique ones stay. Pages with the same wanted words count as
    one there, so that repeated rows and copies under other URLs don't cover each other. Hosts are the authority parts of URLs
    without user, port and "www."; rows without one form a host. A host's pages meet in blocks of at most about
    HOST_PAGES pages dealt by hash of URL and id, so a host with a third of all pages is spread over many tasks; the runs
    that several blocks of a host have are found by their hashes (see across_parts) and count
    like the others, so neither what is decided nor n_repeated depends on the blocks. Null pages are empty and give an empty text; each row gives a row, also with null or repeated ids.
    """
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")
    rows = rows.withColumn("host", host)
    sizes = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOST_PAGES)
    # hosts of more than HOST_PAGES pages: at most a HOST_PAGES-th of the pages' number, and broadcast if few
    sizes = materialize(sizes)
    rows = rows.join(F.broadcast(sizes) if sizes.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS else sizes, "host", "left")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("url", "id"), F.ceil(F.coalesce("n", F.lit(1)) / HOST_PAGES).cast("long")))
    rows = rows.withColumn("hh", F.xxhash64("host"))
    has_large = not sizes.isEmpty()
    fields = ["id", "url", "html", "host", "part", "hh"]
    rows = rows.select(*fields, F.lit(None).cast("binary").alias("hashes"), F.lit(False).alias("folded"), "n")
    if has_large:
        found = across_parts(rows.where("n is not null"))
        nothing = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("id", "url", "html")]
        rows = rows.union(found.select(*nothing, "host", "part", F.xxhash64("host"), "hashes", "folded", F.lit(None).cast("long")))
    # what is known of a part comes before its pages
    dealt = rows.repartition(max(parallelism(spark), -(-pages.count() // TASK_PAGES), 8), "host", "part").sortWithinPartitions("host", "part", F.col("hashes").isNull(), "url", "id")
    dealt = dealt.select("id", "url", "html", F.xxhash64("host", "part").alias("h"), "hh", "hashes", "folded")

    def run(batches):
        ids: list = []
        urls: list = []
        held: list[tuple[int, list[tuple[str, bool, bool, str]]]] = []
        hosts: list[int] = []
        known: dict[int, list[tuple[np.ndarray, bool]]] = {}
        tokens, last, schema = 0, None, None

        def flush():
            found = list(_decide(held, hosts, known))
            out = pa.RecordBatch.from_arrays([pa.array(ids, schema.field(0).type), pa.array(urls, pa.string()), pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["id", "url", "text", "n_repeated"])
            ids.clear(), urls.clear(), held.clear(), hosts.clear(), known.clear()
            return out

        for batch in batches:
            schema = batch.schema
            for i, url, page, h, hh, hashes, folded in zip(*(c.to_pylist() for c in batch.columns)):
                if tokens >= ARRAY_TOKENS and h != last and held:
                    yield flush()
                    tokens = 0
                last = h
                if hashes is not None:
                    known.setdefault(h & (2**64 - 1), []).append((np.frombuffer(hashes, np.uint64), folded))
                    continue
                blocks = placed_blocks(page or "")
                hosts.append(hh)
                ids.append(i)
                urls.append(url)
                held.append((h & (2**64 - 1), blocks))
                tokens += sum(b[0].count(" ") + 1 for b in blocks)
        if held:
            yield flush()

    return map_batches(dealt, run, f"id {kind}, url string, text string, n_repeated bigint")


def op4_host_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: its URL, main text, the text's length, and tokens in runs that its block of the host repeats."""
    found = main_text(read(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")

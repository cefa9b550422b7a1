"""Main text of web pages: page structure, and suffix arrays over each host's token streams.

1. A page is parsed once, into blocks.  A block is *main* (inside an article, or inside
   main where there is no article), *chrome* (in a menu, header, footer, sidebar,
   notice, advert, form or comment element) or *open* (neither).  End tags that HTML lets a
   page leave out are implied.  Class names mark an element as chrome only if every word of the
   name is of that kind or says nothing; in the middle of a sentence a marked inline element is text.
2. All blocks of a page are its token stream, with a separator before each block and after the last.  The
   streams of a host's distinct pages (those of unlike main, or else open, text) are concatenated into
   suffix arrays of at most ``CHUNK`` tokens: full suffix order with common-prefix lengths.  A
   repeated substring is a run of ``RUN`` tokens, or a whole block between its separators,
   that stands on more than half of the host's distinct pages: on two at least, a block on ``MAIN_PAGES``.
   (A longer substring on so many pages is the union of its runs.)
   What fewer pages share is a copy or a quote.
3. Pages go to the arrays in ranges of (host, text).  Of a host over several arrays each of these reports what more than a
   quarter of its pages there have, so the sums bound the number over all of them from both sides; the few
   substrings for which the bounds leave it open are counted again in all pages of the host.
4. A page with main blocks yields these, less those that are repeated blocks; if these are the larger part of the
   page, it is itself a copy and all stay.
   A page without main blocks yields its open blocks less the words that repeated
   substrings cover; if they leave no block half uncovered and no stretch of ``RUN``
   words, the page is itself a copy and its open blocks stay.

A task sends each distinct page of a host on once, so neither a large host nor a page that is copied often gathers in
one task.  Page ids are never read: rows with null or repeated ids are pages like others.

Edge cases: null or empty html gives an empty text; a page whose url has no host
belongs to host ''; pages of equal text on one host are one page for "distinct
pages", whatever their ids.  Unclosed tags, unfinished references and pages cut
off anywhere are read as far as they go.  Extra columns are carried along by
:func:`extract`, except one named like its result.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.kernels import _power_tables, mix, slices, words
from tessera.llm.store import settle, ship

#: Tokens a repeated substring has at least (unless it is a whole block), and tokens an array is built over at most.
RUN, CHUNK = 8, 1 << 20
#: Distinct pages of a host that a block is on at least to be boilerplate as a whole.
MAIN_PAGES = 5

_RAW = "script|style|noscript|template|svg|math|textarea|select|iframe|object|canvas|title|audio|video"
_MARKUP = re.compile(
    rf"<!--.*?(?:--!?>|\Z)|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"""|<(/?)([a-z][a-z0-9:-]*)([^<>"']*(?:(?:"[^"]*"|'[^']*')[^<>"']*)*|[^>]*)>|<(?=/?[a-z!?])[^>]*\Z""",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
# Element kinds of HTML and words of class names (fixed values).
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CHROME = frozenset("aside datalist dialog fieldset footer form head header menu nav search".split())
_NESTED = _BLOCK - frozenset("body h1 h2 h3 h4 h5 h6 hr html legend option p".split())
_ENDS_P = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
_SCOPE = _NESTED - {"address", "div"}
#: Open elements that a start tag ends, and those beyond which it does not look.
_IMPLIED = {
    "li": ({"li"}, _SCOPE - {"li"}),
    "dd": ({"dd", "dt"}, _SCOPE - {"dd", "dt"}),
    "dt": ({"dd", "dt"}, _SCOPE - {"dd", "dt"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr"}, {"table", "thead", "tbody", "tfoot"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot"}, {"table"}),
}
_IMPLIED["tbody"] = _IMPLIED["tfoot"] = _IMPLIED["thead"]
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion cookie cookies consent gdpr newsletter subscribe "
    "subscription signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs share sharing social related recommended comment comments disqus replies "
    "discussion footer popup modal overlay pagination pager toolbar complementary contentinfo".split()
)
#: Words that mark chrome unless the name also says what they belong to.
_WEAK_WORDS = frozenset("alert banner header masthead notice notices search widget".split())
_OWNERS = frozenset("article block content entry page post section story text".split())
_NEUTRAL = frozenset(
    "active all and area bar body bottom box button buttons by cell closed col column container count desktop facebook field fixed floating follow for form global google group "
    "heading icon icons in inline inner input item items js large latest left like link links list lists lower main media mini mobile more new news of on open our outer panel "
    "posts primary reader readers region right row secondary site slot small space spot sticky the this thread title to toggle top twitter unit upper us user users video visible "
    "web with wrap wrapper your zone".split()
)
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


def names_chrome(name: str) -> bool:
    """Whether one class name or id says chrome: some word does, and no other word says something else."""
    found = [w.lower() for w in _SPLIT.split(name) if len(w) > 1]
    if not any(w in _CHROME_WORDS or w in _WEAK_WORDS for w in found):
        return False
    weak = not any(w in _CHROME_WORDS for w in found)
    return all(w in _CHROME_WORDS or w in _WEAK_WORDS or w in _NEUTRAL or (w in _OWNERS and not weak) for w in found)


def _marked(attributes: str) -> bool:
    for m in _NAMES.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        kind = m[1].lower()
        if kind == "role":
            if value.strip().lower() in _ROLES:
                return True
        elif kind == "aria-label":
            if names_chrome(value):
                return True
        elif any(names_chrome(x) for x in value.split()):
            return True
    return False


def blocks(page: str) -> list[tuple[str, str]]:
    """The page's non-empty blocks in order: (kind, text); kinds 'article', 'main', 'open', 'chrome'."""
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, str, bool, bool]] = []
    opened: Counter = Counter()
    kind, mute, soft, plain, at = "open", False, False, False, 0

    def close() -> None:
        nonlocal plain
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append((kind if plain else "chrome", text))
        plain = False

    def add(chunk: str) -> None:
        nonlocal plain
        if mute:
            return
        if "&" in chunk:
            chunk = html_lib.unescape(chunk)
        parts.append(chunk)
        plain = plain or (not soft and not chunk.isspace())

    def leave(i: int) -> None:
        nonlocal kind, mute, soft
        for tag, *_ in stack[i:]:
            opened[tag] -= 1
        _, new, mute, soft = stack[i]
        if new != kind:
            close()
        kind = new
        del stack[i:]

    def imply(ended: set[str], stop: frozenset[str]) -> None:
        if not any(opened[t] for t in ended):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in ended:
                leave(i)
                return
            if stack[i][0] in stop:
                return

    for m in _MARKUP.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _BLOCK:
            close()
        elif tag == "br" and not mute:
            parts.append(" ")
        if m[2]:
            if opened[tag]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        leave(i)
                        break
                    if stack[i][0] in ("td", "th", "table") and tag not in ("table", "tr", "thead", "tbody", "tfoot"):
                        break
            continue
        if tag in _ENDS_P and opened["p"]:
            imply({"p"}, frozenset(("button", "caption", "table", "td", "th")))
        if tag in _IMPLIED:
            while tag in ("tr", "thead", "tbody", "tfoot") and any(opened[t] for t in _IMPLIED[tag][0]):
                before = len(stack)
                imply(*_IMPLIED[tag])
                if len(stack) == before:
                    break
            else:
                imply(*_IMPLIED[tag])
        if tag in _VOID:
            continue
        attributes = m[4]
        chrome, inline, hidden = tag in _CHROME, tag not in _BLOCK, tag == "button"
        if not hidden and ("=" in attributes or "hidden" in attributes):
            hidden = _HIDDEN.search(attributes) is not None
            chrome = chrome or (tag not in ("html", "body", "main") and _marked(attributes))
        if inline and (hidden or chrome):
            # Nothing of a hidden element or a button shows; of a marked one only what stands among other text.
            stack.append((tag, kind, mute, soft))
            opened[tag] += 1
            mute, soft = mute or hidden, soft or chrome
            continue
        chrome = chrome or hidden
        if not (chrome or tag in _NESTED or opened[tag]):
            continue
        new = kind
        if chrome or kind == "chrome":
            heading = tag == "header" and kind == "article" and not hidden and not _marked(attributes)
            new = "heading" if heading else "chrome"
        elif tag == "article":
            new = "article"
        elif tag == "main" and kind == "open":
            new = "main"
        if kind == "heading" and new != "chrome":
            new = "heading"
        if new != kind:
            close()
        stack.append((tag, kind, mute, soft))
        opened[tag] += 1
        kind = new
    if at < len(page):
        add(page[at:])
    close()
    return [("article" if k == "heading" else k, t) for k, t in out]


def main_of(found: list[tuple[str, str]]) -> list[str] | None:
    """The main blocks, or None if the page has no article and no main element with text."""
    for kind in ("article", "main"):
        if some := [t for k, t in found if k == kind]:
            return some
    return None


def host_of(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), F.lit(""))


def suffix_array(first: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of the tokens ``first`` in order, and the length of the common prefix of each with the one before it.

    A suffix ends with its page, in an end that no other page has.  Prefix doubling, where only ties are sorted again.
    """
    n = len(first)
    ends = np.append(np.flatnonzero(np.diff(page)) + 1, n)
    left = np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(n)
    order = np.argsort(first)
    begins = np.diff(first[order], prepend=first[order[:1]] - 1 if n else 0) != 0
    rank = np.empty(n, np.int32)
    starts = np.flatnonzero(begins)
    sizes = np.diff(np.append(starts, n))
    rank[order] = np.repeat(starts, sizes)
    tied = order[np.repeat(sizes > 1, sizes)]
    levels, depth, pages = [], 1, int(page[-1]) + 2 if n else 1
    while True:
        levels.append(rank)
        if not len(tied):
            break
        after = np.where(left[tied] > depth, rank[np.minimum(tied + depth, n - 1)] + pages, pages - 2 - page[tied])
        key = rank[tied].astype(np.int64) * (n + pages + 1) + after
        turn = np.argsort(key)
        tied, key = tied[turn], key[turn]
        old = rank[tied]
        new = np.diff(key, prepend=key[0] - 1) != 0
        of_old = np.maximum.accumulate(np.where(np.diff(old, prepend=-1) != 0, np.arange(len(tied)), 0))
        of_new = np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))
        rank = rank.copy()
        rank[tied] = old + of_new - of_old
        sizes = np.diff(np.append(np.flatnonzero(new), len(tied)))
        tied = tied[np.repeat(sizes > 1, sizes)]
        depth *= 2
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    common = np.zeros(n, np.int64)
    # Equal ranks at a level mean 2^k equal tokens, all within both pages: neighbours that differ there have fewer in common.
    at, a, b, tied_at = np.arange(1, n), array[:-1], array[1:], []
    for level in levels:
        same = level[a] == level[b]
        at, a, b = at[same], a[same], b[same]
        tied_at.append((at, a, b))
    for k, (at, a, b) in reversed(list(enumerate(tied_at))):
        have = common[at]
        inside = (have < left[a]) & (have < left[b])
        i, j = np.minimum(a + have, n - 1), np.minimum(b + have, n - 1)
        common[at] = have + np.where(inside & (levels[k][i] == levels[k][j]), 1 << k, 0)
    return array, common


class Streams:
    """Token streams of pages given by their blocks: a separator before every block and after the last."""

    def __init__(self, texts: pa.Array) -> None:
        flat, sizes = texts.flatten(), pc.list_value_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        w = words(flat, lower=False)
        self.words, n = w, len(sizes)
        counts = np.diff(w.bounds)
        #: Page of each block; tokens of each page, a separator for each block and one more.
        self.page_of_block = np.repeat(np.arange(n), sizes)
        tokens = np.bincount(self.page_of_block, counts + 1, n).astype(np.int64) + (sizes > 0)
        self.page = np.repeat(np.arange(n), tokens)
        #: Places of the separators that begin blocks, and of the words.
        self.blocks = np.cumsum(counts + 1) - (counts + 1) + np.cumsum(np.diff(self.page_of_block, prepend=self.page_of_block[:1]) > 0)
        self.counts = counts
        self.place = self.blocks[w.doc] + 1 + np.arange(len(w.doc)) - w.bounds[w.doc]
        self.token = np.full(len(self.page), _SEPARATOR, np.uint64)
        self.token[self.place] = w.hash
        up, down = _power_tables(len(self.token) + 2)
        sums = np.zeros(len(self.token) + 1, np.uint64)
        np.cumsum(self.token * up[: len(self.token)], out=sums[1:])
        #: Hashes of the runs by their first tokens, and of the whole blocks with both separators.
        self.starts = np.flatnonzero(self.page[: max(0, len(self.page) - RUN + 1)] == self.page[RUN - 1 :]) if len(self.page) >= RUN else np.empty(0, np.int64)
        self.runs = mix((sums[self.starts + RUN] - sums[self.starts]) * down[self.starts]).view(np.int64)
        over = self.blocks + counts + 2
        self.whole = mix((sums[over] - sums[self.blocks]) * down[self.blocks] + (counts.astype(np.uint64) << np.uint64(1)) + np.uint64(1)).view(np.int64)


_SEPARATOR = np.uint64(0x5E9A7A7E5E9A7A7F)


def _best(kinds: list[str]) -> list[str]:
    """The kind of blocks that make each page's text."""
    return ["a" if "a" in k else "m" if "m" in k else "o" for k in kinds]


def repeats(s: Streams, host: np.ndarray, kinds: list[str]) -> tuple[np.ndarray, ...]:
    """Of each run and each whole block in the suffix array of these pages (of the hosts ``host``): hash, a page, number of pages, the least that is asked for, whether some page's text depends on it."""
    first = np.unique(s.token ^ mix(host.view(np.uint64))[s.page], return_inverse=True)[1].astype(np.int64)
    array, common = suffix_array(first, s.page)
    n, pages, best = len(first), len(host), _best(kinds)
    code, length, decides, found = np.zeros(n, np.int64), np.full(n, RUN), np.zeros(n, bool), []
    by_run = np.array([b == "o" for b in best], bool)[s.page[s.starts]]
    by_block = np.array([x == b for k, b in zip(kinds, best) for x in k], bool)
    for at, hashes, own, least in ((s.starts, s.runs, by_run, 2), (s.blocks, s.whole, by_block, MAIN_PAGES)):
        if not len(at):
            continue
        code[at], decides[at] = hashes, own
        if least == MAIN_PAGES:
            length[at] = s.counts + 2
        chosen = np.zeros(n, bool)
        chosen[at] = True
        places = np.flatnonzero(chosen[array])
        some = array[places]
        # Neighbours with their length in common are one substring.
        shared = np.minimum.reduceat(common[: places[-1] + 1], np.r_[places[:1], places[:-1] + 1])
        asked = length[some]
        new = (shared < asked) | (np.diff(asked, prepend=0) != 0)
        new[0] = True
        on = np.sort((np.cumsum(new) - 1) * pages + s.page[some])
        times = np.bincount(on[np.diff(on, prepend=-1) != 0] // pages)
        matters = np.logical_or.reduceat(decides[some], np.flatnonzero(new))
        found.append((code[some[new]], s.page[some[new]], times, np.full(len(times), least), matters))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (*(np.empty(0, np.int64),) * 4, np.empty(0, bool))


def parsed(pages: DataFrame, keep: list[str], url: str, html: str) -> DataFrame:
    """The pages with their blocks, written once: (the kept columns as c0, c1, ...; host, kinds, texts, content)."""
    ship(pages.sparkSession)
    named = lambda c: pages[f"`{c.replace('`', '``')}`"]
    carried = [named(c).alias(f"c{i}") for i, c in enumerate(keep)]
    source = pages.select(*carried, F.xxhash64(host_of(named(url))).alias("host"), named(html).alias("html"))
    inner = T.StructType([*source.schema.fields[:-1], T.StructField("kinds", T.StringType()), T.StructField("texts", T.ArrayType(T.StringType()))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                found = [blocks(x) if x else [] for x in part.column("html").to_pylist()]
                kinds = ["".join(k[0] for k, _ in f) for f in found]
                cols = [*part.columns[:-1], pa.array(kinds, pa.string()), pa.array([[t for _, t in f] for f in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, inner.names)

    # The text by which pages of a host are told apart: the main blocks, or else the open ones.
    best = F.when(F.contains("kinds", F.lit("a")), "a").when(F.contains("kinds", F.lit("m")), "m").otherwise("o")
    own = F.filter("texts", lambda x, i: F.substr(F.col("kinds"), i + 1, F.lit(1)) == best)
    return settle(source.mapInArrow(parse, inner).withColumn("content", F.xxhash64("host", own)), "parsed")


def _cut(batch: pa.RecordBatch, most: int) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Runs of rows of about ``most`` bytes of texts, and their bytes."""
    texts = batch.column("texts")
    sizes = np.cumsum(np.r_[0, pc.fill_null(pc.binary_length(texts.flatten()), 0).to_numpy(zero_copy_only=False)])
    edges = np.cumsum(np.r_[0, pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)])
    ends, at = sizes[edges], 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield batch.slice(at, stop - at), int(ends[stop] - ends[at])
        at = stop


def boilerplate(rows: DataFrame) -> DataFrame:
    """(host, grams): hashes of the repeated substrings of each host that has some on which a page's text depends."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct pages of a task, their texts packed for the way."""
        seen: set[tuple[int, int]] = set()
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            keep = []
            for x in zip(batch.column("host").to_pylist(), batch.column("content").to_pylist()):
                keep.append(x not in seen)
                seen.add(x)
            rows = batch.filter(pa.array(keep, pa.bool_()))
            packed = pa.array([pack("\n".join(t).encode()) for t in rows.column("texts").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("host", "content", "kinds")), packed], ["host", "content", "kinds", "packed"])

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each repeated substring; ``all``: it was counted in all pages of its host.  A row without one for each host and array of the others."""
        held: list[pa.RecordBatch] = []
        size, last, edge = 0, None, None
        unpack = zstandard.ZstdDecompressor().decompress

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, edge
            t = pa.Table.from_batches(held).combine_chunks()
            host = t.column("host").to_numpy()
            stop = len(host)
            if not final and host[0] != host[-1]:  # the last host may go on: it waits
                stop -= int((host[::-1] != host[-1]).argmax())
            rest, t, host = t.slice(stop), t.slice(0, stop).combine_chunks(), host[:stop]
            hosts, of = np.unique(host, return_inverse=True)
            whole = hosts != edge
            if not rest.num_rows:
                whole &= hosts != host[-1]
            total = np.bincount(of)
            gram, page, n, least, matters = repeats(Streams(t.column("texts").combine_chunks()), host, t.column("kinds").to_pylist())
            at = of[page]
            fits = np.where(whole[at], matters & (2 * n > total[at]) & (n >= least), 4 * n > total[at])
            gram, at, n, least, matters = gram[fits], at[fits], n[fits], least[fits], matters[fits]
            names = ["host", "gram", "n", "pages", "least", "matters", "all"]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (hosts[at], gram, n, total[at], least, matters, whole[at])], names)
            some = np.flatnonzero(~whole)
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(hosts[some]), none, none, pa.array(total[some]), none, pa.nulls(len(some), pa.bool_()), pa.array(whole[some])], names)
            held = rest.to_batches() if rest.num_rows else []
            size = int(pc.sum(pc.binary_length(pc.list_flatten(rest.column("texts")))).as_py() or 0) if rest.num_rows else 0
            if not rest.num_rows:
                edge = int(host[-1])

        for batch in batches:
            if not batch.num_rows:
                continue
            host, content = (batch.column(c).to_numpy() for c in ("host", "content"))
            if edge is None:
                edge = int(host[0])  # the first host may have begun in the range before
            new = np.r_[last != (host[0], content[0]), (np.diff(host) != 0) | (np.diff(content) != 0)]
            last = (host[-1], content[-1])
            rows = batch.filter(pa.array(new))
            texts = [unpack(x).decode().split("\n") if k else [] for x, k in zip(rows.column("packed").to_pylist(), rows.column("kinds").to_pylist())]
            rows = pa.RecordBatch.from_arrays([rows.column("host"), rows.column("kinds"), pa.array(texts, pa.list_(pa.string()))], ["host", "kinds", "texts"])
            for one, n in _cut(rows, 6 * CHUNK):
                held.append(one)
                size += n
                if size >= 6 * CHUNK:
                    yield from flush(False)
        if held:
            yield from flush(True)

    dealt = rows.select("host", "content", "kinds", "texts").mapInArrow(once, "host long, content long, kinds string, packed binary").repartitionByRange("host", "content").sortWithinPartitions("host", "content")
    found = settle(dealt.mapInArrow(arrays, "host long, gram long, n long, pages long, least long, matters boolean, all boolean"), "repeated")
    known = found.where("all").select("host", "gram")
    totals = found.where("gram is null").groupBy("host").agg(F.sum("pages").alias("total"))
    sums = found.where("gram is not null and not all").groupBy("host", "gram").agg(F.sum("n").alias("n"), F.sum("pages").alias("pages"), F.max("least").alias("least"), F.bool_or("matters").alias("matters"))
    # An array that does not report a substring has it on a quarter of its pages at most; there it may also matter.
    sums = settle(sums.join(totals, "host").where("matters or pages < total"), "sums")
    sure = sums.where("2 * n > total and n >= least").select("host", "gram")
    doubt = sums.where("not (2 * n > total and n >= least) and 4 * n + total - pages > 2 * total and 4 * n + total - pages >= 4 * least")
    asked = settle(doubt.groupBy("host").agg(F.collect_list("gram").alias("grams")), "asked")

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in _cut(batch, 1 << 20):
                s, host, content = Streams(part.column("texts")), part.column("host").to_numpy(), part.column("content").to_numpy()
                for a, b in _groups(host):
                    wanted = part.column("grams")[a].values.to_numpy()
                    for codes, pages in ((s.runs, s.page[s.starts]), (s.whole, s.page_of_block)):
                        lo, hi = np.searchsorted(pages, (a, b))
                        hit = np.isin(codes[lo:hi], wanted)
                        page, gram = pages[lo:hi][hit], codes[lo:hi][hit]
                        yield pa.RecordBatch.from_arrays([pa.array(host[page]), pa.array(gram), pa.array(content[page])], ["host", "gram", "content"])

    counted = rows.select("host", "content", "texts").join(asked, "host").select("host", "content", "texts", "grams").mapInArrow(hits, "host long, gram long, content long")
    counted = counted.groupBy("host", "gram").agg(F.count_distinct("content").alias("times")).join(doubt, ["host", "gram"])
    every = known.unionByName(sure).unionByName(counted.where("2 * times > total and times >= least").select("host", "gram"))
    return settle(every.distinct().groupBy("host").agg(F.collect_list("gram").alias("grams")), "boilerplate")


def _groups(host: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of one host."""
    begin = np.flatnonzero(np.r_[True, np.diff(host) != 0]) if len(host) else np.empty(0, np.int64)
    yield from zip(begin.tolist(), np.append(begin[1:], len(host)).tolist())


def uncovered(s: Streams, host: np.ndarray, kinds: list[str], texts: list[list[str]], grams: pa.Array) -> list[str]:
    """The main text of each page, given the hashes of its host's repeated substrings."""
    out = []
    begins = np.searchsorted(s.page_of_block, np.arange(len(kinds) + 1))
    run_pages = s.page[s.starts]
    for a, b in _groups(host):
        known = grams[a].values.to_numpy() if grams[a].is_valid else np.empty(0, np.int64)
        whole = np.isin(s.whole[begins[a] : begins[b]], known)
        lo, hi = np.searchsorted(run_pages, (a, b))
        starts = s.starts[lo:hi][np.isin(s.runs[lo:hi], known)]
        for i in range(a, b):
            best = _best(kinds[i : i + 1])[0]
            cut = whole[begins[i] - begins[a] : begins[i + 1] - begins[a]]
            if best != "o":
                chosen = [(t, c) for k, t, c in zip(kinds[i], texts[i], cut) if k == best]
                size, gone = sum(len(t) + 1 for t, _ in chosen), sum(len(t) + 1 for t, c in chosen if c)
                out.append("\n".join(t for t, c in chosen if not c or 2 * gone > size))
                continue
            unique, all_open, own = [], [], False
            for j, (k, t) in enumerate(zip(kinds[i], texts[i])):
                if k != "o":
                    continue
                all_open.append(t)
                block = begins[i] + j
                at, n = s.blocks[block] + 1, s.counts[block]
                near = starts[np.searchsorted(starts, at - RUN + 1) : np.searchsorted(starts, at + n)]
                bare = np.ones(n, bool)
                for p in near.tolist():
                    bare[max(0, p - at) : p + RUN - at] = False
                if cut[j]:
                    bare[:] = False
                if bare.all():
                    unique.append(t)
                    own = True
                elif bare.any():
                    first = s.words.bounds[block]
                    spans = first + np.flatnonzero(bare)
                    unique.append(" ".join(s.words.data[x:y].tobytes().decode() for x, y in zip(s.words.start[spans], s.words.end[spans])))
                    own = own or 2 * len(spans) >= n or "1" * RUN in "".join("01"[x] for x in bare.tolist())
            out.append("\n".join(unique if own else all_open))
    return out


def extract(pages: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` (or its ``keep`` columns) with ``text``, the main text of each page."""
    kept = [c for c in (pages.columns if keep is None else keep) if c.lower() != "text"]
    rows = parsed(pages, kept, url, html)
    names = [f"c{i}" for i in range(len(kept))]
    # Few numbers a host: its repeated substrings are on more than half of its pages, so no more than twice those of a page.
    met = rows.join(boilerplate(rows), "host", "left").select(*names, "host", "kinds", "texts", "grams")
    schema = T.StructType([*(f for f in rows.schema.fields if f.name in names), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in _cut(batch, 1 << 20):
                host = part.column("host").to_numpy()
                if part.column("grams").null_count == part.num_rows:
                    kinds = part.column("kinds").to_pylist()
                    made = ["\n".join(t for k, t in zip(ks, ts) if k == best) for ks, ts, best in zip(kinds, part.column("texts").to_pylist(), _best(kinds))]
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(made, pa.string())], [*names, "text"])
                    continue
                made = uncovered(Streams(part.column("texts")), host, part.column("kinds").to_pylist(), part.column("texts").to_pylist(), part.column("grams"))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(made, pa.string())], [*names, "text"])

    return met.mapInArrow(run, schema).toDF(*kept, "text")

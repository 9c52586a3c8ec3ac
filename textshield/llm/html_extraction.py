"""The main text of web pages: what recurs across many pages of a host is its template and goes.

Every element with a text of its own is hashed with all it contains. Spark counts on how many
different pages of its host each hash occurs; elements that recur are deleted with their subtree.
What element names and classes mark as surroundings goes too, since a template that a host uses on
few pages recurs too seldom to be counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from textshield.llm.blocks import batches
from textshield.llm.markup import TEXTUAL, Page
from textshield.llm.shipping import ship
from textshield.session import write_once

#: Subtrees recur that stand on this many pages and on this share of the pages of their host.
PAGES, SHARE = 3, 0.001
#: Shorter subtrees recur by chance.
WORDS = 5
#: Hashes of recurring subtrees that are broadcast; more are joined.
BROADCAST = 1 << 20
TEXT_BYTES = 4 << 20


def _digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"\x00".join(parts), digest_size=8).digest()


def subtree_hashes(page: Page, host: bytes, articles: set[int], gone: set[int]) -> tuple[list[tuple[int, int]], int]:
    """``element, hash`` of the subtrees that may be template, and a mark that copies of a page share.

    A hash stands for the host, the element names and the texts, not for attributes. Elements that
    only wrap one other element are left out, as are texts inside an article, such as paragraphs:
    an author may repeat them. The mark is the least hash of the texts of the article, or of the
    page outside its marked surroundings, so that near copies of a page usually count as one.
    """
    n, tag = len(page.tag), page.tag
    parts, words, children, own = [[] for _ in range(n)], [0] * n, [0] * n, [False] * n
    inside, covered = [not articles] + [False] * (n - 1), [False] * n
    out, marks, now = [], [], 0
    for event in page.events:
        if event.__class__ is str:
            text = event.split()
            if text:
                parts[now].append(" ".join(text).encode("utf8", "surrogatepass"))
                words[now] += len(text)
                own[now] = True
        elif event is None:
            continue
        elif event > 0:
            inside[event] = inside[now] or event in articles
            covered[event] = covered[now] or event in gone
            now = event
        else:
            i = now
            now = page.parent[i]
            if words[i]:
                digest = _digest(tag[i].encode(), *parts[i])
                parts[now].append(digest)
                words[now] += words[i]
                children[now] += 1
                if own[i] and words[i] >= WORDS and inside[i] and not covered[i]:
                    marks.append(int.from_bytes(digest, "little", signed=True))
                single = children[i] == 1 and not own[i]
                kept = tag[i] in ("html", "body") or i in articles or (tag[i] in TEXTUAL and articles and inside[i])
                if words[i] >= WORDS and not single and not kept:
                    out.append((i, int.from_bytes(_digest(host, digest), "little", signed=True)))
    return out, min(marks, default=0)


def _columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(name)).to_pylist() for name in names]


def _hashed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(stream, "html", TEXT_BYTES):
        number, hashes, hosts, marks = [], [], [], []
        for i, (source, host) in enumerate(zip(*_columns(batch, "html", "host"))):
            page = Page(source or "")
            name = (host or "").encode()
            gone = page.surroundings()
            found, mark = subtree_hashes(page, name, page.articles(gone), gone)
            own = {h for _, h in found}
            # one row for the page itself tells how many pages the host has
            whole = int.from_bytes(_digest(name), "little", signed=True)
            hashes += [whole, *own]
            hosts += [whole] * (1 + len(own))
            number += [i] * (1 + len(own))
            marks += [mark] * (1 + len(own))
        place = pa.array(number, pa.int32())
        r1, r2 = (batch.column(batch.schema.get_field_index(name)).take(place) for name in ("r1", "r2"))
        yield pa.RecordBatch.from_arrays([r1, r2, *(pa.array(x, pa.int64()) for x in (hashes, hosts, marks))], ["r1", "r2", "hash", "host", "mark"])


def _texts(load):
    def texts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = load()
        for batch in batches(stream, "html", TEXT_BYTES):
            joined = batch.schema.get_field_index("hashes") >= 0
            known = _columns(batch, "hashes")[0] if joined else [None] * batch.num_rows
            out = []
            for source, host, own in zip(*_columns(batch, "html", "host"), known):
                page = Page(source or "")
                gone = page.surroundings()
                found, _ = subtree_hashes(page, (host or "").encode(), page.articles(gone), gone)
                if joined:
                    recurring = set(own or ())
                    gone |= {i for i, h in found if h in recurring}
                elif found and len(shared):
                    mine = np.array([h for _, h in found], np.int64)
                    at = np.minimum(np.searchsorted(shared, mine), len(shared) - 1)
                    gone |= {found[k][0] for k in np.flatnonzero(shared[at] == mine)}
                out.append("\n\n".join(page.blocks(gone, page.articles(gone))))
            column = pa.array([t.encode("utf8", "replace").decode("utf8") for t in out], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("row")), column], ["row", "text"])

    return texts


def host_of(url: Column) -> Column:
    """The lower-cased host of an address, without user and port; null has none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _keyed(pages: DataFrame, url: str, html: str) -> DataFrame:
    source = F.col(html).cast("string")
    return pages.select(F.struct(*pages.columns).alias("row"), source.alias("html"), host_of(F.col(url)).alias("host"),
                        F.xxhash64(url, html).alias("r1"), F.xxhash64(html, url, F.lit(1)).alias("r2"))


def recurring(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``hash`` of each subtree that stands on at least three different pages and one in a thousand of its host's."""
    rows = _keyed(pages, url, html).select("html", "host", "r1", "r2").mapInArrow(_hashed, "r1 long, r2 long, hash long, host long, mark long")
    counts = rows.select("hash", "host", "mark").distinct().groupBy("hash", "host").agg(F.count("*").alias("n"))
    counts = write_once(counts.filter((F.col("n") >= PAGES) | (F.col("hash") == F.col("host"))), "subtrees")
    hosts = counts.filter("hash = host").select("host", F.col("n").alias("pages"))
    return counts.filter(f"hash <> host AND n >= {PAGES}").join(hosts, "host").filter(F.col("n") >= SHARE * F.col("pages")).select("hash")


def extract_main_text(pages: DataFrame, url: str = "url", html: str = "html", broadcast: int = BROADCAST) -> DataFrame:
    """All columns of the pages but ``text`` and ``n_chars``, and these two: the main text and its code points.

    Blocks of text are joined by an empty line, white space inside them is one blank. Character
    references are decoded. If a page has ``article`` or ``main`` elements outside its surroundings,
    only they are read. Null and empty pages and those without an article's text give an empty text.
    Pages without an address, or with one that has no host, form one host of their own. Rows equal
    in address and source get equal results and count as one page; columns of any name are carried
    along, a table without rows gives none. Memory follows the longest page.

    Up to ``broadcast`` hashes go to every task, 8 MB by default. Of more, each page gets its own by a join.
    """
    spark = pages.sparkSession
    kept = pages.select(*[c for c in pages.columns if c.lower() not in ("text", "n_chars")])
    template = write_once(recurring(pages, url, html), "template")
    rows = _keyed(kept, url, html)
    if template.limit(broadcast + 1).count() <= broadcast:
        load = ship(spark, np.sort(np.array([r["hash"] for r in template.collect()], np.int64)))
        rows = rows.select("row", "html", "host")
    else:
        found = rows.select("html", "host", "r1", "r2").mapInArrow(_hashed, "r1 long, r2 long, hash long, host long, mark long").select("r1", "r2", "hash")
        own = found.distinct().join(template, "hash").groupBy("r1", "r2").agg(F.collect_list("hash").alias("hashes"))
        load = ship(spark, None)
        rows = rows.join(own, ["r1", "r2"], "left").select("row", "html", "host", "hashes")
    texts = rows.mapInArrow(_texts(load), StructType([rows.schema["row"], StructField("text", StringType())]))
    return texts.select("row.*", "text", F.length("text").cast("long").alias("n_chars"))

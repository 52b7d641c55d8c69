"""Benchmark decontamination with a generalised suffix automaton.

The test items' words, normalised, form one suffix automaton. A document streams through it word by word; at each
word the automaton knows the longest suffix of what was read that occurs in any item. A match of ``window`` words
or more (or a whole item, if the item is shorter) is contamination: its words are hit, its span can be removed.

Normalisation: A-Z in lower case, words are runs of digits, a-z and non-ASCII characters.

Defined cases
  null text: no words, stays null; empty text: no words; null or empty item: ignored; repeated items and repeated
  documents: each counted for itself; an item id that is null: reported as the string ``null`` is not, it is ignored;
  no items: nothing is hit; no documents: an empty result of the same schema; very long texts and items: whole, in memory
  that follows the text; ties (items with the same passage): all are named; extra columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import BitFilter, Scratch, free_name, pieces, utf8

_KEEP = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else (c + 32 if 0x41 <= c <= 0x5A else 0x20) for c in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

#: What one automaton holds at most; more items make more blocks, each a pass of its own over the texts.
BLOCK_WORDS = 200_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word ids, with the items in which each window occurs."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[str] = []
        ends: list[list[int]] = []
        for item_id, words in items:
            if not words:
                continue
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            state, path = 0, []
            for c in ids:
                state = self._extend(state, c)
                path.append(state)
            self.items.append(item_id)
            ends.append(path)
        # Whole items shorter than the window: the state that holds the item, and its length.
        self.short: dict[int, dict[int, set[int]]] = {}
        holders: list[set[int]] = [set() for _ in self.next]
        for n, path in enumerate(ends):
            if len(path) < window:
                self.short.setdefault(self._suffix(path[-1], len(path)), {}).setdefault(len(path), set()).add(n)
            else:
                for p in range(window - 1, len(path)):
                    holders[self._suffix(path[p], window)].add(n)
        # A window's state is the one whose lengths span it, so every item that contains the window reaches it.
        self.holders = {s: frozenset(h) for s, h in enumerate(holders) if h}
        self.least = min([window, *(k for lengths in self.short.values() for k in lengths)])
        self.short_chain = self._chains() if self.short else {}

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def _suffix(self, state: int, length: int) -> int:
        """The state of the suffix of ``length`` words of what ``state`` holds."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _chains(self) -> dict[int, list[tuple[int, int]]]:
        """For each state, the short items among its suffixes, as (length, state)."""
        chains: dict[int, list[tuple[int, int]]] = {}
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            got = chains.get(self.link[s], []) + [(k, s) for k in self.short.get(s, ())]
            if got:
                chains[s] = got
        return chains

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """The hit spans (first word, word after the last), merged and ascending, and the items that occur."""
        ids = list(map(self.vocabulary.get, words))
        # A word outside the vocabulary takes the automaton to its root: only longer runs between such words count.
        known = np.fromiter((x is not None for x in ids), np.bool_, len(ids))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= self.least:
                self._run(ids, a, b, spans, found)
        return spans, found

    def _run(self, ids: list, a: int, b: int, spans: list, found: set) -> None:
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for i in range(a, b):
            c = ids[i]
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            state = nxt[state].get(c, 0)
            matched = matched + 1 if state else 0
            best = 0
            if matched >= window:
                s = self._suffix(state, window)
                if s in self.holders:
                    found |= self.holders[s]
                    best = window
            for k, s in self.short_chain.get(state, ()):
                if k <= matched:
                    found |= self.short[s][k]
                    best = max(best, k)
            if best:
                start = i + 1 - best
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))


def _blocks(items: DataFrame, id_column: str, text_column: str, limit: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of at most ``limit`` words (one longer item is a block by itself), read from the
    cluster partition by partition: neither the driver nor a broadcast ever holds more than a block."""
    block: list[tuple[str, list[bytes]]] = []
    held = 0
    for row in items.select(F.col(id_column).cast("string").alias("i"), F.col(text_column).cast("string").alias("t")).filter("i IS NOT NULL AND t IS NOT NULL").toLocalIterator():
        words = words_of(row["t"].encode())
        if block and held + len(words) > limit:
            yield block
            block, held = [], 0
        block.append((row["i"], words))
        held += len(words)
    if block:
        yield block


def _automaton(items, window: int) -> SuffixAutomaton:
    """One automaton for each Python worker and broadcast, built on first use and kept as long as the broadcast."""
    built = getattr(items, "_loomspan", None)
    if built is None or built.window != window:
        built = items._loomspan = SuffixAutomaton(items.value, window)
    return built


def _merge(a: list, b: list) -> list:
    out: list = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])
_HITS_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.string()))])


def find_contamination(docs: DataFrame, items: DataFrame, *, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "contamination", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with one more column, ``out``: a struct of n_words, spans (merged, in words) and items (ids as
    strings, sorted) of what occurs in the document. ``out`` replaces a column of that name.

    One map over the documents, no shuffle, while the items fit one block. Each further block is a pass over the texts
    that writes down only hits, by the text's digest; one block is broadcast at a time. Texts with such hits are joined
    with them; the others do not move.
    """
    spark = docs.sparkSession
    docs = docs.drop(out)
    blocks = _blocks(items, item_id, item_text, block_words)
    found = _pass(docs, spark.sparkContext.broadcast(next(blocks, [])), window, text, out)
    scratch, hits = None, None
    for n, block in enumerate(blocks):
        scratch = scratch or Scratch(spark, "decontaminate")
        shared = spark.sparkContext.broadcast(block)
        saved = scratch.save(_hits(docs, shared, window, text), f"hits-{n}").dropDuplicates(["digest"])
        shared.destroy()
        hits = saved if hits is None else hits.unionByName(saved)
    if hits is None:
        return found
    by_text = hits.groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    by_text = scratch.save(by_text, "hits")  # a row holds what one text can
    key, flag, more = (free_name(found, c) for c in ("_digest", "_maybe", "_more"))
    marked = BitFilter(by_text, "digest").mark(found.withColumn(key, _digest(F.col(text))), key, flag)
    added = by_text.select(F.col("digest").alias(f"{more}_of"), F.struct("spans", "items").alias(more))
    touched = marked.filter(flag).join(added, F.col(key) == F.col(f"{more}_of"), "left").drop(f"{more}_of", key, flag)
    return marked.filter(~F.col(flag)).drop(key, flag).unionByName(_added(touched, more, out))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("string"), 256))


def _struct(n_words: int, spans: list[tuple[int, int]], items: set[str]) -> dict:
    return {"n_words": n_words, "spans": [{"start": s, "stop": e} for s, e in spans], "items": sorted(items)}


def _pass(docs: DataFrame, items, window: int, text: str, out: str) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(items, window)
        for batch in pieces(batches, text):
            rows = []
            for body in utf8(batch.column(text)):
                words = words_of(body or b"")
                spans, ids = automaton.scan(words)
                rows.append(_struct(len(words), spans, {automaton.items[i] for i in ids}))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _HITS_ARROW)], [*batch.schema.names, out])

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField(out, _HITS)]))


def _hits(docs: DataFrame, items, window: int, text: str) -> DataFrame:
    """(digest, spans, items) of the texts in which something occurs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(items, window)
        for batch in pieces(batches, "body"):
            rows = []
            for body in utf8(batch.column("body")):
                spans, ids = automaton.scan(words_of(body or b""))
                if spans:
                    kept = _struct(0, spans, {automaton.items[i] for i in ids})
                    rows.append({"digest": hashlib.sha256(body).digest(), "spans": kept["spans"], "items": kept["items"]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("digest", pa.binary()), *list(_HITS_ARROW)[1:]]))

    kinds = T.StructType([T.StructField("digest", T.BinaryType()), *_HITS.fields[1:]])
    return docs.select(F.col(text).cast("string").alias("body")).mapInArrow(scan, kinds)


def _added(found: DataFrame, more: str, out: str) -> DataFrame:
    """``found`` with what ``more`` has put into ``out``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for old, new in zip(batch.column(out).to_pylist(), batch.column(more).to_pylist()):
                both = [[(s["start"], s["stop"]) for s in x["spans"]] for x in (old, new or {"spans": []})]
                rows.append(_struct(old["n_words"], _merge(*both), {*old["items"], *(new["items"] if new else ())}))
            kept = [c for c in batch.schema.names if c not in (out, more)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(rows, _HITS_ARROW)], [*kept, out])

    fields = [f for f in found.schema.fields if f.name not in (out, more)]
    return found.mapInArrow(add, T.StructType([*fields, T.StructField(out, _HITS)]))


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = 10, max_coverage: float = 0.5, text: str = "text", n_chars: str | None = "n_chars", **options) -> DataFrame:
    """``docs`` without what the items contain: matching spans are cut from the text, and a document is dropped
    when the spans cover more than ``max_coverage`` of its words (1.0: never). Documents without a hit are returned
    as they are. What is left of a cut is searched again until nothing matches, so no window survives across a seam:
    at once where one block holds all items, else in rounds over the documents that were cut.
    ``n_chars``, if the documents have it, follows the new text.
    """
    spark = docs.sparkSession
    out = free_name(docs, "_contamination")
    blocks = _blocks(items, options.get("item_id", "item_id"), options.get("item_text", "text"), options.get("block_words", BLOCK_WORDS))
    only, several = next(blocks, []), next(blocks, None) is not None
    find = lambda df: find_contamination(df, items, window=window, text=text, out=out, **options)
    covered = F.expr(f"aggregate(`{out}`.spans, 0L, (a, s) -> a + s.stop - s.start)") <= F.col(f"{out}.n_words") * max_coverage
    clean = F.size(f"{out}.spans") == 0
    if not several:
        return _kept_and_cut(docs, spark.sparkContext.broadcast(only), window, max_coverage, text, n_chars)
    scratch = Scratch(spark, "decontaminate-rounds")
    done, left, n = None, docs, 0
    while done is None or not left.isEmpty():
        found = scratch.save(find(left).filter(clean | covered) if done is None else find(left), f"found-{n}")
        fine = found.filter(clean).select(*docs.columns)
        done = fine if done is None else done.unionByName(fine)
        left, n = scratch.save(_cut_texts(found.filter(~clean), docs.schema, out, text, n_chars), f"left-{n}"), n + 1
    return done


def _with_texts(batch: pa.RecordBatch, names: list[str], new: dict[int, str], text: str, n_chars: str | None) -> pa.RecordBatch:
    """The columns ``names`` of a batch, with new texts for some rows."""
    columns = {c: batch.column(c) for c in names}
    if new:
        texts = columns[text].to_pylist()
        sizes = columns[n_chars].to_pylist() if n_chars in columns else []
        for i, t in new.items():
            texts[i] = t
            if sizes:
                sizes[i] = len(t)
        columns[text] = pa.array(texts, columns[text].type)
        if sizes:
            columns[n_chars] = pa.array(sizes, columns[n_chars].type)
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _kept_and_cut(docs: DataFrame, items, window: int, max_coverage: float, text: str, n_chars: str | None) -> DataFrame:
    """One map: a text is scanned, kept, dropped or cut until none of the block's items match."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _automaton(items, window).scan
        for batch in pieces(batches, text):
            keep, new = [], {}
            for i, body in enumerate(utf8(batch.column(text))):
                words = words_of(body or b"")
                spans, _ = scan(words)
                keep.append(sum(b - a for a, b in spans) <= len(words) * max_coverage or not spans)
                if spans and keep[-1]:
                    new[i] = _without(body, spans, scan).decode("utf-8", "replace")
            out = _with_texts(batch, names, new, text, n_chars)
            yield out if all(keep) else out.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def _cut_texts(found: DataFrame, schema: T.StructType, out: str, text: str, n_chars: str | None) -> DataFrame:
    """``found`` with its spans cut from its texts, once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            spans = [[(s["start"], s["stop"]) for s in x["spans"]] for x in batch.column(out).to_pylist()]
            new = {i: _without(t, s, None).decode("utf-8", "replace") for i, (t, s) in enumerate(zip(utf8(batch.column(text)), spans)) if s}
            yield _with_texts(batch, schema.names, new, text, n_chars)

    return found.mapInArrow(cut, schema)


def _without(text: bytes, spans: list[tuple[int, int]], again) -> bytes:
    while spans:
        at = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        parts, last = [], 0
        for s, e in spans:
            parts.append(text[last : at[s][0]].rstrip(b" "))
            last = at[e - 1][1]
        parts.append(text[last:])
        text = b" ".join(p for p in parts if p)
        spans = again(words_of(text))[0] if again else []
    return text


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item, windows of ten words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    c = F.col("contamination")
    return find_contamination(docs, items).select(
        "doc_id",
        c["n_words"].alias("n_words"),
        F.expr("aggregate(contamination.spans, 0L, (a, s) -> a + s.stop - s.start)").alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"),
        (F.size(c["spans"]) > 0).alias("contaminated"),
    )


#: DuckDB's version of op1: windows as strings, joined with those of the items.
OP1_SQL = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
iwin AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM item WHERE len(w) > 0)),
doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
size AS (SELECT DISTINCT k FROM iwin),
dwin AS (
  SELECT doc_id, k, p, array_to_string(list_slice(w, p, p + k - 1), ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k + 1, 0) + 1)) AS p FROM doc, size)),
hit AS (SELECT d.doc_id, d.p, d.k, i.item_id FROM dwin d JOIN iwin i ON d.win = i.win AND d.k = i.k),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS x FROM hit) GROUP BY doc_id),
names AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(x.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(x.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN words x ON d.doc_id = x.doc_id LEFT JOIN names n ON d.doc_id = n.doc_id
"""

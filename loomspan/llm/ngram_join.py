"""N-gram Jaccard self-join by PartEnum signatures, and its classes.

A document is the set of its distinct word shingles. Sets of sizes within one band meet in that band's scheme; a set
also enters the next band's scheme when a partner there is possible. Two sets with Jaccard similarity ``t`` or more and
at most ``r`` elements differ in at most ``k = floor(2r (1 - t) / (1 + t))`` elements. The element domain is cut (by
hash) into ``n1`` parts; a part with at most ``k2`` differences is good, and ``n1 - k // (k2 + 1)`` parts are. Each
part is cut into ``n2`` pieces, and every choice of ``n2 - k2`` pieces of every part, hashed with its place and band,
is a signature: in a good part one choice holds no difference, so sets that are similar enough share a signature, by
counting alone.

``n1`` leaves ``slack`` good parts more than the one that is needed. A set may therefore keep back its *weak*
signatures, those of empty choices and those that very many sets share, as long as they lie in at most ``slack`` parts
of a scheme: a pair's shared signature is weak for both or for neither, so one that is not weak remains. Sets with more
weak parts send them all. So nothing is lost, and no bucket fills with sets that merely lack the same elements or share
a common passage.

From signatures to classes without pairs of all in a bucket:

1. Sets that are equal are one class at once; its smallest id stands for it.
2. Star rounds: in each bucket every member is held against the bucket's smallest id, one row each. Pairs whose count
   sketches (elements by hash bucket) differ by more than two similar sets can are out: first by the sketches folded to
   ``ROUGH`` bytes, which go with every pair, then by whole ones, which move for what is left. The others are verified on
   the whole sets. Verified links join up (see ``components``). A round settles all pairs of its centers, so they leave
   their buckets; buckets of which one component is left are done, the others have a second round.
3. Of buckets that still hold several components, members whose sketch is near no member of another component leave.
   What is left is settled inside: members of different components are compared by
   blocked matrix products of their element incidence, in units of bounded size, and only a spanning forest of the
   links found comes out. Buckets with members in common are settled as one group, unless it is large. No link that
   connects is lost; links within a component change nothing.

Elements are 64-bit hashes of shingles; an element is taken for equal when its hash is.

Defined cases
  null and empty texts, and texts without words: size 0, linked with nothing, a component each; fewer words than a
  shingle: the whole sequence is the one element; repeated rows: a result row each; an id with different texts: each row has its own
  size, the largest set is the one whose links count; null ids: a row each, in a component of their own (null); ties: the smallest
  id stands for a class; very long texts: their sets whole, in memory that follows the text; empty table: empty result; extra
  columns: pass through ``keep_one``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import exp, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import BitFilter, Scratch, join_unique, pieces, utf8, without_ids
from .components import components

#: Elements and members of one unit of step 3: what one task holds at a time.
UNIT_ELEMENTS, UNIT_MEMBERS = 1 << 21, 2048
#: A signature that more rows than this share is weak (see above).
HOT_ROWS = 256
#: Buckets with more members than this go to step 3 whole: their sketches are not compared.
SKETCHED_MEMBERS = 512
#: Bytes of a folded sketch.
ROUGH = 64
#: A group of buckets with more members than this is settled bucket by bucket in step 3.
GROUP_MEMBERS = 16 * UNIT_MEMBERS
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M3
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the ``n``-word shingles; A-Z in lower case, words without ASCII white space."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, np.uint64(width))
    for i in range(width):
        out = _mix(out * _M1 + h[i : len(h) - width + 1 + i])
    return np.unique(out)


@lru_cache(maxsize=None)
def band_of(size: int, percent: int) -> tuple[int, int, int]:
    """(band, its smallest size, its largest size): bands widen by 1 / t."""
    band, low = 0, 1
    while True:
        high = max(low, low * 100 // percent)
        if size <= high:
            return band, low, high
        band, low = band + 1, high + 1


@lru_cache(maxsize=None)
def scheme_of(band: int, low: int, high: int, percent: int) -> tuple[int, int, tuple[tuple[int, ...], ...], int, int]:
    """(n1, n2, choices of pieces, slack, seed) of a band's scheme.

    Few differences: one part, cut fine enough that some choice is free of them. More: parts of one piece, or of three
    with one difference allowed where similarity is high and parts are large; the slack covers the empty choices that
    sets of the band's smallest size are to be expected to have, and three standard deviations.
    """
    k = (100 - percent) * 2 * high // (100 + percent)
    seed = xxhash.xxh64_intdigest(f"band {band} of {percent}")
    if k <= 3:
        n2 = (1, 3, 5, 6)[k]
        return 1, n2, tuple(combinations(range(n2), n2 - k)), 0, seed
    k2, n2 = (1, 3) if percent >= 90 else (0, 1)
    choices = tuple(combinations(range(n2), n2 - k2))
    base, slack = k // (k2 + 1) + 1, 0
    while slack < base:
        n1 = base + slack
        weak = n1 * min(1.0, len(choices) * exp(-low * len(choices[0]) / n2 / n1))
        if slack >= weak + 3 * sqrt(weak):
            break
        slack += 1
    return base + slack, n2, choices, slack, seed


def signatures(elements: np.ndarray, percent: int) -> list[tuple[int, int, np.ndarray]]:
    """(band, slack left, signatures) of a set: in its own band's scheme, and the next one's if larger partners may be
    there. Empty choices are kept back where the slack allows."""
    size = len(elements)
    if not size:
        return []
    own = band_of(size, percent)
    schemes = [own]
    if size * 100 >= percent * (own[2] + 1):
        schemes.append(band_of(own[2] + 1, percent))
    placed = _mix(elements ^ _M1)
    out = []
    for band, low, high in schemes:
        n1, n2, choices, slack, seed = scheme_of(band, low, high, percent)
        salt = np.uint64(seed)
        place = (_mix(placed ^ salt) % np.uint64(n1 * n2)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        edges = np.searchsorted(place[order], np.arange(n1 * n2 + 1))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(elements[order] + salt), dtype=np.uint64)))
        piece = (sums[edges[1:]] - sums[edges[:-1]]).reshape(n1, n2)
        count = np.diff(edges).reshape(n1, n2)
        where = np.arange(n1, dtype=np.uint64) * np.uint64(len(choices))
        sigs, empty = [], []
        for c, chosen in enumerate(choices):
            mixed = np.full(n1, salt)
            for j in chosen:
                mixed = _mix(mixed * _M1 + piece[:, j])
            sigs.append(_mix(mixed + where + np.uint64(c)))
            empty.append(count[:, chosen].sum(axis=1) == 0)
        weak = np.array(empty)
        lost = int(weak.any(axis=0).sum())
        every = np.array(sigs)
        out.append((band, slack - lost, every[~weak]) if lost <= slack else (band, -1, every.ravel()))
    return out


def count_sketch(elements: np.ndarray) -> bytes:
    """How many elements have each value of their lowest bits, about one each, at most 255."""
    m = min(1024, max(64, 1 << (max(len(elements), 1) - 1).bit_length()))
    return np.minimum(np.bincount((elements & np.uint64(m - 1)).astype(np.int64), minlength=m), 255).astype(np.uint8).tobytes()


def folded(counts: np.ndarray, width: int) -> np.ndarray:
    """A sketch as one of ``width`` values: no two are further apart than the sketches they come from."""
    return np.minimum(counts.reshape(-1, width).sum(axis=0, dtype=np.int64), 255)


def may_be_similar(a: bytes, na: int, b: bytes, nb: int, percent: int) -> bool:
    """False only if the sketches alone show more differences than similar sets of these sizes have."""
    if min(na, nb) * 100 < percent * max(na, nb):
        return False
    m = min(len(a), len(b))
    x, y = (folded(np.frombuffer(v, np.uint8), m) for v in (a, b))
    return int(np.abs(x - y).sum()) <= (100 - percent) * (na + nb) // (100 + percent)


def _as_set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * 100 >= percent * (len(a) + len(b) - both)


_SKETCH = "id long, n long, key binary, counts binary, schemes array<struct<band: int, slack: int, sigs: array<long>>>"
_SKETCH_ARROW = pa.list_(pa.struct([("band", pa.int32()), ("slack", pa.int32()), ("sigs", pa.list_(pa.int64()))]))


def _sketches(docs: DataFrame, id_column: str, text: str, n: int, percent: int) -> DataFrame:
    """A row for each row: the set's size, a 128-bit digest of the set, its signatures by scheme."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "body"):
            sizes, keys, counts, bands, slacks, sigs, inner, outer = [], [], [], [], [], [np.zeros(0, np.int64)], [0], [0]
            for t in utf8(batch.column("body")):
                s = shingle_set(t, n)
                sizes.append(len(s))
                keys.append(xxhash.xxh128_digest(s.tobytes()))
                counts.append(count_sketch(s))
                for band, slack, found in signatures(s, percent):
                    bands.append(band)
                    slacks.append(slack)
                    sigs.append(found.view(np.int64))
                    inner.append(inner[-1] + len(found))
                outer.append(len(bands))
            lists = pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(np.concatenate(sigs)))
            schemes = pa.StructArray.from_arrays([pa.array(bands, pa.int32()), pa.array(slacks, pa.int32()), lists], fields=list(_SKETCH_ARROW.value_type))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary()), pa.ListArray.from_arrays(pa.array(outer, pa.int32()), schemes)], ["id", "n", "key", "counts", "schemes"])

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("body")).mapInArrow(run, _SKETCH)


def _sets(docs: DataFrame, wanted: DataFrame, id_column: str, text: str, n: int) -> DataFrame:
    """(id, elements) of the documents with an id in ``wanted``; the text of no other document moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "body"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([shingle_set(t, n).tobytes() for t in utf8(batch.column("body"))], pa.binary())], ["id", "elements"])

    body = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("body"))
    near = BitFilter(wanted, "id").keep(body, "id").select("id", "body")
    return near.mapInArrow(run, "id long, elements binary").groupBy("id").agg(F.max(F.struct(F.octet_length("elements"), "elements")).getField("elements").alias("elements"))


def _kept_pairs(pairs: DataFrame, facts: DataFrame, columns: list[str], test) -> DataFrame:
    """The (a, b) for which ``test(a's columns, b's columns)`` holds; ``facts`` has them by id."""
    side = lambda end: facts.select(F.col("id").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in columns))
    wide = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", *(f"{end}_{c}" for end in "ab" for c in columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, f"a_{columns[0]}", rows=256):
            values = [batch.column(f"{end}_{c}").to_pylist() for end in "ab" for c in columns]
            yield batch.select(["a", "b"]).filter(pa.array([test(*row) for row in zip(*values)], pa.bool_()))

    return wide.mapInArrow(run, "a long, b long")


def _with_rough(sketches: DataFrame) -> DataFrame:
    """``sketches`` (id, n, counts) with ``rough``, the sketch folded to ``ROUGH`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rough = [folded(np.frombuffer(x, np.uint8), ROUGH).astype(np.uint8).tobytes() for x in batch.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rough, pa.binary())], [*batch.schema.names, "rough"])

    return sketches.mapInArrow(run, "id long, n long, counts binary, rough binary")


def _star_round(live: DataFrame, sketches: DataFrame, docs: DataFrame, scratch: Scratch, name: str, id_column: str, text: str, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links of each bucket's smallest id, and what is left of the buckets. ``live``: (sig, id, ...)."""
    centers = scratch.save(live.groupBy("sig").agg(F.min("id").alias("c"), F.count(F.lit(1)).alias("m")).filter("m > 1"), f"{name}-centers")
    placed = live.join(centers, "sig").filter("c <> id")
    pairs = placed.select(F.col("c").alias("a"), F.col("id").alias("b")).distinct()
    alike = lambda x, nx, y, ny: may_be_similar(x, nx, y, ny, percent)
    ends = lambda of: of.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    rough = scratch.save(_kept_pairs(pairs, sketches, ["rough", "n"], alike), f"{name}-rough")
    near = scratch.save(_kept_pairs(rough, BitFilter(ends(rough), "id").keep(sketches, "id"), ["counts", "n"], alike), f"{name}-near")
    wanted = ends(near)
    sets = scratch.save(_sets(docs, wanted, id_column, text, n), f"{name}-sets")
    links = scratch.save(_kept_pairs(near, sets, ["elements"], lambda x, y: similar(_as_set(x), _as_set(y), percent)), f"{name}-links")
    scratch.drop(f"{name}-sets", f"{name}-rough")
    return links, placed.filter("m > 2").drop("c", "m")


def _settle(ids: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between members with different labels."""
    m = len(ids)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    _, column, df = np.unique(flat, return_inverse=True, return_counts=True)
    shared = df[column] > 1  # an element of one member is in no intersection
    column, owner = column[shared], owner[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((m, m), np.float32)
    width = max(64, (16 << 20) // (4 * m))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        block = np.zeros((m, width), np.float32)
        block[owner[a:b], column[a:b] - at] = 1.0
        both += block @ block.T
    shared = both.astype(np.int64)  # counts under 2**24, exact so far
    links = shared * 100 >= percent * (sizes[:, None] + sizes[None, :] - shared)
    root = {int(x): int(x) for x in np.unique(labels)}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(links & (labels[:, None] != labels[None, :]), 1)))):
        x, y = find(int(labels[i])), find(int(labels[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(ids[i]), int(ids[j])))
    return out


def _undecided(buckets: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The rows of ``buckets`` (sig, id, n, label) whose sketch allows a link to another component in their bucket, and
    all rows of buckets with more than ``SKETCHED_MEMBERS``, which hold near copies."""
    members = buckets.groupBy("sig").agg(F.count(F.lit(1)).alias("m"))
    sized = buckets.join(members, "sig")
    small = sized.filter(F.col("m") <= SKETCHED_MEMBERS).drop("m").join(sketches.select("id", "counts"), "id")

    def run(table: pa.Table) -> pa.Table:
        n, label = table.column("n").to_numpy(), table.column("label").to_numpy()
        raw = [np.frombuffer(x, np.uint8) for x in table.column("counts").to_pylist()]
        width = min(map(len, raw))
        counts = np.array([folded(x, width) for x in raw], np.int16)
        near = np.zeros(len(raw), bool)
        for i in range(len(raw) - 1):
            rest = slice(i + 1, None)
            ok = (label[rest] != label[i]) & (np.minimum(n[rest], n[i]) * 100 >= percent * np.maximum(n[rest], n[i]))
            if ok.any():
                ok[ok] = np.abs(counts[rest][ok] - counts[i]).sum(axis=1, dtype=np.int64) <= (100 - percent) * (n[rest][ok] + n[i]) // (100 + percent)
                near[rest] |= ok
                near[i] |= ok.any()
        return table.select(["sig", "id", "n", "label"]).filter(pa.array(near))

    found = small.select("sig", "id", "n", "label", "counts").groupBy("sig").applyInArrow(run, "sig long, id long, n long, label long")
    return found.unionByName(sized.filter(F.col("m") > SKETCHED_MEMBERS).select("sig", "id", "n", "label"))


def _settled(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside unresolved buckets. ``buckets``: (sig, id, label, n).

    A bucket is dealt into chunks by id so that a unit, two chunks of a bucket (or one, with itself), holds about
    ``UNIT_MEMBERS`` members and ``UNIT_ELEMENTS`` elements whatever the bucket's size.
    """
    total = buckets.groupBy("sig").agg(F.sum("n").alias("elements"), F.count(F.lit(1)).alias("members"))
    chunks = F.ceil(F.greatest(F.col("elements") * 2 / UNIT_ELEMENTS, F.col("members") * 2 / UNIT_MEMBERS)).cast("int")
    one = F.when((F.col("elements") <= UNIT_ELEMENTS) & (F.col("members") <= UNIT_MEMBERS), 1).otherwise(F.greatest(chunks, F.lit(2)))
    dealt = buckets.join(total, "sig").withColumn("chunks", one).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    partners = F.sequence(F.lit(0), F.col("chunks") - 1)
    units = dealt.select("sig", "id", "label", "chunk", F.explode(partners).alias("other")).select("sig", "id", "label", F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2"))
    full = units.join(sets, "id").select("sig", "c1", "c2", "id", "label", "elements")

    def run(table: pa.Table) -> pa.Table:
        ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
        found = _settle(ids, labels, [_as_set(x) for x in table.column("elements").to_pylist()], percent) if len(np.unique(labels)) > 1 else []
        return pa.table({"a": pa.array([min(x) for x in found], pa.int64()), "b": pa.array([max(x) for x in found], pa.int64())})

    return full.groupBy("sig", "c1", "c2").applyInArrow(run, "a long, b long").distinct()


def _open(buckets: DataFrame, label: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The buckets that hold several components, with each member's."""
    labelled = scratch.save(buckets.join(label, "id", "left").select("sig", "id", "n", F.coalesce("component", "id").alias("label")), f"{name}-all")
    several = scratch.save(labelled.groupBy("sig").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 <> l1").select("sig"), f"{name}-sigs")
    return scratch.save(labelled.join(several, "sig"), name)


def similarity_classes(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """(id, n_shingles, component_id) for each row: the set's size and the smallest id reachable by links of
    Jaccard similarity ``percent`` / 100 or more."""
    scratch = scratch or Scratch(docs.sparkSession, "ngrams")
    rows = scratch.save(_sketches(docs, id_column, text, n, percent), "sketches")
    known = rows.filter("n > 0 AND id IS NOT NULL")
    # Equal sets: one class, of which the smallest id stands for all.
    classes = scratch.save(known.groupBy("key").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.count(F.lit(1)).alias("rows")), "classes")
    member = scratch.save(join_unique(known.select("id", "key"), classes, ["key"], "rows").groupBy("id", "rep").agg(F.max("n").alias("n")), "members")
    copies = member.groupBy("id").agg(F.bool_and(F.col("id") != F.col("rep")).alias("copy")).filter("copy").select("id")
    copies = scratch.save(copies, "copies")
    # Buckets with two sets or more; signatures that only one set has go before they are shuffled again.
    schemes = without_ids(known.select("id", "n", "schemes"), copies, "id").select("id", "n", F.explode("schemes").alias("s")).select("id", "n", "s.band", "s.slack", F.explode("s.sigs").alias("sig"))
    several = scratch.save(schemes.groupBy("sig").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "several")
    inside = BitFilter(several, "sig", 20).keep(schemes, "sig").join(several, "sig")
    inside = scratch.save(inside.groupBy("sig", "id").agg(F.max("n").alias("n"), F.max("rows").alias("rows"), F.min("band").alias("band"), F.min("slack").alias("slack")), "inside")
    # Hot signatures are kept back by the sets whose slack covers all of theirs in the scheme.
    hot = inside.filter(F.col("rows") > HOT_ROWS)
    spared = hot.groupBy("id", "band").agg(F.count(F.lit(1)).alias("weak"), F.min("slack").alias("left")).filter("weak <= left").select("id", "band")
    kept = hot.join(spared, ["id", "band"], "left_anti").select("sig", "id", "n")
    buckets = scratch.save(inside.filter(F.col("rows") <= HOT_ROWS).select("sig", "id", "n").unionByName(kept), "buckets")
    scratch.drop("inside", "several", "copies")
    near = BitFilter(buckets.select("id"), "id").keep(known.select("id", "n", "counts"), "id")
    sketches = scratch.save(_with_rough(near.groupBy("id").agg(F.max(F.struct("n", "counts")).alias("s")).select("id", "s.n", "s.counts")), "counts")
    sizes = scratch.save(rows.select("id", "n"), "sizes")
    scratch.drop("sketches")
    same_id = member.select(F.col("id").alias("a"), F.col("rep").alias("b")).filter("a <> b")
    args = (sketches, docs, scratch)
    links, rest = _star_round(buckets, *args, "star-1", id_column, text, n, percent)
    label = scratch.save(components(links, scratch, "first"), "labels-1")
    more, rest = _star_round(_open(rest, label, scratch, "open-1"), *args, "star-2", id_column, text, n, percent)
    links = scratch.save(links.unionByName(more), "links")
    label = scratch.save(components(links, scratch, "second"), "labels-2")
    members = scratch.save(_undecided(_open(rest.drop("label"), label, scratch, "open-2"), sketches, percent), "undecided")
    scratch.drop("buckets", "counts", "open-1", "open-1-all", "open-2-all", "star-1-near", "star-2-near", "star-1-centers")
    centers = members.groupBy("sig").agg(F.min("id").alias("c"))
    members = scratch.save(members.join(centers, "sig"), "centered")
    sets = scratch.save(_sets(docs, members.select("id").distinct(), id_column, text, n), "sets")
    # The same sets meet in many buckets: each is sent once to the group of buckets that hang together. A group too
    # large for that is settled bucket by bucket.
    groups = components(members.select(F.col("c").alias("a"), F.col("id").alias("b")).distinct(), scratch, "groups")
    grouped = scratch.save(members.join(groups, "id").select("sig", "component", "id", "n", "label"), "grouped")
    wide = scratch.save(grouped.groupBy("component").agg(F.count_distinct("id").alias("size")).filter(F.col("size") > GROUP_MEMBERS).select("component"), "wide")
    whole = grouped.join(wide, "component", "left_anti").select(F.col("component").alias("sig"), "id", "n", "label").distinct()
    apart = grouped.join(wide, "component", "left_semi").select("sig", "id", "n", "label")
    more = scratch.save(_settled(whole, sets, percent).unionByName(_settled(apart, sets, percent)), "more")
    final = scratch.save(components(links.unionByName(more).unionByName(same_id), scratch, "final"), "labels-3")
    scratch.drop("sets", "grouped", "centered")
    out = sizes.select("id", F.col("n").alias("n_shingles")).join(final, "id", "left")
    return out.select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame, *, id_column: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each class: that with the smallest id. Null ids stay."""
    scratch = Scratch(docs.sparkSession, "keep-one")
    found = scratch.save(similarity_classes(docs, id_column=id_column, **options), "classes")
    gone = scratch.save(found.filter("component_id <> id").select("id").distinct(), "gone")
    return without_ids(docs, gone, id_column)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similarity_classes(docs, n=3, percent=90).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")

"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single pass.

The automaton reads a text once. At each position its output links give every piece that ends there, longer ones first.

* Unigram models: Viterbi. Each piece relaxes the best score of the position, ties staying with what came first. A
  character that is no piece can be passed as unknown, at the lowest piece score less 10.
* BPE models (as the public one on this machine is): scores there are merge ranks, and the best sum of ranks is not
  what merging gives. The pass keeps for each position, in place of the best sum, the one last piece that merging the
  text so far ends in: the piece before it and it must merge to just these two. Ids are the library's own.

Unknown characters become their UTF-8 bytes' pieces (byte fallback) or the unknown piece. Pieces never cross from other
characters to the space mark, so texts are cut there into words; each distinct word of a stretch of texts is encoded once,
and all of them take each step of the pass together, as arrays. For a vocabulary with pieces that do cross, texts stay whole.

Defined cases
  null text: null ids, and null text back; empty text: no ids; the space mark itself (U+2581) comes back as a space, as in
  the library; runs of space marks, whose pieces tie in score: merged directly; other ties: what came first, the longer
  piece; repeated rows: each encoded; very long texts: whole, in stretches cut between words, and long words by
  themselves; empty table: empty result; extra columns pass through, ``out`` replaces a column of that name.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat
from operator import contains

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import pieces

#: Fixed value: SentencePiece's mark for a space.
MARK = "▁"
MODEL_PATH, MAX_PIECES = "/opt/tokenizers/piece_bpe_32k.model", 1_000_000
#: What is worked on at a time: bytes of a batch of texts, characters of a long text, words, and word positions of one
#: pass. Words of more than ``LONG`` characters have a pass of their own.
BATCH, STRETCH, WORDS, CELLS, LONG = 2 << 20, 1 << 19, 1 << 18, 1 << 19, 256


@dataclass
class PieceModel:
    """What a model file says: texts, scores and kinds by id. At most ``MAX_PIECES`` pieces are broadcast."""

    texts: list[str]
    scores: list[float]
    bytes_: dict[int, int]
    unknown: int
    special: frozenset[int]
    dummy_prefix: bool = True
    bpe: bool = False
    byte_ids: list[int] = field(default_factory=list)

    @staticmethod
    def load(path: str = MODEL_PATH) -> PieceModel:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        if n > MAX_PIECES:
            raise ValueError(f"{n} pieces are more than may be broadcast")
        texts = [sp.id_to_piece(i) for i in range(n)]
        values = {i: int(texts[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        ids = [0] * 256 if len(values) == 256 else []
        for i, b in values.items() if ids else ():
            ids[b] = i
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(sp.serialized_model_proto())
        special = frozenset(i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
        return PieceModel(texts, [sp.get_score(i) for i in range(n)], values, sp.unk_id(), special, proto.normalizer_spec.add_dummy_prefix, proto.trainer_spec.model_type == proto.trainer_spec.BPE, ids)


class PieceAutomaton:
    """Aho-Corasick over the pieces in arrays, so that a batch of words takes each step at once.

    ``first``: the node of the longest piece that ends where a node stands (0: none); ``rest``: the next shorter one, by
    the output links.
    """

    def __init__(self, pieces_by_text: dict[str, int]):
        edges: dict[int, int] = {}
        depth, parent, char, piece = [0], [0], [0], [-1]
        for text, i in pieces_by_text.items():
            node = 0
            for c in map(ord, text):
                key = node << 21 | c
                child = edges.get(key)
                if child is None:
                    child = edges[key] = len(depth)
                    depth.append(depth[node] + 1)
                    parent.append(node)
                    char.append(c)
                    piece.append(-1)
                node = child
            piece[node] = i
        fail, first = [0] * len(depth), [0] * len(depth)
        for node in sorted(range(1, len(depth)), key=depth.__getitem__):
            if depth[node] > 1:
                back = fail[parent[node]]
                while back and (back << 21 | char[node]) not in edges:
                    back = fail[back]
                fail[node] = edges.get(back << 21 | char[node], 0)
            first[node] = node if piece[node] >= 0 else first[fail[node]]
        keys = np.fromiter(edges, np.int64, len(edges))
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.fail, self.first = np.array(fail), np.array(first)
        self.rest, self.depth, self.piece = self.first[self.fail], np.array(depth), np.array(piece)

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Where each state goes on its character, by failure links where it has no edge."""
        state, out, todo = state.copy(), np.zeros_like(state), np.arange(len(state))
        while len(todo):
            want = state[todo] << 21 | char[todo]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            hit = self.keys[at] == want
            out[todo[hit]] = self.to[at[hit]]
            todo = todo[~hit]
            todo = todo[state[todo] > 0]
            state[todo] = self.fail[state[todo]]
        return out


class MergeOrder:
    """Whether merging the characters of two pieces ends in just these two.

    It does unless some merge crosses from the first to the second on the way. Only what stands at the seam can cross: the
    nodes ``x`` down the right edge of the first piece's merge tree and ``y`` down the left edge of the second's. ``made``
    says when a node comes to be, by score; ``x`` and ``y`` cross if their joint piece is due before either is taken up
    by its parent. Equal times, and trees deeper than ``DEPTH``, are left to the merge rule itself.
    """

    DEPTH = 12

    def __init__(self, encoder: Encoder):
        texts, ids, n = encoder.model.texts, encoder.ids, len(encoder.model.texts)
        self.n, self.encoder = n, encoder
        due = -np.array(encoder.model.scores)
        self.made = np.full(n, -np.inf)
        self.alone, self.deep = np.zeros(n, np.bool_), np.zeros(n, np.bool_)
        halves = np.full((n, 2), -1, np.int64)
        keys, times = [], []
        for text, i in sorted(ids.items(), key=lambda x: len(x[0])):
            for k in range(1, len(text)):
                if (a := ids.get(text[:k])) is not None and (b := ids.get(text[k:])) is not None:
                    keys.append(a * n + b)
                    times.append(due[i])
            if len(text) == 1:
                self.alone[i] = True
                continue
            parts, last = encoder.merge(text), encoder.last
            self.alone[i] = len(parts) == 1
            if self.alone[i]:
                a, b = (ids.get(x, -1) for x in last)
                halves[i] = a, b
                self.deep[i] = a < 0 or b < 0
                self.made[i] = max(due[i], *(self.made[x] for x in (a, b) if x >= 0))
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.times = np.array([*keys, -1], np.int64)[[*order, -1]], np.array([*times, np.inf])[[*order, -1]]
        self.keys[-1] = np.iinfo(np.int64).max
        #: Nodes down the edges, and when each is taken up.
        self.edges = []
        for side in (1, 0):
            nodes, until = [np.arange(n)], [np.full(n, np.inf)]
            while (nodes[-1] >= 0).any() and len(nodes) <= self.DEPTH:
                above = nodes[-1]
                nodes.append(np.where(above >= 0, halves[above, side], -1))
                until.append(np.where(above >= 0, self.made[above], -np.inf))
            self.deep |= nodes[-1] >= 0
            self.edges.append((nodes, until))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        cross, unsure = np.zeros(len(a), np.bool_), self.deep[a] | self.deep[b]
        for xs, x_until in zip(*self.edges[0]):
            x = xs[a]
            if not (x >= 0).any():
                break
            for ys, y_until in zip(*self.edges[1]):
                y = ys[b]
                at = np.flatnonzero((x >= 0) & (y >= 0) & ~cross)
                if not len(at):
                    break
                want = x[at] * self.n + y[at]
                place = np.searchsorted(self.keys, want)
                hit = self.keys[place] == want
                at, place = at[hit], place[hit]
                due = np.maximum(self.times[place], np.maximum(self.made[x[at]], self.made[y[at]]))
                limit = np.minimum(x_until[a[at]], y_until[b[at]])
                cross[at[due < limit]] = True
                unsure[at[due == limit]] = True
        out = self.alone[a] & self.alone[b] & ~cross
        texts = self.encoder.model.texts
        for k in np.flatnonzero(unsure & out).tolist():
            i, j = texts[a[k]], texts[b[k]]
            out[k] = self.encoder.merge(i + j) == [i, j]
        return out


class PairCache:
    """Which pieces may follow which, in a table of fixed size; what a slot held before is computed again when asked for."""

    def __init__(self, compute, n: int, log2: int = 20):
        self.compute, self.n, self.shift = compute, n, np.uint64(64 - log2)
        self.keys, self.values = np.full(1 << log2, -1, np.int64), np.zeros(1 << log2, np.bool_)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.n + b
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
        out, new = self.values[slot], self.keys[slot] != key
        if new.any():
            fresh, where = np.unique(key[new], return_inverse=True)
            found = self.compute(fresh // self.n, fresh % self.n)
            out[new] = found[where]
            slot = (fresh.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
            self.keys[slot], self.values[slot] = fresh, found
        return out


class Encoder:
    """The encoder of one worker."""

    def __init__(self, model: PieceModel):
        self.model = model
        usable = [i for i in range(len(model.texts)) if i not in model.special and i not in model.bytes_]
        self.ids: dict[str, int] = {model.texts[i]: i for i in usable}
        self.automaton = PieceAutomaton(self.ids)
        self.scanner: ahocorasick.Automaton | None = None
        self.single = np.zeros(0x110000, np.bool_)
        self.single[[ord(t) for t in self.ids if len(t) == 1]] = True
        self.scores, self.sizes = np.array(model.scores), np.array([len(t) for t in model.texts])
        self.unknown_score = min((model.scores[i] for i in usable), default=0.0) - 10.0
        crossing = any(MARK in model.texts[i].lstrip(MARK) for i in usable)
        breaks = "" if any("\n" in model.texts[i] for i in usable) else "\n"
        self.cut = re.compile(".+", re.S) if crossing else re.compile(f"{MARK}*[^{MARK}{breaks}]+|{MARK}+" + ("|\n" if breaks else ""))
        self.seam = None if crossing else re.compile(f"(?<=[^{MARK}]){MARK}")
        self.last = ("", "")  # the last merge of ``merge``
        if model.bpe:
            self.order = MergeOrder(self)
            self.follows = PairCache(self.order, len(model.texts))

    def merge(self, s: str) -> list[str]:
        """``s`` in pieces by the merge rule itself: the best-scored pair first, the left one of equals."""
        parts: list[str | None] = list(s)
        before, after = list(range(-1, len(s) - 1)), [*range(1, len(s)), -1]
        queue: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (i := self.ids.get(both := parts[a] + parts[b])) is not None:
                heapq.heappush(queue, (-self.model.scores[i], a, b, both))

        for k in range(len(s) - 1):
            offer(k, k + 1)
        while queue:
            _, a, b, both = heapq.heappop(queue)
            if parts[a] is None or parts[b] is None or after[a] != b or parts[a] + parts[b] != both:
                continue
            self.last = (parts[a], parts[b])
            parts[a], parts[b] = both, None
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in parts if p is not None]

    def scanned(self, s: str) -> Iterator[tuple[int, tuple[int, float, int]]]:
        """(place of the last character, (size, score, id)) of the pieces in one word, shorter ends first, longer pieces first."""
        if self.scanner is None:
            self.scanner = ahocorasick.Automaton()
            for text, i in self.ids.items():
                self.scanner.add_word(text, (len(text), self.model.scores[i], i))
            self.scanner.make_automaton()
        return self.scanner.iter(s)

    def best(self, s: str) -> array:
        """The ids of the best path through one word, position by position: for words too long to be worked on with others."""
        n = len(s)
        score, last = [0.0] + [float("-inf")] * n, [(-2, 1)] * (n + 1)
        closed = 0  # positions up to here have all their pieces and their unknown edge

        def close(to: int) -> int:
            for p in range(closed + 1, to + 1):
                if not self.single[ord(s[p - 1])] and score[p - 1] + self.unknown_score > score[p]:
                    score[p], last[p] = score[p - 1] + self.unknown_score, (-1, 1)
            return to

        for end, (size, value, i) in self.scanned(s):
            if closed < end:
                closed = close(end)
            at = score[end + 1 - size] + value
            if at > score[end + 1]:
                score[end + 1], last[end + 1] = at, (i, size)
        close(n)
        return self._by_hand(s, last)

    def merged(self, s: str) -> array:
        """The ids of one long word under the merge rule, in one pass."""
        n = len(s)
        last = [(-1, 1)] + [(-2, 1)] * n
        closed = 0

        def close(to: int) -> int:
            for p in range(closed + 1, to + 1):
                if last[p][0] == -2 and not self.single[ord(s[p - 1])]:
                    last[p] = (-1, 1)
            return to

        for end, (size, _, i) in self.scanned(s):
            if closed < end:
                closed = close(end)
            if last[end + 1][0] == -2:
                before = last[end + 1 - size][0]
                if self.follows(np.array([before]), np.array([i]))[0] if before >= 0 else before == -1 and self.order.alone[i]:
                    last[end + 1] = (i, size)
        close(n)
        return self._by_hand(s, last)

    def single_pass(self, words: list[str], sizes: np.ndarray) -> np.ndarray:
        """For each prefix length, by word, the id of the last piece: all words step by step together, longest first.

        -1: an unknown character, -2: no piece ends there on the way of a result.
        """
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        last = np.full((int(sizes[0]) + 1, len(words)), -2, np.int32)
        last[0] = -1
        auto, bpe = self.automaton, self.model.bpe
        score = None if bpe else np.full(last.shape, -np.inf)
        if not bpe:
            score[0] = 0.0
        state = np.zeros(len(words), np.int64)
        for p in range(int(sizes[0])):
            n = int(np.searchsorted(-sizes, -p))  # words longer than p
            char = flat[begin[:n] + p]
            state = auto.step(state[:n], char)
            piece = last[p + 1]
            live = np.flatnonzero(auto.first[state])
            node = auto.first[state[live]]
            while len(live):
                i = auto.piece[node]
                start = p + 1 - auto.depth[node]
                if bpe:
                    before = last[start, live]
                    ok = (before == -1) & self.order.alone[i]
                    pairs = np.flatnonzero(before >= 0)
                    ok[pairs] = self.follows(before[pairs], i[pairs])
                    piece[live[ok]] = i[ok]
                    live, node = live[~ok], node[~ok]
                else:
                    total = score[start, live] + self.scores[i]
                    ok = total > score[p + 1, live]
                    piece[live[ok]], score[p + 1, live[ok]] = i[ok], total[ok]
                node = auto.rest[node]
                live, node = live[node > 0], node[node > 0]
            other = np.flatnonzero(~self.single[char])
            if bpe:
                other = other[piece[other] == -2]
            else:
                edge = score[p, other] + self.unknown_score
                won = edge > score[p + 1, other]
                other = other[won]
                score[p + 1, other] = edge[won]
            piece[other] = -1
        return last

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, how many each has). Runs of space marks, whose pieces tie in score, are merged
        directly under a BPE model."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        alone = sizes > LONG
        if self.model.bpe:
            alone |= np.fromiter(map(contains, words, repeat(MARK * 2)), np.bool_, len(words))
        done: dict[int, array] = {}
        for k in np.flatnonzero(alone).tolist():
            if self.model.bpe and MARK * 2 in words[k]:
                done[k] = self._ids((self.ids.get(x, -1), x) for x in self.merge(words[k]))
            else:
                done[k] = self.merged(words[k]) if self.model.bpe else self.best(words[k])
        order = np.flatnonzero(~alone)
        order = order[np.argsort(-sizes[order], kind="stable")]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at = 0
        while at < len(order):
            group = order[at : at + max(1, CELLS // int(sizes[order[at]] + 1))]
            found.append(self._read_back([words[k] for k in group.tolist()], group, sizes[group], done))
            at += len(group)
        counts = np.zeros(len(words), np.int64)
        for where, _, n in found:
            counts[where] = n
        for k, ids in done.items():
            counts[k] = len(ids)
        starts = np.cumsum(counts) - counts
        values = np.empty(int(counts.sum()), np.int32)
        for where, ids, n in found:
            values[np.arange(len(ids)) + np.repeat(starts[where] - (np.cumsum(n) - n), n)] = ids
        for k, ids in done.items():
            values[starts[k] : starts[k] + len(ids)] = ids
        return values, counts

    def _read_back(self, words: list[str], group: np.ndarray, sizes: np.ndarray, done: dict[int, array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which words, their ids in a row, how many each has), from the words' ends; those with unknown characters go to ``done``."""
        last = self.single_pass(words, sizes)
        path = np.full((len(words), len(last)), -1, np.int32)
        at, column = sizes.copy(), len(last)
        odd = np.zeros(len(words), np.bool_)
        live = np.arange(len(words))
        while len(live):
            column -= 1
            piece = last[at[live], live]
            path[live, column] = piece
            odd[live[piece < 0]] = True
            live, piece = live[piece >= 0], piece[piece >= 0]
            at[live] -= self.sizes[piece]
            live = live[at[live] > 0]
        for j in np.flatnonzero(odd).tolist():
            done[int(group[j])] = self._by_hand(words[j], [(i, int(self.sizes[i]) if i >= 0 else 1) for i in last[: sizes[j] + 1, j].tolist()])
        path = path[~odd]
        return group[~odd], path[path >= 0], (path >= 0).sum(axis=1)

    def _by_hand(self, s: str, last: list[tuple[int, int]]) -> array:
        path, p = [], len(s)
        while p:
            i, size = last[p]
            if i == -2:  # no piece is compatible: cannot be under a total merge order, but ids must be right
                return self._ids((self.ids.get(x, -1), x) for x in self.merge(s))
            path.append((i, s[p - size : p]))
            p -= size
        return self._ids(reversed(path))

    def _ids(self, path) -> array:
        ids = array("i")
        for i, text in path:
            if i >= 0:
                ids.append(i)
            elif self.model.byte_ids:
                ids.extend(self.model.byte_ids[b] for b in text.encode("utf-8", "surrogatepass"))
            else:
                ids.append(self.model.unknown)
        return ids

    def _stretches(self, marked: str) -> Iterator[str]:
        """A text in stretches of about ``STRETCH`` characters, cut where no piece can cross."""
        at = 0
        while self.seam and len(marked) - at > STRETCH and (m := self.seam.search(marked, at + STRETCH)):
            yield marked[at : m.start()]
            at = m.start()
        yield marked[at:] if at else marked

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many each has). Each distinct word of a stretch of texts is encoded once."""
        sizes, values = np.zeros(len(texts), np.int64), []
        words: list[str] = []
        owners: list[tuple[int, int]] = []

        def flush() -> None:
            place = {w: k for k, w in enumerate(dict.fromkeys(words))}
            ids, each = self.encode_words(list(place))
            index = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
            n = each[index]
            values.append(ids[np.arange(int(n.sum())) + np.repeat((np.cumsum(each) - each)[index] - (np.cumsum(n) - n), n)])
            np.add.at(sizes, np.repeat([d for d, _ in owners], [k for _, k in owners]), n)
            words.clear()
            owners.clear()

        for d, text in enumerate(texts):
            if text:
                marked = text.replace(" ", MARK)
                for stretch in self._stretches(MARK + marked if self.model.dummy_prefix else marked):
                    found = self.cut.findall(stretch)
                    words += found
                    owners.append((d, len(found)))
                    if len(words) >= WORDS:
                        flush()
        if words:
            flush()
        return np.concatenate(values) if values else np.zeros(0, np.int32), sizes

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()


class Decoder:
    def __init__(self, model: PieceModel):
        self.dummy_prefix = model.dummy_prefix
        self.raw = [bytes([model.bytes_[i]]) if i in model.bytes_ else t.replace(MARK, " ").encode() for i, t in enumerate(model.texts)]
        for i in model.special:
            self.raw[i] = " ⁇ ".encode() if i == model.unknown else b""

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def column(self, ids: pa.ListArray) -> pa.Array:
        values, edges, known = ids.values.to_numpy(), ids.offsets.to_pylist(), ids.is_valid().to_pylist()
        return pa.array([self.decode(values[a:b].tolist()) if ok else None for a, b, ok in zip(edges, edges[1:], known)], pa.string())


def _encoder(model) -> Encoder:
    """One encoder for each Python worker and broadcast, built on first use and kept as long as the broadcast."""
    built = getattr(model, "_loomspan", None)
    if built is None:
        built = model._loomspan = Encoder(model.value)
    return built


def encode(docs: DataFrame, model: PieceModel, *, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with a column ``out``: the ids of the whole text; and one called ``decoded``, if given: the text that these
    ids stand for, as ``decode`` gives it. One map, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(out, *([decoded] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _encoder(shared), Decoder(shared.value) if decoded else None
        for batch in pieces(batches, text, rows=4096, limit=BATCH):
            values, sizes = encoder.encode_all(batch.column(text).to_pylist())
            edges = np.concatenate(([0], np.cumsum(sizes)))
            ids = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values), mask=batch.column(text).is_null())
            more = {out: ids} | ({decoded: decoder.column(ids)} if decoded else {})
            yield pa.RecordBatch.from_arrays([*batch.columns, *more.values()], [*batch.schema.names, *more])

    added = [T.StructField(out, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def decode(df: DataFrame, model: PieceModel, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with a column ``out``: the text that the ids stand for."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    df = df.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*batch.columns, decoder.column(batch.column(ids))], [*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def op7_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = MODEL_PATH) -> DataFrame:
    """Every document encoded and decoded again."""
    model = PieceModel.load(model_path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = encode(docs, model, decoded="decoded")
    fallback = sorted(model.byte_ids) or [model.unknown]
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.size(F.filter("ids", lambda i: i.between(fallback[0], fallback[-1]))).cast("long").alias("n_fallback"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )

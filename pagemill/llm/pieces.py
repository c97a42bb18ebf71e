"""SentencePiece encoding and decoding with N-best segmentation.

A text, spaces as U+2581 and one put in front, spans a lattice: an edge for every vocabulary
piece that matches, weighted by the piece's score, and for a character no piece covers an edge
to its byte pieces.  The forward Viterbi pass gives the best score up to every position.  These
scores are exact heuristics for an A* search that grows segmentations backward from the end:
the search pops complete segmentations in order of score and never expands a node in vain.

No piece holds U+2581 after another character, nor a line feed, so the lattice falls apart at
these places into units, and a unit again between characters that are neighbours in no piece.
Units are solved once and remembered.  The operator keeps them in arrays and solves the short
ones of many texts together; a text's N best segmentations differ from its best one only in the
N-1 units whose second best loses least, so only these need the search.

The vocabulary's own scores are maximised, also where the model was trained for merges (its
scores are then ranks); decoding is exact for every segmentation.

Edge cases: null and empty texts have no piece, the score 0 and one segmentation, the empty one;
U+2581 in a text is a space after decoding, so round_trip is false there; texts of any length are taken whole; repeated rows
each get their own result; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from itertools import pairwise
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.store import give_back, small_batches

SPACE = "▁"
_UNITS = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")
#: Letters with the spaces before them, or another character.
_RUNS = re.compile(rf"{SPACE}*[^\W\d_]+|.", re.DOTALL)
#: What a character outside the vocabulary costs below the least score.
UNKNOWN_PENALTY = 10.0
#: Units that a worker remembers before it starts anew, which it does at eight ids a unit too.
REMEMBERED = 600_000
#: Of those solved one by one and the searches.
FEWER = REMEMBERED // 32
#: Characters, at most, of a unit that is solved together with others, and such units at a time.
SHORT, TOGETHER = 32, 8192
#: Characters of the texts whose units are looked up together.
GROUP = 1 << 20
#: Of what ``Vocabulary.solve`` gives.
_SCORE, _LOSS = itemgetter(1), itemgetter(2)


def packed(ids: Sequence[int]) -> bytes:
    return array("i", ids).tobytes()


def unpacked(ids: bytes) -> list[int]:
    return array("i", ids).tolist()


class Trie:
    """All pieces as a trie with numbered states, 0 the root, that many characters walk at once.

    Its steps are in a hash table with linear probing, by state and class of the character.
    """

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        chars = sorted({c for p in pieces for c in p})
        #: By code point; 0: in no piece.
        self.classes = np.zeros(0x110000, dtype=np.int32)
        self.classes[list(map(ord, chars))] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        number = {"": 0}
        for p in pieces:
            for k in range(1, len(p) + 1):
                number.setdefault(p[:k], len(number))
        #: By state: characters from the root, and of the piece that ends there its id (-1: there is none) and score.
        self.depth = np.array(list(map(len, number)))
        self.ids = np.array([pieces.get(p, (-1,))[0] for p in number], dtype=np.int32)
        self.scores = np.array([pieces.get(p, (-1, 0.0))[1] for p in number])
        steps = np.array([number[p[:-1]] * self.width + int(self.classes[ord(p[-1])]) for p in number if p], dtype=np.int64)
        bits = (4 * len(number)).bit_length()
        self.shift, self.most = np.uint64(64 - bits), (1 << bits) - 1
        self.steps, self.after = np.full(1 << bits, -1), np.zeros(1 << bits, dtype=np.int32)
        left, slot = np.arange(len(steps)), self._slot(steps)
        while len(left):
            empty = self.steps[slot] < 0
            self.steps[slot[empty]] = steps[left[empty]]
            there = self.steps[slot] == steps[left]
            self.after[slot[there]] = left[there] + 1
            left, slot = left[~there], (slot[~there] + 1) & self.most

    def _slot(self, steps: np.ndarray) -> np.ndarray:
        return (steps.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def walk(self, states: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these states have a step by their class, and the states that those lead to."""
        steps = states.astype(np.int64) * self.width + classes
        slot = self._slot(steps)
        found = self.steps[slot]
        far = np.flatnonzero((found != steps) & (found >= 0))
        while len(far):
            slot[far] = (slot[far] + 1) & self.most
            found[far] = self.steps[slot[far]]
            far = far[(found[far] != steps[far]) & (found[far] >= 0)]
        there = np.flatnonzero(found == steps)
        return there, self.after[slot[there]]


@dataclass
class Vocabulary:
    """Pieces by text with (id, score), the ids of the 256 bytes, and what each id decodes to."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: list[int]
    decoded: list[bytes]
    longest: int = 0
    unknown: float = 0.0
    solved: dict[str, tuple] = field(default_factory=dict)
    others: dict[tuple[str, int], list] = field(default_factory=dict)

    def __post_init__(self):
        self.longest = max(map(len, self.pieces), default=1)
        self.unknown = min((s for _, s in self.pieces.values()), default=0.0) - UNKNOWN_PENALTY
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.pieces):
            raise ValueError("a piece spans units")

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("matcher", "alone", "inner", "trie", "shown", "memory")} | {"solved": {}, "others": {}}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a SentencePiece model whose normaliser changes nothing but spaces."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = " Ａ ﬁ\n  é\t"
        if sp.decode(sp.encode(probe)) != probe:
            raise ValueError("the model's normaliser isn't the identity")
        pieces, byte_ids, decoded = {}, [0] * 256, []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[3:-1], 16)] = i
                decoded.append(bytes([int(piece[3:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                decoded.append(b"")
            else:
                pieces[piece] = (i, sp.get_score(i))
                decoded.append(piece.replace(SPACE, " ").encode())
        return cls(pieces, byte_ids, decoded)

    def ids_of(self, edge: int | str) -> tuple[int, ...]:
        return (edge,) if isinstance(edge, int) else tuple(self.byte_ids[b] for b in edge.encode())

    def edges(self, unit: str) -> list[list[tuple[int, float, int | str]]]:
        """For each end position: (begin, score, id or uncovered character)."""
        get, longest, out = self.pieces.get, self.longest, [[]]
        for end in range(1, len(unit) + 1):
            here = []
            for begin in range(max(0, end - longest), end):
                hit = get(unit[begin:end])
                if hit:
                    here.append((begin, hit[1], hit[0]))
            if not here or here[-1][0] != end - 1:
                here.append((end - 1, self.unknown, unit[end - 1]))
            out.append(here)
        return out

    def forward(self, edges: list) -> list[float]:
        """Viterbi: the best score up to every position."""
        best = [0.0]
        for here in edges[1:]:
            best.append(max(best[b] + s for b, s, _ in here))
        return best

    def nbest_unit(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations by A* from the end: (score, ids).

        Among equal estimates the one that is further on comes first, so ties cost no detour.
        """
        edges = self.edges(unit)
        best = self.forward(edges)
        agenda, out, pushed = [(-best[-1], len(unit), 0, 0.0, None)], [], 0
        while agenda and len(out) < n:
            estimate, at, _, behind, tail = heapq.heappop(agenda)
            if not at:
                ids = []
                while tail:
                    ids.extend(self.ids_of(tail[0]))
                    tail = tail[1]
                out.append((-estimate, tuple(ids)))
            else:
                for begin, score, edge in edges[at]:
                    pushed += 1
                    heapq.heappush(agenda, (-(best[begin] + score + behind), begin, pushed, behind + score, (edge, tail)))
        return out

    @cached_property
    def matcher(self) -> ahocorasick.Automaton:
        """All pieces, each with length, score and packed id."""
        out = ahocorasick.Automaton()
        for piece, (i, score) in self.pieces.items():
            out.add_word(piece, (len(piece), score, packed([i])))
        if len(out):
            out.make_automaton()
        return out

    @cached_property
    def alone(self) -> frozenset[str]:
        return frozenset(p for p in self.pieces if len(p) == 1)

    @cached_property
    def inner(self) -> frozenset[str]:
        """The pairs of neighbouring characters that stand in some piece: no piece spans any other."""
        return frozenset(p[k : k + 2] for p in self.pieces for k in range(len(p) - 1))

    @cached_property
    def trie(self) -> Trie:
        return Trie(self.pieces)

    @cached_property
    def memory(self) -> Memory:
        return Memory(self)

    def solve(self, unit: str) -> tuple[bytes, float, float]:
        """Best ids (packed as int32), best score, and what the second best loses (infinite if there is none)."""
        hit = self.solved.get(unit)
        if hit is None:
            parts = self._parts(unit)
            if len(parts) > 1:
                parts = [self.solved.get(p) or self._part(p) for p in parts]
                hit = (b"".join([p[0] for p in parts]), sum([p[1] for p in parts]), min([p[2] for p in parts]))
                self._remember(unit, hit)
            else:
                hit = self._part(unit)
        return hit

    def _remember(self, unit: str, hit: tuple) -> None:
        if len(self.solved) >= FEWER:
            self.solved.clear()
        self.solved[unit] = hit

    def solve_together(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What ``solve`` gives for these short units, all characters of which are pieces: numbers of ids, ids, scores, losses.

        Each unit has a slot for its begin and one after each character; the matches go by the characters before
        their end, of equal ends the longest first, so each step meets a slot at most once.
        """
        trie = self.trie
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        last = np.cumsum(sizes + 1) - 1
        begin = last - sizes
        total = int(last[-1]) + 1
        place = np.arange(total) - np.repeat(begin, sizes + 1)
        char = np.zeros(total + 1, dtype=np.int64)  # that before the slot; 0, in no piece, before a begin and after the end
        char[:-1][place > 0] = trie.classes[np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32)]
        end, state, matches = np.flatnonzero(place < np.repeat(sizes, sizes + 1)), np.zeros(len(char) - 1 - len(units), dtype=np.int64), []
        while len(end):
            there, state = trie.walk(state, char[end + 1])
            end = end[there] + 1
            piece = np.flatnonzero(trie.ids[state] >= 0)
            matches.append((end[piece], state[piece]))
        end, state = (np.concatenate(x) for x in zip(*matches, strict=True))
        length = trie.depth[state]
        turn = (place[end] * (SHORT + 1) + SHORT - length).astype(np.uint16)
        order = np.argsort(turn, kind="stable")
        end, state, turn = end[order], state[order], turn[order]
        before, score = end - length[order], trie.scores[state]
        one, two, back = np.full(total, -np.inf), np.full(total, -np.inf), np.zeros(total, dtype=np.int64)
        one[begin] = 0.0
        for a, b in pairwise([0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(turn)]):
            e, f, s = end[a:b], before[a:b], score[a:b]
            first, best = one[e], one[f] + s
            one[e] = np.maximum(first, best)
            two[e] = np.maximum(np.maximum(two[e], np.minimum(first, best)), two[f] + s)
            back[e] = np.where(best > first, state[a:b], back[e])
        chosen, end, least = np.zeros(total, dtype=bool), last, begin
        while len(end):
            chosen[end] = True
            end = end - trie.depth[back[end]]
            left = end > least
            end, least = end[left], least[left]
        return np.diff(np.cumsum(chosen)[last], prepend=0), trie.ids[back[chosen]], one[last], one[last] - two[last]

    def _parts(self, unit: str) -> list[str]:
        """The unit cut between runs whose neighbouring characters stand together in no piece.

        Letters mostly stand together in some piece: not worth a look, and no cut is right too.
        """
        runs = _RUNS.findall(unit)
        out = runs[:1]
        for run in runs[1:]:
            if out[-1][-1] + run[0] in self.inner:
                out[-1] += run
            else:
                out.append(run)
        return out

    def _part(self, unit: str) -> tuple[bytes, float, float]:
        """What ``solve`` gives for a unit that isn't cut."""
        if len(unit) == 1:
            known = self.pieces.get(unit)
            hit = (packed([known[0]]), known[1], float("inf")) if known else (packed(self.ids_of(unit)), self.unknown, float("inf"))
        else:
            hit = self._solved(unit, len(unit))
        self._remember(unit, hit)
        return hit

    def solve_all(self, units: list[str]) -> list[tuple[bytes, float, float]]:
        get = self.solved.get
        return [get(u) or self.solve(u) for u in units]

    def _solved(self, unit: str, n: int) -> tuple[bytes, float, float]:
        """The two best scores up to every character, by the pieces that end there; the last place stands for the begin."""
        worst = float("-inf")
        one, two, back = [worst] * n + [0.0], [worst] * (n + 1), [None] * n
        if self.alone.issuperset(unit):
            matches = self.matcher.iter(unit)
        else:
            matches = ((end, (end + 1 - begin, score, packed(self.ids_of(edge)))) for end, here in enumerate(self.edges(unit)[1:]) for begin, score, edge in here)
        for end, hit in matches:
            length, score, _ = hit
            before = end - length
            first, second, best = one[end], two[end], one[before] + score
            if best > first:
                one[end], back[end] = best, hit
                if first > second:
                    second = first
            elif best > second:
                second = best
            best = two[before] + score
            two[end] = best if best > second else second
        ids, at = [], n - 1
        while at >= 0:
            length, _, edge = back[at]
            ids.append(edge)
            at -= length
        ids.reverse()
        return b"".join(ids), one[n - 1], one[n - 1] - two[n - 1]

    @staticmethod
    def units(text: str) -> list[str]:
        return _UNITS.findall(f"{SPACE}{text.replace(' ', SPACE)}") if text else []

    def encode(self, text: str) -> tuple[list[int], float]:
        """Ids and score of the best segmentation."""
        solved = self.solve_all(self.units(text))
        return unpacked(b"".join(s[0] for s in solved)), sum(s[1] for s in solved)

    def nbest(self, text: str, n: int) -> list[tuple[list[int], float]]:
        """The n best segmentations of a text, best first; fewer if there are fewer."""
        units = self.units(text)
        solved = self.solve_all(units)
        total = sum(s[1] for s in solved)
        out = []
        for loss, changes in self._changes(units, list(map(_LOSS, solved)), n):
            out.append((unpacked(b"".join([changes.get(k, hit[0]) for k, hit in enumerate(solved)])), total - loss))
        return out

    def nbest_scores(self, units: list[str], solved: list[tuple], n: int) -> list[float]:
        total = sum(map(_SCORE, solved))
        return [total - loss for loss, _ in self._changes(units, list(map(_LOSS, solved)), n)]

    def _changes(self, units: list[str], losses: list[float], n: int) -> list[tuple[float, dict[int, bytes]]]:
        """The n least losses against the best segmentation, each with the units it changes; ``losses`` are used up."""
        combined, none = [(0.0, {})], float("inf")
        for _ in range(n - 1 if losses else 0):
            least = min(losses)
            if least == none:
                break
            i = losses.index(least)
            losses[i] = none
            ways = self.ways(units[i], n)
            combined += [(loss + x, {**how, i: ids}) for loss, how in combined for x, ids in ways]
            combined = heapq.nsmallest(n, combined, key=lambda c: c[0])
        return combined

    def ways(self, unit: str, n: int) -> list[tuple[float, bytes]]:
        """What the n-1 best segmentations after the best one lose, and their ids."""
        hit = self.others.get((unit, n))
        if hit is None:
            best, score, _ = self.solve(unit)
            found = [(score - s, packed(ids)) for s, ids in self.nbest_unit(unit, n + 1)]
            if len(self.others) >= FEWER:
                self.others.clear()
            hit = self.others[unit, n] = [f for f in found if f[1] != best][: n - 1]
        return hit

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the text that was encoded, its first space being the one put in front."""
        return b"".join(map(self.decoded.__getitem__, ids))[1:] if ids else b""

    @cached_property
    def shown(self) -> tuple[pa.BinaryArray, np.ndarray]:
        """What each id decodes to, and its bytes."""
        return pa.array(self.decoded, pa.binary()), np.array(list(map(len, self.decoded)), dtype=np.int64)

    def decode_all(self, packs: list[bytes]) -> list[bytes]:
        """What ``decode`` gives for each of these packed ids."""
        decoded, sizes = self.shown
        ids = np.frombuffer(b"".join(packs), dtype=np.int32)
        whole = decoded.take(pa.array(ids)).buffers()[2]
        whole = whole.to_pybytes() if whole else b""
        ends = np.concatenate([[0], np.cumsum(sizes[ids])])[np.cumsum([0, *(len(p) // 4 for p in packs)])].tolist()
        return [whole[a + 1 : b] for a, b in pairwise(ends)]


class Memory:
    """Units that were solved, by number: where their ids end among all, scores and losses."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.ends, self.ids, self.scores, self.losses = array("q", [0]), array("i"), array("d"), array("d")

    def look(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What ``solve`` gives for each unit: where its ids end, the ids of all, scores and losses."""
        if len(self.numbers) > REMEMBERED or len(self.ids) > 8 * REMEMBERED:
            self._clear()
        found = list(map(self.numbers.get, units))
        missing = [k for k, number in enumerate(found) if number is None]
        if missing:
            self._learn({units[k] for k in missing})
            for k in missing:
                found[k] = self.numbers[units[k]]
        at = np.fromiter(found, np.int64, len(found))
        ends = np.frombuffer(self.ends, dtype=np.int64)
        begin = ends[at]
        sizes = ends[at + 1] - begin
        to = np.cumsum(sizes)
        ids = np.frombuffer(self.ids, dtype=np.int32)[np.arange(int(sizes.sum())) + np.repeat(begin - to + sizes, sizes)] if len(at) else np.zeros(0, dtype=np.int32)
        return to, ids, *(np.frombuffer(x, dtype=np.float64)[at] if len(at) else np.zeros(0) for x in (self.scores, self.losses))

    def _learn(self, units: set[str]) -> None:
        v, short, others = self.vocabulary, [], []
        for u in units:
            (short if len(u) <= SHORT and v.alone.issuperset(u) else others).append(u)
        short.sort(key=len)
        for i in range(0, len(short), TOGETHER):
            self._add(short[i : i + TOGETHER], *v.solve_together(short[i : i + TOGETHER]))
        for u in others:
            ids, score, loss = v.solve(u)
            self._add([u], np.array([len(ids) // 4]), np.frombuffer(ids, dtype=np.int32), np.array([score], dtype=np.float64), np.array([loss]))

    def _add(self, units: list[str], sizes: np.ndarray, ids: np.ndarray, scores: np.ndarray, losses: np.ndarray) -> None:
        self.numbers.update(zip(units, range(len(self.numbers), len(self.numbers) + len(units)), strict=True))
        self.ends.frombytes((np.cumsum(sizes) + self.ends[-1]).tobytes())
        self.ids.frombytes(ids.tobytes())
        self.scores.frombytes(scores.tobytes())
        self.losses.frombytes(losses.tobytes())


def _id_lists(ids: list[bytes]) -> pa.ListArray:
    """One list of ids for each packed one."""
    ends = np.cumsum([0, *(len(i) // 4 for i in ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))


def _solved_texts(v: Vocabulary, texts: list[str]) -> Iterator[tuple[list[str], list[int], bytes, list[float], list[float]]]:
    """Of each text the units, where their ids end, all ids packed, scores and losses of the units."""
    group, chars = [], 0
    for k, text in enumerate(texts):
        group.append(v.units(text))
        chars += len(text)
        if chars >= GROUP or k == len(texts) - 1:
            ends, ids, scores, losses = v.memory.look([u for units in group for u in units])
            a = begin = 0
            for units in group:
                b = a + len(units)
                to = (ends[a:b] - begin).tolist()
                end = begin + (to[-1] if to else 0)
                yield units, to, ids[begin:end].tobytes(), scores[a:b].tolist(), losses[a:b].tolist()
                a, begin = b, end
            group, chars = [], 0


def _changed(ids: bytes, ends: list[int], changes: dict[int, bytes]) -> bytes:
    """Packed ids of a text with these units changed."""
    out, at = [], 0
    for i in sorted(changes):
        out += [ids[at : 4 * ends[i - 1] if i else 0], changes[i]]
        at = 4 * ends[i]
    return b"".join([*out, ids[at:]])


def encode(docs: DataFrame, model_path: str, n: int = 3, segmentations: bool = False) -> DataFrame:
    """Per row: doc_id, n_pieces, score, nbest_scores (n at most), ids of the best, round_trip.

    round_trip says whether decoding the ids gave back the text's bytes.  With ``segmentations``
    nbest_ids has the ids of all n segmentations, best first.
    """
    schema = "doc_id long, n_pieces long, score double, nbest_scores array<double>, ids array<int>, round_trip boolean" + (", nbest_ids array<array<int>>" if segmentations else "")
    small_batches(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                ids, sizes, scores, nbest, ways = [], [], [], [], []
                texts = [text or "" for text in part.column(1).to_pylist()]
                for units, ends, own, gains, losses in _solved_texts(v, texts):
                    ids.append(own)
                    sizes.append(len(own) // 4)
                    scores.append(float(sum(gains)))
                    found = v._changes(units, losses, n)
                    nbest.append([scores[-1] - loss for loss, _ in found])
                    if segmentations:
                        ways.append([_changed(own, ends, changes) for _, changes in found])
                same = [back == text.encode() for back, text in zip(v.decode_all(ids), texts, strict=True)]
                lists = _id_lists(ids)
                cols = [part.column(0), pa.array(sizes, pa.int64()), pa.array(scores), pa.array(nbest, pa.list_(pa.float64())), lists, pa.array(same)]
                yield pa.RecordBatch.from_arrays(cols + ([pa.ListArray.from_arrays(np.cumsum([0, *map(len, ways)]).astype(np.int32), _id_lists([i for w in ways for i in w]))] if segmentations else []), names=[c.split()[0] for c in schema.split(", ")])
            give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows with ids; null ids give a null text."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if ids is None else vocabulary.value.decode(ids).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")

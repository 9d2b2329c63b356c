"""N-best segmentation into SentencePiece pieces, and decoding.

The pieces of a model and their scores span a lattice over a text. The best
segmentations are found as A* search from the end of the text, where the
forward Viterbi score of each place is the exact heuristic of what is still
to come: paths complete in the order of their scores.

A text falls apart before each run of spaces and around each line end, if no
piece of the model spans such a place. Each part has a lattice of its own, which A*
searches. As the heuristic is exact, the first path goes straight from the end
to the start, and when it is complete the best of the waiting ones has the
score of the second: both scores are kept. A batch's new parts are gone
through in order, since what the heuristic and the pieces before a place are
is the same in all parts that begin alike. The n best of a text differ from
its best only in the n - 1 parts whose second best lose the least; there A*
goes on to the n-th path, and the parts' paths are combined. Scores are
multiples of 2^-20, so that every sum is exact, whatever its order. Time and
memory are linear in a part's length.

The model's normalisation is the plain one: a space is put first, and spaces
become U+2581. A character without a piece becomes its UTF-8 bytes' pieces,
at a score of 10 under the lowest, as public SentencePiece does for unigram
lattices. Of equal scores in a part, the path with the longer last piece comes
first, then that with the longer last but one, and so on; between parts, the
change further left.

Defined results: null and empty texts have one segmentation, the empty one,
with score 0; a text has fewer than n segmentations if its lattice has fewer
paths; equal rows get equal results; an empty table gives an empty result;
columns to keep may not have the name of a column of the result.
"""

from __future__ import annotations

import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from heapq import heappop, heappush
from itertools import islice
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilframe.llm.common import Recent, sliced

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
N_BEST = 3
LITTLE = sys.byteorder == "little"
#: Bytes of parts that a worker keeps with their segmentations, about, and of an entry besides its text.
PARTS_BYTES, ENTRY_BYTES = 64 << 20, 200
#: What is kept of a part is one value, this and its ids: the score, and what the second best loses.
KEPT = struct.Struct("=dd")
#: Ids from which on they are decoded as arrays.
MANY_IDS = 64
#: Scores are multiples of 1 / GRID.
GRID = 1 << 20


class Step:
    """A piece of a path that A* builds from the end of a part. parent is the piece after it.

    Steps compare as their paths do: at the first piece from the end that
    differs, the longer one is less. jump leads to an ancestor far away, so
    that a comparison takes few hops on long paths.
    """

    __slots__ = ("depth", "jump", "parent", "piece", "start")

    def __init__(self, parent: Step | None, start: int, piece: int | None) -> None:
        self.parent, self.start, self.piece, self.depth = parent, start, piece, -1

    def settled(self) -> Step:
        """self, with depth and jump; its parent has them."""
        up = self.parent
        if self.depth < 0:
            if up is None:
                self.depth, self.jump = 0, self
            else:
                far = up.jump
                self.depth, self.jump = up.depth + 1, far.jump if up.depth - far.depth == far.depth - far.jump.depth else up
        return self

    def above(self, depth: int) -> Step:
        """The ancestor at a depth."""
        at = self
        while at.depth > depth:
            at = at.jump if at.jump.depth >= depth else at.parent
        return at

    def __lt__(self, other: Step) -> bool:
        a, b = self.settled(), other.settled()
        depth = min(a.depth, b.depth)
        a, b = a.above(depth), b.above(depth)
        while a.parent is not b.parent:
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.parent, b.parent)
        return a.start < b.start


class Pieces:
    """A model's normal pieces, with what is known of parts of texts."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], n: int = N_BEST) -> None:
        self.byte_ids, self.n = byte_ids, n
        pieces = {p: (i, round(score * GRID) / GRID) for p, (i, score) in pieces.items()}
        self.unknown = min((s for _, s in pieces.values()), default=0.0) - UNKNOWN_PENALTY
        self.names = {i: p for p, (i, _) in pieces.items()}
        self.bytes = {i: b for b, i in enumerate(byte_ids)}
        #: Tries of the pieces, from their first and from their last character: nodes are (nodes by character, score or None, id).
        self.trie, self.back = self.nodes(pieces), self.nodes({p[::-1]: x for p, x in pieces.items()})
        # spaces with what follows and line ends are parts, unless a piece has a space or a line end after another character
        apart = not any("\n" in p and len(p) > 1 or SPACE in p.lstrip(SPACE) for p in pieces)
        self.cut = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if apart else r"[\s\S]+")
        self.kept = Recent(lambda part: self.packed(self.of_part(part)), PARTS_BYTES, ENTRY_BYTES)

    @staticmethod
    def nodes(pieces: dict[str, tuple[int, float]]) -> dict:
        root: dict = {}
        for piece, (i, score) in sorted(pieces.items()):
            kids = root
            for c in piece[:-1]:
                kids = kids.setdefault(c, ({}, None, None))[0]
            kids[piece[-1]] = (kids[piece[-1]][0] if piece[-1] in kids else {}, score, i)
        return root

    @classmethod
    def load(cls, path: str, n: int = N_BEST) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        normal = {model.id_to_piece(i): (i, float(model.get_score(i))) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        return cls(normal, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], n)

    def forward(self, part: str) -> list[float]:
        """The Viterbi scores: of the best path from the start to each place."""
        size, trie, unknown = len(part), self.trie, self.unknown
        best = [0.0] + [-1e300] * size
        for i in range(size):
            here = best[i]
            node = trie.get(part[i])
            if node is None or node[1] is None:  # a character without a piece makes an edge of its own
                best[i + 1] = max(best[i + 1], here + unknown)
            j = i + 1
            while node is not None:
                kids, score, _ = node
                if score is not None and here + score > best[j]:
                    best[j] = here + score
                if j == size or not kids:
                    break
                node = kids.get(part[j])
                j += 1
        return best

    def edges(self, part: str, end: int) -> list[tuple[int, float, int | None]]:
        """(start, score, id, None for an unknown character) of the pieces that end at a place, the shortest first."""
        at = end - 1
        node = self.back.get(part[at])
        out: list = [(at, self.unknown, None)] if node is None or node[1] is None else []
        while node is not None:
            kids, score, piece = node
            if score is not None:
                out.append((at, score, piece))
            if not at or not kids:
                break
            at -= 1
            node = kids.get(part[at])
        return out

    def ids_of(self, part: str, step: Step) -> bytes:
        """The ids of a complete path, from its first piece on."""
        ids: list[int] = []
        while step.parent is not None:
            if step.piece is not None:
                ids.append(step.piece)
            else:
                ids.extend([self.byte_ids[b] for b in part[step.start].encode("utf-8", "surrogatepass")])
            step = step.parent
        return array("i", ids).tobytes() if LITTLE else np.array(ids, "<i4").tobytes()

    def paths(self, part: str) -> Iterator[tuple[float, bytes]]:
        """(score, ids) of one lattice's paths, best first, by A* from its end."""
        forward = self.forward(part)
        queue = [(-forward[-1], Step(None, len(part), None), 0.0)]
        while queue:
            lost, step, behind = heappop(queue)
            while step.start:
                step.settled()
                straight = None
                for start, score, piece in reversed(self.edges(part, step.start)):
                    entry = (-(behind + score + forward[start]), Step(step, start, piece), behind + score)
                    if straight is None and entry[0] == lost:
                        straight = entry  # it would be popped next: it scores as its parent, and its path is the least of these
                    else:
                        heappush(queue, entry)
                _, step, behind = straight
            yield behind, self.ids_of(part, step)

    def search(self, part: str) -> list[tuple[float, bytes]]:
        """The n best (score, ids) of one lattice."""
        return list(islice(self.paths(part), self.n))

    def of_parts(self, parts: Iterable[str]) -> Iterator[tuple[bytes, float, float]]:
        """(ids, score) of each lattice's best path, and what the second best loses.

        These are the steps of ``paths`` up to its first path, from the end to
        the start: the step taken next has the best score and is the last one's
        child, so of the waiting ones only the best score matters. The heuristic
        of a place, which child is best there, and what the best of the others
        loses depend only on what is before it: they are found together, and stay
        for what the next part begins with alike, so parts are best given in order.
        """
        back, unknown, byte_ids = self.back, self.unknown, self.byte_ids
        forward, children, before = [0.0], [(0, None, inf)], ""
        for part in parts:
            same = 0
            for a, b in zip(before, part, strict=False):
                if a != b:
                    break
                same += 1
            before = part
            del forward[same + 1 :], children[same + 1 :]
            for at in range(same, len(part)):  # the edges that edges() has for the place after it
                node, end = back.get(part[at]), at
                if node is None or node[1] is None:
                    top, second, start, best = forward[at] + unknown, -inf, at, None
                else:
                    top, second, start, best = -inf, -inf, at, None
                while node is not None:
                    kids, score, piece = node
                    if score is not None:
                        total = forward[end] + score
                        if total >= top:  # of equal ones the longest
                            second, top, start, best = top, total, end, piece
                        elif total > second:
                            second = total
                    if not end or not kids:
                        break
                    end -= 1
                    node = kids.get(part[end])
                forward.append(top)
                children.append((start, best, top - second))
            end, loss = len(part), inf
            ids: list[int] = []
            while end:
                end, piece, lost = children[end]
                if lost < loss:
                    loss = lost
                if piece is not None:
                    ids.append(piece)
                else:
                    ids.extend([byte_ids[b] for b in reversed(part[end].encode("utf-8", "surrogatepass"))])
            ids.reverse()
            yield array("i", ids).tobytes() if LITTLE else np.array(ids, "<i4").tobytes(), forward[-1], loss

    def of_part(self, part: str) -> tuple[bytes, float, float]:
        return next(self.of_parts([part]))

    of_atom = of_part

    @staticmethod
    def packed(found: tuple[bytes, float, float]) -> bytes:
        ids, score, loss = found
        return KEPT.pack(score, loss) + ids

    def parts(self, text: str | None) -> list[str]:
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, parts: Iterable[list[str]]) -> None:
        """Keeps what these texts' parts give; those not known yet are gone through in order."""
        kept = self.kept
        wanted = {x for x in set().union(*parts) if len(x) <= kept.LONGEST}.difference(kept)
        older = {x: kept.older[x] for x in wanted.intersection(kept.older)}
        kept.keep_all(older.items())
        new = sorted(wanted.difference(older))
        kept.keep_all(zip(new, map(self.packed, self.of_parts(new)), strict=True))

    def n_best(self, text: str | None) -> list[tuple[float, np.ndarray]]:
        """The n best (score, ids) of a text, best first."""
        return [(score, ids) for score, ids, _ in self.segmentations(text)]

    def segmentations(self, text: str | None, parts: list[str] | None = None) -> list[tuple[float, np.ndarray, list[tuple[str, bytes]]]]:
        """The n best (score, ids, the parts with other ids than in the best, with these ids) of a text, best first.

        A segmentation that isn't best in some part loses there at least what
        the part's second best loses; so only the n - 1 parts with the
        smallest losses can differ from their best, and only they are searched.
        parts are the text's, if they are there already.
        """
        if not text:
            return [(0.0, np.empty(0, "<i4"), [])]
        parts = self.parts(text) if parts is None else parts
        found = list(map(self.kept.__getitem__, parts))
        best = [x[KEPT.size :] for x in found]
        scores, losses = np.frombuffer(b"".join([x[: KEPT.size] for x in found])).reshape(-1, 2).T
        base = float(scores.sum())
        order = np.argsort(losses, kind="stable")[: self.n - 1]
        options: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
        others: dict[int, list[tuple[float, bytes]]] = {}
        for k in sorted(int(x) for x in order if losses[x] < np.inf):
            others[k] = self.search(parts[k])
            top = others[k][0][0]
            more = [(loss + top - score, (*changes, (k, r)) if r else changes) for loss, changes in options for r, (score, _) in enumerate(others[k])]
            more.sort(key=lambda x: (x[0], len(x[1]), x[1]))
            options = more[: self.n]
        whole = b"".join(best)
        begins = {k: sum(map(len, best[:k])) for k in others}
        out = []
        for loss, changes in options:
            made = whole
            for k, r in reversed(changes):  # from the right, so that what is to the left stays where it is
                made = made[: begins[k]] + others[k][r][1] + made[begins[k] + len(best[k]) :]
            out.append((base - loss, np.frombuffer(made, "<i4"), [(parts[k], others[k][r][1]) for k, r in changes]))
        return out

    def decode(self, ids) -> str:
        """The text of ids: bytes joined, U+2581 as spaces, without the first space."""
        return Speller(self).text(np.asarray(ids))


class Speller(dict):
    """The UTF-8 bytes of ids, for decoding many ids at once."""

    def __init__(self, model: Pieces) -> None:
        super().__init__({i: p.encode("utf-8", "surrogatepass") for i, p in model.names.items()} | {i: bytes([b]) for i, b in model.bytes.items()})
        # the same as arrays: all bytes, where an id's begin, and their number, -1 for other ids
        self.bytes = np.frombuffer(b"".join(self.values()), np.uint8)
        self.lengths, self.begins = np.full(max(self, default=-1) + 1, -1), np.zeros(max(self, default=-1) + 1, np.int64)
        lengths = np.array([len(x) for x in self.values()], np.int64)
        self.lengths[list(self)], self.begins[list(self)] = lengths, np.cumsum(lengths) - lengths

    def raw(self, ids: np.ndarray) -> bytes:
        if len(ids) < MANY_IDS:
            return b"".join(map(self.__getitem__, ids.tolist()))
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        places = np.repeat(self.begins[ids] - ends + lengths, lengths)
        places += np.arange(len(places))
        return self.bytes[places].tobytes()

    def text(self, ids: np.ndarray) -> str:
        text = self.raw(ids).decode("utf-8", "surrogatepass").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


@cache
def loaded(path: str, n: int) -> tuple[Pieces, Speller]:
    """One model for a worker process, with the parts that it keeps, whatever its tasks (tasks find it by this function's name)."""
    model = Pieces.load(path, n)
    return model, Speller(model)


SCHEMA = "rank int, score double, n_pieces long, ids_crc32 long, decoded_equal boolean, ids array<int>"


def _encoded(path: str, n: int, with_ids: bool, keep: list[str]):
    """Batches with text to a row for each segmentation. decoded_equal compares with the text, with U+2581 read as a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield encoded(batch)  # what is made on the way goes before the next slice

    def encoded(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, speller = loaded(path, n)
        rows, place = [], []
        texts = batch.column("__text").to_pylist()
        one: dict[str, str] = {}  # equal parts are one string
        parts = [[one.setdefault(p, p) for p in model.parts(x)] for x in texts]
        model.learn(parts)
        for i, text in enumerate(texts):
            plain = (text or "").replace(SPACE, " ")
            equal = False
            for rank, (score, ids, changes) in enumerate(model.segmentations(text, parts[i]), 1):
                if equal:  # the best gives the text back; the others differ from it in these parts only
                    same = all(speller.raw(np.frombuffer(new, "<i4")) == part.encode("utf-8", "surrogatepass") for part, new in changes)
                else:
                    same = equal = speller.text(ids) == plain
                rows.append((rank, score, len(ids), zlib.crc32(ids.tobytes()), same, ids if with_ids else None))
                place.append(i)
        took = pa.array(place, pa.int64())
        kept = [batch.column(c).take(took) for c in keep]
        types = [pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
        made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
        if with_ids:
            offsets = np.r_[0, np.cumsum([len(r[5]) for r in rows])].astype(np.int32)
            made.append(pa.ListArray.from_arrays(offsets, np.concatenate([r[5] for r in rows]) if rows else np.empty(0, np.int32)))
        names = ["rank", "score", "n_pieces", "ids_crc32", "decoded_equal", *["ids"] * with_ids]
        return pa.RecordBatch.from_arrays([*kept, *made], names=[*keep, *names])

    return run


def encode_n_best(docs: DataFrame, model_path: str, n: int = N_BEST, with_ids: bool = True, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each of the n best segmentations of each text: keep's columns, rank (from 1), score, n_pieces, ids_crc32 (of little-endian 32-bit ids), decoded_equal (decoding gives the text back) and, with_ids, the ids."""
    made = SCHEMA if with_ids else SCHEMA.removesuffix(", ids array<int>")
    clashing = {c.lower() for c in keep} & {"rank", "score", "n_pieces", "ids_crc32", "decoded_equal", "ids", "__text"}
    if clashing:
        raise ValueError(f"columns of the result have these names: {', '.join(sorted(clashing))}")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    source = docs.select(*keep, docs[text].alias("__text"))
    return source.mapInArrow(_encoded(model_path, n, with_ids, list(keep)), f"{kept}, {made}")

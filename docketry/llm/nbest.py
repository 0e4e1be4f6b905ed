"""SentencePiece encoding and decoding with N-best segmentations (operator 10).

A text's lattice has an edge for every vocabulary piece that matches at a
place. The forward Viterbi pass gives each place the score of its best
prefix; a backward A* search from the end uses it as its heuristic. As the
heuristic is exact, a search state's priority is the score of the best whole
segmentation through it, so states come out of the queue as segmentations in
order, and only the best N states ever need to be kept.

The lattice falls apart at places that no piece can span (before the space
that starts a word; around a character that is in no longer piece). Parts
are searched alone and their results are kept in a bounded cache of each
worker. Of a whole text only the N - 1 parts whose second-best segmentation
costs least can differ from the best one in an N-best result; the same
search runs over the combinations of these parts.

Scores are the model's own piece scores (for a BPE model minus the merge
rank). A character without a piece of its own gets the smallest score less
10 and is written as its UTF-8 bytes. Only the characters of the text count:
strings of control pieces are ordinary text. A literal U+2581 is written as
bytes, so decoding gives every text back exactly.

Defined cases: a null or empty text has no piece, score 0 and no alternative;
it decodes to the empty text. Ties in score are ordered by the search, which
is the same in every run: earlier part first, then the shorter last piece.
Repeated rows are encoded each; extra columns pass through, but one of the
result's name is replaced. Empty tables give empty results. A very long text
is read whole; a part of it without a break costs about 45 bytes a character
while it is searched, in arrays, and nothing after.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.session import importable

SPACE = "▁"
#: Stands for a literal U+2581 of the text; no valid text holds it.
_LITERAL = "\udc81"
UNKNOWN_PENALTY = 10.0
#: Documented bounds of each worker's cache: parts of texts, and about how many bytes they take.
CACHE_PARTS, CACHE_BYTES = 150_000, 16_000_000
#: Parts up to this length are searched together with others of their length.
TOGETHER = 24
CHUNK_CHARS = 1_000_000
#: Alternatives of longer parts aren't kept in the cache.
KEPT_CHARS = 256
_STEP = np.uint64(0x9E3779B97F4A7C15)

ENCODED = "struct<score:double,ids:array<int>,alternatives:array<struct<score:double,edits:array<struct<at:int,n:int,ids:array<int>>>>>>"


class Lattice:
    """Pieces of a SentencePiece model file and the searches over them."""

    def __init__(self, path: str, n_best: int):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.normalizer_spec.name != "identity" or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a model that normalises its input can't give texts back")
        self.n_best = n_best
        kinds = proto.ModelProto.SentencePiece
        self.pieces = {p.piece: (k, float(p.score)) for k, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        if len(self.bytes) < 256:
            raise ValueError("a model without byte pieces can't give texts back")
        self.unknown = min(s for _, s in self.pieces.values()) - UNKNOWN_PENALTY
        longer = {c for p in self.pieces if len(p) > 1 for c in p} - {SPACE}
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            self.parts = re.compile(r"(?s).+")
        else:
            inside = "".join(re.escape(c) for c in sorted(longer))
            self.parts = re.compile(f"(?s){SPACE}*[{inside}]+|{SPACE}+|.")
        self.longest = max(map(len, self.pieces))
        # Every beginning of a piece, with the piece where it is one: a walk over a text ends where no piece goes on.
        self.begun: dict[str, tuple[int, float] | tuple[()]] = {p[:k]: () for p in self.pieces for k in range(1, len(p))} | self.pieces
        hashes = []
        for x in self.begun:
            h = 0
            for c in x:
                h = (h * int(_STEP) + ord(c) + 1) % 2**64
            hashes.append(h)
        order = np.argsort(np.array(hashes, np.uint64))
        self.keys = np.array(hashes, np.uint64)[order]
        self.key_score = np.array([v[1] if v else -np.inf for v in self.begun.values()])[order]
        self.key_id = np.array([v[0] if v else -1 for v in self.begun.values()], np.int32)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two beginnings of pieces share a hash")
        self._forget()

    def written(self, char: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in (SPACE if char == _LITERAL else char).encode())

    def into(self, part: str, j: int) -> list[tuple[int, tuple[int, ...], float]]:
        """The edges that end at a place, the shortest first: (start, ids, score)."""
        out = []
        for i in range(j - 1, max(j - self.longest, 0) - 1, -1):
            found = self.pieces.get(part[i:j])
            if found:
                out.append((i, (found[0],), found[1]))
            elif i == j - 1:
                out.append((i, self.written(part[i]), self.unknown))
        return out

    def edges(self, part: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """``into`` of each place."""
        return [self.into(part, j) for j in range(len(part) + 1)]

    def prepare(self, parts: set[str]) -> None:
        """Number each part and have its Viterbi result; parts of one length that are new go through the lattice together."""
        new = parts - self.number.keys()
        # A part's string, its entry and about a number for each two characters.
        size = sum(150 + 3 * len(x) for x in new)
        if len(self.number) + len(new) > CACHE_PARTS or self.held + size > CACHE_BYTES:
            self._forget()
            new, size = parts, sum(150 + 3 * len(x) for x in parts)
        self.held += size
        by_length: dict[int, list[str]] = {}
        for x in new:
            by_length.setdefault(len(x), []).append(x)
        made: list[tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for n, same in by_length.items():
            step = 20_000 if n <= TOGETHER and len(same) >= 8 else 1
            for k in range(0, len(same), step):
                some = same[k : k + step]
                made.append((some, *(self._viterbi_together(some, n) if step > 1 else self._alone(some[0]))))
        if made:
            start = len(self.number)
            self.number.update((x, start + k) for k, x in enumerate(chain.from_iterable(m[0] for m in made)))
            self.score = np.concatenate([self.score, *(m[1] for m in made)])
            self.cost = np.concatenate([self.cost, *(m[2] for m in made)])
            self.count = np.concatenate([self.count, *(m[3] for m in made)])
            self.flat = np.concatenate([self.flat, *(m[4] for m in made)])
            self.at = np.concatenate([[0], np.cumsum(self.count)])[:-1]

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.held = 0
        self.score, self.cost = np.zeros(0), np.zeros(0)
        self.count, self.at, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.found: dict[str, list[tuple[float, array]]] = {}

    def _alone(self, part: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        score, cost, ids = self._best_of(part)
        return np.array([score]), np.array([cost]), np.array([len(ids)]), np.frombuffer(ids, np.int32)

    def best(self, part: str) -> tuple[float, float, tuple[int, ...]]:
        """(best score, what the second-best costs more, ids of the best) of a prepared part."""
        k = self.number[part]
        return float(self.score[k]), float(self.cost[k]), tuple(self.flat[self.at[k] : self.at[k] + self.count[k]].tolist())

    def _viterbi_together(self, parts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``_viterbi`` for many parts of n characters: each step of the walk is one array operation over all of them."""
        many = len(parts)
        code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(many, n).T.astype(np.uint64)
        first, second = np.full((n + 1, many), -np.inf), np.full((n + 1, many), -np.inf)
        start, piece = np.zeros((n + 1, many), np.int32), np.full((n + 1, many), -1, np.int32)
        first[0] = 0.0
        for i in range(n):
            who = np.arange(many)
            h = np.zeros(many, np.uint64)
            for j in range(i + 1, n + 1):
                h = h * _STEP + code[j - 1, who] + np.uint64(1)
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                begun = self.keys[at] == h
                score, ids = np.where(begun, self.key_score[at], -np.inf), np.where(begun, self.key_id[at], -1)
                if j == i + 1:
                    score = np.where(ids < 0, self.unknown, score)
                s, o = first[i, who] + score, second[i, who] + score
                old = first[j, who]
                better = s >= old
                second[j, who] = np.where(better, np.maximum(old, o), np.maximum(second[j, who], s))
                first[j, who] = np.where(better, s, old)
                start[j, who] = np.where(better, i, start[j, who])
                piece[j, who] = np.where(better, ids, piece[j, who])
                who, h = who[begun], h[begun]
                if not len(who):
                    break
        place, walked = np.full(many, n), []
        while place.any():
            walked.append(np.where(place > 0, piece[place, np.arange(many)], -2))
            place = np.where(place > 0, start[place, np.arange(many)], 0)
        ids = np.stack(walked[::-1], 1)
        count, flat = (ids != -2).sum(1), ids[ids != -2]
        for k in np.flatnonzero((ids == -1).any(1))[::-1].tolist():  # a character without a piece is written as bytes
            at = int(count[:k].sum())
            written = self._viterbi(parts[k])[2]
            flat = np.concatenate([flat[:at], written, flat[at + count[k] :]])
            count[k] = len(written)
        return first[n], first[n] - second[n], count, flat.astype(np.int32)

    def _forward(self, part: str) -> tuple[array, array, array, array]:
        """For each place the best and second-best score of the text before it, and where and with which piece the best one's last edge begins (-1: bytes)."""
        begun, n = self.begun.get, len(part)
        low = float("-inf")
        first, second = array("d", [low]) * (n + 1), array("d", [low]) * (n + 1)
        start, piece = array("i", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        first[0] = 0.0
        for i in range(n):
            here, other = first[i], second[i]
            if part[i] not in self.pieces:
                s = here + self.unknown
                if s >= first[i + 1]:
                    second[i + 1] = max(first[i + 1], other + self.unknown)
                    first[i + 1] = s
                    start[i + 1], piece[i + 1] = i, -1
                elif s > second[i + 1]:
                    second[i + 1] = s
            for j in range(i + 1, n + 1):
                found = begun(part[i:j])
                if found is None:
                    break
                if found:
                    s = here + found[1]
                    # A tie goes to the shorter last piece, as in the search.
                    if s >= first[j]:
                        o = other + found[1]
                        second[j] = first[j] if first[j] > o else o
                        first[j] = s
                        start[j], piece[j] = i, found[0]
                    elif s > second[j]:
                        second[j] = s
        return first, second, start, piece

    def _best_of(self, part: str) -> tuple[float, float, array]:
        first, second, start, piece = self._forward(part)
        ids, j = array("i"), len(part)
        while j:
            if piece[j] >= 0:
                ids.append(piece[j])
            else:
                ids.extend(reversed(self.written(part[start[j]])))
            j = start[j]
        ids.reverse()
        return first[-1], first[-1] - second[-1], ids

    def _viterbi(self, part: str) -> tuple[float, float, tuple[int, ...]]:
        score, cost, ids = self._best_of(part)
        return score, cost, tuple(ids)

    def search(self, part: str) -> list[tuple[float, array]]:
        """The N best segmentations of a part, best first: backward A* over the lattice, whose edges are looked up where the search comes."""
        n, prefix = len(part), self._forward(part)[0]
        # A state that was opened is a node: the one it came from, and the piece (-1: bytes) and place of the edge between them.
        parent, edge, place = array("i"), array("i"), array("i")
        queue, made, out = [(-prefix[n], 0, n, 0.0, -1, -1)], 0, []
        while queue and len(out) < self.n_best:
            f, _, at, g, origin, piece = heapq.heappop(queue)
            node = len(parent)
            parent.append(origin)
            edge.append(piece)
            place.append(at)
            if not at:
                ids = array("i")
                while parent[node] >= 0:
                    ids.extend(self.written(part[place[node]]) if edge[node] < 0 else (edge[node],))
                    node = parent[node]
                out.append((-f, ids))
                continue
            for i, ids, s in self.into(part, at):
                made += 1
                heapq.heappush(queue, (-(g + s + prefix[i]), made, i, g + s, node, ids[0] if part[i:at] in self.pieces else -1))
            if len(queue) > 8 * self.n_best:
                queue = heapq.nsmallest(self.n_best - len(out), queue)  # sorted, so still a heap
        return out

    def encode_all(self, texts: list[str]) -> Iterator[tuple[float, np.ndarray, list[tuple[float, list[tuple[int, int, array]]]]]]:
        """(score, ids, alternatives) of each text; an alternative is (score, edits of the best ids: at, n, ids)."""
        waiting, load = [], 0
        for k, text in enumerate(texts):
            waiting.append(self.parts.findall(SPACE + text.replace(SPACE, _LITERAL).replace(" ", SPACE)) if text else [])
            load += len(text)
            if load >= CHUNK_CHARS or k == len(texts) - 1:
                self.prepare(set().union(*waiting))
                sizes = [len(x) for x in waiting]
                numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(waiting)), np.int64, sum(sizes))
                count = self.count[numbers]
                ends = np.cumsum(count)
                flat = self.flat[np.repeat(self.at[numbers] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]
                first = 0
                for parts in waiting:
                    yield self._assemble(parts, numbers[first : first + len(parts)], flat[ends[first] - count[first] : ends[first + len(parts) - 1]] if parts else flat[:0])
                    first += len(parts)
                waiting, load = [], 0

    def encode(self, text: str) -> tuple[float, np.ndarray, list[tuple[float, list[tuple[int, int, array]]]]]:
        """As ``encode_all`` for one text."""
        return next(self.encode_all([text]))

    def _assemble(self, parts: list[str], numbers: np.ndarray, flat: np.ndarray) -> tuple[float, np.ndarray, list[tuple[float, list[tuple[int, int, array]]]]]:
        if not parts:
            return 0.0, flat, []
        total = float(self.score[numbers].sum())
        if self.n_best < 2:
            return total, flat, []
        cost = self.cost[numbers]
        few = self.n_best - 1
        if len(cost) > few:
            # All parts up to the few-th smallest cost, the earlier ones among equals.
            limit = np.partition(cost, few - 1)[few - 1]
            below, equal = np.flatnonzero(cost < limit), np.flatnonzero(cost == limit)
            chosen = np.sort(np.concatenate([below, equal[: few - len(below)]])).tolist()
        else:
            chosen = list(range(len(cost)))
        options = [self._searched(parts[k]) for k in chosen]
        queue, seen, found = [(0.0, (0,) * len(chosen))], {(0,) * len(chosen)}, []
        while queue and len(found) < self.n_best:
            loss, picks = heapq.heappop(queue)
            found.append((loss, picks))
            for k in range(len(picks)):
                if picks[k] + 1 < len(options[k]):
                    more = (*picks[:k], picks[k] + 1, *picks[k + 1 :])
                    if more not in seen:
                        seen.add(more)
                        heapq.heappush(queue, (loss + options[k][picks[k]][0] - options[k][picks[k] + 1][0], more))
        lengths = self.count[numbers]
        starts = np.cumsum(lengths) - lengths
        alternatives = [(total - loss, [(int(starts[chosen[k]]), int(lengths[chosen[k]]), options[k][p][1]) for k, p in enumerate(picks) if p]) for loss, picks in found[1:]]
        return total, flat, alternatives

    def _searched(self, part: str) -> list[tuple[float, array]]:
        kept = self.found.get(part)
        if kept is None:
            if len(self.found) >= CACHE_PARTS // 20:
                self.found.clear()
            kept = self.search(part)
            if len(part) <= KEPT_CHARS:
                self.found[part] = kept
        return kept


class Decoder:
    """The bytes of each piece, so that texts come out of one gather over all ids."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        written = [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in ((k, model.id_to_piece(k)) for k in range(model.get_piece_size()))]
        self.length = np.array([len(x) for x in written])
        self.at = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(written), np.uint8)

    def texts(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """One text for each run of ids, without the space that the encoder puts in front."""
        n = self.length[ids]
        ends = np.cumsum(n)
        flat = self.bytes[np.repeat(self.at[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate([[0], ends])[offsets]
        full = np.diff(offsets) > 0
        keep = np.ones(len(flat), bool)
        keep[cuts[:-1][full]] = False
        whole = flat[keep].tobytes()
        cuts = cuts - np.concatenate([[0], np.cumsum(full)])
        try:
            whole.decode()
        except UnicodeDecodeError:  # ids that no text gives
            return pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.string())
        return pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(whole))


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Decoder:
    return Decoder(path)


@lru_cache(maxsize=2)
def lattice(path: str, n_best: int) -> Lattice:
    """One per worker, so its cache outlives a task."""
    return Lattice(path, n_best)


_TYPE = pa.struct([
    ("score", pa.float64()),
    ("ids", pa.list_(pa.int32())),
    ("alternatives", pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))),
])


def _nested(lengths: list[int], values: pa.Array, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), pa.int32()), values, type=kind)


def _alternatives(found: list[list[tuple[float, list[tuple[int, int, array]]]]]) -> pa.Array:
    """The alternatives of each text, level by level, without a Python object for every edit."""
    whole = _TYPE.field("alternatives").type
    edits, edit = whole.value_type.field("edits").type, whole.value_type.field("edits").type.value_type
    flat = list(chain.from_iterable(found))
    made = list(chain.from_iterable(e for _, e in flat))
    ids = _nested([len(x[2]) for x in made], pa.array(np.fromiter(chain.from_iterable(x[2] for x in made), np.int32)), edit.field("ids").type)
    places = [pa.array([x[k] for x in made], pa.int32()) for k in (0, 1)]
    each = _nested([len(e) for _, e in flat], pa.StructArray.from_arrays([*places, ids], fields=list(edit)), edits)
    scored = pa.StructArray.from_arrays([pa.array([s for s, _ in flat], pa.float64()), each], fields=list(whole.value_type))
    return _nested([len(x) for x in found], scored, whole)


def encoder(model_path: str, n_best: int = 4, check: bool = False):
    """A column function: text -> (score, ids, alternatives). ``model_path`` must exist on every executor.

    check: also ``round_trip``, whether the decoded ids are the text. One worker does both, so no second one is needed for it.
    """
    kind = [*_TYPE, *([pa.field("round_trip", pa.bool_())] if check else [])]

    @F.arrow_udf(ENCODED[:-1] + ",round_trip:boolean>" if check else ENCODED)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = lattice(model_path, n_best)
        for b in batches:
            done = list(model.encode_all([x or "" for x in b.to_pylist()]))
            offsets = np.concatenate([[0], np.cumsum([len(x[1]) for x in done])])
            ids = np.concatenate([x[1] for x in done] or [np.zeros(0, np.int32)])
            best = [pa.array([x[0] for x in done], pa.float64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))]
            whole = [*best, _alternatives([x[2] for x in done])]
            del done
            if check:
                given = b if pa.types.is_string(b.type) else b.cast(pa.string())
                whole.append(pc.equal(pieces_of(model_path).texts(ids, offsets), given.fill_null("")))
            yield pa.StructArray.from_arrays(whole, fields=kind)

    return encode


def decoder(model_path: str):
    """A column function: ids -> text."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = pieces_of(model_path)
        for b in batches:
            offsets = np.concatenate([[0], np.cumsum(np.nan_to_num(b.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))])
            yield model.texts(b.flatten().to_numpy(), offsets)

    return decode


def encode_documents(docs: DataFrame, model_path: str, *, n_best: int = 4, text: str = "text", check: bool = False, out: str = "pieces") -> DataFrame:
    """``docs`` with the column ``out``: (score, ids, alternatives), and round_trip with ``check``."""
    importable(docs.sparkSession)
    # Marked non-deterministic so that the optimiser never evaluates it twice.
    return docs.withColumn(out, encoder(model_path, n_best, check).asNondeterministic()(F.col(text).cast("string")))


def decoded(ids: Column, model_path: str) -> Column:
    """The texts of lists of ids."""
    return decoder(model_path)(ids)

"""Sampled segmentations of SentencePiece: Gumbel top-k without replacement over the lattice; and decoding."""

from __future__ import annotations

import re
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import tokens as T

MARK = "▁"
#: A word of the normalised text: white space marks, then the rest. No piece reaches over the end of a word.
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: A table of 2**15 slots by the leading bits finds a hash among sorted ones; it stays in a core's cache.
_SLOT = np.uint64(49)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


#: Characters of text that a worker samples at once, and edges of word lattices that it keeps for later batches.
BATCH_CHARS, KEPT_EDGES = 1_000_000, 4_000_000


def state(*parts, h=np.uint64(0)) -> np.ndarray:
    """A counter-based generator's state from whole-number keys; it goes on from h."""
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.uint64)) * _MIX[1] + _MIX[0]
            h = (h ^ (h >> np.uint64(31))) * _MIX[2]
            h ^= h >> np.uint64(29)
    return h


def mixed(*parts, h=np.uint64(0)) -> np.ndarray:
    """Uniform numbers in (0, 1) from whole-number keys, the same for a row in any batch."""
    return ((state(*parts, h=h) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Numbers(dict):
    """Words and their numbers; a word asked for the first time gets the next."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Lattices:
    """The lattices of distinct words, as one: edges sorted by their first place, with conditional probabilities.

    A worker keeps them, so a word's lattice is made once; with over KEPT_EDGES edges they are dropped before the next batch."""

    def __init__(self, words: list[str], vocab: Vocabulary):
        self.words = len(words)
        self.rooms: dict[str, np.ndarray] = {}
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        # A place for each character and one after each word.
        ends = np.cumsum(sizes + 1) - 1
        self.first, self.last = ends - sizes, ends
        places = np.ones(len(codes) + len(words), dtype=bool)
        places[ends] = False
        at = np.flatnonzero(places).astype(np.int32)
        room = (np.repeat(ends, sizes) - at).astype(np.int32)
        start, end, piece = [], [], []
        h = np.zeros(len(codes), dtype=np.uint64)
        alone = np.zeros(len(codes), dtype=bool)
        live = np.arange(len(codes))
        for size in range(1, vocab.longest + 1):
            live = live[room[live] >= size]
            if not len(live):
                break
            now = h[live] * _MIX[2] + codes[live + size - 1] + np.uint64(1)
            keys, ids, slots = vocab.by_size[size]
            spread = now * _MIX[1]
            k = slots[(spread >> _SLOT).astype(np.int32)]
            short = np.flatnonzero(keys[k] < spread)
            while len(short):  # few hashes share a slot
                k[short] += 1
                short = short[keys[k[short]] < spread[short]]
            hit = keys[k] == spread
            live, k = live[hit], k[hit]  # the others begin no piece
            h[live] = now[hit]
            whole = ids[k] >= 0
            begin = at[live[whole]]
            start.append(begin)
            end.append(begin + size)
            piece.append(ids[k[whole]])
            if size == 1:
                alone[live[whole]] = True
        other = np.flatnonzero(~alone)  # a character without a piece: its bytes
        code = codes[other].astype(np.int64)
        start = [*start[::-1], at[other]]  # the longest pieces are the likeliest
        end = [*end[::-1], at[other] + 1]
        piece = [*piece[::-1], np.where(code < 128, vocab.ascii[np.minimum(code, 127)], -code - 1).astype(np.int32)]
        s, e, p = np.concatenate(start), np.concatenate(end), np.concatenate(piece)
        order = np.argsort(s, kind="stable")  # each place's edges are in falling order of their length already
        self.start, self.end, self.piece = (x[order].astype(np.int32) for x in (s, e, p))
        weight = np.where(self.piece >= 0, vocab.weight[np.maximum(self.piece, 0)], vocab.byte_weight)
        n_places = len(places)
        self.row = np.append(0, np.cumsum(np.bincount(self.start, minlength=n_places))).astype(np.int32)
        # Log of the weight of all ways from a place to its word's end, from the last places back.
        beta = np.zeros(n_places)
        to_end = (np.repeat(ends, sizes + 1) - np.arange(n_places))[self.start].astype(np.int16 if sizes.max(initial=0) < 1 << 15 else np.int64)
        group = np.argsort(to_end, kind="stable")
        bounds = np.searchsorted(to_end[group], np.arange(1, int(to_end.max(initial=0)) + 2))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            g = group[a:b]
            if len(g):
                x = weight[g] + beta[self.end[g]]
                cut = np.flatnonzero(np.append(True, self.start[g][1:] != self.start[g][:-1]))
                top = np.maximum.reduceat(x, cut)
                beta[self.start[g][cut]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, np.diff(np.append(cut, len(g))))), cut))
        self.logp = weight + beta[self.end] - beta[self.start]
        self.logp[np.diff(self.row)[self.start] == 1] = 0.0
        # Shares summed within each place, from its first edge on; its last edge takes what rounding leaves.
        self.upto = np.exp(self.logp).astype(np.float32)
        rank = (np.arange(len(self.start)) - self.row[self.start]).astype(np.int16)
        by_rank = np.argsort(rank, kind="stable")
        bounds = np.searchsorted(rank[by_rank], np.arange(1, int(rank.max(initial=0)) + 2))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            self.upto[by_rank[a:b]] += self.upto[by_rank[a:b] - 1]
        self.upto[self.row[1:][np.diff(self.row) > 0] - 1] = 2.0

    def extend(self, more: Lattices) -> None:
        """Takes in the lattices of other words; the arrays are views of longer ones that leave room for more."""
        places, edges = len(self.row) - 1, len(self.start)
        self.words += more.words
        more.row += edges
        for x in (more.first, more.last, more.start, more.end):
            x += places
        for name in ("row", "first", "last", "start", "end", "piece", "logp", "upto"):
            new, now = getattr(more, name), len(getattr(self, name)) - (name == "row")
            room = self.rooms.get(name)
            if room is None or len(room) < now + len(new):
                room = np.empty(2 * (now + len(new)), dtype=new.dtype)
                room[:now] = getattr(self, name)[:now]
                self.rooms[name] = room
            room[now : now + len(new)] = new
            setattr(self, name, room[: now + len(new)])

    def choose(self, place: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge from each place, by its probability; a place has at most as many edges as the longest piece has characters."""
        e = self.row[place]
        more = np.flatnonzero(self.upto[e] <= u)
        while len(more):
            e[more] += 1
            more = more[self.upto[e[more]] <= u[more]]
        return e

    def walk(self, word: np.ndarray, place: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From a place in each word to its end, h the state of its numbers: (occurrence, edge), ordered by occurrence and step."""
        taken, steps = [], np.zeros(len(word), dtype=np.int32)
        live = np.flatnonzero(place < self.last[word]).astype(np.int32)
        now, begin, end, h = place[live], self.first[word[live]], self.last[word[live]], h[live]
        while len(live):
            e = self.choose(now, mixed(now - begin, h=h))
            taken.append((live, e))
            now = self.end[e]
            on = now < end
            steps[live] += 1
            live, now, begin, end, h = live[on], now[on], begin[on], end[on], h[on]
        offset = np.cumsum(steps) - steps
        edges = np.empty(int(steps.sum()), dtype=np.int32)
        for step, (live, e) in enumerate(taken):
            edges[offset[live] + step] = e
        return np.repeat(np.arange(len(word), dtype=np.int32), steps), edges


class Vocabulary:
    def __init__(self, path: str, alpha: float):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        pieces = [self.sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i))]
        if any(not re.fullmatch(f"{MARK}*[^{MARK}]*", pieces[i]) for i in normal):
            raise ValueError("a piece reaches over the end of a word")
        self.pieces = pieces
        self.bytes = {int(pieces[i][3:5], 16): i for i in range(n) if self.sp.is_byte(i)}
        self.unknown = self.sp.unk_id()
        self.ascii = np.array([self.bytes.get(b, self.unknown) for b in range(128)], dtype=np.int64)
        self.weight = alpha * np.array([self.sp.get_score(i) for i in range(n)])
        self.byte_weight = 0.0  # such a character has one way only, so its weight changes nothing
        self.longest = max(len(pieces[i]) for i in normal)
        self.kept: Lattices | None = None
        self.plain = np.zeros(n, dtype=bool)
        self.plain[normal] = True
        #: What each piece adds to a text's bytes; None for pieces that only the library decodes.
        self.raw = np.full(n, None, dtype=object)
        self.raw[normal] = [pieces[i].replace(MARK, " ").encode() for i in normal]
        for value, i in self.bytes.items():
            self.raw[i] = bytes([value])
        self.dummy = self.sp.decode(self.sp.encode("a")) == "a" and self.sp.normalize("a") == MARK + "a"
        #: By length: hashes of all beginnings of pieces, and the piece's id where it ends there (else -1).
        self.by_size = {}
        for size in range(1, self.longest + 1):
            known = {pieces[i][:size]: -1 for i in normal if len(pieces[i]) >= size} | {pieces[i]: i for i in normal if len(pieces[i]) == size}
            h = np.zeros(len(known), dtype=np.uint64)
            for k in range(size):
                h = h * _MIX[2] + np.array([ord(x[k]) for x in known], dtype=np.uint64) + np.uint64(1)
            h *= _MIX[1]
            order = np.argsort(h)
            keys = np.append(h[order], np.uint64(2**64 - 1))
            slots = np.searchsorted(keys, np.arange(1 << 15, dtype=np.uint64) << _SLOT).astype(np.int32)
            self.by_size[size] = (keys, np.append(np.array(list(known.values()), dtype=np.int32)[order], -1), slots)

    def lattices(self, words: list[list[str]]) -> tuple[Lattices, list[np.ndarray]]:
        """Lattices that hold these words, and others that the worker has met, and the words' numbers there."""
        if self.kept is None or len(self.kept.start) > KEPT_EDGES:
            self.kept, self.number = Lattices([], self), Numbers()
        found = [np.fromiter(map(self.number.__getitem__, ws), dtype=np.int32, count=len(ws)) for ws in words]
        if len(self.number) > self.kept.words:
            self.kept.extend(Lattices(list(islice(self.number, self.kept.words, None)), self))
        return self.kept, found

    def words(self, text: str | None) -> list[str]:
        """The words of a text's normal form."""
        whole = self.sp.normalize(text) if text else ""
        if whole.startswith(MARK) and 2 * MARK not in whole and "\0" not in whole:
            return whole.replace(MARK, "\0" + MARK).split("\0")[1:]
        return _WORD.findall(whole)

    def text(self, ids: np.ndarray) -> str:
        """What SentencePiece decodes the ids to; texts with control or unknown pieces, or bytes that are no UTF-8, are left to the library."""
        if not len(ids) or ids.max() >= len(self.raw):
            return self.sp.decode(ids.tolist())
        try:
            text = b"".join(self.raw[ids].tolist()).decode()
        except (TypeError, UnicodeDecodeError):
            return self.sp.decode(ids.tolist())
        return text.removeprefix(" ") if self.dummy and self.plain[ids[0]] else text

    def ids(self, marks: np.ndarray) -> np.ndarray:
        """Piece ids; a character without a piece (-code - 1) becomes the pieces of its bytes."""
        if (marks >= 0).all():
            return marks.astype("<u4")
        out: list[int] = []
        for m in marks.tolist():
            out += [m] if m >= 0 else [self.bytes.get(b, self.unknown) for b in chr(-m - 1).encode()]
        return np.array(out, dtype="<u4")


_vocabularies: dict = {}


def vocabulary(path: str, alpha: float) -> Vocabulary:
    if (path, alpha) not in _vocabularies:
        _vocabularies[path, alpha] = Vocabulary(path, alpha)
    return _vocabularies[path, alpha]


def top_k(texts: list[str | None], keys: list[int], vocab: Vocabulary, k: int, seed: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its k first segmentations by perturbed log-probability: (ids, log_prob, perturbed, inclusion).

    A* over sets of segmentations that share a prefix, ordered by the greatest Gumbel-perturbed log-probability in each set. A
    set's mass is known exactly from the lattice, so its greatest perturbed value is drawn without looking into it: the set taken
    next is walked to one segmentation, and each step of the walk leaves a set of the alternatives there, whose value is
    a Gumbel of their mass truncated at the value of the set. The walks of all texts of a batch run together.
    """
    lat, word_of = vocab.lattices([vocab.words(t) for t in texts])
    out: list[list] = [[] for _ in texts]
    row_key = np.array([x & ((1 << 64) - 1) for x in keys], dtype=np.uint64)
    value = -np.log(-np.log(mixed(np.uint64(seed), row_key, np.uint64(1 << 40))))
    # Of each text: the walked segmentations, as (edges, words, value, log-probabilities before each step, frontier).
    paths: list[list] = [[] for _ in texts]
    # The next walk of each text: (path it leaves, step, value, excluded edges); at first all of the lattice.
    jobs = [(t, None, 0, float(value[t]), ()) for t in range(len(texts)) if len(word_of[t])]
    for draw in range(k):
        if not jobs:
            break
        heads, tails, first_place, own, nth = [], [], [], [], []
        for t, path, step, _, excluded in jobs:
            ws = word_of[t]
            if path is None:
                heads.append(np.zeros(0, dtype=np.int64))
                w0, place0 = 0, None
            else:
                edges, at_word = paths[t][path][0], paths[t][path][1]
                place = int(lat.start[edges[step]])
                options = np.array([o for o in range(lat.row[place], lat.row[place + 1]) if o not in excluded])
                share = np.cumsum(np.exp(lat.logp[options]))
                u = float(mixed(np.uint64(seed), row_key[t], np.uint64(draw), np.uint64(1 << 41)))
                e = int(options[min(int(np.searchsorted(share, u * share[-1], side="right")), len(options) - 1)])
                heads.append(np.append(edges[:step], e))
                w0, place0 = int(at_word[step]), int(lat.end[e])
            rest = ws[w0:]
            start = lat.first[rest].copy()
            if place0 is not None:
                start[0] = place0
            tails.append(rest)
            first_place.append(start)
            own.append(np.full(len(rest), t, dtype=np.int32))
            nth.append(np.arange(w0, len(ws), dtype=np.int32))
        word, place, text, number = map(np.concatenate, (tails, first_place, own, nth))
        drawn = state(np.uint64(draw), h=state(np.uint64(seed), row_key))
        who, got = lat.walk(word, place, state(number, h=drawn[text]))
        cuts = np.searchsorted(who, np.cumsum([0, *map(len, tails)]))
        following = []
        for j, (t, path, step, val, excluded) in enumerate(jobs):
            mine = slice(cuts[j], cuts[j + 1])
            edges = np.concatenate([heads[j], got[mine]])
            old_words = paths[t][path][1][: step + 1] if path is not None else np.zeros(0, dtype=np.int32)
            at_word = np.concatenate([old_words, number[who[mine]]])
            lp = lat.logp[edges]
            total = np.cumsum(lp)
            # Sets left at each new step: all edges there but the one taken.
            new = np.arange(step if path is not None else 0, len(edges))
            taken = np.exp(lp[new])
            if path is not None:
                taken[0] += np.exp(lat.logp[list(excluded)]).sum()
                taken[0] = 1.0 if len(excluded) + 1 >= lat.row[lat.start[edges[step]] + 1] - lat.row[lat.start[edges[step]]] else taken[0]
            # A set's Gumbel before it is truncated at val, which keeps the order of a path's sets.
            frontier = np.full(len(edges), -np.inf)
            with np.errstate(divide="ignore"):
                frontier[new] = (total - lp)[new] + np.log(np.maximum(1.0 - taken, 0.0) / -np.log(mixed(np.uint64(1 << 42), new, h=drawn[t])))
            gone = {step: (*excluded, int(edges[step]))} if path is not None else {}
            paths[t].append([edges, at_word, val, float(total[-1]) if len(total) else 0.0, frontier, gone])
            if path is not None:
                paths[t][path][4][step] = -np.inf  # its rest belongs to the new path's step
            ahead = [int(np.argmax(p[4])) for p in paths[t]]
            tops = [-float(np.logaddexp(-p[2], -p[4][i])) for p, i in zip(paths[t], ahead, strict=True)]
            best = int(np.argmax(tops))
            at, threshold = ahead[best], tops[best]
            if np.isneginf(threshold):
                paths[t].append(None)  # there is no other segmentation
            elif draw + 1 < k:
                shut = paths[t][best][5].get(at, (int(paths[t][best][0][at]),))
                following.append((t, best, at, threshold, shut))
            else:
                paths[t].append(threshold)
        jobs = following
    for t in range(len(texts)):
        if not len(word_of[t]):
            out[t].append((np.zeros(0, dtype="<u4"), 0.0, 0.0, 1.0))
            continue
        kappa = paths[t].pop()
        for edges, _, val, lp, *_ in paths[t]:
            with np.errstate(over="ignore"):
                inclusion = 1.0 if kappa is None else float(-np.expm1(-np.exp(lp - kappa)))
            out[t].append((vocab.ids(lat.piece[edges]), lp, val, inclusion))
    return out


def model_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def sample_segmentations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, alpha: float = 0.0005, seed: int = 17, path: str | None = None) -> DataFrame:
    """Up to k distinct segmentations of each whole text: id, sample (0 first), ids (little-endian u32), log_prob, perturbed, inclusion,
    text_crc32 (of what the ids decode to).

    A segmentation's probability is proportional to exp(alpha * sum of piece scores). In a unigram model the scores are log
    probabilities; in a BPE model, as the one at hand, they are the negative ranks of the merges, so alpha (small, for ranks go
    up to the vocabulary's size) sets how much more likely pieces made by early merges are. Samples are the k of the greatest
    Gumbel-perturbed log-probability, in that order, that is k draws without replacement; inclusion is the probability
    that the segmentation exceeds the threshold, the perturbed value of the k+1st. They depend on the row's key (id and text)
    and the seed only. Texts with fewer than k segmentations give all of them, with inclusion 1.

    Null texts, and texts that normalise to nothing, give one empty segmentation. Null ids are carried through. Characters without a
    piece become the pieces of their bytes. Other columns are not read; no shuffle. Texts are sampled in batches of about
    BATCH_CHARS characters, one longer text alone, and a worker keeps at most KEPT_EDGES edges of lattices besides those of
    its batch; so memory grows with the longest text only. Equal rows get equal samples.
    """
    path = model_path(path)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        vocab = vocabulary(path, alpha)
        for b in T.by_chars(batches, 1, BATCH_CHARS):
            got = top_k(b.column(1).to_pylist(), b.column(2).to_pylist(), vocab, k, seed)
            row = [i for i, g in enumerate(got) for _ in g]
            flat = [x for g in got for x in g]
            cols = [b.column(0).take(pa.array(row, pa.int32())), pa.array([s for g in got for s in range(len(g))], pa.int32()), pa.array([x[0].tobytes() for x in flat], pa.binary())]
            check = pa.array([zlib.crc32(vocab.text(x[0]).encode()) for x in flat], pa.int64())
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([x[i] for x in flat], pa.float64()) for i in (1, 2, 3)), check], ["id", "sample", "ids", "log_prob", "perturbed", "inclusion", "text_crc32"])

    return rows.mapInArrow(run, f"id {kind}, sample int, ids binary, log_prob double, perturbed double, inclusion double, text_crc32 long").withColumnRenamed("id", id_col)


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """docs with the library's own segmentation of each whole text: ids (little-endian u32; a column of that name is replaced); null gives null."""
    path = model_path(path)
    rows = docs.drop(ids_col)
    at, names = rows.columns.index(text_col), [*rows.columns, ids_col]

    def run(batches):
        sp = vocabulary(path, 1.0).sp
        for b in T.by_chars(batches, at, BATCH_CHARS):
            ids = [None if x is None else np.array(sp.encode(x), dtype="<u4").tobytes() for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.binary())], names)

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{ids_col}` binary")


def decode(rows: DataFrame, ids_col: str = "ids", text_col: str = "text", path: str | None = None) -> DataFrame:
    """rows with text: what the ids (little-endian u32) stand for; null ids give null. A column of that name is replaced."""
    path = model_path(path)
    rows = rows.drop(text_col)
    at, names = rows.columns.index(ids_col), [*rows.columns, text_col]

    def run(batches):
        vocab = vocabulary(path, 1.0)
        for b in T.chunks(batches, 64):
            texts = [None if x is None else vocab.text(np.frombuffer(x, dtype="<u4")) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names)

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{text_col}` string")

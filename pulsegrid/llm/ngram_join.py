"""N-gram Jaccard join: rare-first prefix filter with length, positional and suffix filters; each pair is verified once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import _shared as S
from pulsegrid.llm import tokens as T

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
#: Parts into which the suffix filter divides the hashes.
PARTS = 64
#: N-grams that a task holds at once, and bytes of text whose n-grams make one range of hashes.
CHUNK_GRAMS, RANGE_BYTES = 2_000_000, 16 << 20
#: An n-gram in more texts of a chunk than this is common: it is ordered last and not counted.
COMMON_IN_CHUNK = 64
COMMON = 255

#: Rows that travel between the passes; what the columns hold depends on the kind.
_PACKED = "part int, kind int, los binary, sizes binary, at binary, grams binary, codes binary"
_NAMES = [x.split()[0] for x in _PACKED.split(", ")]
DOCS, GRAMS, MARKS, ECHO = range(4)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; a text of fewer words is one n-gram; no word, no n-gram."""
    import xxhash

    got = (text or "").encode().translate(_LOWER).split()  # splits at blank and 0x09-0x0D only
    if not got:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, got), dtype=np.uint64, count=len(got))
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h = (h ^ w[i : len(w) - k + 1 + i]) * _ODD[i % len(_ODD)]
        h ^= h >> np.uint64(29)
    h *= _ODD[0]
    return np.unique(h ^ (h >> np.uint64(32)))


def signature(grams: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(grams.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def parts(grams: np.ndarray) -> np.ndarray:
    """How many hashes fall into each of PARTS equal ranges, modulo 256."""
    return np.bincount((grams >> np.uint64(58)).astype(np.int64), minlength=PARTS).astype(np.uint8).view(np.int8)


def _row(part: int, kind: int, *columns: np.ndarray | None) -> tuple:
    return (part, kind, *(None if c is None else c.tobytes() for c in columns))


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)


class Ranges:
    """Equal ranges of the n-grams' hashes. An n-gram's key is its hash's leading bits: so many that a key's place in its range has
    32 bits; two n-grams with one key are counted and listed together, which only adds candidates."""

    def __init__(self, count: int):
        self.bits = 32 + max(0, count.bit_length() - 1)
        self.first = np.array([-(-(i << self.bits) // count) for i in range(count)], dtype=np.int64)

    def keys(self, grams: np.ndarray) -> np.ndarray:
        return (grams >> np.uint64(64 - self.bits)).astype(np.int64)


def _dealt(part: np.ndarray, kind: int, lo: np.ndarray, size: np.ndarray, gram: np.ndarray, code: np.ndarray) -> list[tuple]:
    """Entries packed by part: the distinct signatures with their sizes, and for each entry its signature's place, gram and code."""
    order = np.lexsort((gram, lo, part))
    cut = np.flatnonzero(np.append(True, np.diff(part[order]) != 0))
    out = []
    for a, b in zip(cut, [*cut[1:], len(order)], strict=True):
        at = order[a:b]
        los, first, place = np.unique(lo[at], return_index=True, return_inverse=True)
        out.append(_row(int(part[at[0]]), kind, los, size[at[first]], place.astype(np.uint32 if len(los) > 1 << 16 else np.uint16), gram[at], code[at].astype(np.uint8)))
    return out


def _entries(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The inverse: lo, size, gram, code of all entries."""
    lo, size, gram, code = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
    for r in rows:
        los = np.frombuffer(r["los"], np.int64)
        at = np.frombuffer(r["at"], np.uint32 if len(los) > 1 << 16 else np.uint16)
        lo.append(los[at])
        size.append(np.frombuffer(r["sizes"], np.int32).reshape(-1, 2)[at])
        gram.append(np.frombuffer(r["grams"], np.int64))
        code.append(np.frombuffer(r["codes"], np.uint8))
    return tuple(map(np.concatenate, (lo, size, gram, code)))


def _requests(words: int, ranges: Ranges):
    """A chunk of texts -> its documents (DOCS), its n-grams by range (GRAMS; copies in a chunk go out once), and of n-grams that
    are common in it: a mark to their range (MARKS), and the texts that hold them to any range, which only hands them on (ECHO)."""

    def chunk(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        sig = np.array([signature(s) for s in sets], dtype=np.int64).reshape(-1, 2)
        low = {x: i for i, x in reversed(list(enumerate(sig[:, 0].tolist()))) if len(sets[i])}
        one = sorted(low.values())
        keys = [ranges.keys(sets[i]) for i in one]
        distinct = [k[np.append(True, k[1:] != k[:-1])] for k in keys]
        size = np.array([(len(k), len(k) - len(d)) for k, d in zip(keys, distinct, strict=True)], dtype=np.int32).reshape(-1, 2)
        any_range = int(sig[0, 1]) % len(ranges.first)
        share = np.concatenate([parts(s) for s in sets])
        out = [_row(any_range, DOCS, sig[:, 0], np.array(list(map(len, sets)), np.int32), sig[:, 1], np.array(ids, np.int64), share)]
        if one:
            flat, who = np.concatenate(distinct), np.repeat(np.arange(len(one)), list(map(len, distinct)))
            lo = sig[one, 0]
            order = np.argsort(flat, kind="stable")
            flat, who = flat[order], who[order]
            start = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
            often = np.repeat(np.diff(np.append(start, len(flat))) > COMMON_IN_CHUNK, np.diff(np.append(start, len(flat))))
            marks = np.unique(flat[often])
            home = np.searchsorted(ranges.first, marks, side="right") - 1
            for r in np.unique(home):
                out.append(_row(int(r), MARKS, None, None, None, marks[home == r], None))
            if often.any():
                out += _dealt(np.full(int(often.sum()), any_range), ECHO, lo[who[often]], size[who[often]], flat[often], np.full(int(often.sum()), COMMON))
            flat, who = flat[~often], who[~often]
            cut = np.searchsorted(flat, np.append(ranges.first, 1 << ranges.bits))
            for r in np.flatnonzero(np.diff(cut)):
                mine = slice(cut[r], cut[r + 1])
                docs, at = np.unique(who[mine], return_inverse=True)
                out.append(_row(int(r), GRAMS, lo[docs], size[docs], at.astype(np.uint32 if len(docs) > 1 << 16 else np.uint16), (flat[mine] - ranges.first[r]).astype(np.uint32), None))
        return _packed(out)

    def run(batches):
        T.release()
        ids, sets, held = [], [], 0
        for b in batches:
            for i in range(b.num_rows):
                ids.append(b.column(0)[i].as_py())
                sets.append(shingles(b.column(1)[i].as_py(), words))
                held += len(sets[-1])
                if held > CHUNK_GRAMS or len(ids) >= 1 << 15:
                    yield chunk(ids, sets)
                    ids, sets, held = [], [], 0
        if ids:
            yield chunk(ids, sets)

    return run


def _answers(ranges: Ranges):
    """All rows of a range -> for each text that holds a repeated n-gram of it, the n-gram and the code of its count, dealt by signature."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = [tuple(r[c] for c in _NAMES) for r in rows if r["kind"] == DOCS]
        lo, size, gram, code = _entries([r for r in rows if r["kind"] == ECHO])
        marks = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["grams"], np.int64) for r in rows if r["kind"] == MARKS)]))
        asked = [r for r in rows if r["kind"] == GRAMS]
        if asked:
            base = ranges.first[asked[0]["part"]]
            plain = [r | {"grams": (np.frombuffer(r["grams"], np.uint32) + base).astype(np.int64), "codes": b""} for r in asked]
            del rows, asked
            l, s, g, _ = _entries(plain)
            order = np.lexsort((l, g))
            l, s, g = l[order], s[order], g[order]
            new = np.append(True, g[1:] != g[:-1])
            once = new | np.append(True, l[1:] != l[:-1])  # a text's copies in other chunks count once
            start = np.flatnonzero(new)
            count = np.add.reduceat(once.astype(np.int64), start)
            mark = np.where(np.isin(g[start], marks), COMMON, np.minimum(np.floor(16 * np.log2(count)), COMMON - 1)).astype(np.uint8)
            keep = once & np.repeat((count > 1) | (mark == COMMON), np.diff(np.append(start, len(g))))
            mark = np.repeat(mark, np.diff(np.append(start, len(g))))
            lo, size, gram, code = np.concatenate([lo, l[keep]]), np.concatenate([size, s[keep]]), np.concatenate([gram, g[keep]]), np.concatenate([code, mark[keep]])
        if len(lo):
            out += _dealt((lo.view(np.uint64) % np.uint64(len(ranges.first))).astype(np.int64), GRAMS, lo, size, gram, code)
        return pa.Table.from_batches([_packed(out)]) if out else table.slice(0, 0)

    return run


def _prefixes(percent: int):
    """All answers of some texts -> the repeated part of each text's prefix: gram, lo, n, m (its repeated n-grams), pos among them."""

    def run(table: pa.Table) -> pa.Table:
        lo, size, gram, code = _entries(table.to_pylist())
        order = np.lexsort((gram, code, lo))
        lo, size, gram = lo[order], size[order], gram[order]
        fresh = np.append(True, (lo[1:] != lo[:-1]) | (gram[1:] != gram[:-1]))
        lo, size, gram = lo[fresh], size[fresh], gram[fresh]
        start = np.flatnonzero(np.append(True, lo[1:] != lo[:-1]))
        held = np.diff(np.append(start, len(lo)))
        pos = np.arange(len(lo)) - np.repeat(start, held)
        n = size[:, 0].astype(np.int64)
        m = np.repeat(held, held) + size[:, 1]  # n-grams of a text with one key may all be repeated
        alone = n - m
        keep = pos < n - -(-percent * n // 100) + 1 - alone
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        return pa.table([pa.array(c[keep]).cast(k) for c, k in zip((gram, lo, n, m, pos), kinds, strict=True)], names=["gram", "lo", "n", "m", "pos"])

    return run


def _documents():
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                share = np.frombuffer(r["codes"], np.int8)
                cols = [np.frombuffer(r["grams"], np.int64), np.frombuffer(r["sizes"], np.int32).astype(np.int64), np.frombuffer(r["los"], np.int64), np.frombuffer(r["at"], np.int64)]
                lists = pa.ListArray.from_arrays(np.arange(0, len(share) + 1, PARTS, dtype=np.int32), pa.array(share))
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), lists], ["id", "n", "lo", "hi", "parts"])

    return run


def _sets(words: int):
    names = ["d", "lo", "grams"]

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                sets = [shingles(t, words) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([signature(s)[0] for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names)

    return run


def least_overlap(a: Column, b: Column, percent: int) -> Column:
    """The smallest integer overlap of sets of sizes a and b with 100 * overlap >= percent * union."""
    return F.ceil((a + b) * percent / F.lit(100 + percent) - 1e-9)


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, broadcast_rows: int = 2_000_000) -> DataFrame:
    """One row per row of docs: id, n_shingles, class_id (smallest id of the rows with the same set), component_id.

    Two texts link when 100 * |intersection| >= percent * |union| of their sets of word n-grams (A-Z lower-cased, words parted by
    white space; a text of fewer words is one n-gram); component_id is the smallest id reachable by links.

    1. One pass over the texts takes each text's set size and signature and deals its n-grams, packed, to ranges of their hashes,
    about RANGE_BYTES of text to a range. There n-grams are counted over distinct sets, and each text gets back the n-grams
    that other sets hold too, with their counts (in steps of a sixteenth of an octave). An n-gram that is common within a chunk
    of texts does not go to its range: a mark does, and it is last in the order. So no range holds a common n-gram's texts.
    2. N-grams that no other set holds come first in the order, then the rarest. A text's prefix is short of its whole by the
    overlap it needs; where n-grams of its own fill the prefix, the text links with nothing and is done. The others post what is
    left of their prefix. 3. In the list of an n-gram (salted, so of any length) all members are paired with the smallest;
    pairs that pass the length, positional and suffix filters are verified on the whole sets, and links are joined to
    components. The positional filter knows how many n-grams of each text are shared at all. 4. Lists that still hold several
    components give the remaining pairs across components, filtered and verified the same way. So links within a
    component need not be expanded, and no link that would join two components is lost.

    Null and empty texts, and texts of white space, have no n-gram and link with nothing. Null ids link with nothing and
    have a null component. Rows with equal ids are one vertex. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    ranges = Ranges(max(1, -(-int(size) // RANGE_BYTES)))
    asked = rows.mapInArrow(_requests(words, ranges), _PACKED).repartition(max(len(ranges.first), 1), "part")
    packed = S.written(asked.groupBy("part").applyInArrow(_answers(ranges), _PACKED), "answers")
    scan = S.written(packed.where(F.col("kind") == DOCS).mapInArrow(_documents(), "id long, n long, lo long, hi long, parts array<tinyint>"), "signatures")
    post = S.written(packed.where(F.col("kind") == GRAMS).groupBy("part").applyInArrow(_prefixes(percent), "gram long, lo long, n int, m int, pos int"), "prefixes")
    S.forget(packed)

    members = S.written(S.with_group(scan.where("n > 0").select("id", "n", "lo", "hi"), ["lo", "hi"], "id", low="class_id", size="copies"), "classes")
    firsts = members.where("id = class_id").select("lo", F.col("id").alias("d")).distinct()
    lists = post.join(firsts, "lo").select("gram", F.struct("d", "lo", "n", "m", "pos").alias("me"))
    lists = S.written(S.with_group(lists, ["gram"], "me", low="pivot", size="c").where("c > 1").select("gram", "me", "pivot"), "lists")
    S.forget(post)

    posted = lists.select(F.col("me.d").alias("d")).distinct()
    shares = S.written(scan.select(F.col("id").alias("d"), "lo", "parts").join(posted, "d", "left_semi"), "shares")
    near = _passing(lists.where("me <> pivot").select(F.col("pivot").alias("a"), F.col("me").alias("b")), shares, percent)
    links = _verified(rows, near, words, percent, broadcast_rows)
    parts = S.components(links)
    known = lists.join(parts.select(F.col("id").alias("__id"), "component_id"), F.col("me.d") == F.col("__id"), "left")
    known = known.select("gram", "me", "pivot", F.coalesce("component_id", "me.d").alias("part"))
    mixed = known.groupBy("gram").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("gram")
    known = known.join(mixed, "gram", "left_semi").where("me <> pivot").withColumns({"d": F.col("me.d"), "lo": F.col("me.lo")})
    known = S.written(known.join(shares, ["d", "lo"]).drop("d", "lo"), "mixed")
    a, b = ((known.select("gram", F.col("me").alias(x), F.col("part").alias(f"p{x}"), F.col("parts").alias(f"s{x}"))) for x in "ab")
    cross = a.join(b, (a.gram == b.gram) & (F.col("a") < F.col("b")) & (F.col("pa") != F.col("pb")) & _filters(percent) & _suffix(F.col("sa"), F.col("sb"), F.col("a.n"), F.col("b.n"), percent))
    cross = S.written(cross.select(F.col("a.d").alias("d1"), F.col("a.lo").alias("lo1"), F.col("b.d").alias("d2"), F.col("b.lo").alias("lo2")).distinct(), "pairs")
    more = _verified(rows, cross, words, percent, broadcast_rows)
    S.forget(known, lists, shares)
    parts = S.components(links.unionByName(more))

    found = members.join(parts.select(F.col("id").alias("class_id"), "component_id"), "class_id", "left").select("id", "n", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    alone = scan.where("n = 0").select("id", "n", F.col("id").alias("class_id"), F.col("id").alias("component_id"))
    none = docs.where(F.col(id_col).isNull()).select(F.col(id_col).cast("long").alias("id"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("component_id"))
    return found.unionByName(alone).unionByName(none).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "class_id", "component_id")


def _filters(percent: int) -> Column:
    """Length and positional filter on postings a and b of one n-gram: of what comes before it in both texts, at most the smaller
    number is shared, and likewise of what comes after; n-grams of a text alone are not among these."""
    na, nb, i, j = F.col("a.n"), F.col("b.n"), F.col("a.pos"), F.col("b.pos")
    length = (100 * na >= percent * nb) & (100 * nb >= percent * na)
    return length & (F.least(i, j) + 1 + F.least(F.col("a.m") - i - 1, F.col("b.m") - j - 1) >= least_overlap(na, nb, percent))


def _suffix(p: Column, q: Column, na: Column, nb: Column, percent: int) -> Column:
    """Suffix filter: sets that overlap enough differ by at most na + nb - 2 * overlap n-grams, in all ranges of the hash together.

    The ranges' sizes are known modulo 256; the distance on that ring is never more than the true one."""
    ring = F.zip_with(p, q, lambda x, y: F.abs(x.cast("int") - y.cast("int")))
    far = F.aggregate(ring, F.lit(0), lambda s, d: s + F.least(d, 256 - d))
    return far <= na + nb - 2 * least_overlap(na, nb, percent)


def _passing(pairs: DataFrame, shares: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (d1, lo1, d2, lo2) all of whose postings pass, and then the suffix filter.

    That reads a few numbers for each text, so whole sets travel only for pairs that are nearly certain."""
    kept = pairs.groupBy(F.col("a.d").alias("d1"), F.col("a.lo").alias("lo1"), F.col("b.d").alias("d2"), F.col("b.lo").alias("lo2")).agg(F.bool_and(_filters(percent)).alias("ok"), F.first("a.n").alias("n1"), F.first("b.n").alias("n2"))
    one = shares.select(F.col("d").alias("d1"), F.col("lo").alias("lo1"), F.col("parts").alias("p1"))
    two = shares.select(F.col("d").alias("d2"), F.col("lo").alias("lo2"), F.col("parts").alias("p2"))
    both = kept.where("ok").join(one, ["d1", "lo1"]).join(two, ["d2", "lo2"])
    return S.written(both.where(_suffix(F.col("p1"), F.col("p2"), F.col("n1"), F.col("n2"), percent)).select("d1", "lo1", "d2", "lo2").distinct(), "pairs")


def _verified(rows: DataFrame, pairs: DataFrame, words: int, percent: int, broadcast_rows: int) -> DataFrame:
    """The links (u, v) among pairs, each decided once on the whole sets."""
    wanted = S.written(pairs.select(F.col("d1").alias("id")).union(pairs.select("d2")).distinct(), "wanted")
    texts = rows.join(S.small(wanted, wanted.count(), broadcast_rows), "id", "left_semi")
    sets = S.written(texts.select("id", "t").mapInArrow(_sets(words), "d long, lo long, grams array<long>"), "sets")
    one = sets.select(F.col("d").alias("d1"), F.col("lo").alias("lo1"), F.col("grams").alias("g1"))
    two = sets.select(F.col("d").alias("d2"), F.col("lo").alias("lo2"), F.col("grams").alias("g2"))
    shared = F.size(F.array_intersect("g1", "g2"))
    links = pairs.join(one, ["d1", "lo1"]).join(two, ["d2", "lo2"]).where(100 * shared >= percent * (F.size("g1") + F.size("g2") - shared))
    links = S.written(links.select(F.col("d1").alias("u"), F.col("d2").alias("v")).distinct(), "verified")
    S.forget(sets)
    return links

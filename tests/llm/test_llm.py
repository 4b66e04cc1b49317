"""The operators against brute force, on small tables with nulls, empty and long texts, ties, copies and clashing columns."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import _shared as S
from pulsegrid.llm import exact_dedup, language_id, line_dedup, ngram_join, packing, queries, records, segmentations, shard, tokens, vector_dedup
from tests.parity import differences

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def texts() -> list:
    rng = np.random.default_rng(3)
    out = [None, "", " ", "\n\n", "a", "A b", "a  b", "don't  <|endoftext|> x", "日本語 \U0001f600 é'", "x" * 5000, "\t\x0b q\x1c r", "123 ...", "line " * 12 + "\n" + "line " * 12]
    for _ in range(12):
        base = list(rng.choice(WORDS, size=60))
        out += [" ".join(base)] * 2
        for _ in range(4):
            v = list(base)
            v[int(rng.integers(60))] = "changed"
            out.append(" ".join(v))
    out.append(" ".join(rng.choice(WORDS, size=9000)))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}", 5, 1, 2.0) for i, t in enumerate(texts())]
    rows.append((None, "a row without an id", None, None, None, None, None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, slot int, shard int, score double").repartition(5)


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def known(docs):
    return docs.where("doc_id is not null")


def test_sql(spark):
    for name, sql in queries.oracle_sql().items():
        assert differences(spark, "/root/testdata/sf0.01", queries.queries()[name], sql) == []


def test_exact_dedup(docs, empty):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts()):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    for ids in groups.values():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (min(ids), len(ids), i == min(ids))
    assert got[None].kept and got[None].group_size == 1
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_shards(docs, empty):
    got = shard.two_pass_shuffle(docs, "doc_id", 4, bucket_bytes=1 << 12).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect())
    for s in range(4):
        assert sorted(r.slot for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r.grown_shard in (r["shard"], 4) for r in got)
    assert shard.two_pass_shuffle(empty, "doc_id", 4).count() == 0


def test_shards_follow_from_rows_and_seed_alone(spark, docs, tmp_path):
    def order(df, n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out = shard.two_pass_shuffle(df, "doc_id", 4, bucket_bytes=1 << 12)
        shard.write_shards(out, str(tmp_path / f"{n}"))
        got = shard.read_shards(spark, str(tmp_path / f"{n}"), out)
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        return got, {(r.doc_id, r.text, r["shard"], r.slot, r.grown_shard) for r in got.collect()}

    (written, a), (_, b) = order(docs, 3), order(docs.repartition(9), 40)
    assert a == b and len(a) == docs.count()
    rows = written.select(F.input_file_name().alias("f"), "shard", "slot", F.monotonically_increasing_id().alias("n")).collect()
    for s in range(4):
        mine = sorted((r.f, r.n, r.slot) for r in rows if r["shard"] == s)
        assert [x for _, _, x in mine] == list(range(len(mine)))


def test_shards_of_equal_rows(spark):
    same = spark.range(3000).select(F.lit(1).alias("doc_id"), F.lit("x" * 40).alias("text")).repartition(4).unionByName(spark.createDataFrame([(i, f"row {i}") for i in range(2, 50)], "doc_id int, text string"))
    got = shard.two_pass_shuffle(same, "doc_id", 3, bucket_bytes=1 << 13, twins=100).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(1, "x" * 40)] * 3000 + [(i, f"row {i}") for i in range(2, 50)])
    for s in range(3):
        assert sorted(r.slot for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_op6_as_registered(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op6_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows) and {r.law for r in got} == {"key"}
    for r in got:
        data = (rows[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data)) and r.grown_shard in (r["shard"], 16)


def test_records_round_trip(spark, docs, empty):
    path = S.scratch(spark, "test-records")
    records.write_records(docs, path, file_bytes=1 << 14)
    index = records.write_index(spark, path)
    enc = tokens.Encoder(tokens.vocabulary_path())
    ids = {i: enc._ids(t or "").tolist() + [2] for i, t in enumerate(texts())}
    start = len(enc._ids("a row without an id")) + 1  # null ids come first
    rows = {r.id: r for r in index.collect()}
    for i, x in ids.items():
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        start += len(x)
    wanted = index.where("id % 7 = 0").select("part", "offset", "id").orderBy(F.rand(1))
    assert {r.key: r.ids for r in records.read_records(spark, path, wanted).collect()} == {i: x for i, x in ids.items() if i % 7 == 0}
    with pytest.raises(ValueError):
        records.unframe(b"\x09" + bytes(40))
    records.write_records(empty, path + "-empty")
    assert records.write_index(spark, path + "-empty").count() == 0


def test_packing(docs, empty):
    cut = S.written(packing.pieces(docs, limit=256), "test-pieces")
    rows = packing.pack(cut, limit=256).collect()
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in rows)
    assert len(rows) == cut.count() and len(bins) <= -(-total // 256) * 1.05 + 1
    again = packing.pack(S.written(cut.withColumns({"sequence_id": F.lit("x"), "offset": F.lit(1)}), "clash"), limit=256)
    assert sorted(again.columns) == sorted(packing.pack(cut, limit=256).columns) and again.count() == len(rows)
    assert packing.pack(S.written(packing.pieces(empty), "none")).count() == 0


def test_pieces_against_the_tokenizer(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.vocabulary_path())
    got = collections.defaultdict(list)
    for r in packing.pieces(docs, limit=256).collect():
        got[r.id].append((r.piece, r.start, r.length, r.ids_crc32))
    for i, t in enumerate(texts()):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 256 + 1
        cuts = [0, *range(first, len(ids), 256), len(ids)]
        want = [(p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        assert sorted(got[i]) == want


@pytest.mark.parametrize("kind", ["uniform", "log-normal", "few", "one"])
def test_configuration_program(kind):
    rng = np.random.default_rng(4)
    sizes = {"uniform": rng.integers(1, 513, 40_000), "log-normal": np.clip(rng.lognormal(4, 1, 40_000), 1, 512).astype(int), "few": rng.choice([200, 150, 313, 512], 999), "one": [7]}[kind]
    counts = dict(collections.Counter(int(x) for x in sizes))
    solution, low = packing.fractional(counts, 512)
    covered = collections.Counter()
    for pattern, weight in solution:
        assert sum(x * t for x, t in pattern.items()) <= 512
        for x, t in pattern.items():
            covered[x] += t * weight
    assert all(covered[x] <= n + 1e-6 for x, n in counts.items())
    plan, by = packing.plan(counts, 512)
    plain = sum(n for _, n in packing.best_fit(counts, 512))
    assert sum(n for _, n in plan) <= plain and by in ("program", "best fit")
    held = collections.Counter()
    for pattern, copies in plan:
        assert sum(x * t for x, t in pattern.items()) <= 512
        for x, t in pattern.items():
            held[x] += t * copies
    assert held == counts
    if kind in ("uniform", "log-normal"):
        share, gap = (0.85, 1.006) if kind == "uniform" else (0.95, 1.001)
        assert sum(x * n for x, n in covered.items()) > share * sum(sizes)
        assert sum(n for _, n in plan) <= gap * low + 1


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(0)
    for sizes in (rng.integers(1, 2049, 60_000), np.clip(rng.lognormal(5.5, 0.9, 60_000).astype(int), 1, 2048)):
        counts = dict(collections.Counter(sizes.tolist()))
        low = packing.fractional(counts, 2048)[1]
        assert sum(n for _, n in packing.plan(counts, 2048)[0]) <= min(1.002 * low, sum(n for _, n in packing.best_fit(counts, 2048)))


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.vocabulary_path())
    got = {r.doc_id: r for r in tokens.token_counts(docs).collect()}
    for i, t in enumerate(texts()):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 512)
    assert tokens.token_counts(empty).count() == 0


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_jaccard(docs, empty, words, percent):
    sets = []
    for t in texts():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(words, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    low = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((low[i], low[j]))
                low = [x if v == y else v for v in low]
    got = {r.doc_id: r for r in ngram_join.jaccard_classes(docs, words=words, percent=percent).collect()}
    assert {i: (got[i].n_shingles, got[i].component_id) for i in range(len(sets))} == {i: (len(s), low[i]) for i, s in enumerate(sets)}
    assert got[None].component_id is None
    assert ngram_join.jaccard_classes(empty).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([base, base + 0.05 * rng.standard_normal(base.shape), base[:5], rng.standard_normal((200, 16))])
    labels = rng.integers(0, 3, len(x)).tolist()
    labels[40:85] = [*labels[:40], *labels[:5]]
    rows = [(i, v.tolist(), str(k)) for i, (v, k) in enumerate(zip(x, labels, strict=True))]
    odd = [(900, None, "0"), (901, [0.0] * 16, "0"), (902, [float("nan")] * 16, "0"), (903, base[0].tolist(), None), (904, [], "0"), (905, [1.0, None], "0")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label string")
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (n @ n.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels))
    np.fill_diagonal(link, False)
    got = {r.vec_id: r for r in vector_dedup.near_vectors(df, leaf=16, block=20).collect()}
    found, true = sum(got[i].n_links for i in range(len(x))), int(link.sum())
    assert true > 60 and 0.97 * true <= found <= true
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, *_ in odd)
    assert vector_dedup.near_vectors(df.limit(0)).count() == 0


def test_vectors_row_by_row(spark):
    """A large group of near vectors in many small leaves: links are counted once each, and components are whole."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 64))
    x = np.concatenate([base, base, base[:1] + 0.08 * rng.standard_normal((120, 64))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.98
    np.fill_diagonal(link, False)
    low = np.arange(len(x))
    for _ in x:
        low = np.minimum(low, np.where(link, low, len(x)).min(axis=1))
    df = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: r for r in vector_dedup.near_vectors(df, leaf=16, block=20).collect()}
    right = [got[i].n_links == n for i, n in enumerate(link.sum(axis=1).tolist())]
    assert all(got[i].n_links <= n for i, n in enumerate(link.sum(axis=1).tolist()))
    assert sum(right) >= 0.95 * len(x)
    assert [got[i].component_id for i in range(len(x))] == low.tolist()


def test_line_dedup(spark):
    common = "A line that many documents share, long enough"
    rows = [(i, f"{common.upper() if i % 2 else common} \nown line {i} of this one document, long enough too\n") for i in range(8)] + [(20, None), (21, ""), (22, common + "\n" + common), (None, common)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bits = line_dedup.line_dedup(df)
    got = {r.doc_id: r for r in line_dedup.apply_bitmaps(df, bits).collect()}
    for i in range(8):
        assert (got[i].n_lines, got[i].n_dropped, got[i].text) == (3, 1, f"own line {i} of this one document, long enough too\n")
    assert (got[20].n_lines, got[20].text, got[21].n_lines) == (1, "", 1)
    assert got[22].n_dropped == 0 and got[None].n_dropped == 0
    assert line_dedup.line_dedup(df.limit(0)).count() == 0
    r = spark.createDataFrame([([2, 4, 7, 8],), ([0, 1],), ([],), ([0, 9],)], "k array<int>").withColumn("l", F.array(*map(F.lit, "abcdefghi")))
    assert [x[0] for x in r.select(F.array_join(line_dedup.kept_slices(F.col("k"), F.col("l")), "")).collect()] == ["abefgi", "bcdefghi", "abcdefghi", ""]


def test_line_dedup_of_a_very_long_text(spark):
    """Linear: 100,000 lines, every second one dropped."""
    shared = [f"line {i} that several documents hold, of forty characters or more" for i in range(50_000)]
    long = "\n".join(x for i, s in enumerate(shared) for x in (s, f"own {i}"))
    df = spark.createDataFrame([(0, long, 5, "x"), *((i, "\n".join(shared), 5, "x") for i in range(1, 6))], "doc_id long, text string, n_lines int, keep string")
    got = {r.doc_id: r for r in line_dedup.apply_bitmaps(df, line_dedup.line_dedup(df)).collect()}
    assert (got[0].n_lines, got[0].n_dropped, got[0].keep) == (100_000, 50_000, "x")
    assert got[0].text == "\n".join(f"own {i}" for i in range(50_000)) and got[1].text == "" and got[5].n_dropped == 0


def test_language_id(spark, docs, empty):
    out = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = [r for r in out.collect() if r.held_out]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.98
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 3, 11)] == ["und"] * 5
    assert all(0 <= r["score"] <= 1 for r in got.values()) and set(docs.columns) - {"score"} < set(got[5].asDict())
    assert language_id.fit(empty) is None and language_id.predict(empty, None).count() == 0


def test_segmentations(docs, empty):
    got = segmentations.decode(segmentations.sample_segmentations(docs, k=3)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, t in enumerate(texts()):
        rows = sorted(by[i], key=lambda r: r["sample"])
        assert len({bytes(r.ids) for r in rows}) == len(rows) >= 1
        assert all(r.text == (t or "") and r.text_crc32 == zlib.crc32((t or "").encode()) for r in rows)
        assert [r.perturbed for r in rows] == sorted([r.perturbed for r in rows], reverse=True)
        assert all(0 <= r.inclusion <= 1 for r in rows)
    again = segmentations.sample_segmentations(docs.repartition(2), k=3)
    assert {(r.doc_id, r["sample"], bytes(r.ids)) for r in again.collect()} == {(r.doc_id, r["sample"], bytes(r.ids)) for r in got}
    assert segmentations.sample_segmentations(empty).count() == 0


def test_segmentations_follow_the_lattice():
    import itertools
    import math

    v = segmentations.Vocabulary(segmentations.model_path(None), 0.0005)

    def ways(w):
        if not w:
            yield (), 0.0
        for n in range(1, min(len(w), v.longest) + 1):
            i = v.sp.piece_to_id(w[:n])
            if v.sp.id_to_piece(i) == w[:n]:
                for a, b in ways(w[n:]):
                    yield (i, *a), b + v.weight[i]

    parts = segmentations._WORD.findall(v.sp.normalize("the cat"))
    logs = {np.array(sum((a for a, _ in c), ()), "<u4").tobytes(): sum(b for _, b in c) for c in itertools.product(*[list(ways(w)) for w in parts])}
    z = np.logaddexp.reduce(list(logs.values()))
    p = {k: math.exp(x - z) for k, x in logs.items()}
    n = 6000
    rows = segmentations.top_k(["the cat"] * n, list(range(n)), v, 2, 5)
    pairs = collections.Counter((r[0][0].tobytes(), r[1][0].tobytes()) for r in rows)
    for (a, b), count in pairs.items():
        want = p[a] * p[b] / (1 - p[a])
        assert abs(count / n - want) < 5 * math.sqrt(want / n) + 1e-3
    # A segmentation's share of the samples, each weighed by its inclusion, is its own: the mean of 1 / inclusion over rows is 1.
    weight = collections.Counter()
    for r in rows:
        for x in r:
            weight[x[0].tobytes()] += 1 / x[3]
    for x in (x for x in p if p[x] > 0.01):
        assert abs(weight[x] / n - 1) < 0.15


def test_plain_encoding(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=segmentations.model_path(None))
    got = {r.doc_id: r for r in segmentations.decode(segmentations.encode(docs.withColumn("ids", F.lit(1))), text_col="back").collect()}
    for i, t in enumerate(texts()):
        assert got[i].back == t and (t is None) == (got[i].ids is None)
        if t is not None:
            assert np.frombuffer(got[i].ids, "<u4").tolist() == sp.encode(t)
    assert segmentations.encode(empty).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {i: t for i, t in rows.items() if t and re.search(r"[^\W\d_]", t)}
    first: dict = {}
    for i in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[i]), i)
    kept = {i: rows[i] for i in first.values()}
    sets = {}
    for i, t in kept.items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t).split()
        k = min(5, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    low = {i: i for i in sets}
    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((low[i], low[j]))
                low = {k: a if v == b else v for k, v in low.items()}
    want = {i for i in ids if low[i] == i}
    out = P.run(spark, SF)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == want
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0

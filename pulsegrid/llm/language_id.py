"""Language ID by hierarchical discrimination: the family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import tokens

#: Families of some languages (ISO 639-1), fixed values; a language not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "pl", "cs", "sk", "uk", "bg", "sr", "hr"),
}


def family(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def lowered(data: bytes) -> np.ndarray:
    """The bytes with A-Z lower-cased and everything up to the blank, digits and ASCII marks as a blank."""
    return _FOLD[np.frombuffer(data, dtype=np.uint8)]


_FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], dtype=np.uint8)
_FOLD[65:91] += 32


def gram_codes(flat: np.ndarray, bits: int) -> np.ndarray:
    """At each byte but the last three, the hashes of the byte 2-, 3- and 4-gram that begin there: (n, 3), below 2**bits."""
    x = flat.astype(np.uint32)
    two = x[:-3] << np.uint32(8) | x[1:-2]
    three = two << np.uint32(8) | x[2:-1]
    four = three << np.uint32(8) | x[3:]
    shift = np.uint32(32 - bits)
    return np.stack([(g * np.uint32(m)) >> shift for g, m in ((two, 2654435761), (three ^ np.uint32(0x5BD1E995), 2246822519), (four, 3266489917))], axis=1)


def features(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams of the whole text and their shares."""
    codes = gram_codes(lowered(b"  " + text.encode() + b"  "), bits).ravel()
    at, n = np.unique(codes, return_counts=True)
    return at.astype(np.int32), (n / n.sum()).astype(np.float32)


def linear_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dims: int, cost: float = 10.0, sweeps: int = 12, seed: int = 1) -> np.ndarray:
    """Weights (the last is the bias) of an L2-regularised hinge-loss SVM, by dual coordinate descent."""
    w = np.zeros(dims + 1)
    alpha = np.zeros(len(rows))
    scale = 30.0  # shares are small; the features are multiplied by it
    norm = np.array([scale**2 * float(v @ v) + 1.0 for _, v in rows])
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * cost
    rng = np.random.default_rng(seed)
    for _ in range(sweeps):
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            g = y[i] * (scale * float(w[at] @ v) + w[-1]) - 1.0
            new = min(max(alpha[i] - g / norm[i], 0.0), weight[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * scale * v
                w[-1] += step
                alpha[i] = new
    w[:-1] *= scale
    return w


@dataclass
class Model:
    bits: int
    langs: list[str]
    families: list[str]
    #: Columns: one against the rest for each family, then one for each pair of languages within a family.
    weights: np.ndarray
    bias: np.ndarray
    pairs: list[tuple[str, str]] = field(default_factory=list)

    def margins(self, texts: list[str]) -> np.ndarray:
        """The mean weight of each text's n-grams, plus bias; blocks of text at a time, so that memory is bounded."""
        out = np.zeros((len(texts), self.weights.shape[1]))
        for i, t in enumerate(texts):
            data = lowered(b"  " + t.encode() + b"  ")
            total, n = np.zeros(self.weights.shape[1]), 0
            for k in range(0, len(data) - 3, 1 << 20):
                codes = gram_codes(data[k : k + (1 << 20) + 3], self.bits).ravel()
                counts = np.bincount(codes, minlength=1 << self.bits) if len(codes) > 1 << (self.bits - 1) else None
                total += counts @ self.weights if counts is not None else self.weights.take(codes, axis=0).sum(axis=0, dtype=np.float64)
                n += len(codes)
            out[i] = total / n + self.bias
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        m = self.margins(texts)
        k = len(self.families)
        best = np.argmax(m[:, :k], axis=1) if k else np.zeros(len(texts), dtype=int)
        langs, scores = [], []
        members = {f: [x for x in self.langs if family(x) == f] for f in self.families}
        at = {p: k + i for i, p in enumerate(self.pairs)}
        for i, f in enumerate(best):
            name = self.families[f]
            sure = 1.0 if k == 1 else 1 / (1 + np.exp(-2 * m[i, f]))
            votes = {x: [0, 0.0] for x in members[name]}
            for a, b in combinations(members[name], 2):
                z = m[i, at[a, b]]
                votes[a if z >= 0 else b][0] += 1
                votes[a][1] += z
                votes[b][1] -= z
            lang = max(votes, key=lambda x: (votes[x][0], votes[x][1]))
            others = len(votes) - 1
            if others:
                sure *= 1 / (1 + np.exp(-2 * votes[lang][1] / others))
            langs.append(lang)
            scores.append(float(min(max(sure, 0.0), 1.0)))
        return langs, scores


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int, bits: int) -> list:
    """Of each language near `per_lang` distinct labelled pairs of id and text, chosen by a hash of both over all rows, as n-gram shares:
    (lang, at, share).

    The pairs are counted first and each language gets its own threshold on the hash, so no language is gathered or sorted, null and
    repeated ids are as good as others, and copies of a row count once. No labelled text gives an empty list."""
    key = F.xxhash64(F.lit(11), F.col(id_col), F.col(text_col))
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t"), key.alias("key"))
    counts = rows.select("lang", "key").distinct().groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return []
    shares = docs.sparkSession.createDataFrame([(r[0], min(1.0, per_lang / r[1])) for r in counts], "lang string, part double")
    dice = F.pmod(F.xxhash64(F.lit(12), "key"), F.lit(1 << 30)) / float(1 << 30)

    def vectors(batches):
        tokens.release()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                got = [features(t, bits) for t in b.column(1)[i : i + 256].to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0)[i : i + 256], pa.array([x.tobytes() for x, _ in got], pa.binary()), pa.array([x.tobytes() for _, x in got], pa.binary()), b.column(2)[i : i + 256]], ["lang", "at", "share", "key"])

    picked = rows.join(F.broadcast(shares), "lang").where(dice < F.col("part")).select("lang", "t", "key").distinct()
    got = picked.mapInArrow(vectors, "lang string, at binary, share binary, key long").collect()
    return [(r.lang, np.frombuffer(r["at"], dtype=np.int32), np.frombuffer(r["share"], dtype=np.float32)) for r in sorted(got, key=lambda r: (r.lang, r.key))]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 800, bits: int = 16) -> Model | None:
    """Learns from text and non-null lang of docs. The sample's bound is `per_lang` rows a language; None without labelled text."""
    rows = sample(docs, id_col, text_col, lang_col, per_lang, bits)
    langs = sorted({r[0] for r in rows})
    if not langs:
        return None
    families = sorted({family(x) for x in langs})
    tasks: list[tuple[list, np.ndarray]] = []
    if len(families) > 1:
        for f in families:
            tasks.append(([r[1:] for r in rows], np.array([1.0 if family(r[0]) == f else -1.0 for r in rows])))
    else:
        tasks.append(([], np.zeros(0)))
    pairs = [p for f in families for p in combinations([x for x in langs if family(x) == f], 2)]
    for a, b in pairs:
        own = [r for r in rows if r[0] in (a, b)]
        tasks.append(([r[1:] for r in own], np.array([1.0 if r[0] == a else -1.0 for r in own])))
    w = np.stack([linear_svm(x, y, 1 << bits) for x, y in tasks], axis=1)
    return Model(bits, langs, families, np.ascontiguousarray(w[:-1], dtype=np.float32), w[-1], pairs)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1): the text's whole bytes are scored; only the text is an input.

    Null texts and texts without a letter are `und` with score 0, as is every text if there is no model. All other columns are
    kept; of clashing names lang_pred and score are replaced. No shuffle; the model's size is (families + pairs) x 2**bits floats.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.withColumn("__t", F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)))
    names = docs.columns

    def run(batches):
        tokens.release()
        m = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                texts = part.column(part.num_columns - 1).to_pylist()
                live = [k for k, t in enumerate(texts) if t is not None and m is not None]
                langs, scores = ["und"] * len(texts), [0.0] * len(texts)
                if live:
                    for k, x, s in zip(live, *m.predict([texts[k] for k in live]), strict=True):
                        langs[k], scores[k] = x, s
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double")

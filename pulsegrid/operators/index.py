"""A positional inverted index kept as Parquet: built, appended to by batches, compacted; phrases are found by meeting positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegrid.functions.numeric import r
from pulsegrid.functions.text import ascii_lower, let
from pulsegrid.operators.steps import forget, saved


def tokens(columns: list[str]) -> Column:
    """Runs of letters a-z (in any case) and digits over the columns in turn."""
    return F.filter(F.split(ascii_lower(F.concat_ws(" ", *columns)), "[^a-z0-9]+"), lambda w: w != "")


def terms_of(phrase: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in phrase.lower()).split()


def _back(positions: str, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


class PhraseIndex:
    """Postings (bucket, term, id, positions) and lengths (id, len) below a folder, in generations.

    A term's bucket is a hash of it, and a bucket is a folder, so a phrase reads the buckets of its terms only, and within
    them, for files are sorted by term, the row groups that hold these. Rows of one bucket are written by several tasks, dealt
    by a hash of the id, so a term that is in every document is no task's own burden. build() and compact() write a new generation
    and readers take the newest that is whole; append() adds files to it. Postings hold one row for each term and document; a document's
    positions of a term are one array, as long as the document at most.
    """

    def __init__(self, spark: SparkSession, path: str, columns: list[str], id_col: str = "id", buckets: int = 64, parts: int = 4) -> None:
        self.spark, self.path, self.columns, self.id_col, self.buckets, self.parts = spark, path.rstrip("/"), columns, id_col, buckets, parts

    def _generations(self) -> list[int]:
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        whole = [n for n in names if n.startswith("g") and all(fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/{t}/_SUCCESS")) for t in ("postings", "lengths"))]
        return sorted(int(n[1:]) for n in whole)

    def _place(self, generation: int, table: str) -> str:
        return f"{self.path}/g{generation:06d}/{table}"

    @property
    def generation(self) -> int:
        found = self._generations()
        if not found:
            raise FileNotFoundError(f"no index below {self.path}: call build() first")
        return found[-1]

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self._place(self.generation, table))

    def _save(self, postings: DataFrame, lengths: DataFrame, generation: int, mode: str, repeated: bool = False) -> None:
        """The lengths come last: a document counts as indexed only when its postings are there. With `repeated`, of rows with one term
        and id one is written; they are in one partition and side by side in it already."""
        dealt = postings.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(self.parts))).repartition(self.buckets * self.parts, "bucket", "part")
        if repeated:
            same = W.partitionBy("bucket", "term", "id", "part").orderBy(F.lit(0))
            dealt = dealt.withColumn("__n", F.row_number().over(same)).where(F.col("__n") == 1).drop("__n")
        dealt.sortWithinPartitions("bucket", "term", "id").drop("part").write.mode(mode).partitionBy("bucket").parquet(self._place(generation, "postings"))
        lengths.write.mode(mode).parquet(self._place(generation, "lengths"))

    def _entries(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """A document's words are sorted with their places, and each run of a word is cut out: its postings need no shuffle."""
        rows = docs.select(F.col(self.id_col).alias("id"), tokens(self.columns).alias("w"))

        def cut(s: Column) -> Column:
            begins = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x["term"] != F.get(s, i - 1)["term"]), i).otherwise(-1)), lambda i: i >= 0)
            return let(begins, lambda b: F.transform(b, lambda i, k: F.struct(F.get(s, i)["term"].alias("term"), F.slice(s, i + 1, F.coalesce(F.get(b, k + 1), F.size(s)) - i)["at"].alias("positions"))))

        pairs = F.sort_array(F.transform("w", lambda w, i: F.struct(w.alias("term"), i.alias("at"))))
        postings = rows.select("id", F.inline(let(pairs, cut)))
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")
        return postings.select("term", "id", "positions", bucket.alias("bucket")), rows.select("id", F.size("w").alias("len"))

    def build(self, docs: DataFrame) -> None:
        """A new generation of these documents alone: what was changed or deleted since is as it is in docs. Ids must be distinct."""
        found = self._generations()
        self._save(*self._entries(docs), found[-1] + 1 if found else 0, "overwrite")

    def append(self, docs: DataFrame) -> None:
        """Adds the documents that are not in the index yet; a batch that is given again adds nothing. Only ids meet the index; texts are
        joined, by the ids that are new, if some of the batch are and some aren't."""
        ids = docs.select(F.col(self.id_col).alias("__id"))
        fresh = saved(ids.join(self._read("lengths").select(F.col("id").alias("__id")), "__id", "left_anti"), "fresh")
        n = fresh.count()
        if n:
            new = docs if n == ids.count() else docs.join(fresh.distinct(), F.col(self.id_col) == F.col("__id"), "left_semi")
            self._save(*self._entries(new), self.generation, "append")
        forget(fresh)

    def compact(self) -> None:
        """A new generation with the same rows in as few files as build() writes. A batch that died between its postings and its
        lengths leaves postings without a length: they go, so that its repetition counts once."""
        lengths, postings = self._read("lengths"), self._read("postings")
        lost = saved(postings.select("id").distinct().join(lengths, "id", "left_anti"), "lost")
        if not lost.isEmpty():
            postings = postings.join(lost, "id", "left_anti")
        self._save(postings.select("term", "id", "positions", "bucket"), lengths, self.generation + 1, "overwrite", True)
        forget(lost)

    def vacuum(self) -> None:
        """Deletes all generations but the newest; not while others read them."""
        for g in self._generations()[:-1]:
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/g{g:06d}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def postings(self, words: list[str]) -> DataFrame:
        """Rows of these terms, from their buckets, with repeated ones; the buckets are literals, so that the scan is pruned."""
        rows = self.spark.range(1).select(*[F.pmod(F.xxhash64(F.lit(w)), F.lit(self.buckets)).cast("int") for w in words]).first()
        return self._read("postings").where(F.col("bucket").isin(sorted(set(rows))) & F.col("term").isin(words))

    def occurrences(self, phrase: str) -> DataFrame:
        """(id, f, len): the documents that hold the phrase and how often, without overlap, counted from the front.

        The postings of the distinct terms are joined on the id, the rarest first; a start is a position p of the first word with
        the i-th word at p + i for each i. A phrase without a term finds nothing."""
        words = terms_of(phrase)
        lengths = self._read("lengths").dropDuplicates(["id"])
        if not words:
            return lengths.select("id", F.lit(0).cast("long").alias("f"), "len").where(F.lit(False))
        rows = self.postings(sorted(set(words)))
        counts = {x.term: x.n for x in rows.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each word of the phrase
        rare = sorted(set(words), key=lambda w: (counts.get(w, 0), w))
        names = {w: f"p{i}" for i, w in enumerate(rare)}
        joined = reduce(lambda a, b: a.join(b, "id"), [rows.where(F.col("term") == w).dropDuplicates(["id"]).select("id", F.col("positions").alias(names[w])) for w in rare])
        shifted = [_back(names[w], i) for i, w in enumerate(words)]
        starts = F.array_sort(reduce(F.array_intersect, shifted))
        n = len(words)
        # The last start that counted, and how many did; -n is before any.
        first = F.struct(F.lit(-n).alias("last"), F.lit(0).cast("long").alias("f"))
        count = F.aggregate(starts, first, lambda s, p: F.when(p >= s["last"] + n, F.struct(p.alias("last"), (s["f"] + 1).alias("f"))).otherwise(s))["f"]
        return joined.select("id", count.alias("f")).where("f > 0").join(lengths, "id").select("id", "f", "len")

    def search(self, phrase: str, limit: int = 50, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """The documents that hold the phrase, best first by BM25 with the phrase as its one term; texts are not read.

        A weight of a phrase that is in most documents is held at 1e-6; documents without a token count in the averages."""
        seen = self.occurrences(phrase)
        total = self._read("lengths").dropDuplicates(["id"]).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))
        hits = seen.agg(F.count(F.lit(1)).alias("hits"))
        idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col("hits") + 0.5) / (F.col("hits") + 0.5)))
        score = idf * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
        out = seen.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(hits))
        return out.select(F.col("id").alias(self.id_col), r(score, 6).alias("score")).orderBy(F.desc("score"), self.id_col).limit(limit)
